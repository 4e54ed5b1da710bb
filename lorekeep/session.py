"""What a Spark session needs so that its Python workers can import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def workers_import(spark: SparkSession) -> None:
    """Adds this checkout to the Python workers' path. On a cluster without a shared checkout, ship it with --py-files."""
    here = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in (here, *paths) if p)
