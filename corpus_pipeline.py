"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; what it returns is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import new_folder
from lorekeep.llm.decontam import clean_documents
from lorekeep.llm.jaccard_join import one_of_each
from lorekeep.llm.line_dedup import dedup_lines
from lorekeep.llm.mixing import mixed_documents
from lorekeep.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't predict toxic. Learnt from the labels of these documents."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of lines; a document goes if all its lines are such repeats. n_chars follows the text."""
    d = dedup_lines(docs, report_col="__report").where("__report.n_removed < __report.n_lines")
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("__report.n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        d = d.withColumn("n_chars", n_chars)
    return d.drop("__report")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of the least id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with their size, their source's size and target, and the words taken of each.

    A column of docs by the name of one of these gives way to it.
    """
    d = mixed_documents(docs, mix_col="__mix")
    mix = d.schema["__mix"].dataType.fieldNames()
    return d.select(*[f"`{c}`" for c in docs.columns if c.lower() not in mix], "__mix.*")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

#: The classifier can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix made of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
