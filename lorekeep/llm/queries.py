"""The thin queries op1 to op10 over the text tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    """Where this machine keeps the vocabulary of op7; never copied here."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.chat import canonical_turns

    # the roles are recovered from the texts alone; a test holds them against the column
    return canonical_turns(table(spark, sf_dir, "conversations"), role_col=None)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.suffix_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).drop("kept", "spans")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.ngram_lm import scores

    return scores(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.line_dedup import dedup_lines

    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "line_report.*", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "matches")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.bpe_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copies", "n_links")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorekeep.llm.media import text_media

    return text_media(table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def llm_oracle_sql() -> dict[str, str]:
    from lorekeep.llm.decontam import contamination_sql
    from lorekeep.llm.jaccard_join import pairs_sql
    from lorekeep.llm.line_dedup import lines_sql
    from lorekeep.llm.mixing import mix_sql

    return {
        "op4_line_dedup": f"WITH {lines_sql()} SELECT doc_id, n_lines, n_removed, n_runs, sha256(text) AS kept_sha256 FROM lines_out",
        "op5_source_mixing": mix_sql(),
        "op6_benchmark_decontamination": contamination_sql(),
        "op8_ngram_jaccard_join": pairs_sql(),
    }
