"""Which files a document shows in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpus_catalog import config as C
from corpus_catalog.functions import text as X
from corpus_catalog.operators.ordering import row_numbers


def score(path: Column, role: Column, entrypoints: Column, is_priority: Column) -> Column:
    name = F.lower(X.file_name(path))

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    return (
        points(role == "entrypoint", 10)
        + points(role == "config", 5)
        + points(role == "docs", 3)
        + points(X.any_of([name.contains(part) for part in C.KEY_FILE_NAMES]), 3)
        + points(is_priority, 2)
        + points(F.exists(entrypoints, lambda e: e["confidence"] > C.HIGH_CONFIDENCE), 1)
    )


def scored(summaries: DataFrame) -> DataFrame:
    """Add score and is_key; needs is_priority from the inventory."""
    value = score(F.col("path"), F.col("role"), F.col("entrypoints"), F.col("is_priority"))
    return summaries.withColumn("score", value).withColumn(
        "is_key", F.col("score") >= C.KEY_FILE_SCORE
    )


def key_files(scored_rows: DataFrame, limit: int = C.WINDOW_ROWS) -> DataFrame:
    """Key files with their rank: best score first, then path."""
    keys = scored_rows.filter("is_key")
    ranked = row_numbers(keys, ["repo"], [F.desc("score"), F.asc("path")], limit)
    return ranked.withColumnRenamed("row_no", "rank")


def other_files(scored_rows: DataFrame) -> DataFrame:
    """Remaining files with the start of their summary."""
    return scored_rows.filter(~F.col("is_key")).select(
        "repo", "path", "role", X.cell(F.col("summary")).alias("summary")
    )
