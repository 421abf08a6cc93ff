"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the one before kept and
is written as Parquet. All but the last return the columns of ``documents``. They decide
on rows, not on ids: ids may be null, or be those of several texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpus_catalog.llm import decontaminate, near_dups, packing, quality, substrings
from corpus_catalog.llm.common import Work, documents, free_name, short_row_key
from corpus_catalog.sources import tables


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the key of each row, and the name of its column."""
    name = free_name(docs, "row_key")
    return docs.withColumn(name, short_row_key(docs)), name


def _without(keyed: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """Rows whose keys are not in the first column of ``gone``, without the key."""
    gone = gone.select(F.col(gone.columns[0]).alias(name)).distinct()
    return keyed.join(gone, name, "left_anti").drop(name)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each judged by itself."""
    keyed, name = _keyed(docs)
    return _without(keyed, name, quality.quality(keyed, name).filter(~F.col("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (similarity 0.8 or more), of the smallest id, without one only if
    none has any. Of equal rows one stays."""
    keyed, name = _keyed(docs)
    with Work(spark, "near-duplicates") as work:
        found = near_dups.near_duplicates(keyed, name)
        gone = work.keep(found.filter(~F.col("kept")).select("doc_id").distinct(), "gone")
        several = work.keep(found.filter("kept").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "several")
    if several.isEmpty():
        return _without(keyed, name, gone)
    # Dealt out again, so that copies of one row are combined per task before they meet.
    repeated = (
        keyed.join(several, keyed[name] == several.doc_id, "left_semi").select(*docs.columns)
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).dropDuplicates()
    )
    return _without(keyed, name, gone.union(several)).union(repeated)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document, or an earlier place, has already."""
    keyed, name = _keyed(docs)
    return substrings.without_repeats(keyed, substrings.repeated_paragraphs(keyed, name), name).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    keyed, name = _keyed(docs)
    return _without(keyed, name, decontaminate.leaks(keyed, documents(spark, sf_dir, "benchmark"), name))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Robust estimates, components and token ids have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = tables.new_path(spark, f"pipeline-{name}-{uuid.uuid4().hex[:8]}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
