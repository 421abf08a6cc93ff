"""Proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked. Sorted by fractional
rank, (rank - 1/2) / rows of the source, every stretch of the order holds the
sources in their overall proportions; cutting it into equal stretches gives
shards whose counts are at most one apart and whose mixtures match.

No source is ranked in one task: hashes are uniform, so their leading bits cut a
source into even buckets, and fractions cut the whole order into even buckets
again. Ranks inside a bucket are added to what the buckets before it hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpus_catalog.llm.common import Work

#: Rows of a bucket, about.
BUCKET = 4096


def _ahead(counts: DataFrame, by: list[Column | str], order: str) -> DataFrame:
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))


def shard(
    docs: DataFrame,
    shards: int,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, size, text_crc32, source, shard, slot`` of every row.

    ``size`` is the UTF-8 bytes of the text plus 1, a null text counts as empty; slots are
    gapless from 0. Null or missing sources are a source of their own. Rows that agree in
    everything take neighbouring ranks, either way round. An empty table gives an
    empty one; other columns aren't read.
    """
    source = F.col(source_col).cast("string") if source_col in docs.columns else F.lit(None).cast("string")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    with Work(docs.sparkSession, "shards") as work:
        rows = work.store(
            docs.select(
                F.col(id_col).alias("doc_id"),
                source.alias("source"),
                (F.octet_length(body) + 1).cast("long").alias("size"),
                F.crc32(body).alias("text_crc32"),
            ).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")),
            "rows",
        )
        total = rows.count()
        bits = max(0, (total // BUCKET).bit_length())
        keyed = rows.withColumn("stratum", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))).withColumn(
            "bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
        )
        counts = work.store(keyed.groupBy("stratum", "bucket").agg(F.count("*").alias("n")), "counts")
        ahead = work.store(
            _ahead(counts, ["stratum"], "bucket")
            .withColumn("all", F.sum("n").over(Window.partitionBy("stratum"))).drop("n"),
            "ahead",
        )
        order = Window.partitionBy("stratum", "bucket").orderBy("h", "doc_id", "text_crc32", "size")
        ranked = keyed.withColumn("rank", F.row_number().over(order)).join(ahead, ["stratum", "bucket"])
        fraction = (2 * (F.col("rank") + F.col("ahead")) - 1) / (2 * F.col("all"))
        parts = 1 << bits
        placed = work.keep(
            ranked.select("doc_id", "source", "stratum", "size", "text_crc32", "h", fraction.alias("fraction"))
            .withColumn("part", F.floor(F.col("fraction") * parts)),
            "fractions",
        )
        # One row per bucket, a few thousandths of the rows.
        parts_ahead = work.keep(
            _ahead(placed.groupBy("part").agg(F.count("*").alias("n")), [F.lit(0)], "part").drop("n"), "parts"
        )
    order = Window.partitionBy("part").orderBy("fraction", "stratum", "h", "doc_id", "text_crc32", "size")
    position = placed.withColumn("rank", F.row_number().over(order)).join(parts_ahead, "part")
    position = position.withColumn("at", (F.col("rank") + F.col("ahead") - 1).cast("long"))
    cut = position.withColumn("shard", F.expr(f"cast(at * {shards} div {max(total, 1)} as int)"))
    # A shard begins at the first position that falls into it.
    first = F.expr(f"(cast(shard as long) * {max(total, 1)} + {shards - 1}) div {shards}")
    return cut.select("doc_id", "size", "text_crc32", "source", "shard", (F.col("at") - first).alias("slot"))
