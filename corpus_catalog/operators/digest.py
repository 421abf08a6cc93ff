"""Fingerprints of a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpus_catalog.functions import text as X
from corpus_catalog.functions.json_text import json_string

#: Hex digits of a path's SHA-256 that name its block.
BLOCK_DIGITS = 4
_ENTRIES = "concat('[', listagg(entry, ', ') within group (order by path, source_hash), ']')"


def _entries(files: DataFrame) -> DataFrame:
    return files.select(
        "repo",
        "path",
        "source_hash",
        F.concat(
            F.lit("["),
            json_string(F.col("ignore_mode")),
            F.lit(", "),
            json_string(F.col("path")),
            F.lit(", "),
            json_string(F.col("source_hash")),
            F.lit("]"),
        ).alias("entry"),
    )


def scan_hash(files: DataFrame) -> DataFrame:
    """``(repo, ignore_mode, path, source_hash)`` to ``(repo, files, scan_hash)``.

    SHA-256 cannot be split, so a repo of any size is hashed in two levels. Files
    fall into blocks by the first ``BLOCK_DIGITS`` hex digits of their path's
    SHA-256. A block's digest is that of the JSON list of its sorted
    ``[mode, path, hash]`` triples; the repo's is taken over the digests of its
    blocks in order, cut to 16 characters.
    """
    return combined(block_digests(files))


def block_of(path: Column) -> Column:
    """Block that a path falls into."""
    return F.substring(F.sha2(path, 256), 1, BLOCK_DIGITS)


def block_digests(files: DataFrame) -> DataFrame:
    """``(repo, block, files, digest)``: what a digest is taken over, to be stored and kept up to date."""
    return (
        _entries(files)
        .withColumn("block", block_of(F.col("path")))
        .groupBy("repo", "block")
        .agg(F.count(F.lit(1)).alias("files"), F.sha2(F.expr(_ENTRIES), 256).alias("digest"))
    )


def touched_blocks(changes: DataFrame) -> DataFrame:
    """``(repo, block)`` of all paths that a diff ``(repo, kind, old_path, new_path)`` names."""
    paths = changes.select("repo", F.explode(F.array("old_path", "new_path")).alias("path"))
    return paths.filter(F.col("path").isNotNull()).select("repo", block_of(F.col("path")).alias("block")).distinct()


def updated_blocks(blocks: DataFrame, files: DataFrame, touched: DataFrame) -> DataFrame:
    """``block_digests`` of the new snapshot ``files (repo, ignore_mode, path, source_hash)``; only touched blocks are hashed.

    ``touched`` is a stored table.  The mode belongs to a block's entries: of a repo whose mode changes
    all blocks, old and new, must be touched.
    """
    again = files.withColumn("block", block_of(F.col("path"))).join(touched, ["repo", "block"], "left_semi")
    kept = blocks.join(touched, ["repo", "block"], "left_anti")
    return kept.unionByName(block_digests(again.drop("block")))


def combined(blocks: DataFrame) -> DataFrame:
    """``(repo, files, scan_hash)`` of block digests."""
    top = F.expr("listagg(digest, ', ') within group (order by block)")
    return blocks.groupBy("repo").agg(F.sum("files").alias("files"), X.short_hash(top).alias("scan_hash"))


def listing_hash(files: DataFrame) -> DataFrame:
    """``(repo, files, scan_hash)`` in one level: SHA-256 of the whole sorted JSON list.

    One task takes all files of a repo; only for repos known to be small, and for
    comparison with digests taken elsewhere. Nothing here chooses it by size.
    """
    return _entries(files).groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"), X.short_hash(F.expr(_ENTRIES)).alias("scan_hash")
    )


def scan_hash_of(repos: DataFrame, files: DataFrame) -> DataFrame:
    """Digest of every given ``(repo, ignore_mode)``; without files, that of no blocks."""
    found = files.select("repo", "path", "source_hash").join(
        repos.select("repo", "ignore_mode"), "repo"
    )
    return (
        repos.select("repo", "ignore_mode")
        .join(scan_hash(found), "repo", "left")
        .select(
            "repo",
            "ignore_mode",
            F.coalesce("files", F.lit(0)).alias("files"),
            F.coalesce("scan_hash", X.short_hash(F.lit(""))).alias("scan_hash"),
        )
    )


def corpus_fingerprint(files: DataFrame) -> DataFrame:
    """One order-free fingerprint of a whole corpus, from partial sums modulo 2^60; repeated rows count."""
    row = F.sha2(F.concat_ws("\n", "repo", "path", "source_hash"), 256)
    # 15 hex digits fit a bigint.
    number = F.conv(F.substring(row, 1, 15), 16, 10).cast("bigint")
    total = F.coalesce(F.sum(number.cast("decimal(20,0)")), F.lit(0))
    return files.agg(
        F.count(F.lit(1)).alias("files"), (total % F.lit(2**60)).cast("bigint").alias("fingerprint")
    )
