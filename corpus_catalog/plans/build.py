"""A whole build, and what changed since the last one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpus_catalog import config as C
from corpus_catalog.operators import cache as K, diff as D
from corpus_catalog.operators.document import documents, token_budget
from corpus_catalog.operators.inventory import normalized
from corpus_catalog.operators.summarize import packed, summarize, unpacked
from corpus_catalog.sources.cache_table import CacheTable
from corpus_catalog.sources.tables import materialize


@dataclass
class Build:
    """Tables of one build; all are stored, none holds file contents."""

    summaries: DataFrame  # packed rows with cache_hit, staleness_reason, is_priority
    manifest: DataFrame  # repo, path, source_hash
    cache: DataFrame  # the new cache; of a stored one, what this build found in it and added


def contents_of(
    files: DataFrame,
    wanted: DataFrame,
    rows: int,
    limit: int = C.BROADCAST_ROWS,
    by: tuple[str, ...] = ("repo", "path"),
) -> DataFrame:
    """Files listed in ``wanted`` and perhaps some more, without shuffling contents.

    Callers join their results back on the exact keys, so a superset is fine.
    A counted list is broadcast as 64-bit hashes, whose size does not depend on
    the keys.  If it is too long, the repos it touches are; if those are too
    many, all files are returned: handling them where they lie costs less than
    moving their contents.
    """
    if rows > limit:
        wanted, by = wanted.select("repo").distinct(), ("repo",)
        if wanted.count() > limit:
            return files
    key = F.xxhash64(*by).alias("wanted_key")
    return (
        files.withColumn("wanted_key", key)
        .join(F.broadcast(wanted.select(key)), "wanted_key", "left_semi")
        .drop("wanted_key")
    )


def fill(
    files: DataFrame,
    inventory: DataFrame,
    cache: DataFrame | None,
    key: K.CacheKey,
    broadcast_rows: int = C.BROADCAST_ROWS,
) -> DataFrame:
    """Packed summaries of all inventory files: hits from the cache, misses computed.

    Without a cache the contents are read once.  With one, the lookup moves
    hashes only, and then the contents of the misses are read.
    """
    files, inventory = normalized(files), materialize(inventory, "inventory")
    listed = contents_of(files, inventory, inventory.count(), broadcast_rows)
    if cache is None:
        return inventory.withColumns(
            {"cache_hit": F.lit(False), "staleness_reason": F.lit("not_cached")}
        ).join(packed(summarize(listed)), ["repo", "path"])
    present = D.build_inputs(inventory, D.hashes(listed))
    found = materialize(
        K.lookup(present, cache, key).drop("is_stale", "approx_tokens"), "lookup"
    )
    hits, misses = found.filter("cache_hit"), found.filter(~F.col("cache_hit"))
    n_misses = misses.count()
    if n_misses == 0:
        return hits
    fresh = packed(summarize(contents_of(listed, misses, n_misses, broadcast_rows)))
    misses = misses.drop("source_hash", "summary")
    return hits.unionByName(misses.join(fresh, ["repo", "path"]))


def build(
    files: DataFrame,
    inventory: DataFrame,
    cache: DataFrame | CacheTable | None,
    key: K.CacheKey,
    built_at: Column,
) -> Build:
    """One build.  Of a stored cache only the buckets of the inventory's repos are read, and written if they change."""
    stored = cache if isinstance(cache, CacheTable) else None
    if stored is not None:
        inventory = materialize(inventory, "inventory")
        cache = stored.read(files.sparkSession, inventory.select("repo").distinct())
    filled = materialize(fill(files, inventory, cache, key), "summaries")
    fresh = filled.filter(~F.col("cache_hit")).select("repo", "path", "source_hash", "summary")
    new = K.entries(fresh, key, built_at)
    known = new if cache is None else K.upsert(cache, new)
    if stored is not None:
        known = materialize(known, "cache")  # before the table changes
        if not fresh.isEmpty():
            stored.upsert(new)
    return Build(
        summaries=filled,
        manifest=filled.select("repo", "path", "source_hash"),
        cache=known,
    )


def context_documents(built: Build, modes: DataFrame, part_bytes: int = C.PART_BYTES) -> DataFrame:
    """Markdown documents with their token estimate and warnings."""
    parts = materialize(documents(unpacked(built.summaries), modes, part_bytes), "documents")
    return parts.join(token_budget(parts), "repo")
