"""Content-addressed summary cache: lookup, upsert, statistics."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpus_catalog import config as C
from corpus_catalog.functions import text as X
from corpus_catalog.schemas import SUMMARY


@dataclass(frozen=True)
class CacheKey:
    """The parts of the key that are equal for a whole run."""

    prompt_hash: str
    backend_id: str = C.BACKEND_ID
    tool_version: str = C.TOOL_VERSION


def staleness(key: CacheKey, source_hash: Column, entry_hash: Column) -> Column:
    """First difference between an entry and the wanted key; null if none."""
    return (
        F.when(entry_hash.isNull(), "not_cached")
        .when(entry_hash != source_hash, "source_changed")
        .when(F.col("prompt_hash") != key.prompt_hash, "prompt_changed")
        .when(F.col("backend_id") != key.backend_id, "backend_changed")
        .when(F.col("tool_version") != key.tool_version, "tool_changed")
    )


def lookup(current: DataFrame, cache: DataFrame, key: CacheKey) -> DataFrame:
    """Left join of ``(repo, path, source_hash)`` with the cache, hashes only.

    Adds cache_hit, is_stale, staleness_reason, and for hits the summary and
    approx_tokens of the entry.
    """
    entries = cache.withColumnRenamed("source_hash", "entry_hash").select(
        "repo",
        "path",
        "entry_hash",
        "prompt_hash",
        "backend_id",
        "tool_version",
        "summary",
        "approx_tokens",
    )
    reason = staleness(key, F.col("source_hash"), F.col("entry_hash"))
    hit = F.col("staleness_reason").isNull()
    return (
        current.join(entries, ["repo", "path"], "left")
        .withColumn("staleness_reason", reason)
        .select(
            *[current[c] for c in current.columns],
            hit.alias("cache_hit"),
            (~hit).alias("is_stale"),
            "staleness_reason",
            F.when(hit, F.col("summary")).alias("summary"),
            F.when(hit, F.col("approx_tokens")).alias("approx_tokens"),
        )
    )


def entries(packed: DataFrame, key: CacheKey, built_at: Column) -> DataFrame:
    """Cache rows for freshly summarised files."""
    # A quarter of the summary's characters, written as a Python dictionary.
    chars = X.display_length(F.col("summary"), SUMMARY)
    tokens = F.floor(chars / C.CHARS_PER_TOKEN).cast("bigint")
    return packed.select(
        "repo",
        "path",
        "source_hash",
        F.lit(key.prompt_hash).alias("prompt_hash"),
        F.lit(key.backend_id).alias("backend_id"),
        F.lit(key.tool_version).alias("tool_version"),
        "summary",
        built_at.cast("timestamp").alias("ts"),
        tokens.alias("approx_tokens"),
    )


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """One entry per path; new entries replace old ones."""
    kept = cache.join(new.select("repo", "path"), ["repo", "path"], "left_anti")
    return kept.unionByName(new)


def latest(versions: DataFrame, order: list[str] = ["ts"]) -> DataFrame:
    """Latest version per path; combined per task before the shuffle."""
    columns = versions.columns
    whole = F.struct(*columns)
    rank = F.struct(*order)
    return (
        versions.groupBy("repo", "path").agg(F.max_by(whole, rank).alias("row")).select("row.*")
    )


def evict_deleted(cache: DataFrame, inventory: DataFrame) -> DataFrame:
    """Drop entries of files that are gone."""
    return cache.join(inventory, ["repo", "path"], "left_semi")


def stats(looked_up: DataFrame) -> DataFrame:
    """Hits, misses, tokens saved and hit rate per repo."""
    hits, total = F.col("hits"), F.col("hits") + F.col("misses")
    return (
        looked_up.groupBy("repo")
        .agg(
            F.count_if("cache_hit").alias("hits"),
            F.count_if(~F.col("cache_hit")).alias("misses"),
            F.coalesce(F.sum("approx_tokens"), F.lit(0)).alias("tokens_saved"),
        )
        .withColumn("hit_rate", F.coalesce(F.try_divide(hits, total), F.lit(0.0)))
    )


def status(looked_up: DataFrame, cache: DataFrame, documents: DataFrame) -> DataFrame:
    """Files tracked, hits, each staleness reason, entries, document bytes per repo."""
    reasons = ["not_cached", "source_changed", "prompt_changed", "backend_changed", "tool_changed"]
    tracked = looked_up.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("cache_hit").alias("hits"),
        *[F.count_if(F.col("staleness_reason") == r).alias(r) for r in reasons],
    )
    stored = cache.groupBy("repo").agg(F.count(F.lit(1)).alias("entries"))
    written = documents.groupBy("repo").agg(
        (F.sum(F.octet_length("content") + 1) - 1).alias("document_bytes")
    )
    counts = ["files", "hits", *reasons, "entries"]
    return (
        tracked.join(stored, "repo", "full_outer")
        .join(written, "repo", "full_outer")
        .select(
            "repo",
            *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
            F.col("document_bytes").isNotNull().alias("has_document"),
            "document_bytes",
        )
    )


def purge(cache: DataFrame, repos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cache without the given repos, number of removed entries per repo)."""
    kept = cache.join(repos, "repo", "left_anti")
    removed = (
        cache.join(repos, "repo", "left_semi")
        .groupBy("repo")
        .agg(F.count(F.lit(1)).alias("removed"))
    )
    return kept, removed


def prompt_hash(prompt: str = C.SUMMARY_PROMPT) -> str:
    """Prompt part of the cache key."""
    return hashlib.sha256(prompt.encode("utf-8")).hexdigest()[:16]


def prompt_requests(files: DataFrame) -> DataFrame:
    """Summary requests for the included files, over redacted text.

    Input is the gated table of ``summarize.gate``.
    """
    before, after = C.SUMMARY_PROMPT.split("{path}")
    middle, end = after.split("{content}")
    prompt = F.concat(
        F.lit(before), F.col("path"), F.lit(middle), X.redact(F.col("text")), F.lit(end)
    )
    return (
        files.filter(~F.col("excluded"))
        .select("repo", "path", prompt.alias("prompt"))
        .withColumn("prompt_hash", X.short_hash(F.col("prompt")))
        .withColumn("chars", F.length("prompt").cast("bigint"))
    )


def cost_estimate(requests: DataFrame) -> DataFrame:
    """Requests and estimated prompt tokens per repo."""
    return requests.groupBy("repo").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(X.token_estimate(F.col("chars"))).alias("prompt_tokens"),
    )
