"""Manifests and differences between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpus_catalog import config as C
from corpus_catalog.functions import text as X
from corpus_catalog.operators.ordering import row_numbers

KINDS = ["modified", "added", "deleted", "renamed"]


def hashes(files: DataFrame) -> DataFrame:
    """``(repo, path, source_hash)`` of the readable files; contents go no further.

    A table that already carries the hash is not read for its contents.
    """
    if "source_hash" in files.columns:
        found = F.col("source_hash")
        return files.filter(found.isNotNull()).select("repo", "path", "source_hash")
    return files.filter(F.col("content").isNotNull()).select(
        "repo", "path", X.source_hash(F.col("content")).alias("source_hash")
    )


def build_inputs(inventory: DataFrame, file_hashes: DataFrame) -> DataFrame:
    """Inventory rows that exist and could be read."""
    return inventory.join(file_hashes, ["repo", "path"])


def manifest_defaults(manifest: DataFrame) -> DataFrame:
    """Fill the fields an older manifest lacks."""
    filled = {
        "schema_version": F.lit(C.MANIFEST_SCHEMA_VERSION),
        "tool_version": F.lit(""),
        "ignore_mode": F.lit(""),
        "scan_hash": F.lit(""),
    }
    return manifest.withColumns(
        {
            name: F.coalesce(F.col(name), default) if name in manifest.columns else default
            for name, default in filled.items()
        }
    )


def builds(scan_hashes: DataFrame, tool_version: str = C.TOOL_VERSION) -> DataFrame:
    """Build header per repo; its files are the manifest rows."""
    return scan_hashes.select(
        "repo",
        F.lit(C.MANIFEST_SCHEMA_VERSION).alias("schema_version"),
        F.lit(tool_version).alias("tool_version"),
        "ignore_mode",
        "scan_hash",
        "files",
    )


def _delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Paths that differ, with the hash on each side; one shuffle, which all uses share.

    A join would be rewritten for each use, into another one for every kind.
    """
    absent = F.lit(None).cast("string")
    known = F.col("repo").isNotNull() & F.col("path").isNotNull()
    old = previous.select("repo", "path", F.col("source_hash").alias("old_hash"), absent.alias("new_hash"))
    new = current.select("repo", "path", absent.alias("old_hash"), F.col("source_hash").alias("new_hash"))
    kind = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash") != F.col("new_hash"), "modified")
    )
    return (
        old.unionByName(new)
        .filter(known)  # else some uses would push it below the shuffle, and share none
        .repartition("repo", "path")
        .groupBy("repo", "path")
        .agg(F.max("old_hash").alias("old_hash"), F.max("new_hash").alias("new_hash"))
        .withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
    )


def renames(delta: DataFrame, pair_all: bool = False) -> DataFrame:
    """Deleted and added files of equal content: ``(repo, old_path, new_path)``.

    One pair per content, the smallest path on each side; minimums combine
    per task, so a content with very many copies is no hot spot.  ``pair_all``
    pairs the k-th deleted with the k-th added copy.
    """
    gone = delta.filter(F.col("kind") == "deleted").select(
        "repo", F.col("old_hash").alias("source_hash"), F.col("path").alias("old_path")
    )
    new = delta.filter(F.col("kind") == "added").select(
        "repo", F.col("new_hash").alias("source_hash"), F.col("path").alias("new_path")
    )
    group = ["repo", "source_hash"]
    if pair_all:
        gone = row_numbers(gone, group, ["old_path"])
        new = row_numbers(new, group, ["new_path"])
        pairs = gone.join(new, [*group, "row_no"])
    else:
        pairs = (
            gone.groupBy(*group)
            .agg(F.min("old_path").alias("old_path"))
            .join(new.groupBy(*group).agg(F.min("new_path").alias("new_path")), group)
        )
    return pairs.select("repo", "old_path", "new_path")


def diff(previous: DataFrame, current: DataFrame, pair_all: bool = False) -> DataFrame:
    """Changes ``(repo, kind, old_path, new_path)`` between two manifests.

    Both inputs are compact ``(repo, path, source_hash)`` tables.
    """
    delta = _delta(previous, current)
    renamed = renames(delta, pair_all)
    matched = renamed.select(
        "repo",
        F.explode(
            F.array(
                F.struct(F.lit("deleted").alias("kind"), F.col("old_path").alias("path")),
                F.struct(F.lit("added").alias("kind"), F.col("new_path").alias("path")),
            )
        ).alias("end"),
    ).select("repo", "end.kind", "end.path")
    plain = delta.join(matched, ["repo", "kind", "path"], "left_anti").select(
        "repo",
        "kind",
        F.when(F.col("kind") != "added", F.col("path")).alias("old_path"),
        F.when(F.col("kind") != "deleted", F.col("path")).alias("new_path"),
    )
    return plain.unionByName(renamed.withColumn("kind", F.lit("renamed")))


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("repo").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    )


def diff_status(previous_builds: DataFrame, current_modes: DataFrame, changes: DataFrame) -> DataFrame:
    """Whether a diff can be shown for a repo: no_baseline, mode_mismatch, no_changes, ok."""
    before = previous_builds.select("repo", F.col("ignore_mode").alias("previous_mode"))
    counts = changes.groupBy("repo").agg(F.count(F.lit(1)).alias("n_changes"))
    state = (
        F.when(F.col("previous_mode").isNull(), "no_baseline")
        .when(F.col("previous_mode") != F.col("ignore_mode"), "mode_mismatch")
        .when(F.col("n_changes") == 0, "no_changes")
        .otherwise("ok")
    )
    return (
        current_modes.select("repo", "ignore_mode")
        .join(before, "repo", "left")
        .join(counts, "repo", "left")
        .withColumn("n_changes", F.coalesce("n_changes", F.lit(0)))
        .select("repo", "previous_mode", "ignore_mode", "n_changes", state.alias("status"))
    )
