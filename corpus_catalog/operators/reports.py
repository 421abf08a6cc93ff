"""Reports on the changes since the last build."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpus_catalog import config as C
from corpus_catalog.operators.diff import KINDS, change_counts
from corpus_catalog.operators.document import (
    ORDER,
    file_block,
    frame_lines,
    line,
    union_lines,
)
from corpus_catalog.operators.ordering import assemble
from corpus_catalog.operators.summarize import missing_defaults

# Section order of each report.
SECTIONS = {
    "list": ["modified", "added", "deleted", "renamed"],
    "summaries": ["modified", "added", "renamed", "deleted"],
    "both": ["modified", "added", "renamed", "deleted"],
}


def changed_summaries(changes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Changed files that still exist, with their summaries."""
    current = changes.filter(F.col("new_path").isNotNull())
    found = current.join(
        summaries.withColumnRenamed("path", "new_path"), ["repo", "new_path"], "left"
    )
    unread = F.concat(F.lit("Could not read: "), F.col("new_path"))
    return missing_defaults(found.withColumn("summary", F.coalesce("summary", unread)))


def _entries(changes: DataFrame, summaries: DataFrame | None, mode: str) -> DataFrame:
    """One text per changed file: a bullet or a block."""
    arrow = F.concat("old_path", F.lit(" → "), "new_path")
    shown = F.when(F.col("kind") == "renamed", arrow).otherwise(F.coalesce("new_path", "old_path"))
    bullet = F.concat(F.lit("- "), shown)
    if mode == "list":
        return changes.withColumn("text", bullet)
    blocks = changed_summaries(changes, summaries)
    if mode == "summaries":
        text = F.concat(file_block(shown, entry=False), F.lit("\n"))
    else:
        lead = F.when(
            F.col("kind") == "renamed", F.concat(F.lit("*"), arrow, F.lit("*\n\n"))
        ).otherwise("")
        text = F.concat(lead, file_block(F.col("new_path"), entry=False), F.lit("\n"))
    columns = ["repo", "kind", "old_path", "new_path", "text"]
    deleted = changes.filter(F.col("kind") == "deleted").withColumn("text", bullet)
    return blocks.withColumn("text", text).select(*columns).unionByName(deleted.select(*columns))


def change_report(
    changes: DataFrame,
    headers: DataFrame,
    mode: str = "both",
    summaries: DataFrame | None = None,
    part_bytes: int = C.PART_BYTES,
) -> DataFrame:
    """``(repo, part, content)`` for repos with a baseline and changes.

    ``headers`` has repo, previous_hash, scan_hash and ignore_mode, one row per
    repo that can be compared; ``changes`` is a stored table, it is read
    several times.
    """
    changes = changes.join(headers.select("repo"), "repo", "left_semi")
    counts = change_counts(changes)
    per_repo = headers.join(counts, "repo")
    title = F.concat(
        F.lit("# Project Changes: "),
        F.col("repo"),
        F.lit("\n\n> Since scan: "),
        F.col("previous_hash"),
        F.lit(" → "),
        F.col("scan_hash"),
        F.lit(" | Mode: "),
        F.col("ignore_mode"),
        F.lit("\n"),
    )
    listed = F.concat_ws(
        ", ",
        *[F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(f" {k}"))) for k in KINDS],
    )
    frame = {0: title}
    if mode == "both":
        frame[1] = F.concat(F.lit("**Changes:** "), listed, F.lit("\n"))
    places = {kind: 10 * (n + 1) for n, kind in enumerate(SECTIONS[mode])}
    for kind, section in places.items():
        present = F.col(kind) > 0
        heading = f"## {kind.capitalize()}" + ("" if mode == "list" else "\n")
        frame[section] = F.when(present, heading)
        # Blocks end with a blank line of their own, bullet lists need one.
        if mode == "list" or kind == "deleted":
            frame[section + 2] = F.when(present, "")
    section = F.coalesce(*[F.when(F.col("kind") == k, n + 1) for k, n in places.items()])
    key = F.coalesce(F.when(F.col("kind") == "renamed", F.col("new_path")), "old_path", "new_path")
    entries = _entries(changes, summaries, mode)
    lines = union_lines(
        [
            frame_lines(per_repo, frame),
            entries.select(*line(section, F.col("text"), key=key)),
        ]
    )
    return assemble(lines, ["repo"], ORDER, part_bytes=part_bytes)
