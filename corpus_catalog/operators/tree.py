"""Directory trees and per-directory counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpus_catalog import config as C
from corpus_catalog.functions import text as X
from corpus_catalog.operators.ordering import assemble
from corpus_catalog.sources.tables import materialize


def directory_counts(files: DataFrame) -> DataFrame:
    """Files directly in and anywhere below each directory; the top is ``''``."""
    direct = files.groupBy("repo", X.parent_dir(F.col("path")).alias("dir")).agg(
        F.count(F.lit(1)).alias("n")
    )
    prefixes = F.filter(X.ancestor_dirs(F.concat("dir", F.lit("/_"))), lambda d: d != "")
    spread = direct.select(
        "repo", "dir", "n", F.explode(F.concat(F.array(F.lit("")), prefixes)).alias("node")
    )
    own = F.when(F.col("node") == F.col("dir"), F.col("n")).otherwise(0)
    return spread.groupBy("repo", F.col("node").alias("dir")).agg(
        F.sum(own).alias("files"), F.sum("n").alias("files_below")
    )


def _parents(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("parent", X.parent_dir(F.col("node"))).withColumn("name", X.file_name(F.col("node")))


def _last_siblings(nodes: DataFrame) -> DataFrame:
    """``(repo, node, is_last)`` of the last entry of each directory."""
    # Found per directory and joined back on its own full path, a unique key, so a
    # directory of any size stays spread out.
    path = F.when(F.col("parent") == "", F.col("last")).otherwise(F.concat("parent", F.lit("/"), "last"))
    return (
        nodes.groupBy("repo", "parent")
        .agg(F.max("name").alias("last"))
        .select("repo", path.alias("node"), F.lit(True).alias("is_last"))
    )


def tree_nodes(files: DataFrame) -> DataFrame:
    """``(repo, node, is_file, below, parent, name, is_last)``: every file and directory; stored.

    ``below`` counts the files below a directory.  A path may be both a file and a
    directory of others; it is one node.
    """
    own = files.select("repo", F.col("path").alias("node"), F.lit(True).alias("is_file"), F.lit(0).cast("bigint").alias("below"))
    dirs = directory_counts(files).filter(F.col("dir") != "").select(
        "repo", F.col("dir").alias("node"), F.lit(False).alias("is_file"), F.col("files_below").alias("below")
    )
    nodes = _parents(own.union(dirs).groupBy("repo", "node").agg(F.max("is_file").alias("is_file"), F.sum("below").alias("below")))
    flagged = nodes.join(_last_siblings(nodes), ["repo", "node"], "left")
    return materialize(flagged.withColumn("is_last", F.coalesce("is_last", F.lit(False))), "nodes")


def _moves(changes: DataFrame) -> DataFrame:
    """``(repo, path, step)``: 1 for each path that a diff adds, -1 for each that it takes away."""
    gone, new = F.col("old_path"), F.col("new_path")
    steps = F.array(F.struct(gone.alias("path"), F.lit(-1).alias("step")), F.struct(new.alias("path"), F.lit(1).alias("step")))
    moved = changes.filter(gone.isNull() | new.isNull() | (gone != new)).select("repo", F.inline(steps))
    return moved.filter(F.col("path").isNotNull())


def updated_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """``tree_nodes`` after a diff ``(repo, kind, old_path, new_path)``; only paths that it names are expanded.

    The last entry is found again only in directories where an entry came or went.  Stored.
    """
    moves = materialize(_moves(changes), "moves")
    none = F.lit(0).cast("bigint")
    own = moves.select("repo", F.col("path").alias("node"), F.col("step").cast("bigint").alias("file"), none.alias("below"))
    # Ancestors are expanded per directory, not per path.
    per_dir = moves.groupBy("repo", X.parent_dir(F.col("path")).alias("dir")).agg(F.sum("step").alias("step"))
    above = per_dir.select("repo", F.explode(X.ancestor_dirs(F.concat("dir", F.lit("/_")))).alias("node"), none.alias("file"), F.col("step").alias("below"))
    steps = own.union(above.filter(F.col("node") != "")).groupBy("repo", "node").agg(F.sum("file").alias("d_file"), F.sum("below").alias("d_below"))
    steps = materialize(steps, "steps")
    known = nodes.select("repo", "node", "is_file", F.col("below").alias("old_below"), "is_last")
    was = F.coalesce(F.col("is_file") | (F.col("old_below") > 0), F.lit(False))
    after = steps.join(known, ["repo", "node"], "left").select(
        "repo", "node", was.alias("was"), F.coalesce("is_last", F.lit(False)).alias("is_last"),
        (F.coalesce(F.col("is_file").cast("bigint"), none) + F.col("d_file") > 0).alias("is_file"),
        (F.coalesce("old_below", none) + F.col("d_below")).alias("below"),
    )
    after = materialize(_parents(after.withColumn("exists", F.col("is_file") | (F.col("below") > 0))), "after")
    columns = ["repo", "node", "is_file", "below", "parent", "name", "is_last"]
    kept = nodes.select(*columns).join(steps, ["repo", "node"], "left_anti")
    merged = materialize(kept.unionByName(after.filter("exists").select(*columns)), "merged-nodes")
    open_dirs = materialize(after.filter("was <> exists").select("repo", "parent").distinct(), "open-dirs")
    again = merged.join(open_dirs, ["repo", "parent"], "left_semi")
    last = _last_siblings(again)
    mended = again.drop("is_last").join(last, ["repo", "node"], "left").withColumn("is_last", F.coalesce("is_last", F.lit(False)))
    rest = merged.join(open_dirs, ["repo", "parent"], "left_anti")
    return materialize(rest.select(*columns).unionByName(mended.select(*columns)), "nodes")


def updated_counts(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """``directory_counts`` after a diff; only paths that it names are expanded."""
    moves = _moves(changes)
    direct = moves.groupBy("repo", X.parent_dir(F.col("path")).alias("dir")).agg(F.sum("step").alias("n"))
    prefixes = F.filter(X.ancestor_dirs(F.concat("dir", F.lit("/_"))), lambda d: d != "")
    spread = direct.select("repo", "dir", "n", F.explode(F.concat(F.array(F.lit("")), prefixes)).alias("node"))
    own = F.when(F.col("node") == F.col("dir"), F.col("n")).otherwise(0)
    steps = spread.select("repo", F.col("node").alias("dir"), own.alias("files"), F.col("n").alias("files_below"))
    total = counts.select("repo", "dir", "files", "files_below").unionByName(steps)
    return (
        total.groupBy("repo", "dir")
        .agg(F.sum("files").alias("files"), F.sum("files_below").alias("files_below"))
        .filter("files_below > 0")
    )


def tree_lines(files: DataFrame, mark_top_files: bool = True) -> DataFrame:
    """Lines of the drawn tree: ``(repo, key, text)``, ordered by ``key``.

    Top-level entries carry a slash even if they are files, unless
    ``mark_top_files`` is off.
    """
    return drawn_lines(tree_nodes(files), mark_top_files)


def drawn_lines(nodes: DataFrame, mark_top_files: bool = True) -> DataFrame:
    """Lines of the tree of stored ``tree_nodes``."""
    nodes = nodes.withColumn("is_dir", F.col("below") > 0)
    # Indentation below a directory: blank under each last sibling among it and
    # the directories above it, a line under the others.  Only last siblings
    # are joined and gathered, at most one per level.
    levels = (
        nodes.filter("is_dir")
        .select(
            "repo",
            F.col("node").alias("parent"),
            F.posexplode(X.ancestor_dirs(F.concat("node", F.lit("/_")))).alias("level", "node"),
        )
        .filter(F.col("level") > 0)
    )
    last_dirs = nodes.filter(F.col("is_dir") & F.col("is_last")).select("repo", "node")
    blanks = (
        levels.join(last_dirs, ["repo", "node"])
        .groupBy("repo", "parent")
        .agg(F.collect_list("level").alias("blanks"))
    )
    # Stored, so that the adaptive join can split a directory with very many entries.
    blanks = materialize(blanks, "blanks")
    parents = F.split("parent", "/")
    indent = F.array_join(
        F.transform(
            F.slice(parents, 2, F.size(parents)),
            lambda _, i: F.when(
                F.coalesce(F.array_contains("blanks", i + 1), F.lit(False)), "    "
            ).otherwise("│   "),
        ),
        "",
    )
    slash = F.when(F.col("is_dir"), "/").otherwise("")
    top_slash = F.lit("/") if mark_top_files else slash
    branch = F.when(F.col("is_last"), "└── ").otherwise("├── ")
    text = F.when(F.col("parent") == "", F.concat("name", top_slash)).otherwise(
        F.concat(indent, branch, F.col("name"), slash)
    )
    return nodes.join(blanks, ["repo", "parent"], "left").select(
        "repo", X.order_key(F.col("node")).alias("key"), text.alias("text")
    )


def directory_tree(
    files: DataFrame, part_bytes: int = C.PART_BYTES, mark_top_files: bool = True
) -> DataFrame:
    """``(repo, part, content)``; a long tree comes in ordered parts."""
    return assemble(tree_lines(files, mark_top_files), ["repo"], ["key"], part_bytes=part_bytes)
