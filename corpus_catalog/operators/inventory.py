"""Which files belong to a repo: scan modes, ignore rules, submodules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpus_catalog import config as C
from corpus_catalog.functions import globs, text as X
from corpus_catalog.functions.globs import Rule
from corpus_catalog.sources.tables import materialize

GIT = "git"
BEST_EFFORT = "best_effort"
RULE_COLUMNS = ["ignoring", "keeping", "rules"]


def normalized(files: DataFrame) -> DataFrame:
    return files.withColumn("path", X.normal_path(F.col("path")))


def tracked_only(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """Exactly the files a version-control manifest lists."""
    return files.join(tracked, ["repo", "path"], "left_semi")


def scan_modes(repos: DataFrame, tracked: DataFrame, files: DataFrame) -> DataFrame:
    """Mode and warning of each requested repo.

    ``repos`` has repo, vcs (under version control) and vcs_tool (tool found).
    A repo that does not exist, or is under version control with an empty
    manifest, gets a warning.  With a column root ('directory', 'file' or null)
    that says what exists, so that an empty directory does and a file gets a warning of
    its own; without it a repo exists if it has files.
    """
    has_root = "root" in repos.columns
    listed = tracked.select("repo").distinct().withColumn("listed", F.lit(True))
    present = files.select("repo").distinct().withColumn("present", F.lit(True))
    mode = F.when(F.col("vcs_tool") & F.col("vcs") & F.col("present"), GIT).otherwise(BEST_EFFORT)
    warning = (
        F.when(F.col("root") == "file", F.concat(F.lit("Root is not a directory: "), "repo"))
        .when(~F.col("present"), F.concat(F.lit("Root directory does not exist: "), "repo"))
        .when(~F.col("vcs_tool"), "git not found; using best-effort ignore matching")
        .when((F.col("ignore_mode") == GIT) & ~F.col("listed"), "version-control listing is empty")
    )
    exists = F.col("root") == "directory" if has_root else F.col("present")
    flagged = F.coalesce(exists, F.lit(False)).alias("present")
    root = F.col("root") if has_root else F.lit(None).cast("string").alias("root")
    return (
        repos.join(listed, "repo", "left")
        .join(present, "repo", "left")
        .select("repo", "vcs", "vcs_tool", root, flagged, F.coalesce("listed", F.lit(False)).alias("listed"))
        .withColumn("ignore_mode", mode)
        .select("repo", "ignore_mode", "present", warning.alias("warning"))
    )


def is_hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda part: part.startswith("."))


# --- one rule list for all repos: literals, nothing is joined -----------------


def ignore_filter(files: DataFrame, rules: list[Rule]) -> DataFrame:
    return files.filter(~globs.is_ignored(F.col("path"), rules))


def ignore_prune(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Drop files below an ignored directory; a negated rule cannot bring them back."""
    pruned = F.exists(X.ancestor_dirs(F.col("path")), lambda d: globs.is_ignored(d, rules))
    return files.filter(~pruned)


# --- rules per repo -----------------------------------------------------------


def with_rules(rows: DataFrame, rules_by_repo: DataFrame) -> DataFrame:
    """Add the rules of each row's repo.

    One row per file, so a repo with many files stays many small rows; a
    skewed repo is split by the adaptive join.
    """
    none = F.array().cast("array<struct<negated:boolean,regex:string>>")
    return rows.join(rules_by_repo, "repo", "left").withColumns(
        {
            "ignoring": F.coalesce("ignoring", F.lit("")),
            "keeping": F.coalesce("keeping", F.lit("")),
            "rules": F.coalesce("rules", none),
        }
    )


def ignored_by_repo_rules(path: Column) -> Column:
    return globs.is_ignored_by(path, F.col("ignoring"), F.col("keeping"), F.col("rules"))


def pruned_by_repo_rules(path: Column) -> Column:
    return F.exists(X.ancestor_dirs(path), ignored_by_repo_rules)


# --- submodules ---------------------------------------------------------------


def submodule_filter(files: DataFrame, names: DataFrame, markers: DataFrame) -> DataFrame:
    """Drop files below a submodule.

    A directory is one if its base name equals a listed path, or if it holds a
    pointer file.  Directories are few next to files, so ancestors are
    expanded per directory, not per file.
    """
    dirs = files.select("repo", X.parent_dir(F.col("path")).alias("dir")).distinct()
    above = dirs.select(
        "repo",
        "dir",
        F.explode(X.ancestor_dirs(F.concat("dir", F.lit("/")))).alias("above"),
    ).withColumn("base", X.file_name(F.col("above")))
    listed = names.select("repo", F.col("path").alias("base")).distinct()
    marked = markers.select("repo", F.col("path").alias("above")).distinct()
    inside = (
        above.join(listed, ["repo", "base"], "left_semi")
        .select("repo", "dir")
        .union(above.join(marked, ["repo", "above"], "left_semi").select("repo", "dir"))
        .distinct()
    )
    # Stored, so that the adaptive join can split a directory with very many files.
    inside = materialize(inside, "submodule-dirs")
    return (
        files.withColumn("dir", X.parent_dir(F.col("path")))
        .join(inside, ["repo", "dir"], "left_anti")
        .drop("dir")
    )


# --- whole scan -----------------------------------------------------------------


def _settings(modes: DataFrame, rules_by_repo: DataFrame) -> DataFrame:
    """Mode and rules, one row per repo."""
    return with_rules(modes.select("repo", "ignore_mode"), rules_by_repo)


def _passes_rules(path: Column) -> Column:
    """Rules of the repo; pruning and the hidden filter only where directories are walked."""
    walked = ~is_hidden(path) & ~pruned_by_repo_rules(path)
    return ~ignored_by_repo_rules(path) & ((F.col("ignore_mode") == GIT) | walked)


def candidates(files: DataFrame, modes: DataFrame, rules_by_repo: DataFrame) -> DataFrame:
    """Files with contents, without most of those that a scan would drop.

    Spares ignored files the summary where the inventory is too long to be
    broadcast to the contents.  The settings are broadcast if their measured
    size allows it; otherwise nothing is dropped.
    """
    settings = _settings(modes, rules_by_repo)
    text = F.aggregate(
        "rules", F.lit(0).cast("bigint"), lambda sum, rule: sum + F.length(rule["regex"]) + 32
    )
    row = F.length("repo") + F.length("ignoring") + F.length("keeping") + text + 64
    size = settings.agg(F.sum(row)).first()[0] or 0
    if size > C.BROADCAST_BYTES:
        return files
    return (
        files.join(F.broadcast(settings), "repo")
        .filter(_passes_rules(X.normal_path(F.col("path"))))
        .drop("ignore_mode", *RULE_COLUMNS)
    )


def scan(
    files: DataFrame,
    modes: DataFrame,
    tracked: DataFrame,
    rules_by_repo: DataFrame,
    submodule_names: DataFrame,
    submodule_markers: DataFrame,
) -> DataFrame:
    """Inventory ``(repo, path, ignore_mode, is_priority)``.

    Only paths flow through the joins; contents are read later.
    """
    path, mode = F.col("path"), F.col("ignore_mode")
    paths = normalized(files.select("repo", "path"))
    # Stored, so that the adaptive join can split a repo with very many files.
    settings = materialize(_settings(modes, rules_by_repo), "settings")
    kept = (
        paths.join(settings, "repo")
        .filter(_passes_rules(path))
        .drop(*RULE_COLUMNS)
    )
    listed = tracked_only(kept.filter(mode == GIT), normalized(tracked))
    walked = submodule_filter(
        kept.filter(mode == BEST_EFFORT), submodule_names, submodule_markers
    )
    return listed.unionByName(walked).select(
        "repo", "path", "ignore_mode", X.is_priority_name(path).alias("is_priority")
    )


def preview(inventory: DataFrame, n: int) -> DataFrame:
    """First ``n`` paths per repo and the number of further ones.

    The row limit is applied per task before the shuffle, so a large repo sends
    at most ``n`` rows per task.
    """
    totals = inventory.groupBy("repo").agg(F.count(F.lit(1)).alias("files"))
    first = (
        inventory.select(
            "repo",
            "path",
            F.row_number().over(Window.partitionBy("repo").orderBy("path")).alias("position"),
        )
        .filter(F.col("position") <= n)
    )
    more = F.greatest(F.col("files") - n, F.lit(0))
    return first.join(totals, "repo").select("repo", "position", "path", more.alias("more"))
