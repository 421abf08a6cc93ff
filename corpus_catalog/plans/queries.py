"""Registered queries: every operator over the provided tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpus_catalog import config as C
from corpus_catalog.functions import globs, text as X
from corpus_catalog.operators import cache as K
from corpus_catalog.operators import diff as D
from corpus_catalog.operators import digest as DG
from corpus_catalog.operators import document as DOC
from corpus_catalog.operators import inventory as I
from corpus_catalog.operators import rank as RK
from corpus_catalog.operators import reports as REP
from corpus_catalog.operators import summarize as S
from corpus_catalog.operators.digest import corpus_fingerprint, scan_hash_of
from corpus_catalog.operators.ordering import assemble
from corpus_catalog.operators.tree import (
    directory_counts,
    directory_tree,
    drawn_lines,
    tree_nodes,
    updated_counts,
    updated_nodes,
)
from corpus_catalog.plans import build as B
from corpus_catalog.sources import corpus, rules as R, tables
from corpus_catalog.sources.cache_table import CacheTable
from corpus_catalog.sources.tables import materialize
from corpus_catalog.sources.tree_source import read_trees
from corpus_catalog.streaming import watch as W

KEY = K.CacheKey(K.prompt_hash())
FIRST_BUILD = "2024-01-01 00:00:00"
SECOND_BUILD = "2024-01-02 00:00:00"

# Patterns for the single-pattern match, each with its own result column.
GLOBS = {
    "m_suffix": "*.md",
    "m_class": "pkg[13]/**",
    "m_anchored": "/d*/README.md",
    "m_dir": "vendor/",
    "m_deep_dir": "dup/vendor/sub/",
    "m_single": "d1?/*.py",
    "m_deep": "pkg*/**/util.ts",
    "m_no_range": "[a-z]*",
    "m_bang": "!x",
}


def _doc_id(path: Column) -> Column:
    """Document that a path was derived from."""
    return F.regexp_extract(path, r"(?:\A|/)d([0-9]+)/", 1).cast("bigint")


class Tables:
    """Frames derived from the provided tables, for one query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    # --- files -------------------------------------------------------------

    @cached_property
    def docs(self) -> DataFrame:
        return corpus.documents(self.spark, self.sf_dir)

    @cached_property
    def texts(self) -> DataFrame:
        """Documents for work on whole texts."""
        return tables.spread(self.docs, "doc_id")

    @cached_property
    def files1(self) -> DataFrame:
        return corpus.files_v1(self.texts)

    @cached_property
    def files2(self) -> DataFrame:
        return corpus.files_v2(self.texts)

    @cached_property
    def paths1(self) -> DataFrame:
        return corpus.files_v1(self.docs).select("repo", "path")

    @cached_property
    def paths2(self) -> DataFrame:
        return corpus.files_v2(self.docs).select("repo", "path")

    @cached_property
    def pages(self) -> DataFrame:
        return corpus.pages_files(self.spark, self.sf_dir)

    # --- inventory ----------------------------------------------------------

    @cached_property
    def rules(self) -> DataFrame:
        return R.ignore_rules(corpus.rule_files(self.docs))

    @cached_property
    def submodule_names(self) -> DataFrame:
        files = corpus.submodule_files(self.docs)
        return R.submodule_names(files.filter(F.col("path") == ".gitmodules"))

    @cached_property
    def submodule_markers(self) -> DataFrame:
        return R.submodule_markers(corpus.submodule_files(self.docs))

    @cached_property
    def modes(self) -> DataFrame:
        return I.scan_modes(corpus.repos(self.docs), corpus.tracked(self.docs), self.paths1)

    @cached_property
    def existing(self) -> DataFrame:
        """Repos that exist, with their mode."""
        return self.stored_modes.filter("present").select("repo", "ignore_mode")

    # One small row per repo each; stored, since every scan needs them.

    @cached_property
    def stored_modes(self) -> DataFrame:
        return materialize(self.modes, "modes")

    @cached_property
    def stored_rules(self) -> DataFrame:
        return materialize(R.rules_by_repo(corpus.rule_files(self.docs)), "rules")

    def scan(self, files: DataFrame, tracked: DataFrame) -> DataFrame:
        return I.scan(
            files,
            self.existing,
            tracked,
            self.stored_rules,
            self.submodule_names,
            self.submodule_markers,
        )

    @cached_property
    def inventory1(self) -> DataFrame:
        return self.scan(self.paths1, corpus.tracked(self.docs))

    @cached_property
    def inventory2(self) -> DataFrame:
        """Second scan; version control lists every file."""
        return self.scan(self.paths2, self.paths2)

    # --- hashes and summaries -------------------------------------------------

    @cached_property
    def hashes1(self) -> DataFrame:
        return materialize(D.hashes(self.files1), "hashes")

    @cached_property
    def hashes2(self) -> DataFrame:
        return materialize(D.hashes(self.files2), "hashes")

    @cached_property
    def summaries1(self) -> DataFrame:
        return S.summarize(self.files1)

    @cached_property
    def cache1(self) -> DataFrame:
        """Cache written by a build of the first snapshot."""
        built = F.lit(FIRST_BUILD)
        return materialize(K.entries(S.packed(self.summaries1), KEY, built), "cache")

    @cached_property
    def mixed_cache(self) -> DataFrame:
        """The same with entries of other prompts, backends and tool versions."""
        n = _doc_id(F.col("path")) % 7
        return self.cache1.withColumns(
            {
                "prompt_hash": F.when(n == 0, "p0").otherwise(F.col("prompt_hash")),
                "backend_id": F.when(n == 1, "b0").otherwise(F.col("backend_id")),
                "tool_version": F.when(n == 2, "0").otherwise(F.col("tool_version")),
            }
        )

    def stored_cache(self, entries: DataFrame) -> CacheTable:
        table = CacheTable(tables.new_path(self.spark, "cache-table"))
        table.upsert(entries)
        return table

    # --- builds ----------------------------------------------------------------

    @cached_property
    def build1(self) -> B.Build:
        """Cold build of the scanned first snapshot."""
        return self._build(self.files1, self.inventory1, None, FIRST_BUILD)

    @cached_property
    def build2(self) -> B.Build:
        """Incremental build of the scanned second snapshot."""
        return self._build(
            self.files2, self.inventory2, materialize(self.build1.cache, "cache"), SECOND_BUILD
        )

    def _build(self, files, inventory, cache, at: str) -> B.Build:
        candidates = I.candidates(files, self.existing, self.stored_rules)
        return B.build(candidates, inventory, cache, KEY, F.lit(at))

    @cached_property
    def rows1(self) -> DataFrame:
        return S.unpacked(self.build1.summaries)

    @cached_property
    def documents1(self) -> DataFrame:
        return DOC.documents(self.rows1, self.existing)

    @cached_property
    def changes(self) -> DataFrame:
        """Changes between the two builds."""
        return materialize(D.diff(self.build1.manifest, self.build2.manifest), "changes")

    @cached_property
    def report_headers(self) -> DataFrame:
        before = scan_hash_of(self.existing, self.build1.manifest)
        now = scan_hash_of(self.existing, self.build2.manifest)
        return before.select("repo", F.col("scan_hash").alias("previous_hash")).join(
            now.select("repo", "ignore_mode", "scan_hash"), "repo"
        )

    def report(self, mode: str) -> DataFrame:
        rows = S.unpacked(self.build2.summaries) if mode != "list" else None
        report = REP.change_report(self.changes, self.report_headers, mode, rows)
        return report.select("repo", "part", "content")

    # --- streams -----------------------------------------------------------------

    def versions(self) -> list[DataFrame]:
        """File versions in order of arrival.

        The first snapshot, what differs in the second, and both again: repeats,
        of which the first snapshot's are also late.
        """
        day1, day2 = F.lit(FIRST_BUILD).cast("timestamp"), F.lit(SECOND_BUILD).cast("timestamp")
        kept = F.lit(False).alias("deleted")
        first = self.files1.select("repo", "path", "content", kept, day1.alias("ts"))
        delta = materialize(D.diff(self.hashes1, self.hashes2), "changes")
        new = delta.filter(F.col("new_path").isNotNull()).select("repo", F.col("new_path").alias("path"))
        # Found where they lie, then compared exactly: contents of unchanged files are not shuffled.
        near = B.contents_of(self.files2, new, new.count())
        written = near.join(new, ["repo", "path"], "left_semi").select("repo", "path", "content", kept, day2.alias("ts"))
        gone = delta.filter(F.col("kind").isin("deleted", "renamed"))
        removed = gone.select(
            "repo",
            F.col("old_path").alias("path"),
            F.lit(None).cast("binary").alias("content"),
            F.lit(True).alias("deleted"),
            day2.alias("ts"),
        )
        second = materialize(written.unionByName(removed), "versions")
        return [first, second, first.unionByName(second)]

    def settings(self) -> list[DataFrame]:
        """Setting versions in order of arrival: rules of all repos alike at first, then everything, then both again."""
        day1, day2 = F.lit(FIRST_BUILD).cast("timestamp"), F.lit(SECOND_BUILD).cast("timestamp")

        def rows(frame: DataFrame, kind: str, path: Column, content: Column, deleted: bool = False, ts: Column = day2) -> DataFrame:
            return frame.select(
                "repo", F.lit(kind).alias("kind"), path.alias("path"), content.cast("binary").alias("content"),
                F.lit(deleted).alias("deleted"), ts.alias("ts"),
            )

        none, path = F.lit(""), F.col("path")
        versioned = self.existing.filter(F.col("ignore_mode") == I.GIT).select("repo")
        before = corpus.tracked(self.docs).join(versioned, "repo", "left_semi")
        now = self.paths2.join(versioned, "repo", "left_semi")
        definitions = corpus.submodule_files(self.docs)
        at_first = F.lit("\n".join(["*.ts", "pkg2/", *corpus.SAMPLE_RULES]))
        first = rows(self.existing, W.RULES, none, at_first, ts=day1)
        first = first.unionByName(rows(before, W.TRACKED, path, F.lit(None), ts=day1))
        second = [
            rows(self.existing, W.MODE, none, F.col("ignore_mode")),
            rows(corpus.rule_files(self.docs), W.RULES, none, F.col("content")),
            rows(definitions.filter(path == ".gitmodules"), W.SUBMODULES, none, F.col("content")),
            rows(definitions.filter(path != ".gitmodules"), W.MARKER, path, F.col("content")),
            rows(now, W.TRACKED, path, F.lit(None)),
            rows(before.join(now, ["repo", "path"], "left_anti"), W.TRACKED, path, F.lit(None), deleted=True),
        ]
        second = materialize(DOC.union_lines(second), "settings")
        return [first, second, first.unionByName(second)]

    def stream_to_table(self, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Run a transformation over the landed versions; the written result."""
        landing = tables.new_path(self.spark, "landing")
        for number, arrival in enumerate(self.versions()):
            arrival.write.parquet(f"{landing}/{number}")
        stream = transform(W.read_versions(self.spark, landing))
        path = tables.new_path(self.spark, "sink")
        W.run_available(stream, path, tables.new_path(self.spark, "stream-checkpoint"))
        return tables.read(self.spark, path, stream.schema)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Tables], DataFrame]):
    """Register a query under its function name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(spark, sf_dir))

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    QUERIES[build.__name__] = run
    return run


def _joined(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


# --- sources ------------------------------------------------------------------


@query
def file_inventory(t: Tables) -> DataFrame:
    """All files of both corpora, normalised and sorted."""
    backslashed = t.paths1.withColumn(
        "path",
        F.when(F.length("path") % 2 == 0, F.replace("path", F.lit("/"), F.lit("\\"))).otherwise(
            F.col("path")
        ),
    )
    every = I.normalized(backslashed).unionByName(t.pages.select("repo", "path"))
    return every.orderBy("repo", "path")


@query
def tree_ingest(t: Tables) -> DataFrame:
    """The first snapshot written as directories, some files as links that lead nowhere or in circles, and read back."""
    folder = tables.new_path(t.spark, "trees").removeprefix("file:")
    name = X.file_name(F.col("path"))
    link = F.when(F.col("doc_id") % 41 == 1, name).when(F.col("doc_id") % 43 == 2, F.lit("nowhere"))
    corpus.write_trees(t.files1.withColumn("link", link), folder)
    read = read_trees(t.spark, folder)
    return read.select(
        "repo", "path", "size", "source_hash", "read_error", S.exclusion_reason(F.col("content"), F.col("read_error"), F.col("unheld")).alias("reason")
    )


@query
def vcs_manifest_scan(t: Tables) -> DataFrame:
    return I.tracked_only(t.paths1, corpus.tracked(t.docs))


@query
def scan_modes(t: Tables) -> DataFrame:
    return t.modes


@query
def ignore_rules(t: Tables) -> DataFrame:
    return t.rules.select(
        "repo", "ord", "negated", "kind", "pattern", F.col("regex").isNotNull().alias("valid")
    )


@query
def rule_warnings(t: Tables) -> DataFrame:
    return R.rule_warnings(t.rules)


@query
def submodule_paths(t: Tables) -> DataFrame:
    return t.submodule_names


@query
def content_gate(t: Tables) -> DataFrame:
    """First inventory against the second snapshot, with some unreadable files."""
    unreadable = F.col("doc_id") % 41 == 1
    files = t.files2.withColumn("read_error", F.when(unreadable, "Permission denied")).withColumn(
        "content", F.when(~unreadable, F.col("content"))
    )
    flags = ["exclusion_reason", "excluded", "is_binary", "decode_lossy"]
    gated = S.gate(files).select("repo", "path", *flags)
    reason = F.when(F.col("excluded").isNull(), S.NOT_FOUND).otherwise(F.col("exclusion_reason"))
    return (
        t.paths1.join(gated, ["repo", "path"], "left")
        .withColumn("exclusion_reason", reason)
        .select(
            "repo",
            "path",
            "exclusion_reason",
            F.coalesce("excluded", F.lit(True)).alias("excluded"),
            F.coalesce("is_binary", F.lit(False)).alias("is_binary"),
            F.coalesce("decode_lossy", F.lit(False)).alias("decode_lossy"),
        )
    )


@query
def build_inputs(t: Tables) -> DataFrame:
    """Tracked files of the first snapshot that the second still has."""
    return D.build_inputs(corpus.tracked(t.docs), D.hashes(t.files2))


@query
def build_manifest(t: Tables) -> DataFrame:
    """Manifest and build header, written as a snapshot and read back."""
    manifest = t.build1.manifest
    stored = manifest.join(D.builds(scan_hash_of(t.existing, manifest)), "repo")
    root = tables.new_path(t.spark, "manifests")
    tables.write_snapshot(stored.sortWithinPartitions("repo", "path"), root)
    read = D.manifest_defaults(tables.read_snapshot(t.spark, root, stored.schema))
    return read.select(
        "repo",
        "path",
        "source_hash",
        F.col("schema_version").cast("bigint").alias("schema_version"),
        "tool_version",
        "ignore_mode",
        "scan_hash",
    )


# --- filters --------------------------------------------------------------------


@query
def glob_match(t: Tables) -> DataFrame:
    """Which of several patterns each path matches."""
    path = F.col("path")
    return t.paths1.select(
        "repo", "path", *[globs.matches(path, p).alias(name) for name, p in GLOBS.items()]
    )


@query
def ignore_filter(t: Tables) -> DataFrame:
    """One rule list for all repos."""
    return I.ignore_filter(t.paths1, globs.compile_rules(corpus.SAMPLE_RULES))


@query
def ignore_filter_by_repo(t: Tables) -> DataFrame:
    """Each repo's own rules."""
    ruled = I.with_rules(t.paths1, R.rules_by_repo(corpus.rule_files(t.docs)))
    return ruled.filter(~I.ignored_by_repo_rules(F.col("path"))).select("repo", "path")


@query
def ignore_prune(t: Tables) -> DataFrame:
    """Ancestor pruning and rules, without the hidden filter."""
    rules = globs.compile_rules(corpus.SAMPLE_RULES)
    return I.ignore_filter(I.ignore_prune(t.paths1, rules), rules)


@query
def hidden_filter(t: Tables) -> DataFrame:
    return t.paths1.filter(~I.is_hidden(F.col("path")))


@query
def submodule_filter(t: Tables) -> DataFrame:
    return I.submodule_filter(t.paths1, t.submodule_names, t.submodule_markers)


@query
def priority_paths(t: Tables) -> DataFrame:
    return t.paths1.filter(X.is_priority_name(F.col("path")))


@query
def scan(t: Tables) -> DataFrame:
    """The whole scan: modes, rules, pruning, submodules, priority flags."""
    return t.inventory1


@query
def secret_scan(t: Tables) -> DataFrame:
    content = F.col("content")
    return t.files1.select(
        "repo",
        "path",
        X.has_private_key(content).alias("private_key"),
        X.has_private_key(content, strict_keys=True).alias("private_key_strict"),
    )


# --- scalars ----------------------------------------------------------------------


@query
def content_hash(t: Tables) -> DataFrame:
    return D.hashes(t.files1)


@query
def decode_text(t: Tables) -> DataFrame:
    """Decoding of valid, broken and cut-off byte sequences."""
    n = F.col("doc_id") % 3
    broken = (
        F.when(n == 0, F.concat(F.unhex(F.lit("FF")), "content"))
        .when(n == 1, F.concat("content", F.unhex(F.lit("E282"))))
        .otherwise(F.col("content"))
    )
    content = F.col("bytes")
    return t.files1.withColumn("bytes", broken).select(
        "repo",
        "path",
        X.is_lossy(content).alias("decode_lossy"),
        F.length(X.decode(content)).cast("bigint").alias("chars"),
        F.sha2(X.decode(content), 256).alias("text_hash"),
    )


@query
def secret_redact(t: Tables) -> DataFrame:
    """Redaction of every text, before the gate."""
    return S.redacted_text(t.files1).select(
        "repo",
        "path",
        F.col("redaction_count").cast("bigint").alias("redaction_count"),
        F.sha2("redacted", 256).alias("redacted_hash"),
    )


@query
def role_classify(t: Tables) -> DataFrame:
    """Name, extension and role of every file, before the gate."""
    path = F.col("path")
    return t.files1.select(
        "repo",
        "path",
        X.file_name(path).alias("name"),
        X.extension(path).alias("extension"),
        X.role(path, X.decode(F.col("content"))).alias("role"),
    )


@query
def symbol_index(t: Tables) -> DataFrame:
    found = S.symbols(t.summaries1)
    return found.withColumn("position", F.col("position").cast("bigint"))


@query
def import_deps(t: Tables) -> DataFrame:
    python = t.summaries1.filter(X.extension(F.col("path")) == ".py")
    return python.select(
        "repo", "path", _joined("import_deps"), F.size("import_deps").cast("bigint").alias("n")
    )


@query
def entrypoints(t: Tables) -> DataFrame:
    found = t.summaries1.select("repo", F.explode("entrypoints").alias("e"))
    return found.select(
        "repo", "e.path", F.col("e.lineno").cast("bigint").alias("lineno"), "e.evidence", "e.confidence"
    )


@query
def js_symbols(t: Tables) -> DataFrame:
    scripts = t.summaries1.filter(X.extension(F.col("path")).isin(S.JS_EXTENSIONS))
    return scripts.select("repo", "path", "summary", _joined("public_symbols"), _joined("import_deps"))


@query
def file_summary(t: Tables) -> DataFrame:
    return t.summaries1.select(
        "repo", "path", "source_hash", "summary", "role", "excluded", "exclusion_reason"
    )


@query
def summary_counts(t: Tables) -> DataFrame:
    counts = ["public_symbols_count", "entrypoints_count", "redaction_count"]
    return t.summaries1.select(
        "repo", "path", *[F.col(c).cast("bigint").alias(c) for c in counts]
    )


@query
def page_summary(t: Tables) -> DataFrame:
    """Summaries of the web page corpus."""
    return S.summarize(t.pages).select(
        "repo",
        "path",
        "source_hash",
        "summary",
        "role",
        F.col("redaction_count").cast("bigint").alias("redaction_count"),
    )


# --- cache -------------------------------------------------------------------------


@query
def cache_lookup(t: Tables) -> DataFrame:
    """Second snapshot looked up in the stored cache, of which the buckets of its repos are read."""
    cache = t.stored_cache(t.mixed_cache).read(t.spark, t.paths2.select("repo").distinct())
    found = K.lookup(D.hashes(t.files2), cache, KEY)
    return found.withColumn("summary", F.col("summary.summary"))


@query
def cache_json(t: Tables) -> DataFrame:
    """Entries kept as JSON; cut-off ones count as absent."""
    value = F.to_json(F.struct("*"))
    damaged = _doc_id(F.col("path")) % 7 == 0
    lines = t.cache1.select(
        F.when(damaged, F.substring(value, F.lit(1), F.length(value) - 9))
        .otherwise(value)
        .alias("value")
    )
    return tables.parse_cache(lines).select("repo", "path", "source_hash", "approx_tokens")


@query
def cache_upsert(t: Tables) -> DataFrame:
    """The mixed cache after storing the stale entries of the second snapshot."""
    found = K.lookup(t.hashes2, t.mixed_cache, KEY)
    stale = materialize(found.filter("is_stale").select("repo", "path"), "stale")
    fresh = S.packed(S.summarize(B.contents_of(t.files2, stale, stale.count())))
    new = K.entries(fresh.join(stale, ["repo", "path"], "left_semi"), KEY, F.lit(SECOND_BUILD))
    table = t.stored_cache(t.mixed_cache)
    table.upsert(new)
    return table.read(t.spark).withColumn("summary", F.col("summary.summary")).withColumn(
        "ts", F.date_format("ts", "yyyy-MM-dd")
    )


@query
def cache_latest(t: Tables) -> DataFrame:
    """Latest of several entries per path."""
    first = t.hashes1.withColumn("ts", F.lit(FIRST_BUILD).cast("timestamp"))
    second = t.hashes2.withColumn("ts", F.lit(SECOND_BUILD).cast("timestamp"))
    newest = K.latest(first.unionByName(second), ["ts", "source_hash"])
    return newest.withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))


@query
def cache_evict(t: Tables) -> DataFrame:
    """Entries left after dropping those of deleted files."""
    kept = K.evict_deleted(t.cache1, t.paths2)
    return kept.select("repo", "path", "source_hash", "approx_tokens")


@query
def cache_stats(t: Tables) -> DataFrame:
    return K.stats(K.lookup(t.hashes2, t.mixed_cache, KEY))


@query
def cache_status(t: Tables) -> DataFrame:
    looked_up = K.lookup(t.hashes2, t.mixed_cache, KEY)
    return K.status(looked_up, t.mixed_cache, t.documents1)


@query
def cache_purge(t: Tables) -> DataFrame:
    """Entries removed and kept when every third repo is purged."""
    number = corpus.repo_number()
    purged = t.hashes1.select("repo").distinct().filter(number % 3 == 0)
    table = t.stored_cache(t.cache1)
    removed = table.purge(purged)
    left = table.read(t.spark).groupBy("repo").agg(F.count(F.lit(1)).alias("kept"))
    return left.join(removed, "repo", "full_outer").select(
        "repo",
        F.coalesce("removed", F.lit(0)).alias("removed"),
        F.coalesce("kept", F.lit(0)).alias("kept"),
    )


@query
def incremental_build(t: Tables) -> DataFrame:
    """Second snapshot over the cache of the first."""
    return S.unpacked(B.fill(t.files2, t.paths2, t.cache1, KEY)).select(
        "repo",
        "path",
        "source_hash",
        "cache_hit",
        "staleness_reason",
        "summary",
        "role",
        _joined("public_symbols"),
        _joined("import_deps"),
    )


# --- differences ---------------------------------------------------------------------


@query
def changes(t: Tables) -> DataFrame:
    return D.diff(t.hashes1, t.hashes2)


@query
def rename_detect(t: Tables) -> DataFrame:
    return D.diff(t.hashes1, t.hashes2).filter(F.col("kind") == "renamed").drop("kind")


@query
def rename_all(t: Tables) -> DataFrame:
    """Renames with all copies paired in order."""
    found = D.diff(t.hashes1, t.hashes2, pair_all=True)
    return found.filter(F.col("kind") == "renamed").drop("kind")


@query
def change_counts(t: Tables) -> DataFrame:
    return D.change_counts(D.diff(t.hashes1, t.hashes2))


@query
def diff_status(t: Tables) -> DataFrame:
    """Baselines are missing for some repos and of another mode for others."""
    number = corpus.repo_number()
    before = D.builds(scan_hash_of(t.existing, t.hashes1)).filter(number % 7 != 1)
    now = t.stored_modes.withColumn(
        "ignore_mode",
        F.when(number % 7 == 2, F.lit(I.GIT)).otherwise(F.col("ignore_mode")),
    )
    found = D.diff(t.hashes1, t.hashes2).filter(number % 7 != 3)
    return D.diff_status(before, now, found)


@query
def changes_list(t: Tables) -> DataFrame:
    return t.report("list")


@query
def changes_summaries(t: Tables) -> DataFrame:
    return t.report("summaries")


@query
def changes_both(t: Tables) -> DataFrame:
    return t.report("both")


# --- documents -------------------------------------------------------------------------


@query
def scan_digest(t: Tables) -> DataFrame:
    return scan_hash_of(t.existing, t.hashes1)


@query
def scan_hash_update(t: Tables) -> DataFrame:
    """Digests of the second snapshot from the stored blocks of the first: a diff's blocks are read and hashed again."""
    modes = t.existing.select("repo", "ignore_mode")
    blocks = materialize(DG.block_digests(t.hashes1.join(modes, "repo")), "blocks")
    # The manifest lies in parts of blocks, of which those that the diff touches are read.
    part = F.substring(DG.block_of(F.col("path")), 1, 2).alias("part")
    root = tables.new_path(t.spark, "manifest-parts")
    stored = t.hashes2.join(modes, "repo").select("repo", "ignore_mode", "path", "source_hash", part)
    tables.write_snapshot(stored.hint("rebalance", "part"), root, by=("part",))
    touched = materialize(DG.touched_blocks(D.diff(t.hashes1, t.hashes2)), "touched")
    parts = touched.select(F.substring("block", 1, 2).alias("part")).distinct()  # 256 at most
    read = tables.read_snapshot(t.spark, root, stored.schema).join(F.broadcast(parts), "part", "left_semi")
    return DG.combined(DG.updated_blocks(blocks, read.drop("part"), touched))


@query
def fingerprint(t: Tables) -> DataFrame:
    return corpus_fingerprint(D.hashes(t.files1))


@query
def key_file_score(t: Tables) -> DataFrame:
    rows = t.summaries1.withColumn("is_priority", X.is_priority_name(F.col("path")))
    return RK.scored(rows).select("repo", "path", F.col("score").cast("bigint").alias("score"), "is_key")


@query
def key_files(t: Tables) -> DataFrame:
    ranked = RK.key_files(RK.scored(S.missing_defaults(t.rows1)))
    symbols, imports = F.col("public_symbols"), F.col("import_deps")
    return ranked.select(
        "repo",
        "rank",
        "path",
        F.col("score").cast("bigint").alias("score"),
        "role",
        "summary",
        X.head_list(symbols, C.DOCUMENT_LIST_ITEMS).alias("provides"),
        X.head_list(imports, C.DOCUMENT_LIST_ITEMS).alias("consumes"),
    )


@query
def other_files(t: Tables) -> DataFrame:
    return RK.other_files(RK.scored(t.rows1)).orderBy("repo", "path")


@query
def tree(t: Tables) -> DataFrame:
    return directory_tree(t.paths1)


@query
def directory_tree_update(t: Tables) -> DataFrame:
    """Trees of the second snapshot, from the stored nodes of the first and a diff."""
    nodes = updated_nodes(tree_nodes(t.paths1), D.diff(t.hashes1, t.hashes2))
    return assemble(drawn_lines(nodes), ["repo"], ["key"])


@query
def directory_rollup_update(t: Tables) -> DataFrame:
    """Counts of the second snapshot, from the stored counts of the first and a diff."""
    before = materialize(directory_counts(t.paths1), "counts")
    return updated_counts(before, D.diff(t.hashes1, t.hashes2))


@query
def directory_rollup(t: Tables) -> DataFrame:
    return directory_counts(t.paths1)


@query
def context_doc(t: Tables) -> DataFrame:
    return t.documents1


@query
def document_sink(t: Tables) -> DataFrame:
    """Documents written as text and read back."""
    path = tables.new_path(t.spark, "documents")
    tables.write_documents(t.documents1, path)
    return tables.read_documents(t.spark, path)


@query
def token_budget(t: Tables) -> DataFrame:
    return DOC.token_budget(t.documents1).withColumn("warnings", F.array_join("warnings", ","))


@query
def context_json(t: Tables) -> DataFrame:
    return DOC.documents_json(t.rows1, t.existing)


# --- requests and previews -----------------------------------------------------------------


@query
def prompt_requests(t: Tables) -> DataFrame:
    requests = K.prompt_requests(S.gate(t.files1))
    return requests.select("repo", "path", "prompt_hash", "chars")


@query
def cost_estimate(t: Tables) -> DataFrame:
    """Prompt tokens of the files that the cache does not hold."""
    misses = K.lookup(t.hashes2, t.mixed_cache, KEY).filter("is_stale").select("repo", "path")
    sized = K.prompt_requests(S.gate(t.files2)).select("repo", "path", "chars")
    return K.cost_estimate(sized.join(misses, ["repo", "path"], "left_semi"))


@query
def dry_run_preview(t: Tables) -> DataFrame:
    first = I.preview(t.inventory1, C.PREVIEW_FILES)
    return first.withColumn("position", F.col("position").cast("bigint"))


# --- streams ----------------------------------------------------------------------------------


@query
def watch_versions(t: Tables) -> DataFrame:
    """Every delivered version, as streamed."""
    stored = t.stream_to_table(W.version_keys)
    return stored.withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))


@query
def watch_dedup(t: Tables) -> DataFrame:
    """Versions without repeated deliveries, however late; state is kept by RocksDB."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", W.ROCKSDB
    before = t.spark.conf.get(name, None)
    t.spark.conf.set(name, provider)
    try:
        stored = t.stream_to_table(W.drop_superseded)
    finally:
        t.spark.conf.unset(name) if before is None else t.spark.conf.set(name, before)
    return stored.withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))


@query
def watch_rebuild(t: Tables) -> DataFrame:
    """Final state of the watched corpus, files and settings; equals the scanned build of the second snapshot."""
    landing, settings = tables.new_path(t.spark, "landing"), tables.new_path(t.spark, "settings-landing")
    watch = W.Watch(tables.new_path(t.spark, "watch"), landing)
    checkpoint = tables.new_path(t.spark, "stream-checkpoint")
    for number, (arrival, changed) in enumerate(zip(t.versions(), t.settings())):
        arrival.write.parquet(f"{landing}/{number}")
        changed.write.parquet(f"{settings}/{number}")
        # Each run goes on where the last one stopped.
        streams = W.read_versions(t.spark, landing), W.read_settings(t.spark, settings)
        watch.start(streams[0], checkpoint, available_now=True, settings=streams[1]).awaitTermination()
    return S.unpacked(watch.files(t.spark)).select(
        "repo", "path", "source_hash", "summary", "role", _joined("public_symbols")
    )


# Names of the coverage list that differ from the function names above.
QUERIES["scan_hash"] = QUERIES.pop("scan_digest")
QUERIES["directory_tree"] = QUERIES.pop("tree")
