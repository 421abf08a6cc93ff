"""Contracts and quirks of each operator."""

import glob
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F, types as T

from corpus_catalog import config as C
from corpus_catalog.operators import cache as K
from corpus_catalog.operators import diff as D
from corpus_catalog.operators import inventory as I
from corpus_catalog.operators import rank as RK
from corpus_catalog.operators import reports as REP
from corpus_catalog.operators import summarize as S
from corpus_catalog.operators import tree as TR
from corpus_catalog.plans import build as B
from corpus_catalog.schemas import CACHE, SUMMARY
from corpus_catalog.sources import rules as R, tables
from corpus_catalog.sources.tree_source import read_trees

FUNCTIONS = '''"""Reads meters."""

import os
import sys
from pathlib import Path

def read_meter():
    pass

class Meter:
    pass

def _calibrate():
    pass

if __name__ == "__main__":
    read_meter()
'''


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0]


# --- summaries ---------------------------------------------------------------


def test_python_summary(files):
    row = one(S.summarize(files({"pkg/sample.py": FUNCTIONS})))
    assert row.public_symbols == ["read_meter", "Meter"]
    assert row.public_symbols_count == 2
    assert row.import_deps == ["os", "pathlib", "sys"]
    assert row.summary == "Reads meters."
    assert row.role == "entrypoint"
    assert [e.asDict() for e in row.entrypoints] == [
        {
            "path": "pkg/sample.py",
            "lineno": 16,
            "evidence": 'if __name__ == "__main__"',
            "confidence": 0.95,
        }
    ]
    assert (row.excluded, row.exclusion_reason, row.redaction_count) == (False, None, 0)
    assert row.source_hash == hashlib.sha256(FUNCTIONS.encode()).hexdigest()


def test_gate_order(files):
    key = "-----BEGIN RSA PRIVATE KEY-----"
    big = "x = 1\n" * 50_000
    found = S.summarize(
        files(
            {
                "b.bin": b"a\0b",
                "big.py": big + f"def f(): pass\n# {key}\nif __name__ == 'x': pass\n",
                "key.py": f"K = '{key}'\n",
                "ok.py": 'token = "x"\n',
                "lossy.txt": b"a\xff",
            }
        )
    )
    by = {r.path: r for r in found.collect()}
    assert {p: r.exclusion_reason for p, r in by.items()} == {
        "b.bin": "binary_file",
        "big.py": "file_too_large",
        "key.py": "private_key_block",
        "ok.py": None,
        "lossy.txt": None,
    }
    # Too large: still summarised, always marked lossy, never with entry points.
    assert by["big.py"].public_symbols == ["f"]
    assert by["big.py"].role == "entrypoint"
    assert by["big.py"].decode_lossy and by["big.py"].entrypoints == []
    assert by["big.py"].redaction_count == 0
    # Other exclusions carry nothing.
    assert (by["key.py"].role, by["key.py"].summary) == ("unknown", "File excluded: contains private key")
    assert (by["b.bin"].is_binary, by["b.bin"].summary) == (True, "Binary file: b.bin")
    assert by["ok.py"].redaction_count == 1
    assert by["lossy.txt"].decode_lossy
    assert not by["ok.py"].decode_lossy


def test_missing_and_unreadable(spark):
    df = spark.createDataFrame(
        [("r", "a", None, None), ("r", "b", None, "Permission denied")],
        "repo string, path string, content binary, read_error string",
    )
    got = {r.path: (r.exclusion_reason, r.summary) for r in S.summarize(df).collect()}
    assert got == {
        "a": ("file_not_found", "File not found: a"),
        "b": ("read_error", "Could not read file: Permission denied"),
    }


def test_summary_texts(files):
    found = S.summarize(
        files(
            {
                "a.py": "x = 1",
                "b.py": "import z\nimport a",
                "c.ts": "export const a = 1\n" * 12,
                "d.YML": "x",
                "e.md": "no title",
                "f.md": "## no\n# Yes it is",
                "g.txt": "1\n2\r\n3",
                "h": "",
                "broken.py": "def f(:",
                "long.md": "# " + "t" * 600,
            }
        )
    )
    got = {r.path: r.summary for r in found.collect()}
    assert got.pop("long.md") == ("Documentation: " + "t" * 600)[:497] + "..."
    assert got == {
        "a.py": "Python file: a.py",
        "b.py": "Imports: a, z",
        "c.ts": "JavaScript/TypeScript file with 12 exports",
        "d.YML": "Configuration file: d.YML",
        "e.md": "Markdown documentation: e.md",
        "f.md": "Documentation: Yes it is",
        "g.txt": "g.txt: 3 lines",
        "h": "h: 0 lines",
        "broken.py": "Python file: broken.py",
    }
    assert len({r.path: r for r in found.collect()}["c.ts"].public_symbols) == 10


def test_stored_hash_is_used(files):
    hashed = files({"a": "x"}).withColumn("source_hash", F.lit("h"))
    assert one(D.hashes(hashed)).source_hash == "h"
    assert one(S.summarize(hashed)).source_hash == "h"


# --- inventory -------------------------------------------------------------------


def scan(spark, paths, rules="", vcs=False, tool=True, tracked=(), gitmodules="", markers=()):
    files = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
    tracked = spark.createDataFrame([("r", p) for p in tracked], "repo string, path string")
    repos = spark.createDataFrame([("r", vcs, tool)], "repo string, vcs boolean, vcs_tool boolean")
    rule_files = spark.createDataFrame([("r", rules)], "repo string, content string")
    modules = spark.createDataFrame([("r", gitmodules)], "repo string, content string")
    marked = spark.createDataFrame([("r", m) for m in markers], "repo string, path string")
    modes = I.scan_modes(repos, tracked, files)
    by_repo = R.rules_by_repo(rule_files)
    found = I.scan(files, modes, tracked, by_repo, R.submodule_names(modules), marked)
    mode = one(modes)
    return {r.path: r.is_priority for r in found.collect()}, mode.ignore_mode, mode.warning


def test_version_control_mode(spark):
    got, mode, warning = scan(
        spark,
        ["tracked.py", "ignored.txt", ".gitignore", "a.log", "vendor/x.py", "important.env"],
        rules="vendor\n*.env\n!important.env\n",
        vcs=True,
        tracked=["tracked.py", ".gitignore", "a.log", "vendor/x.py", "important.env", "gone.py"],
    )
    # Hidden files stay, a bare directory name prunes nothing.
    assert (sorted(got), mode, warning) == (
        [".gitignore", "important.env", "tracked.py", "vendor/x.py"],
        "git",
        None,
    )


def test_best_effort_mode(spark):
    got, mode, warning = scan(
        spark,
        ["app.py", ".env", "prod.env", "vendor/x.py", "vendor/keep.txt", "other.txt", "kept.txt", ".h/a",
         "x/.hid", "a.log", "foo.egg-info/z", "build/x"],
        rules="vendor\n*.txt\n!kept.txt\n!vendor/keep.txt\n",
        tool=False,
    )
    assert (sorted(got), mode) == (["app.py", "foo.egg-info/z", "kept.txt", "prod.env"], "best_effort")
    assert got["app.py"] and not got["kept.txt"]
    assert "git not found" in warning


def test_roots_without_files(spark):
    schema = "repo string, vcs boolean, vcs_tool boolean, root string"
    repos = spark.createDataFrame(
        [("empty", False, True, "directory"), ("one", False, True, "file"), ("none", False, True, None), ("full", True, True, "directory")], schema
    )
    held = spark.createDataFrame([("full", "a.py"), ("none", "stale.py")], "repo string, path string")
    got = {r.repo: (r.present, r.ignore_mode, r.warning) for r in I.scan_modes(repos, held, held).collect()}
    assert got == {
        "empty": (True, "best_effort", None),
        "one": (False, "best_effort", "Root is not a directory: one"),
        "none": (False, "best_effort", "Root directory does not exist: none"),
        "full": (True, "git", None),
    }
    old = {r.repo: (r.present, r.warning) for r in I.scan_modes(repos.drop("root"), held, held).collect()}
    assert old["full"] == (True, None) and old["empty"] == (False, "Root directory does not exist: empty")


def test_submodules_are_left_out(spark):
    got, _, _ = scan(
        spark,
        ["libs/foo/a.py", "libs/bar/b.py", "dup/c.py", "x/dup/d.py", "dup.py"],
        gitmodules="[submodule]\n\tpath = libs/foo\n path=dup \n",
        markers=["libs/bar"],
    )
    # A listed path of several parts is found by its marker only.
    assert sorted(got) == ["dup.py", "libs/foo/a.py"]


def test_submodule_markers(files):
    df = files({"a/.git": " gitdir: ../x\n", "b/.git": "other", "c/git": "gitdir:", ".git": "gitdir: up"})
    assert sorted(r.path for r in R.submodule_markers(df).collect()) == ["", "a"]


def test_malformed_rules_are_reported(spark):
    df = spark.createDataFrame([("r", "[x\n*.a\n")], "repo string, content string")
    assert one(R.rule_warnings(R.ignore_rules(df, []))).warning == "malformed ignore rule: [x"


def test_preview(spark, rows):
    df = spark.createDataFrame([("r", f"f{i:03}") for i in range(25)] + [("q", "z")], "repo string, path string")
    got = I.preview(df, 20).collect()
    assert len(got) == 21
    assert {r.more for r in got if r.repo == "r"} == {5}
    assert {r.more for r in got if r.repo == "q"} == {0}


def test_candidates_drop_what_a_scan_drops(spark, files, monkeypatch):
    df = files({"a.py": "", ".h/x": "", "v/x": "", "b.log": ""}).unionByName(
        files({"a.py": "", ".h/x": "", "v/x": "", "b.log": ""}, "g")
    )
    modes = spark.createDataFrame([("r", "best_effort"), ("g", "git")], "repo string, ignore_mode string")
    rules = R.rules_by_repo(spark.createDataFrame([("r", "v"), ("g", "v")], "repo string, content string"))
    kept = I.candidates(df, modes, rules)
    assert kept.columns == df.columns
    assert {(r.repo, r.path) for r in kept.collect()} == {
        ("r", "a.py"), ("g", "a.py"), ("g", ".h/x"), ("g", "v/x"),
    }
    monkeypatch.setattr(C, "BROADCAST_BYTES", 1)
    assert I.candidates(df, modes, rules).count() == df.count()


def test_contents_are_picked_without_a_shuffle(spark, files):
    df = files({"a": "", "b": ""}).unionByName(files({"c": ""}, "q"))
    wanted = spark.createDataFrame([("r", "a")], "repo string, path string")

    def picked(rows, limit):
        found = B.contents_of(df, wanted, rows, limit)
        assert "hashpartitioning(wanted_key" not in found._jdf.queryExecution().toString()
        return sorted(r.path for r in found.collect())

    assert picked(1, 10) == ["a"]
    assert picked(11, 10) == ["a", "b"]  # the repos that are touched
    assert picked(11, 0) == ["a", "b", "c"]


# --- cache -----------------------------------------------------------------------


KEY = K.CacheKey("p1", "b", "1")


@pytest.fixture
def cache(spark, files):
    packed = S.packed(S.summarize(files({"a.py": "x = 1", "b.py": "y = 2"})))
    return tables.materialize(K.entries(packed, KEY, F.lit("2024-01-01")), "cache")


@pytest.mark.parametrize(
    "key,reason",
    [
        (KEY, None),
        (K.CacheKey("p2", "b", "1"), "prompt_changed"),
        (K.CacheKey("p1", "c", "1"), "backend_changed"),
        (K.CacheKey("p1", "b", "2"), "tool_changed"),
        (K.CacheKey("p2", "c", "2"), "prompt_changed"),
    ],
)
def test_lookup_reasons(files, cache, key, reason):
    current = D.hashes(files({"a.py": "x = 1"}))
    row = one(K.lookup(current, cache, key))
    assert (row.cache_hit, row.is_stale, row.staleness_reason) == (reason is None, reason is not None, reason)
    assert (row.summary is None) == (reason is not None)


def test_lookup_of_changed_and_unknown(files, cache):
    current = D.hashes(files({"a.py": "x = 2", "new.py": "", "b.py": "y = 2"}))
    found = K.lookup(current, cache, KEY)
    assert {r.path: r.staleness_reason for r in found.collect()} == {
        "a.py": "source_changed",
        "new.py": "not_cached",
        "b.py": None,
    }
    stats = one(K.stats(found))
    assert (stats.hits, stats.misses, stats.hit_rate) == (1, 2, 1 / 3)
    assert stats.tokens_saved > 0


def test_upsert_latest_purge_evict(files, cache, rows):
    new = K.entries(S.packed(S.summarize(files({"a.py": "x = 9"}))), KEY, F.lit("2024-02-01"))
    merged = K.upsert(cache, new)
    assert merged.count() == 2
    assert rows(K.latest(cache.unionByName(new)), "path", "source_hash") == rows(merged, "path", "source_hash")
    kept, removed = K.purge(merged, cache.select("repo").distinct())
    assert kept.count() == 0 and one(removed).removed == 2
    left = K.evict_deleted(merged, files({"b.py": ""}).select("repo", "path"))
    assert rows(left, "path") == [("b.py",)]


def test_json_entries(spark, cache):
    lines = cache.select(F.to_json(F.struct("*")).alias("value"))
    bad = spark.createDataFrame([("{broken",), ("[]",), ('{"path": 3}',), ("",)], "value string")
    parsed = tables.parse_cache(lines.union(bad))
    assert sorted(map(str, parsed.collect())) == sorted(map(str, cache.collect()))


def test_status(spark, files, cache):
    found = K.lookup(D.hashes(files({"a.py": "x = 2", "b.py": "y = 2"})), cache, KEY)
    none = spark.createDataFrame([], "repo string, part long, content string")
    row = one(K.status(found, cache, none))
    assert (row.files, row.hits, row.source_changed, row.entries, row.has_document) == (2, 1, 1, 2, False)
    docs = spark.createDataFrame([("r", 0, "é")], "repo string, part long, content string")
    assert one(K.status(found, cache, docs)).document_bytes == 2


# --- builds ------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast_rows", [0, 10_000])
def test_second_build_hits_everything(files, broadcast_rows):
    df = files({"a.py": "x = 1", "b.md": "# T", "gone.py": "z"})
    listed = df.filter("path <> 'gone.py'").select("repo", "path")
    first = B.build(df, listed, None, KEY, F.lit("2024-01-01"))
    assert first.manifest.count() == 2
    filled = B.fill(df, listed, first.cache, KEY, broadcast_rows)
    assert {(r.path, r.cache_hit) for r in filled.collect()} == {("a.py", True), ("b.md", True)}
    changed = files({"a.py": "x = 2", "b.md": "# T", "c.js": ""})
    again = B.fill(changed, changed.select("repo", "path"), first.cache, KEY, broadcast_rows)
    assert {(r.path, r.cache_hit, r.staleness_reason) for r in again.collect()} == {
        ("a.py", False, "source_changed"),
        ("b.md", True, None),
        ("c.js", False, "not_cached"),
    }
    cold = B.fill(changed, changed.select("repo", "path"), None, KEY, broadcast_rows)
    assert {r.path: r.summary for r in cold.collect()} == {r.path: r.summary for r in again.collect()}


def test_backslashes_in_paths(spark, files):
    df = files({"a\\b.py": "x = 1"})
    modes = spark.createDataFrame([("r", "best_effort")], "repo string, ignore_mode string")
    rules = R.rules_by_repo(spark.createDataFrame([], "repo string, content string"))
    none = spark.createDataFrame([], "repo string, path string")
    found = I.scan(df, modes, none, rules, none, none)
    for cache in (None, spark.createDataFrame([], CACHE)):
        assert one(B.fill(I.candidates(df, modes, rules), found, cache, KEY)).path == "a/b.py"


def test_documents_are_equal_for_equal_input(spark, files):
    df = files({"main.py": FUNCTIONS, "lib/u.py": "def f(): pass", "README.md": "# Hi"})
    modes = spark.createDataFrame([("r", "git")], "repo string, ignore_mode string")
    listed = df.select("repo", "path").withColumn("is_priority", F.col("path") == "main.py")
    texts = []
    for _ in range(2):
        built = B.build(df, listed, None, KEY, F.lit("2024-01-01"))
        texts.append(one(B.context_documents(built, modes)))
    assert texts[0] == texts[1]
    doc = texts[0].content
    assert "## Directory Structure" in doc and "## Key Files" in doc and "## Other Files" in doc
    assert '### main.py\n**Role:** entrypoint\n\nReads meters.\n\n**Provides:** read_meter, Meter\n**Consumes:** os, pathlib, sys\n**Entry:** `if __name__ == "__main__"` (line 16)\n' in doc
    assert "| lib/u.py | library | Defines: f |" in doc
    other = modes.withColumn("ignore_mode", F.lit("best_effort"))
    built = B.build(df, listed, None, KEY, F.lit("2024-01-01"))
    assert one(B.context_documents(built, other)).scan_hash != texts[0].scan_hash


def test_token_budget_of_many_files(spark, files):
    df = files({f"file_{i}.py": f'"""{"word " * 60}"""' for i in range(400)})
    modes = spark.createDataFrame([("r", "git")], "repo string, ignore_mode string")
    listed = df.select("repo", "path").withColumn("is_priority", F.lit(False))
    built = B.build(df, listed, None, KEY, F.lit("2024-01-01"))
    assert one(B.context_documents(built, modes)).warnings == ["token_budget_exceeded"]


def test_scores(spark):
    data = [
        ("README.md", "docs", False, 0.0, 6),
        ("pyproject.toml", "config", True, 0.0, 10),
        ("main.py", "entrypoint", True, 0.95, 13),
        ("a.py", "library", False, 0.95, 1),
        ("b.py", "library", False, 0.8, 0),
    ]
    df = spark.createDataFrame(data, "path string, role string, p boolean, conf double, want int")
    score = RK.score(
        F.col("path"), F.col("role"), F.array(F.struct(F.col("conf").alias("confidence"))), F.col("p")
    )
    for r in df.withColumn("score", score).collect():
        assert r.score == r.want, r.path


# --- differences ---------------------------------------------------------------------


def manifest(spark, rows):
    return spark.createDataFrame([("r", p, h) for p, h in rows], "repo string, path string, source_hash string")


def test_diff_kinds_and_ambiguous_renames(spark, rows):
    old = manifest(spark, [("same", "1"), ("edit", "2"), ("b_old", "3"), ("a_old", "3"), ("gone", "4")])
    new = manifest(spark, [("same", "1"), ("edit", "9"), ("y_new", "3"), ("x_new", "3"), ("z_new", "3"), ("fresh", "5")])
    got = rows(D.diff(old, new), "kind", "old_path", "new_path")
    assert got == sorted(
        [
            ("modified", "edit", "edit"),
            ("renamed", "a_old", "x_new"),
            ("deleted", "b_old", None),
            ("deleted", "gone", None),
            ("added", None, "y_new"),
            ("added", None, "z_new"),
            ("added", None, "fresh"),
        ],
        key=repr,
    )
    paired = rows(D.diff(old, new, pair_all=True).filter("kind = 'renamed'"), "old_path", "new_path")
    assert paired == [("a_old", "x_new"), ("b_old", "y_new")]


def test_diff_invariants(spark):
    import random

    rng = random.Random(3)
    names = [f"f{i}" for i in range(80)]
    old = manifest(spark, [(n, str(rng.randint(0, 15))) for n in rng.sample(names, 50)])
    new = manifest(spark, [(n, str(rng.randint(0, 15))) for n in rng.sample(names, 50)])
    counts = {r.kind: r["count"] for r in D.diff(old, new).groupBy("kind").count().collect()}
    same = old.join(new, ["repo", "path", "source_hash"]).count()
    assert counts["added"] + counts["modified"] + counts["renamed"] + same == 50
    assert counts["deleted"] + counts["modified"] + counts["renamed"] + same == 50
    assert D.diff(old, old).isEmpty()


def test_diff_shuffles_its_inputs_once(spark, tmp_path):
    """All uses of the difference share one exchange: each table is read once."""
    manifest(spark, [("same", "1"), ("a_old", "3"), ("gone", "4")]).write.parquet(str(tmp_path / "old"))
    manifest(spark, [("same", "2"), ("x_new", "3"), ("fresh", "5")]).write.parquet(str(tmp_path / "new"))
    found = D.diff(spark.read.parquet(str(tmp_path / "old")), spark.read.parquet(str(tmp_path / "new")))
    assert len(found.collect()) == 4
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 2, plan


def test_diff_status(spark):
    before = spark.createDataFrame([("b", "git"), ("c", "git"), ("d", "git")], "repo string, ignore_mode string")
    now = spark.createDataFrame([("a", "git"), ("b", "best_effort"), ("c", "git"), ("d", "git")], "repo string, ignore_mode string")
    changes = spark.createDataFrame([("d", "added", None, "x")], "repo string, kind string, old_path string, new_path string")
    got = {r.repo: r.status for r in D.diff_status(before, now, changes).collect()}
    assert got == {"a": "no_baseline", "b": "mode_mismatch", "c": "no_changes", "d": "ok"}


def test_reports(spark, files):
    changes = spark.createDataFrame(
        [("r", "modified", "m.py", "m.py"), ("r", "renamed", "old.md", "new.md"), ("r", "deleted", "gone", None)],
        "repo string, kind string, old_path string, new_path string",
    )
    heads = spark.createDataFrame([("r", "aa", "bb", "git")], "repo string, previous_hash string, scan_hash string, ignore_mode string")
    rows = S.summarize(files({"m.py": "import os\ndef f(): pass"}))
    title = "# Project Changes: r\n\n> Since scan: aa → bb | Mode: git\n\n"
    block = "**Role:** library\n\nDefines: f. Imports: os\n\n**Provides:** f\n**Consumes:** os\n\n"
    lost = "**Role:** unknown\n\nCould not read: new.md\n\n"
    assert one(REP.change_report(changes, heads, "list")).content == (
        title + "## Modified\n- m.py\n\n## Deleted\n- gone\n\n## Renamed\n- old.md → new.md\n"
    )
    assert one(REP.change_report(changes, heads, "summaries", rows)).content == (
        title + "## Modified\n\n### m.py\n" + block + "## Renamed\n\n### old.md → new.md\n" + lost + "## Deleted\n\n- gone\n"
    )
    assert one(REP.change_report(changes, heads, "both", rows)).content == (
        title + "**Changes:** 1 modified, 1 deleted, 1 renamed\n\n## Modified\n\n### m.py\n" + block
        + "## Renamed\n\n*old.md → new.md*\n\n### new.md\n" + lost + "## Deleted\n\n- gone\n"
    )
    assert REP.change_report(changes, heads.filter("repo = 'x'"), "list").count() == 0


# --- requests and tables ----------------------------------------------------------------


def test_prompts_hold_redacted_text_only(files):
    gated = S.gate(files({"a.py": 'password = "hunter2"', "k.pem": "-----BEGIN RSA PRIVATE KEY-----"}))
    row = one(K.prompt_requests(gated))
    assert "hunter2" not in row.prompt and 'password = "[REDACTED]"' in row.prompt
    assert row.prompt == C.SUMMARY_PROMPT.replace("{path}", "a.py").replace("{content}", 'password = "[REDACTED]"')
    assert row.prompt_hash == hashlib.sha256(row.prompt.encode()).hexdigest()[:16]
    assert K.prompt_hash() == hashlib.sha256(C.SUMMARY_PROMPT.encode()).hexdigest()[:16]


def test_snapshots(spark, cache):
    root = tables.new_path(spark, "snapshots")
    assert tables.read_snapshot(spark, root, CACHE).isEmpty()
    assert tables.write_snapshot(cache, root) == 0
    assert tables.write_snapshot(K.upsert(tables.read_snapshot(spark, root, CACHE), cache), root) == 1
    assert tables.read_snapshot(spark, root, CACHE).count() == 2
    assert tables.snapshots(spark, root) == [0, 1]


def test_document_sink_writes_exact_text(spark, tmp_path):
    docs = spark.createDataFrame([("r", 0, "é line\nlast\n"), ("q", 0, "x\n")], "repo string, part long, content string")
    tables.write_documents(docs, str(tmp_path / "out"))
    (written,) = (tmp_path / "out" / "repo=r").glob("*.txt")
    assert written.read_bytes().decode() == "é line\nlast\n"


def test_source_trees(spark, tmp_path):
    for path, data in {
        "one/__init__.py": b"", "one/.env": b"A=1", "one/_x/a.py": b"x", "one/.git/HEAD": b"ref",
        "two/d/e/f.bin": b"\0\xff", "two/sub/.git": b"gitdir: y",
    }.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    (tmp_path / "two" / "dangling").symlink_to("nowhere")
    got = {(r.repo, r.path): r.content for r in read_trees(spark, str(tmp_path)).collect()}
    assert got == {
        ("one", "__init__.py"): b"", ("one", ".env"): b"A=1", ("one", "_x/a.py"): b"x",
        ("two", "d/e/f.bin"): b"\0\xff", ("two", "sub/.git"): b"gitdir: y", ("two", "dangling"): None,
    }
    single = read_trees(spark, str(tmp_path / "one"), "mine")
    assert {r.repo for r in single.collect()} == {"mine"} and single.count() == 3


def test_deep_chain_of_directories_is_listed_in_rounds(spark, tmp_path):
    """10,000 directories in each other: longer than any path may be, and no round lists them all."""
    at = os.open(tmp_path, os.O_RDONLY)
    for depth in range(10_000):
        os.mkdir("d", dir_fd=at)
        last, at = at, os.open("d", os.O_RDONLY, dir_fd=at)
        os.close(last)
        if depth % 2500 == 2499:
            with os.fdopen(os.open(f"f{depth}.py", os.O_WRONLY | os.O_CREAT, dir_fd=at), "w") as f:
                f.write(f"x = {depth}")
    os.close(at)
    found = {r.path: bytes(r.content) for r in read_trees(spark, str(tmp_path)).collect()}
    assert found == {"d/" * n + f"f{n}.py": b"x = %d" % n for n in (2499, 4999, 7499, 9999)}


def test_wide_tree_in_small_rounds(spark, tmp_path):
    from corpus_catalog.sources import tree_source

    want = set()
    for i in range(40):
        for j in range(i % 5):
            place = f"r{i % 3}/a{i}/b{j}/c"
            (tmp_path / place).mkdir(parents=True)
            (tmp_path / place / "f").write_text("x" * i)
            want.add((f"{place}/f", i))
    os.mkfifo(tmp_path / "r0" / "pipe")
    (tmp_path / "r1" / "way").symlink_to(tmp_path / "r0")
    for share in (1, 1000):
        got = tree_source.list_trees(spark, str(tmp_path), first_share=share).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert tree_source.list_trees(spark, str(tmp_path / "nowhere")).collect() == []


def test_files_too_large_to_hold(spark, tmp_path):
    """Two gigabytes that take no room on the disk: hash, size, lines and gate without the content."""
    size, text = (2 << 30) + 5, b"a\r\nb\n" * 3000
    (tmp_path / "r").mkdir()
    with open(tmp_path / "r" / "big.log", "wb") as f:
        f.write(text)
        f.truncate(size)
    with open(tmp_path / "r" / "blob", "wb") as f:
        f.truncate(C.HOLD_BYTES + 1)
    (tmp_path / "r" / "small.py").write_text("x = 1\n")
    files = tables.materialize(read_trees(spark, str(tmp_path)), "files")
    got = {r.path: r for r in files.collect()}
    digest, zeros = hashlib.sha256(text), bytes(1 << 24)
    for begin in range(len(text), size, len(zeros)):
        digest.update(zeros[: size - begin])
    big = got["big.log"]
    assert (big.content, big.size, big.source_hash, tuple(big.unheld)) == (None, size, digest.hexdigest(), (False, 6001))
    assert got["blob"].unheld.binary and got["small.py"].unheld is None
    assert {r.path: r.source_hash for r in D.hashes(files).collect()}["blob"] == got["blob"].source_hash
    rows = {r.path: (r.exclusion_reason, r.role, r.summary, r.decode_lossy) for r in S.summarize(files).collect()}
    assert rows["big.log"] == ("file_too_large", "unknown", "big.log: 6001 lines", True)
    assert rows["blob"][0] == "binary_file" and rows["small.py"][0] is None


def test_trees_are_copied_in_small_pieces(tmp_path):
    """A task holds a few files at a time, however many it writes or reads."""
    import tracemalloc

    import pyarrow as pa

    from corpus_catalog.sources import corpus, tree_source

    n, content = 48, bytes(range(256)) * 4096  # 1 MiB
    places = [f"r/d{i}/f" for i in range(n)]
    columns = {"repo": ["r"] * n, "path": [p[2:] for p in places], "content": [content] * n, "link": pa.array([None] * n, pa.string())}
    given = pa.RecordBatch.from_pydict(columns)
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in corpus._write(str(tmp_path))(iter([given]))) == n
        listed = pa.RecordBatch.from_pydict({"place": places})
        sizes, found = [], {}
        for batch in tree_source._contents(str(tmp_path), None, C.HOLD_BYTES)(iter([listed])):
            sizes.append(batch.nbytes)
            found |= dict.fromkeys(batch["path"].to_pylist(), batch["content"][0].as_py() == content)
            del batch
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == dict.fromkeys(columns["path"], True)
    assert max(sizes) < 8 << 20 and peak < 24 << 20


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_lines_counted_in_pieces(size):
    from corpus_catalog.sources.tree_source import _Lines

    r = random.Random(6)
    bits = ["a", "\n", "\r", "\r\n", "\x0b", "\x85", "\u2028", "\u2029", "é", "\x1e", "\u2027", "\xa0"]
    for _ in range(300):
        text = "".join(r.choice(bits) for _ in range(r.randrange(12)))
        data, lines = text.encode(), _Lines()
        for i in range(0, len(data), size):
            lines.add(data[i : i + size])
        assert lines.total() == len(text.splitlines())


def test_fingerprint_counts_repeated_rows(spark):
    from corpus_catalog.operators.digest import corpus_fingerprint

    rows = [("r", "a", "1"), ("r", "b", "2")]
    schema = "repo string, path string, source_hash string"
    once, twice, none = (corpus_fingerprint(spark.createDataFrame(x, schema)).first() for x in (rows, rows * 2, []))
    assert once.fingerprint != twice.fingerprint != 0 and (none.files, none.fingerprint) == (0, 0)


def test_entry_tokens_equal_python(spark):
    texts = ["plain", "it's", 'say "no"', "it's \"both\"", "a\\b\n\tc\r", "é 日本 🙂", "\x00\x1f\x7f\xa0\xad​ \U000e0001", "", None]
    empty = {"provides": [], "consumes": [], "entrypoints_count": 0, "excluded": False, "redaction_count": 0}
    summaries = [
        {"summary": t, "role": "library", "public_symbols": [x for x in texts[:i] if x], "public_symbols_count": i, "import_deps": [t or ""],
         "entrypoints": [{"path": t, "lineno": 12, "evidence": "e", "confidence": 0.95}] * (i % 3), "exclusion_reason": t,
         "is_binary": i % 2 == 0, "decode_lossy": True, **empty}
        for i, t in enumerate(texts)
    ]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("repo", "path", "source_hash")] + [T.StructField("summary", SUMMARY)])
    packed = spark.createDataFrame([("r", str(i), "h", s) for i, s in enumerate(summaries)], schema)
    found = {int(r.path): r.approx_tokens for r in K.entries(packed, KEY, F.lit("2024-01-01")).collect()}
    assert found == {i: len(str(s)) // 4 for i, s in enumerate(summaries)}


@pytest.fixture
def no_broadcasts(spark):
    """Settings under which a join must split the partitions of a hot key to pass."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.maxPartitionBytes": "64k",
        "spark.sql.files.openCostInBytes": "64k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_files(spark):
    """A directory of one repo holds most files; the rest are spread."""
    n = F.col("id")
    hot = F.concat(F.lit("src/pkg/"), F.sha2(n.cast("string"), 256), F.lit(".py"))
    other = F.concat(F.lit("d"), n % 97, F.lit("/"), n, F.lit(".txt"))
    return spark.range(0, 24_000, 1, 8).select(
        F.when(n % 4 == 0, F.concat(F.lit("q"), n % 31)).otherwise("r").alias("repo"), F.when(n % 4 == 0, other).otherwise(hot).alias("path")
    )


def split_joins(df):
    """Rows of ``df`` and whether its plan split a skewed join, as executed."""
    return len(df.collect()), "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_hot_directory_and_repo_are_split(spark, no_broadcasts):
    files = hot_files(spark)
    names = spark.createDataFrame([("q1", "d3")], "repo string, path string")
    left = files.filter("not (repo = 'q1' and path like 'd3/%')").count()
    assert left < 24_000 and split_joins(I.submodule_filter(files, names, names)) == (left, True)
    rows, split = split_joins(TR.tree_lines(files))
    assert split and rows > 24_000
    modes = files.select("repo").distinct().withColumn("ignore_mode", F.lit("best_effort"))
    rules = R.rules_by_repo(spark.createDataFrame([("r", "*.log")], "repo string, content string"))
    assert split_joins(I.scan(files, modes, files.limit(0), rules, names, names)) == (left, True)
