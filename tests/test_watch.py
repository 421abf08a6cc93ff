import glob
from datetime import datetime

import pytest

from corpus_catalog.operators import inventory as I
from corpus_catalog.schemas import FILE_VERSIONS, SETTING_VERSIONS
from corpus_catalog.sources import tables
from corpus_catalog.streaming import watch as W


def version(path, text, day, repo="r"):
    content = None if text is None else bytearray(text.encode())
    return (repo, path, content, text is None, datetime(2024, 1, day))


def setting(kind, text, day, path="", repo="r", deleted=False):
    return (repo, kind, path, None if text is None else bytearray(text.encode()), deleted, datetime(2024, 1, day))


@pytest.fixture
def run(spark, tmp_path):
    """Land batches one after the other and process each; ``settings`` are landed beside them."""

    def go(batches, settings=None, seen=None, **options):
        landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
        watch = W.Watch(tables.new_path(spark, "watch"), landing, **options)
        for n, batch in enumerate(batches):
            spark.createDataFrame(batch, FILE_VERSIONS).write.parquet(f"{landing}/{n}")
            stream, beside = W.read_versions(spark, landing), None
            if settings is not None:
                spark.createDataFrame(settings[n], SETTING_VERSIONS).write.parquet(f"{tmp_path}/settings/{n}")
                beside = W.read_settings(spark, f"{tmp_path}/settings")
            watch.start(stream, checkpoint, available_now=True, settings=beside).awaitTermination()
            if seen is not None:
                seen.append({r.path for r in watch.files(spark).collect()})
        return watch

    return go


def state(watch, spark):
    return {(r.repo, r.path): r.summary.summary for r in watch.files(spark).collect()}


def test_state_follows_versions(spark, run):
    watch = run(
        [
            [version("a.md", "# One", 1), version("b.md", "# B", 1), version("x", "", 1, "q")],
            [version("a.md", "# Two", 2), version("b.md", None, 2), version("b.md", "# B", 1)],
            [version("a.md", "# One", 3), version("b.md", "# late", 1), version("x", None, 3, "q")],
            [version("a.md", "# One", 3), version("skip.log", "x", 3)],
        ],
        fold_every=2,
    )
    assert state(watch, spark) == {("r", "a.md"): "Documentation: One"}
    docs = {r.repo: r.content for r in watch.latest_documents(spark).collect()}
    assert list(docs) == ["r"] and "Documentation: One" in docs["r"]
    assert len(tables.snapshots(spark, watch.files_log.bases)) == 2


def test_batches_leave_no_intermediate_tables(spark, run):
    run([[version("a.md", "# One", 1)]])
    left = glob.glob(tables.shared_dir(spark) + "/corpus_catalog/*")
    assert not [p for p in left if any(f"/{n}-" in p for n in ("newest", "known", "to-judge", "judged", "fresh", "documented"))]


def test_unchanged_content_is_a_hit(spark, run):
    watch = run([[version("a.md", "# One", 1)], [version("a.md", "# One", 2)]])
    (row,) = watch.files(spark).collect()
    assert row.cache_hit and row.ts == datetime(2024, 1, 2)
    assert row.summary.summary == "Documentation: One"


def test_repeated_batch_changes_nothing(spark, run):
    watch = run([[version("a.md", "# One", 1)], [version("a.md", "# Two", 2), version("n.md", "# N", 2)]])
    before = state(watch, spark)
    batch = spark.createDataFrame([version("a.md", "# Two", 2), version("n.md", "# N", 2)], FILE_VERSIONS)
    watch.process(batch, 1)
    assert state(watch, spark) == before


def test_many_misses_are_read_in_place(spark, run):
    batches = [[version(f"f{i}.md", f"# T{i}", 1) for i in range(9)], [version("f1.md", "# new", 2)]]
    watch = run(batches, broadcast_rows=0)
    found = state(watch, spark)
    assert len(found) == 9 and found[("r", "f1.md")] == "Documentation: new"


TREE = ["a.md", "lib/x.py", "lib/y.tmp", ".env", ".hid/h.md", "sub/s.md", "own/o.md"]
FIRST = [version(p, f"# {p}", 1) for p in TREE]


def test_only_an_ignore_file_changes(spark, run):
    """No file version arrives after the first batch, but paths are withdrawn and admitted."""
    seen = []
    settings = [
        [setting(W.RULES, "*.tmp", 1)],
        [setting(W.RULES, "lib/", 2)],
        [setting(W.RULES, "*.md", 1), setting(W.RULES, "lib/", 2)],  # late, and again
        [setting(W.RULES, None, 3, deleted=True)],
    ]
    watch = run([FIRST, [], [], []], settings, seen)
    assert seen[0] == {"a.md", "lib/x.py", "sub/s.md", "own/o.md"}
    assert seen[1] == seen[2] == {"a.md", "sub/s.md", "own/o.md"}
    assert seen[3] == {"a.md", "lib/x.py", "lib/y.tmp", "sub/s.md", "own/o.md"}
    # y.tmp was never summarised before; its text comes from the landed versions.
    assert state(watch, spark)[("r", "lib/y.tmp")] == "y.tmp: 1 lines"
    (doc,) = watch.latest_documents(spark).collect()
    assert "lib/y.tmp" in doc.content and ".env" not in doc.content


def test_ignored_files_are_never_summarised(spark, run):
    watch = run([FIRST], [[setting(W.RULES, "*.tmp", 1)]])
    kept = watch.files_log.read(spark).collect()
    assert {r.path for r in kept} == set(TREE)
    assert {r.path for r in kept if r.summary is None} == {"lib/y.tmp", ".env", ".hid/h.md"}


def test_without_landing_admitted_paths_wait(spark, run, tmp_path):
    watch = run([FIRST], [[setting(W.RULES, "*.tmp", 1)]])
    blind = W.Watch(watch.root)
    batch = spark.createDataFrame([setting(W.RULES, "", 2)], SETTING_VERSIONS)
    versions = spark.createDataFrame([], FILE_VERSIONS).withColumn("kind", W.F.lit(W.FILE))
    blind.process(versions.unionByName(batch), 1)
    assert "lib/y.tmp" not in blind.latest_documents(spark).first().content
    again = spark.createDataFrame([version("lib/y.tmp", "# now", 5)], FILE_VERSIONS)
    blind.process(again, 2)
    assert "lib/y.tmp" in {r.path for r in blind.files(spark).collect() if r.summary is not None}


def test_modes_submodules_and_listings_change(spark, run, rows):
    seen = []
    settings = [
        [setting(W.SUBMODULES, "path = own", 1), setting(W.MARKER, "gitdir: x", 1, "sub/.git")],
        [setting(W.MARKER, None, 2, "sub/.git", deleted=True)],
        [setting(W.MODE, "git", 3), *(setting(W.TRACKED, None, 3, p) for p in (".hid/h.md", "own/o.md", "gone.md", ".env"))],
        [setting(W.TRACKED, None, 4, "own/o.md", deleted=True)],
    ]
    run([FIRST, [], [], [version("own/o.md", "# new", 4)]], settings, seen)
    walked = {"a.md", "lib/x.py", "lib/y.tmp"}
    assert seen == [walked, walked | {"sub/s.md"}, {".hid/h.md", "own/o.md"}, {".hid/h.md"}]


def test_state_equals_a_scan(spark, run):
    """Random versions and settings of three repos in three batches; the state is the scan of the newest of each."""
    import random

    r, repos, n = random.Random(8), ("p", "q", "r"), 0
    texts = {W.MODE: ["git", "best_effort"], W.RULES: ["*.tmp\n!lib/y.tmp", "lib/", "own/\n*.py", ""], W.SUBMODULES: ["path = own", "path = none"]}
    files, settings = [], []
    for day in range(1, 4):
        files.append([version(p, r.choice(["# A", "# B", None]), day, q) for q in repos for p in TREE if r.random() < 0.5])
        settings.append([setting(k, r.choice(t), day, repo=q) for q in repos for k, t in texts.items() if r.random() < 0.5])
        settings[-1] += [setting(W.TRACKED, None, day, p, q, r.random() < 0.4) for q in repos for p in TREE if r.random() < 0.4]
    watch = run(files, settings, fold_every=2, buckets=2)
    newest = {(v[0], v[1]): v for batch in files for v in batch}
    chosen = {(s[0], s[1], s[2]): s for batch in settings for s in batch}
    alive = spark.createDataFrame([v[:2] for v in newest.values() if not v[3]], "repo string, path string")
    pick = lambda kind: [s for s in chosen.values() if s[1] == kind and not s[4]]
    modes = {s[0]: bytes(s[3]).decode() for s in pick(W.MODE)}
    ruled = {s[0]: bytes(s[3]).decode() for s in pick(W.RULES)}
    text = "repo string, content string"
    want = I.scan(
        alive,
        spark.createDataFrame([(q, modes.get(q, I.BEST_EFFORT)) for q in repos], "repo string, ignore_mode string"),
        spark.createDataFrame([(s[0], s[2]) for s in pick(W.TRACKED)], "repo string, path string"),
        W.R.rules_by_repo(spark.createDataFrame([(q, ruled.get(q)) for q in repos], text)),
        W.R.submodule_names(spark.createDataFrame([(s[0], bytes(s[3]).decode()) for s in pick(W.SUBMODULES)], text)),
        spark.createDataFrame([], "repo string, path string"),
    )
    found = watch.files(spark).collect()
    assert {(x.repo, x.path) for x in found} == {(x.repo, x.path) for x in want.collect()}
    assert all(x.summary is not None for x in found)


def test_a_batch_reads_the_buckets_it_touches(spark, run):
    watch = run([[version("a.md", "# A", 1, f"r{i}") for i in range(40)], [version("a.md", "# B", 2, "r7")]], buckets=16)
    root = watch.files_log.deltas.removeprefix("file:")
    folders = [{p.split("=")[-1] for p in glob.glob(f"{root}/snapshot={n}/bucket=*")} for n in (0, 1)]
    assert len(folders[0]) > 8 and len(folders[1]) == 1
    one = spark.createDataFrame([("r7",)], "repo string")
    read = watch.files_log.read(spark, repos=one)
    assert "bucket=" in str(read.inputFiles()) and len(read.collect()) == 1
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def superseded(spark, tmp_path, runs):
    landing, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", W.ROCKSDB)
    try:
        for n, batch in enumerate(runs):
            spark.createDataFrame(batch, FILE_VERSIONS).write.parquet(f"{landing}/{n}")
            W.run_available(W.drop_superseded(W.read_versions(spark, landing)), sink, str(tmp_path / "checkpoint"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return sorted((r.path, r.ts.day, r.deleted) for r in spark.read.parquet(sink).collect())


def test_redeliveries_are_dropped_after_any_time(spark, tmp_path):
    """Each run resumes the checkpoint; event times move on by ten years, then the first versions come again."""
    later = lambda v, year: (*v[:4], v[4].replace(year=year))
    first = [version("a", "1", 1), version("b", "1", 1), version("b", None, 2)]
    runs = [first, [later(version("a", "1", 5), 2034), later(version("c", "1", 6), 2034)], first + first, [version("c", "0", 9), version("d", "1", 3)]]
    assert superseded(spark, tmp_path, runs) == [("a", 1, False), ("a", 5, False), ("b", 1, False), ("b", 2, True), ("c", 6, False), ("d", 3, False)]


def test_newest_of_equal_times(spark, tmp_path):
    """A deletion comes after a content of the same time, and repeats in one batch are one."""
    rows = [version("a", None, 1), version("a", "1", 1), version("a", "1", 1), version("a", "1", 2), version("a", "2", 3), version("a", "1", 4)]
    assert superseded(spark, tmp_path, [rows, rows]) == [("a", 1, False), ("a", 1, True), ("a", 2, False), ("a", 3, False), ("a", 4, False)]


def test_late_first_deliveries_pass(spark, tmp_path):
    """Each run resumes the checkpoint; the third brings a path older than any watermark, and a repeat."""
    landing, sink = str(tmp_path / "in"), str(tmp_path / "out")
    runs = [[version("a", "1", 20)], [version("b", "2", 28)], [version("c", "3", 1), version("b", "2", 28)], [version("d", "4", 2)]]
    for n, batch in enumerate(runs):
        spark.createDataFrame(batch, FILE_VERSIONS).write.parquet(f"{landing}/{n}")
        stream = W.drop_redelivered(W.read_versions(spark, landing))
        W.run_available(stream, sink, str(tmp_path / "checkpoint"))
    got = spark.read.parquet(sink)
    assert got.columns == ["repo", "path", "ts", "deleted", "source_hash"]
    assert sorted(r.path for r in got.collect()) == ["a", "b", "c", "d"]


def test_return_to_older_content_is_a_new_version(spark, tmp_path):
    rows = [version("a", "1", 1), version("a", "2", 2), version("a", "1", 3), version("a", "2", 2)]
    landing, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, FILE_VERSIONS).write.parquet(landing)
    stream = W.drop_redelivered(W.read_versions(spark, landing))
    W.run_available(stream, sink, str(tmp_path / "checkpoint"))
    got = [r.ts.day for r in spark.read.parquet(sink).orderBy("ts").collect()]
    assert got == [1, 2, 3]


def test_a_batch_is_read_twice_at_most(spark, tmp_path):
    """Once for keys, hashes and settings together, and once for the contents that are to be summarised."""
    read = spark.sparkContext.accumulator(0)
    files = [(r, W.FILE, p, c, d, t) for r, p, c, d, t in FIRST]
    both = spark.sparkContext.parallelize([*files, setting(W.RULES, "*.tmp", 1)])
    batch = spark.createDataFrame(both.map(lambda row: (read.add(1), row)[1]), SETTING_VERSIONS)
    watch = W.Watch(tables.new_path(spark, "watch"))
    watch.process(batch, 0)
    assert {r.path for r in watch.files(spark).collect()} == {"a.md", "lib/x.py", "sub/s.md", "own/o.md"}
    assert read.value <= 2 * (len(FIRST) + 1)


def test_contents_are_not_shuffled(spark, tmp_path):
    """However long the list of missing versions is; other versions of its paths are left out."""
    landed = [version("a.md", "# One", 1), version("a.md", "# Two", 2), version("a.md", "# Two", 3), version("b.md", "# B", 1)]
    spark.createDataFrame(landed, FILE_VERSIONS).write.parquet(f"{tmp_path}/landed")
    files = spark.read.schema(FILE_VERSIONS).parquet(f"{tmp_path}/landed")
    missing = tables.materialize(W.version_keys(files).filter("day(ts) = 2").select("repo", "path", "source_hash"), "missing")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for rows in (9, 0):  # also if the list is too long to be broadcast
            found = W.Watch("unused", broadcast_rows=rows)._summaries(files, missing)
            plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
            moved = [part for part in plan.split("\n\n") if part.split("\n")[0].endswith((") Exchange", ") Sort"))]
            assert moved and not [part for part in moved if "content#" in part]
            assert [(r.path, r.summary.summary) for r in found.collect()] == [("a.md", "Documentation: Two")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_arrivals_after_the_first_are_stored(spark):
    """The third arrival repeats the second, which is found and written once."""
    from corpus_catalog.plans import queries

    t = queries.Tables(spark, "/root/testdata/sf0.001")
    for later in (t.versions()[1], t.settings()[1]):
        assert "Exchange" not in later._jdf.queryExecution().executedPlan().toString()
