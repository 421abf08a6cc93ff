"""The stored cache: what a change writes and a lookup reads."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from corpus_catalog.operators import cache as K
from corpus_catalog.operators.summarize import packed, summarize
from corpus_catalog.plans import build as B
from corpus_catalog.sources import tables
from corpus_catalog.sources.cache_table import CacheTable

KEY = K.CacheKey("p1")
REPOS = [f"r{i}" for i in range(30)]


def files_of(spark, contents):
    data = [(repo, path, text.encode()) for (repo, path), text in contents.items()]
    return spark.createDataFrame(data, "repo string, path string, content binary")


def entries(spark, contents, at="2024-01-01"):
    return K.entries(packed(summarize(files_of(spark, contents))), KEY, F.lit(at))


@pytest.fixture
def table(spark, tmp_path):
    return CacheTable(str(tmp_path / "cache"), buckets=16)


def stored(table, spark, repos=None):
    return {(r.repo, r.path): r.summary.summary for r in table.read(spark, repos).collect()}


def written(table):
    """Modification times of the data files, by bucket."""
    found = {}
    for file in glob.glob(f"{table.root}/rows/bucket=*/*.parquet"):
        found.setdefault(file.split("bucket=")[1].split("/")[0], set()).add((file, os.stat(file).st_mtime_ns))
    return found


def test_upsert_purge_and_empty(spark, table, rows):
    assert stored(table, spark) == {}
    table.upsert(entries(spark, {(r, "a.md"): "# A" for r in REPOS}))
    table.upsert(entries(spark, {("r1", "a.md"): "# B", ("r2", "n.md"): "# N", ("new", "x.md"): "# X"}))
    want = {(r, "a.md"): "Documentation: A" for r in REPOS} | {("r1", "a.md"): "Documentation: B", ("r2", "n.md"): "Documentation: N", ("new", "x.md"): "Documentation: X"}
    assert stored(table, spark) == want
    gone = spark.createDataFrame([("r2",), ("r3",), ("unknown",)], "repo string")
    assert rows(table.purge(gone)) == [("r2", 2), ("r3", 1)]
    assert stored(table, spark) == {k: v for k, v in want.items() if k[0] not in ("r2", "r3")}
    everything = spark.createDataFrame([(r,) for r in [*REPOS, "new"]], "repo string")
    table.purge(everything)
    assert stored(table, spark) == {}
    table.upsert(entries(spark, {("r2", "z.md"): "# Z"}))
    assert stored(table, spark) == {("r2", "z.md"): "Documentation: Z"}


def test_build_of_one_repo_writes_one_bucket(spark, table):
    contents = {(r, f"f{i}.md"): f"# {r} {i}" for r in REPOS for i in range(3)}
    files = files_of(spark, contents)
    inventory = files.select("repo", "path", F.lit("git").alias("ignore_mode"), F.lit(False).alias("is_priority"))
    B.build(files, inventory, table, KEY, F.lit("2024-01-01"))
    before = written(table)
    assert len(before) > 10 and len(stored(table, spark)) == 90

    files = files_of(spark, {(r, p): "# changed" if p == "f1.md" else t for (r, p), t in contents.items() if r == "r7"})
    built = B.build(files, inventory.filter("repo = 'r7'"), table, KEY, F.lit("2024-01-02"))
    assert sorted((r.path, r.cache_hit) for r in built.summaries.collect()) == [("f0.md", True), ("f1.md", False), ("f2.md", True)]
    after = written(table)
    changed = [b for b in after if after[b] != before.get(b)]
    assert len(changed) == 1 and after.keys() == before.keys()
    assert stored(table, spark)[("r7", "f1.md")] == "Documentation: changed" and len(stored(table, spark)) == 90

    B.build(files, inventory.filter("repo = 'r7'"), table, KEY, F.lit("2024-01-03"))  # nothing new: nothing is written
    assert written(table) == after


def test_lookup_reads_the_buckets_of_its_repos(spark, table):
    """Pruned when the plan runs, in a plan that does not know the repos."""
    table.upsert(entries(spark, {(r, "a.md"): "# A" for r in REPOS}))
    asked = spark.createDataFrame([("r7", "a.md", "h")], "repo string, path string, source_hash string")
    found = K.lookup(asked, table.read(spark, asked.select("repo")), KEY)
    assert [(r.repo, r.staleness_reason) for r in found.collect()] == [("r7", "source_changed")]
    plan = found._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()

    def leaves(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return leaves(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return leaves(node.plan())
        below = [node.children().apply(i) for i in range(node.children().size())]
        return [x for c in below for x in leaves(c)] if below else [node]

    read = [n.metrics().apply("numFiles").value() for n in leaves(plan) if n.getClass().getSimpleName() == "FileSourceScanExec" and "bucket" in n.toString()]
    total = sum(map(len, written(table).values()))
    assert read and min(read) <= 2 < total


def test_interrupted_change_is_finished(spark, table):
    table.upsert(entries(spark, {(r, "a.md"): "# A" for r in REPOS}))
    whole = stored(table, spark)

    class Stopped(CacheTable):
        def _finish(self, spark):
            pass

    Stopped(table.root, 16).upsert(entries(spark, {("r1", "b.md"): "# B"}))
    for file in [f for f, _ in written(table)[str(bucket_of(spark, "r1"))]]:
        os.remove(file)  # a partition that was removed and not yet replaced
    assert stored(table, spark) == whole | {("r1", "b.md"): "Documentation: B"}
    assert not tables.exists(spark, f"{table.root}/aside")


def bucket_of(spark, repo):
    return spark.range(1).select(F.pmod(F.xxhash64(F.lit(repo)), F.lit(16))).first()[0]
