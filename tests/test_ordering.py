import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from corpus_catalog.operators import digest, document, ordering, reports, tree
from corpus_catalog.operators.diff import diff
from corpus_catalog.sources import tables


@pytest.fixture
def skewed(spark):
    """One repo holds most rows."""
    rng = random.Random(5)
    data = [("big", f"d{rng.randint(0, 9)}/e{rng.randint(0, 9)}/f{i}.py") for i in range(400)]
    data += [("small", "a/b.py"), ("small", "c.py"), ("tiny", "x")]
    return data


def paths_frame(spark, data):
    return spark.createDataFrame(data, "repo string, path string")


def test_row_numbers_of_hot_groups(spark, skewed):
    df = paths_frame(spark, skewed)
    got = ordering.row_numbers(df, ["repo"], [F.desc("path")], limit=50).collect()
    for repo in {"big", "small", "tiny"}:
        want = sorted((p for r, p in skewed if r == repo), reverse=True)
        assert [r.path for r in sorted(got, key=lambda r: r.row_no) if r.repo == repo] == want
        assert sorted(r.row_no for r in got if r.repo == repo) == list(range(1, len(want) + 1))


def cut_by_bytes(texts, width, limit):
    """The texts of each part, by where they begin in the whole."""
    parts, at = {}, 0
    for text in texts:
        parts.setdefault(at // limit, []).append(text)
        at += len(text.encode()) + width
    return parts


@pytest.mark.parametrize("part_bytes", [1, 7, 50, 1000, 1 << 20])
@pytest.mark.parametrize("separator", ["\n", ""])
def test_parts_join_to_the_whole(spark, skewed, part_bytes, separator):
    """One rule for a group of 400 rows and one of a single row."""
    text = F.concat("path", F.when(F.length("path") % 3 == 0, "é" * 40).otherwise("!"))
    rows = [(r, p, p + ("é" * 40 if len(p) % 3 == 0 else "!")) for r, p in sorted(skewed)]
    df = paths_frame(spark, skewed).withColumn("text", text)
    got = ordering.assemble(df, ["repo"], ["path"], separator, part_bytes).collect()
    for repo in {"big", "small", "tiny"}:
        want = cut_by_bytes([t for r, _, t in rows if r == repo], len(separator), part_bytes)
        assert {r.part: r.content for r in got if r.repo == repo} == {n: separator.join(t) for n, t in want.items()}


def test_long_lines_of_few_rows_come_in_parts(spark):
    """What counts is bytes: ten long lines are cut, a thousand short ones are not."""
    data = [("long", f"{i}", "x" * 5000) for i in range(10)] + [("short", f"{i:04}", "y") for i in range(1000)]
    df = spark.createDataFrame(data, "repo string, path string, text string")
    got = ordering.assemble(df, ["repo"], ["path"], part_bytes=10_000).collect()
    parts = {repo: [len(r.content) for r in got if r.repo == repo] for repo in ("long", "short")}
    assert parts == {"long": [10_001] * 5, "short": [1999]}


def test_parts_do_not_depend_on_partitions(spark, skewed):
    df = paths_frame(spark, skewed).withColumn("text", F.col("path"))
    results = []
    for n in ("1", "4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = ordering.assemble(df.repartition(int(n)), ["repo"], ["path"], part_bytes=300).collect()
        results.append(sorted(tuple(r) for r in got))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]


def listed(mode, entries):
    triples = sorted((mode, p, h) for p, h in entries)
    return hashlib.sha256(json.dumps(triples).encode()).hexdigest()


def in_blocks(mode, entries):
    blocks = {}
    for p, h in entries:
        blocks.setdefault(hashlib.sha256(p.encode()).hexdigest()[:4], []).append((p, h))
    return hashlib.sha256(", ".join(listed(mode, blocks[b]) for b in sorted(blocks)).encode()).hexdigest()[:16]


def test_digests_of_json_lists(spark):
    data = [("r", "git", 'a"\\é\n.py', "1"), ("r", "git", "b c/👍", "2"), ("q", "best_effort", "z", "")]
    df = spark.createDataFrame(data, "repo string, ignore_mode string, path string, source_hash string")
    for make, want in ((digest.listing_hash, lambda *a: listed(*a)[:16]), (digest.scan_hash, in_blocks)):
        got = {r.repo: (r.files, r.scan_hash) for r in make(df).collect()}
        assert got["r"] == (2, want("git", [(d[2], d[3]) for d in data[:2]]))
        assert got["q"] == (1, want("best_effort", [("z", "")]))


def test_digest_has_one_rule_for_all_sizes(spark):
    """Two thousand files share some blocks, two share none; neither size nor layout matters."""
    sizes = {"big": 2000, "small": 2}
    data = [(r, f"d{i % 7}/f{i}.py", f"h{i}") for r, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(data, "repo string, path string, source_hash string").withColumn("ignore_mode", F.lit("git"))
    want = {r: (n, in_blocks("git", [(p, h) for q, p, h in data if q == r])) for r, n in sizes.items()}
    for frame in (df, df.repartition(3, "path")):
        assert {r.repo: (r.files, r.scan_hash) for r in digest.scan_hash(frame).collect()} == want
    modes = spark.createDataFrame([("small", "git"), ("none", "git")], "repo string, ignore_mode string")
    got = {r.repo: (r.files, r.scan_hash) for r in digest.scan_hash_of(modes, df).collect()}
    assert got == {"small": want["small"], "none": (0, in_blocks("git", []))}


def drawn(paths):
    """Independent rendering."""
    root = {}
    for p in paths:
        at = root
        for part in p.split("/"):
            at = at.setdefault(part, {})
    lines = []

    def below(node, prefix):
        names = sorted(node)
        for name in names:
            last = name == names[-1]
            lines.append(prefix + ("└── " if last else "├── ") + name + ("/" if node[name] else ""))
            below(node[name], prefix + ("    " if last else "│   "))

    for name in sorted(root):
        lines.append(name + "/")
        below(root[name], "")
    return "\n".join(lines)


@pytest.mark.parametrize("part_bytes", [200, 1 << 20])
def test_tree_equals_independent_rendering(spark, part_bytes):
    rng = random.Random(9)
    names = ["a", "a-b", "b", "b.x", "a0", "z", "é"]
    data = set()
    for repo in ("p", "q", "r"):
        for _ in range(60 if repo == "p" else 12):
            data.add((repo, "/".join(rng.choices(names, k=rng.randint(1, 5)))))
    got = tree.directory_tree(paths_frame(spark, sorted(data)), part_bytes).collect()
    for repo in ("p", "q", "r"):
        parts = [r.content for r in sorted(got, key=lambda r: r.part) if r.repo == repo]
        assert "\n".join(parts) == drawn(sorted(p for r, p in data if r == repo))


def test_few_files_in_very_deep_directories(spark):
    """Three files, 200 levels: the tree is 80 KB of indentation, in parts that each hold little more than 8,000 bytes."""
    deep = "/".join(f"d{i}" for i in range(200))
    paths = [f"{deep}/a.py", f"{deep}/b.py", "c.py"]
    got = tree.directory_tree(paths_frame(spark, [("r", p) for p in paths]), 8000).collect()
    parts = [r.content for r in sorted(got, key=lambda r: r.part)]
    assert "\n".join(parts) == drawn(paths)
    longest = max(len(line.encode()) for line in drawn(paths).split("\n"))
    assert len(parts) > 5 and max(len(p.encode()) for p in parts) <= 8000 + longest


def test_directory_counts(spark, rows):
    df = paths_frame(spark, [("r", "a/b/c"), ("r", "a/d"), ("r", "e")])
    got = rows(tree.directory_counts(df), "dir", "files", "files_below")
    assert got == [("", 1, 3), ("a", 1, 2), ("a/b", 1, 1)]


def summaries(spark, n):
    data = [
        ("big" if i % 5 else "small", f"s{i % 3}/f{i}.py", f"h{i}", f"Text {i}" * (1 + i % 20),
         "entrypoint" if i % 3 == 0 else "library", [f"s{i}"], ["os"], bool(i % 2))
        for i in range(n)
    ]
    df = spark.createDataFrame(
        data,
        "repo string, path string, source_hash string, summary string, role string, "
        "public_symbols array<string>, import_deps array<string>, cache_hit boolean",
    )
    entry = F.struct(
        F.col("path").alias("path"), F.lit(3).alias("lineno"), F.lit("main").alias("evidence"), F.lit(0.95).alias("confidence")
    )
    return df.withColumn("entrypoints", F.array(entry)).withColumn("is_priority", F.lit(False))


def joined(frame, separator="\n"):
    found = {}
    for r in sorted(frame.collect(), key=lambda r: r.part):
        found.setdefault(r.repo, []).append(r.content)
    return {repo: separator.join(parts) for repo, parts in found.items()}, found


def test_large_documents_come_in_parts(spark):
    df = summaries(spark, 60)
    modes = spark.createDataFrame([("big", "git"), ("small", "git"), ("none", "git")], "repo string, ignore_mode string")
    whole, _ = joined(document.documents(df, modes))
    cut, parts = joined(document.documents(df, modes, part_bytes=1500))
    assert len(parts["big"]) > 2
    assert cut == whole
    assert whole["none"].endswith("```\n\n```\n") and "Files: 0 | Cache: 0/0" in whole["none"]

    whole, _ = joined(document.documents_json(df, modes), "")
    cut, parts = joined(document.documents_json(df, modes, part_bytes=1500), "")
    assert len(parts["big"]) > 1
    for repo in whole:
        a, b = json.loads(whole[repo]), json.loads(cut[repo])
        assert a == b
        assert len(a["key_files"]) + len(a["other_files"]) == a["metadata"]["files"]


def test_sink_writes_ordered_files_that_join_to_the_document(spark, tmp_path):
    df = summaries(spark, 60)
    modes = spark.createDataFrame([("big", "git"), ("small", "git"), ("none", "git")], "repo string, ignore_mode string")
    whole, _ = joined(document.documents(df, modes))
    for part_bytes in (700, 1 << 20):
        path = str(tmp_path / str(part_bytes))
        tables.write_documents(document.documents(df, modes, part_bytes), path)
        for repo, text in whole.items():
            files = sorted((tmp_path / str(part_bytes) / f"repo={repo}").glob("*.txt"))
            assert "".join(f.read_bytes().decode() for f in files) == text
            assert part_bytes > 700 or repo != "big" or len(files) > 5
        read, _ = joined(tables.read_documents(spark, path), "")
        assert read == whole


def test_budget_covers_all_parts(spark):
    parts = spark.createDataFrame([("r", 0, "a" * 16000), ("r", 1, "b" * 16000), ("q", 0, "x" * 32000)], "repo string, part long, content string")
    got = {r.repo: (r.chars, r.approx_tokens, r.warnings) for r in document.token_budget(parts).collect()}
    assert got == {"r": (32001, 8001, ["token_budget_exceeded"]), "q": (32000, 8000, [])}


def test_large_reports_come_in_parts(spark):
    old = spark.createDataFrame([("r", f"p{i}", f"h{i}") for i in range(60)], "repo string, path string, source_hash string")
    new = spark.createDataFrame([("r", f"p{i}" if i % 3 else f"q{i}", f"h{i}") for i in range(10, 70)], "repo string, path string, source_hash string")
    heads = spark.createDataFrame([("r", "a", "b", "git")], "repo string, previous_hash string, scan_hash string, ignore_mode string")
    found = diff(old, new)
    whole, _ = joined(reports.change_report(found, heads, "list"))
    cut, parts = joined(reports.change_report(found, heads, "list", part_bytes=100))
    assert len(parts["r"]) > 1 and whole == cut


def snapshots(seed, n):
    """Random snapshots of two repos: files come, go, move and change; a path may be a file and a directory."""
    rng = random.Random(seed)
    names = ["a", "a-b", "b", "b.x", "z", "é"]
    current, found = {}, []
    for _ in range(n):
        for _ in range(30):
            path = (rng.choice("pq"), "/".join(rng.choices(names, k=rng.randint(1, 4))))
            if rng.random() < 0.4:
                current.pop(path, None)
            else:
                current[path] = f"h{rng.randint(0, 9)}"
        if current and rng.random() < 0.7:
            (repo, path), h = rng.choice(sorted(current.items()))
            del current[repo, path]
            current[repo, f"moved/{path}"] = h
        found.append(dict(current))
    return [*found, {k: v for k, v in current.items() if k[0] == "p"}]  # at last one repo is gone


def manifest(spark, snapshot):
    return spark.createDataFrame([(r, p, h) for (r, p), h in snapshot.items()], "repo string, path string, source_hash string")


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_and_counts_follow_changes(spark, rows, seed):
    found = [manifest(spark, s) for s in snapshots(seed, 2)]
    nodes, counts = tree.tree_nodes(found[0]), tree.directory_counts(found[0])
    for old, new in zip(found, found[1:]):
        changed = tables.materialize(diff(old, new), "changes")
        nodes, counts = tree.updated_nodes(nodes, changed), tables.materialize(tree.updated_counts(counts, changed), "counts")
        columns = ["repo", "node", "is_file", "below", "parent", "name", "is_last"]
        assert rows(nodes, *columns) == rows(tree.tree_nodes(new), *columns)
        assert rows(counts, "repo", "dir", "files", "files_below") == rows(tree.directory_counts(new), "repo", "dir", "files", "files_below")
    content = {r.repo: r.content for r in ordering.assemble(tree.drawn_lines(nodes), ["repo"], ["key"]).collect()}
    assert content == {"p": drawn(sorted(p for r, p in snapshots(seed, 2)[-1] if r == "p"))}


def test_digests_follow_changes(spark, rows):
    found = [manifest(spark, s).withColumn("ignore_mode", F.lit("git")) for s in snapshots(5, 2)]
    blocks = digest.block_digests(found[0])
    for old, new in zip(found, found[1:]):
        touched = tables.materialize(digest.touched_blocks(diff(old, new)), "touched")
        # Untouched files may be left out of what is read.
        read = new.withColumn("block", digest.block_of(F.col("path"))).join(touched, ["repo", "block"], "left_semi")
        blocks = tables.materialize(digest.updated_blocks(blocks, read.drop("block"), touched), "blocks")
        assert rows(blocks, "repo", "block", "files", "digest") == rows(digest.block_digests(new), "repo", "block", "files", "digest")
        assert rows(digest.combined(blocks), "repo", "files", "scan_hash") == rows(digest.scan_hash(new), "repo", "files", "scan_hash")
