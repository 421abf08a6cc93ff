import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpus_catalog.functions import globs


RUNS = "array<struct<negated:boolean,regex:string>>"


def expected(path: str, pattern: str) -> bool:
    """Plain statement of the rules, one path at a time, without brackets."""
    if pattern.endswith("/"):
        p = pattern[:-1]
        return path == p or path.startswith(p + "/") or p in path.split("/")

    def fits(text: str, glob: str) -> bool:
        if not glob:
            return not text
        if glob.startswith("**/"):
            return fits(text, glob[3:]) or any(
                text[i] == "/" and fits(text[i + 1 :], glob[3:]) for i in range(len(text))
            )
        if glob.startswith("**"):
            return any(fits(text[i:], glob[2:]) for i in range(len(text) + 1))
        if glob[0] == "*":
            stop = text.find("/")
            stop = len(text) if stop < 0 else stop
            return any(fits(text[i:], glob[1:]) for i in range(stop + 1))
        if glob[0] == "?":
            return bool(text) and text[0] != "/" and fits(text[1:], glob[1:])
        return bool(text) and text[0] == glob[0] and fits(text[1:], glob[1:])

    if pattern.startswith("/"):
        return fits(path, pattern[1:])
    parts = path.split("/")
    return any(fits("/".join(parts[i:]), pattern) for i in range(len(parts)))


paths = st.lists(st.text("ab.-", min_size=1, max_size=3), min_size=1, max_size=4).map("/".join)


@settings(max_examples=400, deadline=None)
@given(paths, st.text("ab.-*?/", min_size=1, max_size=6))
def test_regex_agrees_with_plain_matching(path, pattern):
    regex = globs.compile_pattern(pattern).regex
    found = bool(re.search(regex.replace(r"\z", r"\Z"), path))
    assert found == expected(path, pattern)


@pytest.mark.parametrize(
    "pattern,path,matches",
    [
        ("*.log", "a/b.log", True),
        ("*.log", "a.log/b", False),
        ("[a-z]", "-", True),
        ("[a-z]", "b", False),
        ("[!a]", "a", True),
        ("[!a]", "!", True),
        ("[!a]", "b", False),
        ("x[", "x[", False),
        ("[]a]", "]", True),
        ("[*]y", "//]y", True),
        (r"a\*", "a*", True),
        (r"a\*", "ab", False),
        ("*.egg-info/", "foo.egg-info/x", False),
        ("/build/", "build/x", False),
        ("build/", "a/build/x", True),
        ("a/b/", "a/b/c", True),
        ("a/b/", "x/a/b/c", False),
        ("!x", "!x", True),
        ("a&&b", "a&&b", True),
        ("[&&]", "&", True),
        ("a.log", "a.log\n", True),
    ],
)
def test_match_in_spark(spark, pattern, path, matches):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(globs.matches(F.col("path"), pattern)).first()[0] == matches


def test_last_match_wins_for_literal_and_row_rules(spark):
    rules = globs.parse_rules("# c\n\n *.log \n!keep.log\r\nkeep.log/\n[bad\n/a*\n!/ab\n")
    assert [(r.pattern, r.negated, r.tail is None) for r in rules] == [
        ("*.log", False, False),
        ("keep.log", True, False),
        ("keep.log/", False, False),
        ("[bad", False, True),
        ("/a*", False, False),
        ("/ab", True, False),
    ]
    paths = ["x.log", "keep.log", "d/keep.log", "ab", "ac", "z"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    runs = F.array(
        *[
            F.struct(F.lit(n).alias("negated"), F.lit(r).alias("regex"))
            for n, r in globs.decision_runs(rules)
        ]
    )
    signs = [F.lit(globs.one_regex(rules, negated)) for negated in (False, True)]
    got = df.select(
        "path",
        globs.is_ignored(F.col("path"), rules).alias("a"),
        globs.is_ignored_by(F.col("path"), *signs, runs).alias("b"),
        globs.is_ignored_by(F.col("path"), F.lit(""), F.lit(""), F.array().cast(RUNS)).alias("c"),
    ).collect()
    assert not any(r.c for r in got)
    want = {"x.log": True, "keep.log": True, "d/keep.log": True, "ab": False, "ac": True, "z": False}
    assert {r.path: r.a for r in got} == want
    assert all(r.a == r.b for r in got)


def test_rules_of_a_table_agree_with_literal_rules(spark):
    from corpus_catalog.operators import inventory as I
    from corpus_catalog.sources import rules as R

    texts = {
        "a": "*.log\n!k*\nkeep/\n[bad\n/x*\n!/xy\n!/xz\n",
        "b": "*.py\n",
        "c": "!x\n",
        "d": "# nothing\n",
    }
    names = ["x.log", "k.log", "keep/k.log", "xy", "xz", "xa", "m.py", "d/m.py", "z"]
    rule_files = spark.createDataFrame(list(texts.items()), "repo string, content string")
    paths = spark.createDataFrame([(r, n) for r in [*texts, "e"] for n in names], "repo string, path string")
    ruled = I.with_rules(paths, R.rules_by_repo(rule_files, []))
    got = {(r.repo, r.path): r.i for r in ruled.select("repo", "path", I.ignored_by_repo_rules(F.col("path")).alias("i")).collect()}
    for repo in [*texts, "e"]:
        rules = globs.parse_rules(texts.get(repo, ""))
        want = paths.filter(F.col("repo") == repo).select("path", globs.is_ignored(F.col("path"), rules).alias("i"))
        for row in want.collect():
            assert got[(repo, row.path)] == row.i, (repo, row.path)


def test_paths_are_normalised(spark):
    path = spark.createDataFrame([("node_modules\\x.js",)], "path string")
    rules = globs.compile_rules(["node_modules/"])
    column = path["path"]
    assert path.select(globs.is_ignored(column, rules), globs.matches(column, "node_modules/")).first()[:] == (True, True)
