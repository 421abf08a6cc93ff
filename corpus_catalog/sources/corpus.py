"""Source trees derived from the provided ``documents`` table.

The table holds prose, so names, directories and code around the text are
derived from ``doc_id``: every row becomes one file of the repo ``source``.
Two snapshots (``v1``, ``v2``) differ by added, deleted, edited and moved
files.  Everything is a projection of the table, so it scales with it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The name of a file, by doc_id % 16.
NAMES = [
    "README.md",
    "main.py",
    "test_mod.py",
    "mod.py",
    "config.yaml",
    "package.json",
    "index.js",
    "util.ts",
    "notes.txt",
    "Makefile",
    "debug.log",
    "prod.env",
    "pyproject.toml",
    "__init__.py",
    "blob.bin",
    "lib.go",
]
# Special directories, by doc_id % 11; all others are pkg0..pkg4.
DIRECTORIES = {0: "", 1: "node_modules/", 2: "tests/", 3: ".hidden/", 4: "vendor/sub/"}

SAMPLE_RULES = ["node_modules/", "*.log", "*.env", "!pkg1/**/prod.env", "vendor"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _mod(n: int) -> Column:
    return F.col("doc_id") % n


def _id() -> Column:
    return F.col("doc_id").cast("string")


def _path() -> Column:
    package = F.concat(F.lit("pkg"), _mod(5).cast("string"), F.lit("/"))
    directory = F.coalesce(
        *[F.when(_mod(11) == n, F.lit(d)) for n, d in DIRECTORIES.items()], package
    )
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (_mod(16) + 1).cast("int"))
    return F.concat(directory, F.lit("d"), _id(), F.lit("/"), name)


def _comment(mark: str) -> Column:
    return F.concat(F.lit(mark), F.replace(F.col("text"), F.lit("\n"), F.lit("\n" + mark)))


def _content() -> Column:
    text = F.col("text")
    guard = F.when(_mod(16) == 1, 'if __name__ == "__main__":\n    pass\n').otherwise("")
    python = F.concat(
        F.lit("import os\nfrom pkg"),
        _mod(5).cast("string"),
        F.lit('.mod import fn\napi_key = "k'),
        _id(),
        F.lit('"\ndef fn_'),
        _id(),
        F.lit("():\n    pass\nclass C_"),
        _id(),
        F.lit(":\n    pass\n"),
        guard,
        _comment("# "),
    )
    script = F.concat(
        F.lit('import x from "./lib'),
        _mod(5).cast("string"),
        F.lit('"\nexport function f_'),
        _id(),
        F.lit("() {}\nexport default class C_"),
        _id(),
        F.lit(" {}\n"),
        _comment("// "),
    )
    # The text again and again, to more than the size limit.
    times = F.expr("cast(200000 div (length(text) + 1) + 1 as int)")
    oversized = F.repeat(F.concat(text, F.lit("\n")), times)
    return (
        F.when(_mod(251) == 7, oversized)
        .when(
            _mod(97) == 5,
            F.concat(F.lit('K = "-----BEGIN RSA PRIVATE KEY-----"\n'), text),
        )
        .when(_mod(16) == 14, F.concat(F.lit("BIN"), F.char(F.lit(0)), text))
        .when(_mod(16).isin(1, 2, 3, 13), python)
        .when(_mod(16).isin(6, 7), script)
        .when(_mod(16) == 0, F.concat(F.lit("# Title "), _id(), F.lit("\n\n"), text))
        .otherwise(text)
    )


def files_v1(docs: DataFrame) -> DataFrame:
    """First snapshot: every document; some files have a second copy below ``dup/``."""
    copies = F.when(
        (_mod(19) == 4) & (_mod(3) == 0),
        F.array(F.col("path"), F.concat(F.lit("dup/"), F.col("path"))),
    ).otherwise(F.array("path"))
    return (
        docs.withColumn("path", _path())
        .select(
            F.col("source").alias("repo"),
            F.explode(copies).alias("path"),
            _content().cast("binary").alias("content"),
            "doc_id",
        )
    )


def files_v2(docs: DataFrame) -> DataFrame:
    """Second snapshot: some files gone, edited or moved, and new copies below ``new/``."""
    moved = F.when(_mod(19) == 4, "moved/").otherwise("")
    edit = F.when(_mod(13) == 5, "\n# modified").otherwise("")
    copies = F.when(
        _mod(23) == 6, F.array(F.col("path"), F.concat(F.lit("new/"), F.col("path")))
    ).otherwise(F.array("path"))
    placed = docs.filter(_mod(17) != 3).withColumn("path", F.concat(moved, _path()))
    return placed.select(
        F.col("source").alias("repo"),
        F.explode(copies).alias("path"),
        F.concat(_content(), edit).cast("binary").alias("content"),
        "doc_id",
    )


# --- side tables ------------------------------------------------------------


def repo_number() -> Column:
    """Number of a repo; null for repos that do not exist."""
    return F.substring("repo", 4, 9).try_cast("int")


def repos(docs: DataFrame) -> DataFrame:
    """Requested repos: version-control flag, tool flag; some do not exist."""
    known = docs.select(F.col("source").alias("repo")).distinct()
    n = repo_number()
    known = known.select(
        "repo",
        ((n % 2 == 0) | (n % 10 == 7)).alias("vcs"),
        (n % 10 != 3).alias("vcs_tool"),
        F.when(n % 10 == 9, F.array("repo", F.concat("repo", F.lit("-gone"))))
        .otherwise(F.array("repo"))
        .alias("requested"),
    )
    return known.select(F.explode("requested").alias("repo"), "vcs", "vcs_tool")


def tracked(docs: DataFrame) -> DataFrame:
    """Tracked paths of the repos under version control."""
    rows = files_v1(docs).select("repo", "path", "doc_id")
    return rows.filter((F.col("doc_id") % 29 != 0) & (repo_number() % 2 == 0)).select(
        "repo", "path"
    )


def rule_files(docs: DataFrame) -> DataFrame:
    """One ignore file per repo: the sample rules and one rule of its own."""
    per_repo = docs.groupBy(F.col("source").alias("repo")).agg(F.max("doc_id").alias("m"))
    sample = "# ignore rules\n\n" + "\n".join(f"  {r} " for r in SAMPLE_RULES)
    return per_repo.select(
        "repo",
        F.concat(
            F.lit(sample + "\r\npkg"),
            (F.col("m") % 5).cast("string"),
            F.lit("/**/util.t?\n!/tests/d"),
            F.col("m").cast("string"),
            F.lit("*/*\n[ab\n"),
        ).alias("content"),
    )


def submodule_files(docs: DataFrame) -> DataFrame:
    """Submodule definition file and marker file of every repo."""
    names = docs.select(F.col("source").alias("repo")).distinct()
    definition = '[submodule "sub"]\n\tpath = vendor/sub\n\turl = ../sub\n[submodule "dup"]\n\tpath=dup \n'
    rows = [
        (".gitmodules", definition),
        ("vendor/sub/.git", "gitdir: ../../.git/modules/sub\n"),
        ("pkg0/.git", "not a pointer"),
    ]
    files = F.array(
        *[F.struct(F.lit(p).alias("path"), F.lit(c).cast("binary").alias("content")) for p, c in rows]
    )
    return names.select("repo", F.inline(files))


def pages_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second corpus: hosts as repos, URL paths as paths, markup as content."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    url = r"\Ahttps?://([^/]+)/([^?#]*)"
    return pages.select(
        F.regexp_extract("url", url, 1).alias("repo"),
        F.concat(F.regexp_extract("url", url, 2), F.lit("/page"), F.col("page_id"), F.lit(".html")).alias("path"),
        F.col("html").cast("binary").alias("content"),
    )


def _write(folder: str):
    """Writes rows one at a time, so that no second copy of a batch's contents is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                repo, path, content, link = (column[row] for column in batch.columns)
                target = os.path.join(folder, repo.as_py(), path.as_py())
                os.makedirs(os.path.dirname(target), exist_ok=True)
                if not link.is_valid:
                    with open(target, "wb") as f:
                        f.write(content.as_buffer())
                elif not os.path.islink(target):  # else written by a lost attempt
                    os.symlink(link.as_py(), target)
            yield batch.select([0])

    return run


def write_trees(files: DataFrame, folder: str) -> None:
    """Files ``(repo, path, content, link)`` below a folder that every executor can reach; a link if that is set."""
    written = files.select("repo", "path", "content", "link").mapInArrow(_write(folder), "repo string")
    written.write.format("noop").mode("overwrite").save()
