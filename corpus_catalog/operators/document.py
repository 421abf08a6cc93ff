"""One Markdown or JSON document per repo.

A document is assembled from lines ``(repo, section, rank, key, text)`` and cut by
bytes into ordered parts; see ``ordering.assemble``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpus_catalog import config as C
from corpus_catalog.functions import text as X
from corpus_catalog.operators.digest import scan_hash_of
from corpus_catalog.operators.ordering import assemble
from corpus_catalog.operators.rank import scored
from corpus_catalog.operators.tree import tree_lines

ORDER = ["section", "rank", "key"]


def line(
    section: Column | int, text: Column, rank: Column | int = 0, key: Column | str = ""
) -> list[Column]:
    def as_column(value):
        return value if isinstance(value, Column) else F.lit(value)

    return [
        F.col("repo"),
        as_column(section).cast("int").alias("section"),
        as_column(rank).cast("int").alias("rank"),
        as_column(key).alias("key"),
        text.alias("text"),
    ]


def frame_lines(per_repo: DataFrame, texts: dict[int, Column]) -> DataFrame:
    """Lines that occur once per repo, by section; null texts are left out."""
    lines = F.array(
        *[F.struct(F.lit(n).alias("section"), text.alias("text")) for n, text in texts.items()]
    )
    return (
        per_repo.select("repo", F.inline(lines))
        .filter(F.col("text").isNotNull())
        .select(*line(F.col("section"), F.col("text")))
    )


def union_lines(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def file_block(title: Column, entry: bool) -> Column:
    """Heading, role, summary and lists of one file."""
    symbols, imports = F.col("public_symbols"), F.col("import_deps")
    parts = [
        F.concat(F.lit("### "), title),
        F.concat(F.lit("**Role:** "), F.col("role")),
        F.lit(""),
        F.col("summary"),
        F.when(
            F.size(symbols) > 0,
            F.concat(F.lit("\n**Provides:** "), X.head_list(symbols, C.DOCUMENT_LIST_ITEMS)),
        ),
        F.when(
            F.size(imports) > 0,
            F.concat(F.lit("**Consumes:** "), X.head_list(imports, C.DOCUMENT_LIST_ITEMS)),
        ),
    ]
    if entry:
        first = F.get("entrypoints", F.lit(0))
        parts.append(
            F.when(
                first.isNotNull(),
                F.concat(
                    F.lit("**Entry:** `"),
                    first["evidence"],
                    F.lit("` (line "),
                    first["lineno"].cast("string"),
                    F.lit(")"),
                ),
            )
        )
    return F.concat_ws("\n", *parts)


def totals(rows: DataFrame, modes: DataFrame) -> DataFrame:
    """File counts, cache hits, mode and digest of every repo in ``modes``."""
    counts = rows.groupBy("repo").agg(
        F.count_if("is_key").alias("n_key"),
        F.count_if(~F.col("is_key")).alias("n_other"),
        F.count_if("cache_hit").alias("hits"),
    )
    return (
        scan_hash_of(modes, rows)
        .join(counts, "repo", "left")
        .na.fill(0, ["n_key", "n_other", "hits"])
    )


def document_lines(rows: DataFrame, per_repo: DataFrame, escape_cells: bool = False) -> DataFrame:
    n_key, n_other = F.col("n_key") > 0, F.col("n_other") > 0
    header = F.concat(
        F.lit("# Project Context: "),
        F.col("repo"),
        F.lit("\n\n> Files: "),
        F.col("files").cast("string"),
        F.lit(" | Cache: "),
        F.col("hits").cast("string"),
        F.lit("/"),
        F.col("files").cast("string"),
        F.lit(" hits | Mode: "),
        F.col("ignore_mode"),
        F.lit(" | Hash: "),
        F.col("scan_hash"),
        F.lit("\n\n## Directory Structure\n\n```"),
    )
    after_tree = F.when(n_key, "```\n\n## Key Files\n").otherwise("```\n")
    table_head = "## Other Files\n\n| File | Role | Summary |\n|------|------|---------|"
    summary = X.cell(F.col("summary"))
    if escape_cells:
        summary = F.replace(F.replace(summary, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    cells = F.concat(
        F.lit("| "), "path", F.lit(" | "), "role", F.lit(" | "), summary, F.lit(" |")
    )
    block = F.concat(file_block(F.col("path"), entry=True), F.lit("\n"))
    is_key = F.col("is_key")
    frame = {
        0: header,
        1: F.when(F.col("files") == 0, F.lit("")),
        2: after_tree,
        4: F.when(n_other, F.lit(table_head)),
        6: F.when(n_other, F.lit("")),
    }
    tree = tree_lines(rows.select("repo", "path"))
    return union_lines(
        [
            frame_lines(per_repo, frame),
            tree.select(*line(1, F.col("text"), key=F.col("key"))),
            rows.select(
                *line(
                    F.when(is_key, 3).otherwise(5),
                    F.when(is_key, block).otherwise(cells),
                    rank=F.when(is_key, -F.col("score")).otherwise(0),
                    key=F.col("path"),
                )
            ),
        ]
    )


def token_budget(parts: DataFrame) -> DataFrame:
    """Length, token estimate and warning of each document over all its parts."""
    sizes = parts.groupBy("repo").agg((F.sum(F.length("content") + 1) - 1).alias("chars"))
    tokens = X.token_estimate(F.col("chars"))
    over = F.col("approx_tokens") > C.TOKEN_BUDGET
    return sizes.withColumn("approx_tokens", tokens).withColumn(
        "warnings",
        F.when(over, F.array(F.lit("token_budget_exceeded"))).otherwise(
            F.array().cast("array<string>")
        ),
    )


def documents(
    summaries: DataFrame, modes: DataFrame, part_bytes: int = C.PART_BYTES, escape_cells: bool = False
) -> DataFrame:
    """``(repo, part, content, scan_hash, files, hits)``; Markdown.

    ``summaries`` is a stored table with is_priority and cache_hit; it is read
    several times.  ``modes`` lists the repos to document.
    """
    rows = scored(summaries)
    per_repo = totals(rows, modes)
    lines = document_lines(rows, per_repo, escape_cells)
    content = assemble(lines, ["repo"], ORDER, part_bytes=part_bytes)
    return content.join(per_repo.select("repo", "scan_hash", "files", "hits"), "repo")


def documents_json(summaries: DataFrame, modes: DataFrame, part_bytes: int = C.PART_BYTES) -> DataFrame:
    """``(repo, part, content)``; parts of one JSON document, joined with nothing.

    Pieces are assembled like the lines of the Markdown form.
    """
    rows = scored(summaries)
    per_repo = totals(rows, modes)
    first = rows.groupBy("repo").agg(
        F.min(F.when(F.col("is_key"), F.struct(-F.col("score"), "path")))["path"].alias("first_key"),
        F.min(F.when(~F.col("is_key"), F.col("path"))).alias("first_other"),
    )
    # Joined on the path, not the repo, so that no repo is a hot key.
    starts = first.select(
        "repo", F.explode(F.array("first_key", "first_other")).alias("path")
    ).select("repo", "path", F.lit(True).alias("starts"))
    items = rows.join(starts, ["repo", "path"], "left")
    comma = F.when(F.col("starts"), "").otherwise(",")

    metadata = F.to_json(
        F.struct("files", F.col("hits").alias("cache_hits"), "ignore_mode", "scan_hash")
    )
    head = F.concat(F.lit('{"metadata":'), metadata, F.lit(',"tree":"'))
    key_item = F.to_json(
        F.struct("path", "role", "summary", "public_symbols", "import_deps", "entrypoints")
    )
    other_item = F.to_json(F.struct("path", "role", "summary"))
    tree = tree_lines(rows.select("repo", "path"))
    first_top = rows.groupBy("repo").agg(
        F.min(F.substring_index("path", "/", 1)).alias("key"), F.lit("").alias("newline")
    )
    escaped = F.to_json(F.array("text"))
    unquoted = F.expr("substring(escaped, 3, length(escaped) - 4)")
    newline = F.coalesce("newline", F.lit("\\n"))
    is_key = F.col("is_key")
    frame = {
        0: head,
        2: F.lit('","key_files":['),
        4: F.lit('],"other_files":['),
        6: F.lit("]}"),
    }
    pieces = union_lines(
        [
            frame_lines(per_repo, frame),
            tree.join(first_top, ["repo", "key"], "left")
            .withColumn("escaped", escaped)
            .select(*line(1, F.concat(newline, unquoted), key=F.col("key"))),
            items.select(
                *line(
                    F.when(is_key, 3).otherwise(5),
                    F.concat(comma, F.when(is_key, key_item).otherwise(other_item)),
                    rank=F.when(is_key, -F.col("score")).otherwise(0),
                    key=F.col("path"),
                )
            ),
        ]
    )
    return assemble(pieces, ["repo"], ORDER, separator="", part_bytes=part_bytes)
