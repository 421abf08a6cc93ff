"""Connected components of a table of links, by alternating large and small stars.

Each round relinks every node to the smallest neighbour of its neighbourhood, so
paths shrink by a factor and the links never outnumber the first ones. Nothing
is gathered: minimums are combined before the shuffle, and the stored minimums
let Spark split the joins on nodes with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpus_catalog.llm.common import Work


def _star(work: Work, sides: DataFrame, name: str) -> DataFrame:
    """Each (u, v) with the smallest of u and its neighbours in ``sides``."""
    least = work.store(
        sides.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), f"{name}-least"
    )
    return sides.join(least, "u")


def _settled(edges: DataFrame) -> bool:
    """Whether every link leads straight to a root."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root"))
    )
    per_node = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return per_node.filter("up > 1 or up = 1 and root = 1").isEmpty()


def components(work: Work, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(node, component)`` of every node of ``links (a, b)``; the component is its smallest node.

    An empty table of links gives an empty table. Links of a node with itself,
    repeated links and null ends are ignored. After a given number of ``rounds`` a
    component may still have several labels, but no label belongs to two.
    """
    edges = work.store(
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    done = 0
    while done != rounds:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = work.store(
            _star(work, both, "large").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "large",
        )
        small = _star(work, large, "small")
        edges = work.store(
            small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct(),
            "small",
        )
        done += 1
        if done != rounds and _settled(edges):
            break
    nodes = edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select("v").distinct().join(edges.select("u").distinct(), F.col("v") == F.col("u"), "left_anti")
    return nodes.union(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
