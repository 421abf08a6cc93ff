"""MinHash near-dedup with bottom-k sketches of one hash function.

Links are all pairs of texts whose sets of 5-word shingles have a Jaccard
similarity of at least ``threshold``; groups are the connected components.

1.  One pass hashes every shingle once and keeps, per text, the size of its set,
    a 128-bit fingerprint of the set and the ``k`` smallest hashes. Texts with
    equal sets become one node.
2.  Inverted lists of the retained values count how many of a node's values any
    other node retains. Too few, and no partner can be similar: most nodes end here.
3.  The lists generate the pairs. A node needs to be in the lists of its rarest
    values only, as many as guarantee that two sketches with enough values
    in common meet in one of them; and every member of a list is paired with the
    list's cleanest member only, the one with the fewest values of its own, such as the text that others were
    copied from. Union-sketch estimates filter the pairs, the full sets decide.
4.  What these stars leave apart is looked for in the lists of the rarest shingles of the full sets: a
    sketch of 32 values leaves room for too many pairs in a family of texts
    just below the threshold. Lists that hold several components give the pairs between them, as far
    as their places in the lists leave room for the needed overlap. Pairs inside a
    component would not change it, so they are never formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpus_catalog.llm import shingles as S
from corpus_catalog.llm.common import Work, key
from corpus_catalog.llm.components import components

#: Values retained per text.
K = 32
#: Part of the union sketch that a pair must share at least. At a similarity of
#: 0.8 a sketch of 32 falls below it once in ten million pairs.
SHARED = 13 / 32


def _batches(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), [(t or "").encode() for t in batch.column(1).to_pylist()]
        for begin, stop in S.chunks(texts):
            found = [v for _, v in S.text_shingles(texts[begin:stop])]
            yield make(ids.slice(begin, stop - begin), found)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)))


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int = K) -> DataFrame:
    """``id, n, f1, f2, sketch``: set size, fingerprint and the ``k`` smallest hashes of every text."""

    def run(batches):
        def make(ids, found):
            prints = [S.fingerprint(v) for v in found]
            return pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(v) for v in found], pa.int64()),
                    pa.array([p[0] for p in prints], pa.int64()),
                    pa.array([p[1] for p in prints], pa.int64()),
                    _lists([v[:k] for v in found]),
                ],
                ["id", "n", "f1", "f2", "sketch"],
            )

        return _batches(batches, make)

    ids, kind = key(docs, id_col)
    rows = docs.select(ids, F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"id {kind}, n long, f1 long, f2 long, sketch array<long>")


def full_sets(texts: DataFrame) -> DataFrame:
    """``f1, f2, hashes`` of ``texts (t)``: the fingerprint and the distinct shingle hashes, sorted."""

    def run(batches):
        def make(_, found):
            prints = [S.fingerprint(v) for v in found]
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), _lists(found)],
                ["f1", "f2", "hashes"],
            )

        return _batches((pa.RecordBatch.from_arrays([b.column(0)] * 2, ["t", "text"]) for b in batches), make)

    return texts.mapInArrow(run, "f1 long, f2 long, hashes array<long>")


def _ceil_share(size: Column | str, threshold: float) -> Column:
    """Smallest whole number that is at least ``threshold`` of ``size``; exact for whole per cents."""
    return F.expr(f"cast(({round(threshold * 10_000)} * {size} + 9999) div 10000 as long)")


def _estimated(k: int, x: str = "x_sketch", y: str = "y_sketch") -> Column:
    """Whether the ``k`` smallest values of two sketches are shared often enough.

    Sets that their sketches hold whole are left to the exact test.
    """
    return F.expr(
        f"size(array_intersect(slice(array_sort(array_union({x}, {y})), 1, {k}), array_intersect({x}, {y})))"
        f" >= {SHARED} * least({k}, size(array_union({x}, {y})))"
    )


def _confirmed(work: Work, pairs: DataFrame, sketches: DataFrame, sets: DataFrame, threshold: float, k: int, name: str):
    """Pairs ``(a, b)`` whose ``sketches (rep, n, sketch)`` and then full ``sets (rep, hashes)`` are similar enough."""
    left = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("x_sketch"))
    right = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("y_sketch"))
    near = work.store(
        pairs.join(left, "a").join(right, "b").filter(_estimated(k)).select("a", "b"), f"{name}-near"
    )
    # Only sets of such pairs are dealt out.
    asked = work.store(near.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), f"{name}-asked")
    known = sets.join(asked, "rep", "left_semi")
    left = known.select(F.col("rep").alias("a"), F.col("hashes").alias("x"))
    right = known.select(F.col("rep").alias("b"), F.col("hashes").alias("y"))
    common = F.size(F.array_intersect("x", "y")).cast("long")
    both = F.size("x") + F.size("y") - F.col("common")
    return work.store(
        near.join(left, "a").join(right, "b")
        .select("a", "b", common.alias("common"), "x", "y")
        .filter(F.col("common") * 10_000 >= both.cast("long") * round(threshold * 10_000))
        .select("a", "b").distinct(),
        f"{name}-links",
    )


def _comparable(threshold: float, x: str, y: str) -> Column:
    """Sets of too different sizes can't be similar."""
    share = round(threshold * 10_000)
    return F.expr(f"10000 * least({x}, {y}) >= {share} * greatest({x}, {y})")


def rarest(work: Work, items: DataFrame) -> DataFrame:
    """Lists under which nodes with enough in common must meet: ``rep, n, m, needed, h, before, rank``.

    ``items (rep, n, m, needed, h)`` are the ``m`` values of each node, of which a partner has ``needed``
    at least. A node is listed under its rarest values, in one order for all nodes. ``before``
    counts its values ahead of ``h`` in that order, first those of no other node. With
    ``needed`` or more of them left from ``h`` on, two such nodes share one of the
    listed. ``rank`` is the part that no other node holds.
    """
    common = work.store(items.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"), "common")
    mine = Window.partitionBy("rep")
    ranked = items.join(common, "h").select(
        "rep", "n", "m", "needed", "h",
        F.row_number().over(mine.orderBy("c", "h")).alias("place"),
        F.greatest(F.col("m") - F.count("*").over(mine), F.lit(0)).alias("own"),
    )
    return work.store(
        ranked.select(
            "rep", "n", "m", "needed", "h", (F.col("own") + F.col("place") - 1).alias("before"), (F.col("own") / F.col("m")).alias("rank")
        ).filter("m - before >= needed"),
        "rarest",
    )


def set_items(sets: DataFrame, threshold: float) -> DataFrame:
    """Whole ``sets (rep, n, hashes)`` as items: a similar set holds ``threshold`` of them."""
    return sets.select("rep", "n", F.col("n").alias("m"), _ceil_share("n", threshold).alias("needed"), F.explode("hashes").alias("h"))


def _stars(work: Work, lists: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b)`` of each list's member of the lowest rank with the others."""
    pivots = work.store(
        lists.groupBy("h").agg(F.min(F.struct("rank", "rep", "n")).alias("p"), F.count("*").alias("c"))
        .filter("c > 1").select("h", F.col("p.rep").alias("a"), F.col("p.n").alias("a_n")),
        "pivots",
    )
    return (
        lists.join(pivots, "h").filter(F.col("rep") != F.col("a")).filter(_comparable(threshold, "n", "a_n"))
        .select("a", F.col("rep").alias("b")).distinct()
    )


def linked(
    work: Work, items: DataFrame, sketches: DataFrame, sets: DataFrame, threshold: float, k: int = K,
    lists: DataFrame | None = None,
) -> DataFrame:
    """Links ``(a, b)`` that connect all similar ``sets (rep, hashes)``, not each of their pairs.

    ``items`` are those of the whole sets. First each member of a list is compared with the list's member of the lowest rank, in
    the lists of the rarest items and in further ``lists (rep, n, h, rank)``. Then
    members of different components are compared that meet under a rarest value:
    at the first one that two nodes share, what either has from there on bounds their overlap.
    """
    share = round(threshold * 10_000)
    listed = rarest(work, items)
    stars = _stars(work, listed, threshold)
    if lists is not None:
        stars = stars.union(_stars(work, lists, threshold)).distinct()
    first = _confirmed(work, stars, sketches, sets, threshold, k, "star")
    found = work.store(components(work, first, rounds=1), "found")  # enough to leave few pairs

    # Pairs between the components that still meet in a list.
    placed = work.store(
        listed.join(found, listed.rep == found.node, "left")
        .select("rep", "n", "h", (F.col("m") - F.col("before")).alias("rest"), F.coalesce("component", "rep").alias("component")),
        "placed",
    )
    mixed = work.store(
        placed.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low <> high").select("h"),
        "mixed",
    )
    left = work.store(placed.join(mixed, "h"), "left")
    right = left.select("h", *(F.col(c).alias(f"b_{c}") for c in ("rep", "n", "rest", "component")))
    between = (
        left.join(right, "h").filter("component <> b_component and rep < b_rep")
        .filter(f"least(rest, b_rest) * {10_000 + share} >= {share} * (n + b_n)")
        .filter(_comparable(threshold, "n", "b_n")).select(F.col("rep").alias("a"), F.col("b_rep").alias("b")).distinct()
    )
    return first.union(_confirmed(work, between, sketches, sets, threshold, k, "between"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, k: int = K
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer
    than five words has one shingle, the whole sequence. Null, empty and blank
    texts have none: they are linked with nothing and kept. A null id is never linked: its
    component is null and it is kept. Rows repeated with one id and one text are kept all or
    none; those of one id with different texts are judged each by its own. The component is the smallest id it holds, which is the one kept; an
    empty table gives an empty one. Ids may be structs. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    with Work(spark, "near-dups") as work:
        rows = work.store(sketches(docs, id_col, text_col, k), "sketches")
        known = rows.filter("n > 0 and id is not null")
        found = work.store(
            known.groupBy("f1", "f2").agg(F.min("id").alias("doc"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")),
            "nodes",
        )
        # Nodes go by half of their fingerprint, unless two share it.
        apart = found.groupBy("f1").count().filter("count > 1").isEmpty()
        node = (F.col("f1") if apart else F.struct("f1", "f2")).alias("rep")
        members = work.keep(rows.select("id", "n", F.when(F.expr("n > 0 and id is not null"), node).alias("rep")), "members")
        nodes = found.select(node, "doc", "n", "sketch")

        # Nodes that share enough retained values with others.
        needed = F.when(F.col("n") <= threshold * k, _ceil_share("n", threshold)).otherwise(
            F.ceil(F.lit(SHARED) * F.least(F.col("n"), F.lit(k)))
        )
        retained = nodes.select("rep", "n", F.size("sketch").cast("long").alias("m"), needed.cast("long").alias("needed"), F.explode("sketch").alias("h"))
        listed = work.store(retained.groupBy("h").count().filter("count > 1").select("h"), "lists")
        likely = work.store(
            retained.join(listed, "h").groupBy("rep").agg(F.count("*").alias("shared"), F.max("needed").alias("needed"))
            .filter("shared >= needed").select("rep"),
            "likely",
        )
        likely = work.store(nodes.join(likely, "rep"), "likely-nodes")
        items = likely.select("rep", "n", F.size("sketch").cast("long").alias("m"), needed.cast("long").alias("needed"), F.explode("sketch").alias("h"))

        texts = docs.select(key(docs, id_col)[0].alias("doc"), F.col(text_col).cast("string").alias("t"))
        asked = likely.select("doc").distinct()
        sets = full_sets(texts.join(asked, "doc", "left_semi").select("t")).select(node, "hashes")
        sets = work.store(sets.dropDuplicates(["rep"]), "sets")
        stars = rarest(work, items).select("rep", "n", "h", "rank")
        counted = sets.join(likely.select("rep", "n"), "rep")
        links = linked(work, set_items(counted, threshold), likely.select("rep", "n", "sketch"), sets, threshold, k, stars)
        groups = work.store(components(work, links), "groups")
        # The smallest id of each component, by way of its nodes.
        grouped = work.store(groups.join(likely.select(F.col("rep").alias("node"), "doc"), "node"), "grouped")
        first = grouped.groupBy("component").agg(F.min("doc").alias("label"))
        labels = grouped.join(first, "component").select(F.col("node").alias("rep"), "label")
        labels = work.keep(nodes.join(labels, "rep", "left").select("rep", F.coalesce("label", "doc").alias("component_id")), "labels")
    result = members.join(labels, "rep", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
