"""Benchmark decontamination: size-partitioned MinHash containment, in DataFrame functions only.

A test item is leaked by a text that holds at least ``threshold`` of the item's
distinct 5-word shingles. Items and texts are sketched with one hash function.

An item keeps its ``K`` smallest hashes. A long text holds many other shingles, so a
sketch of fixed size would lose a short item in it. Texts are therefore
partitioned by size, in powers of two, and items by theirs; a text of a partition
up to ``u`` shingles retains for items of at least ``q`` shingles its smallest
``u * 2K / q`` hashes, which cover the item's smallest ``K`` but for a chance of
about one in ten thousand for the last of them. A pair that shares ``HITS`` values is a candidate, and its
whole shingle sets decide. At a containment of 0.8 fewer than 4 of 16 are shared
twice in ten million pairs.

The item sketches are a stored table of ``K`` rows per item; Spark broadcasts it
if its size is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpus_catalog.llm.common import Work, let, lower_ascii, words

K, HITS = 16, 4
WIDTH = 5


def shingles(text: Column) -> Column:
    """Distinct hashes of the 5-word shingles of a text; none if it has fewer words."""
    return let(
        words(lower_ascii(text)),
        lambda w: F.when(
            F.size(w) >= WIDTH,
            F.array_distinct(
                F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.xxhash64(*(w[i + k] for k in range(WIDTH))))
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def _power(n: str) -> Column:
    """Largest power of two up to ``n``."""
    return F.expr(f"cast(shiftleft(1L, cast(floor(log2({n})) as int)) as long)")


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = 0.8,
) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item``: every text that holds a test item, and how much of it.

    Words are lower-cased in A-Z and split at ASCII white space. Items of fewer than
    five words, empty and null ones leak nowhere; null and empty texts hold nothing. Rows without an id are not reported. Rows
    repeated with one id count as one, by the most that one of them holds. Empty
    tables give an empty one; other columns aren't read.
    """
    share = round(threshold * 10_000)
    with Work(docs.sparkSession, "leaks") as work:
        tests = work.keep(
            items.filter(F.col(item_id).isNotNull())
            .select(F.col(item_id).alias("item_id"), shingles(F.col(item_text)).alias("set"))
            .filter(F.size("set") > 0).dropDuplicates(["item_id", "set"])
            .select("item_id", "set", F.size("set").cast("long").alias("q")).withColumn("q_low", _power("q")),
            "items",
        )
        sketch = work.store(
            tests.select("item_id", "q", "q_low", F.explode(F.slice(F.sort_array("set"), 1, K)).alias("v")), "item-sketches"
        )
        least = sketch.agg(F.min("q_low")).first()[0] or 1  # the widest part any text retains
        text = F.col(text_col).cast("string")
        sized = (
            docs.filter(F.col(id_col).isNotNull())
            .select(F.col(id_col).alias("doc_id"), F.sort_array(shingles(text)).alias("set"))
            .filter(F.size("set") > 0)
            .withColumn("u", 2 * _power("size(set)"))
        )
        retained = sized.select(
            "doc_id", "u", F.posexplode(F.expr(f"slice(set, 1, cast(least(size(set), ceil(u * {2 * K} / {least})) as int))"))
        )
        hits = (
            retained.join(sketch, retained.col == sketch.v).filter(f"pos < ceil(u * {2 * K} / q_low)")
            .groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"), F.max("q").alias("q"))
        )
        candidates = work.keep(hits.filter(f"hits >= least({HITS}, q)").select("doc_id", "item_id"), "candidates")
        ids = work.keep(candidates.select("doc_id").distinct(), "ids")
    suspect = docs.join(ids, docs[id_col] == ids.doc_id, "left_semi").select(
        F.col(id_col).alias("doc_id"), shingles(text).alias("doc_set")
    )
    shared = F.size(F.array_intersect("set", "doc_set")).cast("long")
    return (
        candidates.join(suspect, "doc_id").join(tests, "item_id")
        .select("doc_id", "item_id", shared.alias("n_shared"), F.col("q").alias("n_item"))
        .filter(F.col("n_shared") * 10_000 >= F.col("n_item") * share)
        .groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
    )


#: The same by exact shingles, for DuckDB.
LEAKS_SQL = r"""
with texts as (
    select 'd' as kind, doc_id as id, text from documents union all select 'i', item_id, text from benchmark
),
split as (
    select kind, id, [x for x in regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+')
        if x <> ''] as w
    from texts where id is not null
),
places as (select kind, id, w, unnest(range(1, len(w) - 3)) as i from split where len(w) >= 5),
shingle as (select distinct kind, id, array_to_string(w[i : i + 4], ' ') as s from places),
size as (select id as item_id, count(*) as n_item from shingle where kind = 'i' group by id)
select d.id as doc_id, i.id as item_id, count(*) as n_shared, any_value(n_item) as n_item
from shingle d join shingle i on d.kind = 'd' and i.kind = 'i' and d.s = i.s join size on item_id = i.id
group by d.id, i.id having 10 * count(*) >= 8 * any_value(n_item)
"""
