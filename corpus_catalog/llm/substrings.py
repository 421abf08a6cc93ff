"""Substring dedup by MinHash banding of content-defined paragraphs.

A paragraph is a stretch of words between two places that the words around them
choose: where a hash of three words is the least within ``REACH`` words on either side. Line
ends don't count, so a passage is cut alike in a line of its own, wrapped
over many, or in the middle of a longer one, but for its two ends. Paragraphs have 13 words on
average, so a passage of 50 words holds a whole one in 96 of 100 cases, and two copies of it
collide.

1.  Each paragraph's signature has ``BANDS x ROWS`` minimums over its 5-word shingles.
    Paragraphs with equal sets are one node, so copies cost one row each. Equal
    ones agree in every band; at a similarity of 0.8 two miss all bands once in a hundred times (0.2 ** 3).
2.  Different nodes that agree in a band are compared by the exact Jaccard similarity of their
    shingles; see ``near_dups.linked`` for how large lists are compared
    without forming all pairs. Links form components, of which the first
    paragraph by (id, place) stays.
3.  Neighbouring paragraphs that go are one span. It is extended at both ends, word by word, as far as the
    text goes on like that of the paragraph that stays. Spans of ``min_words`` or more are removed;
    shorter ones are phrases and stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from corpus_catalog.llm import shingles as S
from corpus_catalog.llm.common import Work, free_name, key
from corpus_catalog.llm.components import components
from corpus_catalog.llm.near_dups import K, linked, set_items

REACH = 6
BANDS, ROWS = 3, 1
MIN_WORDS = 30
#: Words of a paragraph at most; one without a place to cut, such as one word over and over, is cut by count.
LONGEST = 48
#: Lists of places up to this size go to the texts instead of the texts to them.
BROADCAST_BYTES = 32 << 20

_random = np.random.default_rng(7)
_FACTOR = _random.integers(1, 2**63, BANDS * ROWS + 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERM = _random.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_NONE = np.uint64(2**64 - 1)


def cuts(value: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where paragraphs begin among words with hashes ``value``, which lie in ascending ``text``."""
    n = len(value)
    gram = np.full(n, _NONE)
    if n >= 3:
        whole = text[2:] == text[:-2]
        mixed = S.mix(value[:-2] * _FACTOR[-1] + value[1:-1] * _FACTOR[-2] + value[2:] * _FACTOR[-3])
        gram[:-2] = np.where(whole, mixed, _NONE)
    least = gram != _NONE
    for step in range(1, min(REACH, n - 1) + 1):
        apart = text[step:] != text[:-step]
        least[step:] &= apart | (gram[step:] < gram[:-step])  # of equal ones the first
        least[:-step] &= apart | (gram[:-step] <= gram[step:])
    least |= np.r_[True, text[1:] != text[:-1]][:n]
    begin = np.flatnonzero(least)
    extra = (np.diff(np.append(begin, n)) - 1) // LONGEST
    more = [np.arange(b + LONGEST, b + LONGEST * e + 1, LONGEST) for b, e in zip(begin[extra > 0], extra[extra > 0])]
    return np.sort(np.concatenate([begin, *more])) if more else begin


def _words(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: the first one's place; of each word its hash, its text in the run and its number in that text."""
    for begin, stop in S.chunks(texts):
        joined = np.frombuffer(b"\n".join(texts[begin:stop]) + b"\n", np.uint8)
        start, _, value = S.words(joined)
        ends = np.cumsum([len(t) + 1 for t in texts[begin:stop]])
        text = np.searchsorted(ends, start, side="right")
        first = np.searchsorted(text, np.arange(stop - begin))
        yield begin, value, text, np.arange(len(value)) - first[text]


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat.view(np.int64)))


def _paragraphs(texts: list[bytes]):
    """Of each run of texts: per paragraph of 5 words or more its text, number in it, first word, size; where its hashes begin, and all hashes."""
    for at, value, text, number in _words(texts):
        if not len(value):
            continue
        begin = cuts(value, text)
        size = np.diff(np.append(begin, len(value)))
        own = text[begin]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        place = np.arange(len(begin)) - np.repeat(first, np.diff(np.append(first, len(begin))))
        owner, found = S.shingle_groups(np.repeat(np.arange(len(begin)), size), value)
        long = size[owner] >= S.WIDTH
        owner, found = owner[long], found[long]
        order = np.lexsort((found, owner))
        owner, found = owner[order], found[order]
        fresh = np.r_[True, (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])][: len(owner)]
        owner, found = owner[fresh], found[fresh]
        cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)])
        if len(cut):
            kept = owner[cut]
            yield at + own[kept], place[kept], number[begin[kept]], size[kept], cut, found


def _node(found: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Number of each set of hashes; sets that differ have the same one once in 10^19 pairs."""
    own = found.view(np.uint64)
    sums = np.add.reduceat(S.mix(own + np.uint64(1)), cut)
    return S.mix(sums ^ S.mix(np.add.reduceat(S.mix(own ^ np.uint64(0x9E3779B97F4A7C15)), cut))).view(np.int64)


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, place, first, size, node, bands`` of every paragraph: number in its text, first word, words, set, band hashes."""

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for text, place, first, size, cut, found in _paragraphs(texts):
                own = found.view(np.uint64)
                bands = np.empty((len(cut), BANDS), np.uint64)
                for b in range(BANDS):
                    value = np.full(len(cut), b, np.uint64)
                    for p in range(b * ROWS, (b + 1) * ROWS):
                        value = S.mix(value ^ np.minimum.reduceat(own * _FACTOR[p] + _TERM[p], cut))
                    bands[:, b] = value
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(text)),
                        pa.array(place.astype(np.int32)),
                        pa.array(first.astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                        pa.array(_node(found, cut)),
                        _lists(bands.ravel(), np.full(len(cut), BANDS)),
                    ],
                    ["id", "place", "first", "size", "node", "bands"],
                )

    ids, kind = key(docs, id_col)
    rows = docs.select(ids.alias("id"), F.col(text_col).cast("string"))
    return rows.filter("id is not null").mapInArrow(run, f"id {kind}, place int, first int, size int, node long, bands array<long>")


def paragraph_sets(texts: DataFrame) -> DataFrame:
    """``rep, hashes`` of the paragraphs numbered in ``places`` of ``texts (t, places)``: their nodes and sets."""

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            wanted = [set(places) for places in batch.column(1).to_pylist()]
            for text, place, _, _, cut, found in _paragraphs(texts):
                node, stop = _node(found, cut), np.append(cut[1:], len(found))
                own = np.flatnonzero([p in wanted[t] for t, p in zip(text.tolist(), place.tolist())])
                if len(own):
                    flat = np.concatenate([found[cut[i] : stop[i]] for i in own])
                    yield pa.RecordBatch.from_arrays([pa.array(node[own]), _lists(flat, (stop - cut)[own])], ["rep", "hashes"])

    return texts.select("t", "places").mapInArrow(run, "rep long, hashes array<long>")


def stretches(texts: DataFrame) -> DataFrame:
    """``id, at, before, after`` for each number in ``asked`` of ``texts (id, t, asked)``: hashes of the words ahead of that word and from it on.

    At most ``LONGEST + REACH`` on either side, the ones ahead last word first.
    """
    reach = LONGEST + REACH

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            asked = batch.column(2).to_pylist()
            for begin, value, text, _ in _words(texts):
                edge = np.searchsorted(text, np.arange(text[-1] + 2)) if len(text) else np.zeros(1, np.int64)
                ids, ats, before, after = [], [], [], []
                for own in range(len(edge) - 1):
                    words = value[edge[own] : edge[own + 1]]
                    for at in asked[begin + own]:
                        ids.append(begin + own)
                        ats.append(at)
                        before.append(words[max(0, at - reach) : at][::-1])
                        after.append(words[at : at + reach])
                if ids:
                    sides = [_lists(np.concatenate(x), np.array([len(w) for w in x])) for x in (before, after)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(ats, pa.int32()), *sides], ["id", "at", "before", "after"])

    kind = key(texts, "id")[1]
    return texts.select("id", "t", "asked").mapInArrow(run, f"id {kind}, at int, before array<long>, after array<long>")


def _with_lists(texts: DataFrame, lists: DataFrame, column: str) -> DataFrame:
    """``texts (id, t)`` with the list of numbers that ``lists (id, column)`` has for them; others are left out."""
    size = int(lists.agg(F.coalesce(F.sum(80 + 4 * F.size(column)), F.lit(0))).first()[0])
    return texts.join(F.broadcast(lists) if size <= BROADCAST_BYTES else lists.hint("merge"), "id")


def _equal_words(mine: str, theirs: str) -> Column:
    """How many words two lists begin with alike."""
    differs = F.zip_with(mine, theirs, lambda x, y: ~x.eqNullSafe(y))
    found = F.array_position(differs, F.lit(True))
    return F.when(found > 0, found - 1).otherwise(F.least(F.size(mine), F.size(theirs))).cast("int")


def repeated_paragraphs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, min_words: int = MIN_WORDS
) -> DataFrame:
    """Spans to remove: ``id, first, size, first_id, first_first``, in words from 0.

    ``first_*`` is where the paragraph that stays, of the component of the span's first one, begins. Null, empty and
    short texts have no paragraphs; rows without an id are left alone. Rows repeated
    with one id count as one document. Passages repeated inside one document are
    removed too. Ids may be structs. An empty table gives an empty one; other columns aren't read. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    texts = docs.select(key(docs, id_col)[0].alias("id"), F.col(text_col).cast("string").alias("t")).filter("id is not null")
    with Work(spark, "substrings") as work:
        found = work.store(paragraphs(docs, id_col, text_col), "paragraphs")
        where = F.struct("id", "first", "place")
        reps = work.store(
            found.groupBy("node").agg(F.min(where).alias("rep"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")), "reps"
        )

        # Nodes that agree in a band with another one.
        banded = reps.select(F.col("node").alias("rep"), F.explode("bands").alias("h"))
        shared = work.store(banded.groupBy("h").count().filter("count > 1").select("h"), "shared")
        lists = work.store(banded.join(shared, "h"), "lists")
        reps = reps.drop("bands")
        # The paragraph that collides in most bands is the likeliest origin of the others.
        hits = work.store(lists.groupBy("rep").agg((-F.count("*")).alias("rank")), "hits")
        asked = work.store(
            hits.join(reps, hits.rep == reps.node).groupBy(reps.rep["id"].alias("id")).agg(F.collect_set(reps.rep["place"]).alias("places")),
            "asked",
        )
        sets = paragraph_sets(_with_lists(texts, asked, "places")).dropDuplicates(["rep"]).withColumn("n", F.size("hashes").cast("long"))
        sets = work.store(sets, "sets")
        sketches = sets.select("rep", "n", F.slice("hashes", 1, K).alias("sketch"))
        ranked = lists.join(hits, "rep").join(sets.select("rep", "n"), "rep")
        links = linked(work, set_items(sets, threshold), sketches, sets, threshold, lists=ranked)
        groups = work.store(components(work, links), "groups")

        # The first paragraph of each component; without links, of each node that has copies.
        grouped = work.store(groups.join(reps, "node"), "grouped")
        first = grouped.groupBy("component").agg(F.min("rep").alias("stays"))
        labels = grouped.join(first, "component").select("node", "stays")
        alone = reps.filter("copies > 1").join(groups, "node", "left_anti").select("node", F.col("rep").alias("stays"))
        labels = work.store(labels.union(alone), "labels")
        goes = found.drop("bands").join(labels, "node").filter(F.struct("id", "first", "place") != F.col("stays"))
        goes = work.store(goes.select("id", "place", "first", "size", "stays").distinct(), "goes")
        work.release(found)

        # Neighbours that go are one span.
        order = Window.partitionBy("id").orderBy("place")
        opens = F.coalesce(F.lag("place").over(order) != F.col("place") - 1, F.lit(True)).cast("int")
        numbered = goes.withColumn("opens", opens).withColumn("span", F.sum("opens").over(order))
        ends = F.struct("first", "size", "stays")
        spans = numbered.groupBy("id", "span").agg(F.min(ends).alias("a"), F.max(ends).alias("b"))
        spans = work.store(
            spans.select(
                "id", "span", F.col("a.first").alias("first"), (F.col("b.first") + F.col("b.size")).cast("int").alias("stop"),
                F.col("a.stays").alias("a_stays"), (F.col("b.first")).alias("b_first"), F.col("b.stays").alias("b_stays"),
            ),
            "spans",
        )
        # Where both texts go on: ahead of the first paragraph, and after the last one's first word.
        points = spans.select(
            F.explode(
                F.array(
                    F.struct(F.col("id"), F.col("first").alias("at")), F.struct(F.col("id"), F.col("b_first").alias("at")),
                    F.struct(F.col("a_stays.id").alias("id"), F.col("a_stays.first").alias("at")),
                    F.struct(F.col("b_stays.id").alias("id"), F.col("b_stays.first").alias("at")),
                )
            ).alias("p")
        ).select("p.*")
        asked = work.store(points.distinct().groupBy("id").agg(F.collect_list("at").alias("asked")), "points")
        sides = work.store(stretches(_with_lists(texts, asked, "asked")).dropDuplicates(["id", "at"]), "sides")

        def side(name: str, own: str) -> DataFrame:
            return sides.select(F.col("id").alias(f"{name}_id"), F.col("at").alias(f"{name}_at"), F.col(own).alias(name))

        def met(spans: DataFrame, name: str, own: str, at: str, of: str) -> DataFrame:
            return spans.join(side(name, own), (F.col(of) == F.col(f"{name}_id")) & (F.col(at) == F.col(f"{name}_at")), "left")

        ahead = met(met(spans, "x", "before", "first", "id"), "y", "before", "a_stays.first", "a_stays.id")
        ahead = work.store(ahead.select(*spans.columns, F.coalesce(_equal_words("x", "y"), F.lit(0)).alias("ahead")), "ahead")
        behind = met(met(ahead, "x", "after", "b_first", "id"), "y", "after", "b_stays.first", "b_stays.id")
        alike = F.coalesce(_equal_words("x", "y"), F.lit(0))
        extended = behind.select(
            "id", "a_stays", "first", (F.col("first") - F.col("ahead")).alias("begin"), F.greatest("stop", F.col("b_first") + alike).alias("end")
        )
        # In the text that stays, a span must not reach into its own copy.
        own = F.col("a_stays.id") == F.col("id")
        begin = F.when(own & (F.col("a_stays.first") < F.col("first")), F.greatest("begin", F.col("a_stays.first") + 1)).otherwise(F.col("begin"))
        result = work.keep(
            extended.withColumn("begin", begin).filter(F.col("end") - F.col("begin") >= min_words).select(
                "id", F.col("begin").cast("int").alias("first"), (F.col("end") - F.col("begin")).cast("int").alias("size"),
                F.col("a_stays.id").alias("first_id"), F.col("a_stays.first").alias("first_first"),
            ),
            "result",
        )
    return result


@arrow_udf(StringType())
def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without spans of words; where one was, a line ends if one did, else a space stays."""
    left = []
    for text, gone in zip(text.to_pylist(), spans.to_pylist()):
        if text is None or not gone:
            left.append(text)
            continue
        data = text.encode()
        start, end, _ = S.words(np.frombuffer(data, np.uint8))
        pieces, at, after = [], 0, 0
        for first, size in sorted((s["first"], s["size"]) for s in gone):
            first, stop = max(first, after), min(first + size, len(start))
            if stop <= first:
                continue
            pieces.append(data[at : start[first]].rstrip(b" \t\n\v\f\r"))
            hole = data[end[first - 1] if first else 0 : start[stop] if stop < len(start) else len(data)]
            at, after = int(start[stop]) if stop < len(start) else len(data), stop
            pieces.append(b"\n" if b"\n" in hole else b" ")
        pieces.append(data[at:])
        left.append(b"".join(pieces).strip(b" \t\n\v\f\r").decode())
    return pa.array(left, pa.string())


def without_repeats(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated passages; a text of which nothing is left goes.

    The other columns stay as they are, but for ``n_chars``, which follows the text.
    """
    own, spans, left = (free_name(docs, n) for n in ("spans_id", "spans", "left_text"))
    gone = repeats.groupBy(F.col("id").alias(own)).agg(F.collect_set(F.struct("first", "size")).alias(spans))
    changed = F.col(spans).isNotNull()
    # Only changed texts go through Python.
    joined = docs.join(gone, F.col(id_col) == F.col(own), "left")
    joined = joined.withColumn(left, _cut(F.when(changed, F.col(text_col).cast("string")), F.col(spans)))
    kept = joined.filter(~changed | F.col(left).rlike(r"[^\x20\x09-\x0D]"))
    kept = kept.withColumn(text_col, F.when(changed, F.col(left)).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.length(text_col).cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)
