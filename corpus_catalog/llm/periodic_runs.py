"""Periodic runs of words, from Lyndon arrays that Baier's grouping yields.

A run is a maximal stretch with a smallest period q; reported are those of at least
``max(MIN_LENGTH, MIN_REPEATS * q)`` words.

1.  *Pieces.* In such a run every 3-word sequence comes again q words later, all
    through but its last q + 2 words. Stretches of a text whose 3-word sequences come again that
    soon, for that long, are the only ones that can hold a run, and hold it whole;
    the rest of the text has none. Most texts end here.
2.  *Grouping.* Phase one of the suffix sorter: suffixes are grouped by first word, groups
    are taken from the highest to the lowest, and each moves the nearest lower
    suffix before every member into a new group just above that suffix's own. When a group's turn
    comes, its common prefix is the longest Lyndon word that begins there. Done for words in
    ascending and in descending order.
3.  *Extension.* The first words of every run hold one of these Lyndon words as its root.
    Each root is extended both ways as far as words q apart are equal, by binary
    descent over the ranks of all stretches of 1, 2, 4, ... words. Long enough
    ones are the runs; equal finds are one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MIN_LENGTH, MIN_REPEATS = 6, 4
GRAM = 3


def lyndon_lengths(word: list[int]) -> np.ndarray:
    """Length of the longest Lyndon word that begins at each place, by Baier's grouping."""
    n = len(word)
    symbols = sorted(set(word))
    number = {w: g for g, w in enumerate(symbols)}
    group = [number[w] for w in word]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    length = [1] * len(symbols)
    lower = list(range(-1, len(symbols) - 1))  # the next lower group
    upper = list(range(1, len(symbols) + 1))
    upper[-1] = -1
    found = np.empty(n, np.int64)
    before = [-2] * n  # the nearest place before with a lower suffix; -2 while its group waits
    at = len(symbols) - 1
    while at >= 0:
        size = length[at]
        hits: dict[int, dict[int, list[int]]] = {}  # group -> how often -> places that members lead to
        place, times = -1, 0
        own = [i for i in members[at] if group[i] == at]
        members[at] = []
        for i in own:
            found[i] = size
            p = i - 1
            while p >= 0 and before[p] != -2:
                p = before[p]
            before[i] = p
            if p == place:
                times += 1
                continue
            if place >= 0:
                hits.setdefault(group[place], {}).setdefault(times, []).append(place)
            place, times = p, 1
        if place >= 0:
            hits.setdefault(group[place], {}).setdefault(times, []).append(place)
        for low, by_times in hits.items():
            for count in sorted(by_times, reverse=True):  # more copies of the prefix: higher
                new, above = len(members), upper[low]
                members.append(by_times[count])
                length.append(length[low] + count * size)
                lower.append(low)
                upper.append(above)
                upper[low] = new
                if above >= 0:
                    lower[above] = new
                for p in by_times[count]:
                    group[p] = new
        at = lower[at]
    return found


class Extension:
    """How far words at two places agree, onward and backward: ranks of all stretches of 2^k words."""

    def __init__(self, word: np.ndarray):
        self.n = len(word)
        self.ranks = [np.unique(word, return_inverse=True)[1].astype(np.int64)]
        while 2 ** len(self.ranks) <= self.n:
            last, width = self.ranks[-1], 2 ** (len(self.ranks) - 1)
            both = last[:-width] * (int(last.max()) + 1) + last[width:]
            self.ranks.append(np.unique(both, return_inverse=True)[1].astype(np.int64))

    def onward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from a and b > a on."""
        total = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[k]
            fits = np.flatnonzero(b + total < len(rank))
            some = fits[rank[a[fits] + total[fits]] == rank[b[fits] + total[fits]]]
            total[some] += 2**k
        return total

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words up to and with a and b > a."""
        total = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, width = self.ranks[k], 2**k
            fits = np.flatnonzero(a - total - width + 1 >= 0)
            left, right = a[fits] - total[fits] - width + 1, b[fits] - total[fits] - width + 1
            total[fits[rank[left] == rank[right]]] += width
        return total


def runs_of(word: np.ndarray, min_length: int = 2, min_repeats: int = 2) -> np.ndarray:
    """``start, length, period`` of every run of at least ``min_length`` words and ``min_repeats`` periods, in order."""
    n = len(word)
    extension, parts = Extension(word), []
    for order in (word, -word):
        period = lyndon_lengths(order.tolist())
        root = np.arange(n)
        inside = np.flatnonzero(root + period < n)  # a root that ends the text has its copies before it
        onward, backward = np.zeros(n, np.int64), np.zeros(n, np.int64)
        onward[inside] = extension.onward(root[inside], root[inside] + period[inside])
        inner = np.flatnonzero(root > 0)
        backward[inner] = extension.backward(root[inner] - 1, root[inner] + period[inner] - 1)
        start, length = root - backward, backward + period + onward
        good = (length >= min_length) & (length >= min_repeats * period)
        parts.append(np.stack([start[good], length[good], period[good]], axis=1))
    found = np.unique(np.concatenate(parts), axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def pieces(word: np.ndarray) -> list[tuple[int, int]]:
    """Stretches, apart from each other, that hold every reported run whole."""
    n = len(word)
    if n < MIN_LENGTH:
        return []
    gram = word[: n - GRAM + 1].astype(np.int64)
    for k in range(1, GRAM):
        both = gram * (int(word.max()) + 1) + word[k : n - GRAM + 1 + k]
        gram = np.unique(both, return_inverse=True)[1] if k < GRAM - 1 else both
    order = np.argsort(gram, kind="stable")
    again = np.full(len(gram), n, np.int64)  # words until the same sequence comes again
    same = np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
    again[order[same]] = order[same + 1] - order[same]
    spans, width = [], 1
    while MIN_REPEATS * (least_period := width // 2 + 1) <= n:  # periods from there up to width
        needed = max(MIN_LENGTH, MIN_REPEATS * least_period) - least_period - GRAM + 1
        near = np.concatenate([[False], again <= width, [False]])
        edge = np.flatnonzero(near[1:] != near[:-1])
        begin, stop = edge[::2], edge[1::2]
        long = stop - begin >= needed
        spans += zip(begin[long].tolist(), np.minimum(stop[long] + width + GRAM - 1, n).tolist())
        width *= 2
    merged: list[tuple[int, int]] = []
    for begin, stop in sorted(spans):
        if merged and begin <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(stop, merged[-1][1])
        else:
            merged.append((begin, stop))
    return merged


def text_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """``start, length, period`` of the reported runs of a text, by start, then period."""
    if len(words) < MIN_LENGTH:
        return []
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return []
    word = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    found = []
    for begin, stop in pieces(word):
        own = np.unique(word[begin:stop], return_inverse=True)[1].astype(np.int64)
        found += [(begin + s, n, q) for s, n, q in runs_of(own, MIN_LENGTH, MIN_REPEATS).tolist()]
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without what any run holds beyond its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep))


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, made periodic from some word on in a tenth of the texts, which a hash of the id chooses."""
    h, n = 0 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rearrange=None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row: its runs (start, length, period), and the text without their repeats.

    Words are runs without ASCII white space, numbered from 0, compared as they are. Null, empty and short texts have
    no runs; the words of any text without runs come back joined by one space. ``rearrange(id, words)``
    may give the words to look at instead. Null ids and repeated rows are treated like others. A text
    of any length is looked at whole in the memory of one task, some hundred bytes a word and more where it
    is periodic. An empty table gives an empty one; other columns aren't read.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                n, flat, cuts, texts = [], [], [0], []
                for i, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    words = text.encode().split()
                    words = rearrange(i, words) if rearrange else words
                    runs = text_runs(words)
                    n.append(len(words))
                    flat += runs
                    cuts.append(len(flat))
                    texts.append(collapsed(words, runs).decode())
                triples = np.array(flat, np.int64).reshape(-1, 3)
                each = pa.StructArray.from_arrays([pa.array(triples[:, k]) for k in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), each), pa.array(texts, pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return rows.mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )


def digest(found: DataFrame) -> DataFrame:
    """One row per row of ``periodic_runs``: its number of runs, its longest run, and hashes of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("order"), r.start.alias("start"), r.period.alias("period"))))
    one = found.select("doc_id", "n_words", "collapsed", F.size("runs").cast("long").alias("n_runs"), lines.alias("lines"), longest.alias("best"))
    length: Column = -F.col("best.order")
    return one.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.expr("(-1000 * best.order) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
