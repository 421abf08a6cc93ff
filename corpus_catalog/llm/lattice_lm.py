"""Language-model scores from a subword lattice.

A text's words are split into pieces of an existing vocabulary; a word has many
segmentations, and its probability is the sum over all of them, by a forward
recursion in log space over the lattice of pieces. Pieces don't reach across
words, so a text's marginal probability is the product over its words and its end.

The vocabulary's own scores (ranks) give the first piece probabilities; one round of expectation
maximisation over the training texts makes them fit the corpus. Both it and the scoring
work on distinct words with their counts: what is shuffled grows with the
vocabulary of the corpus. The sums over a text need each word's score back:
the ``TOP`` most frequent words (16 bytes each, so at most 6 MB with their counts) go to all
tasks, the rare rest is joined by the word's hash.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpus_catalog.llm import shingles as S
from corpus_catalog.llm.common import Work

#: Words whose scores go to every task.
TOP = 1 << 18
#: Words longer than this are segmented one by one, in bytes.
LONG = 64
#: Weight of the vocabulary's own scores against the counted pieces.
PRIOR = 1e-3
_SPACE = "▁"
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_random = np.random.default_rng(11)
_MUL = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The usable pieces of a vocabulary as bytes: those without inner spaces, and all single bytes."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: dict[bytes, float] = {}
        for i in range(model.vocab_size()):
            text = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            if text.strip(_SPACE) and _SPACE not in text[1:]:
                piece = text.replace(_SPACE, " ").encode()
                pieces[piece] = max(pieces.get(piece, 0.0), 1 / (10 - model.get_score(i)))
        least = min(pieces.values(), default=1.0)
        for b in range(256):  # any text can be segmented
            pieces.setdefault(bytes([b]), least / 10)
        self.names = list(pieces)
        weight = np.array(list(pieces.values()))
        self.prior = weight / weight.sum()
        self.at = {p: i for i, p in enumerate(self.names)}
        self.longest = max(map(len, self.names))
        self.single = np.array([self.at[bytes([b])] for b in range(256)])
        # Open addressing over hashes of the longer pieces.
        self.mask = (1 << (4 * len(self.names)).bit_length()) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.ids = np.full(self.mask + 1, -1, np.int32)
        for i, p in enumerate(self.names):
            if len(p) > 1:
                h = np.zeros(1, np.uint64)
                for b in p:
                    h = (h + _MUL[b]) * _STEP
                slot = int(S.mix(h)[0]) & self.mask
                while self.ids[slot] >= 0:
                    slot = (slot + 1) & self.mask
                self.keys[slot], self.ids[slot] = h[0], i

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, or -1."""
        slot = (S.mix(h) & np.uint64(self.mask)).astype(np.int64)
        found = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        while len(todo):
            ids = self.ids[slot]
            hit = (ids >= 0) & (self.keys[slot] == h[todo])
            found[todo[hit]] = ids[hit]
            go = (ids >= 0) & ~hit
            todo, slot = todo[go], (slot[go] + 1) & self.mask
        return found


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    return Pieces(path)


def _sum_logs(rows: list[np.ndarray]) -> np.ndarray:
    if len(rows) == 1:
        return rows[0]
    stack = np.stack(rows)
    most = stack.max(0)
    return most + np.log(np.exp(stack - most).sum(0))


def lattice(pieces: Pieces, logp: np.ndarray, words: np.ndarray, count: np.ndarray | None = None):
    """Log probability of words of one length (rows of bytes), all segmentations summed.

    With ``count`` also the expected number of each piece, words weighted by it.
    """
    n, length = words.shape
    alpha = [np.zeros(n)]
    arcs: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
    # Hash of every span, extended byte by byte for all starts at once.
    spans: dict[int, np.ndarray] = {}
    padded = np.append(logp, -np.inf)
    for j in range(1, length + 1):
        last = _MUL[words[:, j - 1]]
        spans = {i: (h + last) * _STEP for i, h in spans.items() if j - i <= pieces.longest}
        spans[j - 1] = last * _STEP
        here = []
        for i, h in spans.items():
            found = pieces.single[words[:, i]] if j - i == 1 else pieces.find(h)
            if j - i == 1 or (found >= 0).any():
                here.append((i, found, padded[found]))
        alpha.append(_sum_logs([alpha[i] + lp for i, _, lp in here]))
        arcs.append(here if count is not None else [])
    if count is None:
        return alpha[-1], None
    expected = np.zeros(len(logp))
    into: list[list[np.ndarray]] = [[] for _ in range(length)]
    beta = np.zeros(n)
    for j in range(length, 0, -1):
        if j < length:
            beta = _sum_logs(into[j])
        for i, found, lp in arcs[j - 1]:
            into[i].append(lp + beta)
            share = count * np.exp(alpha[i] + lp + beta - alpha[-1])
            has = found >= 0
            expected += np.bincount(found[has], share[has], len(logp))
    return alpha[-1], expected


def long_word(pieces: Pieces, logp: np.ndarray, word: bytes, count: float | None = None):
    """The same for one word of any length."""
    n = len(word)
    alpha, arcs = [0.0] + [-math.inf] * n, []
    for j in range(1, n + 1):
        for i in range(max(0, j - pieces.longest), j):
            k = pieces.at.get(word[i:j])
            if k is not None:
                a, b = alpha[j], alpha[i] + logp[k]
                alpha[j] = b + math.log1p(math.exp(a - b)) if b >= a else a + math.log1p(math.exp(b - a))
                if count is not None:
                    arcs.append((i, j, k))
    if count is None:
        return alpha[n], None
    expected, beta = np.zeros(len(logp)), [-math.inf] * n + [0.0]
    for i, j, k in reversed(arcs):
        through = logp[k] + beta[j]
        expected[k] += count * math.exp(alpha[i] + through - alpha[n])
        a = beta[i]
        beta[i] = through + math.log1p(math.exp(a - through)) if through >= a else a + math.log1p(math.exp(through - a))
    return alpha[n], expected


def _by_length(words: list[bytes]):
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for begin in range(0, len(at), 8192):
            yield int(size) + 1, at[begin : begin + 8192]


def _each(pieces: Pieces, logp: np.ndarray, words: list[bytes], counts: np.ndarray | None):
    """Log probabilities of words, and expected pieces if counted."""
    result, expected = np.empty(len(words)), np.zeros(len(logp))
    for size, at in _by_length(words):
        if size > LONG:
            for k in at:
                result[k], more = long_word(pieces, logp, b" " + words[k], None if counts is None else counts[k])
                expected += 0 if more is None else more
        else:
            rows = np.frombuffer(b"".join(b" " + words[k] for k in at), np.uint8).reshape(len(at), size)
            result[at], more = lattice(pieces, logp, rows, None if counts is None else counts[at].astype(float))
            expected += 0 if more is None else more
    return result, expected


# --- steps over the corpus ---------------------------------------------------------


def _hashed(texts: list[bytes]):
    """Runs of texts: where each begins, their bytes, and text, start, end, hash of every word."""
    for begin, stop in S.chunks(texts):
        data = b"\n".join(texts[begin:stop]) + b"\n"
        start, end, value = S.words(np.frombuffer(data, np.uint8))
        ends = np.cumsum([len(t) + 1 for t in texts[begin:stop]])
        yield begin, stop, data, np.searchsorted(ends, start, side="right"), start, end, value.view(np.int64)


def word_counts(rows: DataFrame) -> DataFrame:
    """``h, word, c`` of ``rows (text, train)``: distinct words, and how often training texts have them.

    Tasks add up what they read before it is shuffled, a bounded number of words at a time.
    """

    def run(batches):
        known: dict[int, list] = {}

        def flush():
            yield pa.RecordBatch.from_arrays(
                [pa.array(known, pa.int64()), pa.array([v[0] for v in known.values()], pa.binary()), pa.array([v[1] for v in known.values()], pa.int64())],
                ["h", "word", "c"],
            )

        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            train = np.array(batch.column(1).to_pylist(), bool)
            for begin, _, data, owner, start, end, value in _hashed(texts):
                each, first, inverse = np.unique(value, return_index=True, return_inverse=True)
                counts = np.bincount(inverse, train[begin + owner], len(each)).astype(np.int64)
                for h, k, c in zip(each.tolist(), first.tolist(), counts.tolist()):
                    have = known.get(h)
                    if have is None:
                        known[h] = [data[start[k] : end[k]].translate(_UPPER), c]
                    else:
                        have[1] += c
                if len(known) > 200_000:
                    yield from flush()
                    known.clear()
        if known:
            yield from flush()

    partial = rows.mapInArrow(run, "h long, word binary, c long")
    return partial.groupBy("h", "word").agg(F.sum("c").alias("c"))


def _expected_pieces(words: DataFrame, path: str, logp: np.ndarray) -> DataFrame:
    """``k, n``: how often each piece is expected in the training words."""

    def run(batches):
        pieces, total = vocabulary(path), np.zeros(len(logp))
        for batch in batches:
            total += _each(pieces, logp, batch.column(0).to_pylist(), batch.column(1).to_numpy())[1]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["k", "n"])

    found = words.select("word", "c").mapInArrow(run, "k long, n double")
    return found.groupBy("k").agg(F.sum("n").alias("n"))


def _scored(words: DataFrame, path: str, logp: np.ndarray) -> DataFrame:
    """``h, c, lp`` of ``words (h, word, c)``: with the log10 probability of each word."""

    def run(batches):
        pieces = vocabulary(path)
        for batch in batches:
            result, _ = _each(pieces, logp, batch.column(1).to_pylist(), None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(result / math.log(10))], ["h", "c", "lp"]
            )

    return words.select("h", "word", "c").mapInArrow(run, "h long, c long, lp double")


def _partial_scores(rows: DataFrame, top: np.ndarray) -> DataFrame:
    """Sums over each text's frequent words; its other words with their counts in ``rest``."""
    order = np.argsort(top["h"])
    top = top[order]

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, train = batch.column(0), batch.column(2)
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for begin, stop, _, owner, _, _, value in _hashed(texts):
                n = stop - begin
                place = np.minimum(np.searchsorted(top["h"], value), max(0, len(top) - 1))
                hit = top["h"][place] == value if len(top) else np.zeros(len(value), bool)
                sums = [np.bincount(owner[hit], top[f][place[hit]], n) for f in ("lp", "base", "known")]
                order = np.lexsort((value[~hit], owner[~hit]))
                who, what = owner[~hit][order], value[~hit][order]
                fresh = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (what[1:] != what[:-1])][: len(who)])
                often = np.diff(np.append(fresh, len(who)))
                offsets = np.searchsorted(who[fresh], np.arange(n + 1)).astype(np.int32)
                rest = pa.StructArray.from_arrays([pa.array(what[fresh]), pa.array(often, pa.int64())], ["h", "n"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((part << 40) + at + np.arange(n), pa.int64()),
                        ids.slice(begin, n),
                        pa.array([not x for x in train.slice(begin, n).to_pylist()], pa.bool_()),
                        pa.array(np.bincount(owner, minlength=n).astype(np.int64) + 1),
                        *(pa.array(s) for s in sums),
                        pa.ListArray.from_arrays(pa.array(offsets), rest),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "lp", "base", "known", "rest"],
                )
                at += n

    return rows.mapInArrow(
        run,
        "row long, doc_id long, held_out boolean, n_tokens long, lp double, base double, known double, "
        "rest array<struct<h: long, n: long>>",
    )


def score(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", top: int = TOP, rounds: int = 1
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Learns from the rows whose crc32 of the id as text is not 2 modulo 7; a null id counts
    as an empty text there. Words are split at ASCII white space and lower-cased in A-Z; every text has an end
    token too. A null, empty or blank text has that only. ``base_score`` is the smoothed word
    model, ``score`` the lattice's log10 probability. Repeated rows are learned from
    and scored as often as they come; an empty table gives an empty one; other columns aren't read.
    """
    pieces = vocabulary(vocabulary_path)
    with Work(docs.sparkSession, "lattice") as work:
        rest = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7
        rows = docs.select(
            F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), (rest != 2).alias("train")
        )
        words = work.store(word_counts(rows.select("t", "train")), "words")
        ends = rows.filter("train").count()
        seen, kinds = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        tokens, distinct = seen + ends, kinds + (ends > 0)

        p, end = pieces.prior, ends or 1
        logp, log_end = np.log(p / 2), math.log(0.5)
        for _ in range(rounds if seen else 0):
            counted = np.zeros(len(p))
            for k, n in _expected_pieces(words.filter("c > 0"), vocabulary_path, logp).collect():  # one row per piece at most
                counted[k] = n
            total = counted.sum()
            p = (counted + PRIOR * total * pieces.prior) / (total * (1 + PRIOR) + end)
            logp, log_end = np.log(p), math.log(end / (total * (1 + PRIOR) + end))

        scored = work.keep(_scored(words, vocabulary_path, logp), "scored")
        # The least count that keeps the frequent words within the bound.
        sizes = scored.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c"))
        least, held = None, 0
        for c, n in work.store(sizes, "sizes").filter("c > 1").orderBy(F.desc("c")).limit(top).collect():
            if held + n > top:
                break
            least, held = c, held + n
        frequent = scored.filter(F.col("c") >= least).toArrow() if least is not None else None
        base = -math.log10(tokens + distinct + 1)
        table = np.zeros(held, [("h", np.int64), ("lp", float), ("base", float), ("known", float)])
        if frequent is not None:
            table["h"], table["lp"] = frequent["h"].to_numpy(), frequent["lp"].to_numpy()
            table["base"] = np.log10(frequent["c"].to_numpy() + 1) + base
            table["known"] = 1
        partial = work.keep(_partial_scores(rows, table), "partial")
    others = partial.select("row", F.inline("rest")).join(scored, "h").groupBy("row").agg(
        F.sum(F.col("lp") * F.col("n")).alias("o_lp"),
        F.sum((F.log10(F.col("c") + 1) + base) * F.col("n")).alias("o_base"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("o_known"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return partial.drop("rest").join(others, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + zero("o_known") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("o_base") + math.log10(ends + 1) + base).alias("base_score"),
        (F.col("lp") + zero("o_lp") + log_end / math.log(10)).alias("score"),
    )
