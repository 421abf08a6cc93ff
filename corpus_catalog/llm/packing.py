"""Best-fit packing of token sequences.

Best-fit decreasing needs one view of all pieces, but pieces of equal length are
alike and lengths are bounded by the sequence, so the view is a histogram. The
driver packs the histogram (at most one entry per length): a segment tree over the remaining
capacities finds the tightest open bins for a length in logarithmic time, and
runs of equal bins are filled at once. What comes out is a short list of runs; a piece's
rank among those of its length tells its bin and offset.

Ranks need neither a sort nor a shuffle of the pieces: each task counts its own
per length, stored with the pieces, and adds what the tasks before it have.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from corpus_catalog.llm.common import Work

LENGTH = 2048
END = 0


# --- tokens --------------------------------------------------------------------


def _bytes_of_characters() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable ones stand for
    themselves, the rest for characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def byte_encoder(path: str):
    """Function from a text to its ids, for a byte-level BPE file of the ``tokenizers`` library.

    The file's own vocabulary is run by ``tiktoken``, which gives the same ids four times
    as fast (7.9 against 1.9 MB a second); a probe makes sure when the worker starts.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    byte = _bytes_of_characters()
    ranks = {bytes(byte[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
    fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    probe = " It's  a tést,\n\t2024: 日本 <|endoftext|>x\r\n don't 🙂  "
    if fast.encode(probe, allowed_special="all") != Tokenizer.from_file(path).encode(probe, add_special_tokens=False).ids:
        raise ValueError(f"{path} is not a plain byte-level vocabulary")
    return lambda text: fast.encode_to_numpy(text, allowed_special="all") if text else np.empty(0, np.uint32)


def pieces(docs: DataFrame, path: str, id_col: str, text_col: str, length: int, end: int, keep_ids: bool) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, rank`` and, if asked for, ``ids`` (little-endian 32-bit).

    A text's ids and one ``end``; if they are more than ``length``, every piece but the first is full.
    ``rank`` counts the pieces of equal length within the task ``part``.
    """
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, rank long"
    schema += ", ids binary" if keep_ids else ""

    def run(batches):
        encode, part, seen = byte_encoder(path), TaskContext.get().partitionId(), [0] * (length + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                some = batch.slice(at, 500)
                for key, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    ids = np.append(encode(text), end).astype("<u4")
                    first = len(ids) % length or length
                    cuts = [0, *range(first, len(ids) + 1, length)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        data = ids[a:b].tobytes()
                        rows.append((key, i, a, b - a, zlib.crc32(data), part, seen[b - a], data)[: 7 + keep_ids])
                        seen[b - a] += 1
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), TYPES)]
                yield pa.RecordBatch.from_arrays(columns, NAMES[: 7 + keep_ids])

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return rows.mapInArrow(run, schema)


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]


# --- the plan --------------------------------------------------------------------


class Tightest:
    """Segment tree over remaining capacities: the smallest that is open and large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        node = capacity + self.size
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def at_least(self, need: int) -> int | None:
        node = need + self.size
        if self.open[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Runs of best-fit decreasing: rows ``length, rank, bin, per bin, offset``.

    The piece of rank ``r`` in the run that begins at ``rank`` lies in bin
    ``bin + (r - rank) // per bin``, after ``offset`` and the run's earlier pieces there.
    """
    runs, bins, tree = [], 0, Tightest(capacity)
    left: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # runs of bins by remaining capacity

    def put(start: int, count: int, remaining: int) -> None:
        if count and remaining:
            left[remaining].append((start, count))
            if len(left[remaining]) == 1:
                tree.set(remaining, True)

    for size in sorted(histogram, reverse=True):
        rank, count = 0, histogram[size]
        while count:
            remaining = tree.at_least(size)
            if remaining is None:
                remaining = capacity
                start, free = bins, -(-count // (capacity // size))
                bins += free
            else:
                start, free = left[remaining].pop()
                if not left[remaining]:
                    tree.set(remaining, False)
            per = remaining // size  # the bin just used is the tightest until it's full
            runs.append((size, rank, start, per, capacity - remaining))
            full, rest = min(count // per, free), 0
            if full < free:
                rest = count - full * per
            put(start, full, remaining - per * size)
            if full < free:
                put(start + full, 1, remaining - rest * size)
                put(start + full + 1, free - full - 1, remaining)
            count -= full * per + rest
            rank += full * per + rest
    return np.array(runs, np.int64).reshape(-1, 5)


def place(runs: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of pieces, by binary search among the runs."""
    shift = np.int64(2**48)
    run = runs[np.searchsorted(runs[:, 0] * shift + runs[:, 1], length * shift + rank, side="right") - 1]
    into = rank - run[:, 1]
    return run[:, 2] + into // run[:, 3], run[:, 4] + into % run[:, 3] * length


# --- the operator ------------------------------------------------------------------


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end: int = END,
    keep_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece, ``ids`` too if asked for.

    Null and empty texts give the one id ``end``. Null ids and repeated rows are packed like
    any others, each row once. An empty table gives an empty one; other columns aren't read.
    """
    with Work(docs.sparkSession, "packing") as work:
        cut = work.keep(pieces(docs, tokenizer, id_col, text_col, length, end, keep_ids), "pieces")
        counts = work.store(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
        histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
        runs = plan(histogram, length)
        before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        ahead = work.keep(
            counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")), "ahead"
        )
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    extra = ["ids"] if keep_ids else []

    def run(batches):
        for batch in batches:
            bins, offset = place(
                runs, *(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(bins), pa.array(offset), *batch.columns[6:]],
                [*NAMES[:5], "sequence_id", "offset", *extra],
            )

    ranked = cut.join(ahead, ["length", "part"]).select(*NAMES[:5], (F.col("rank") + F.col("ahead")).alias("rank"), *extra)
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(run, schema + (", ids binary" if keep_ids else "")).withColumn("length", F.col("length").cast("long"))
