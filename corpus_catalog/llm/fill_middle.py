"""Fill-in-middle transformation: texts cut at two line boundaries, found by a learned rank index.

The boundaries of all lines of a run of texts, as offsets in code points, are one ascending
table: rank in, offset out. ``RankIndex`` stores it as a piecewise-linear model: each
segment is a line from its first boundary on that misses no boundary by more than
``error``, and what it misses is kept as a residual of one byte. A cut is predicted
by its segment and corrected by its residual, which gives the exact offset.

Each text is cut twice, at ranks that a hash of its id chooses, and written in one of two
orders: ``psm`` is prefix, suffix, middle, ``spm`` is suffix, prefix, middle. A text that
holds one of the marks, or is empty, stays ``plain``, so that every output can be undone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpus_catalog.llm import shingles as S

#: What a segment may miss by, in code points; residuals must fit in a byte.
ERROR = 100
#: Boundaries looked at together while a segment grows.
STEP = 512
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class RankIndex:
    """Ascending whole numbers by rank: linear segments and the residuals that make them exact."""

    def __init__(self, values: np.ndarray, error: int = ERROR):
        if not 0 <= error <= 126:
            raise ValueError("error must be between 0 and 126")
        values = np.asarray(values, np.int64)
        first, slope, at = [], [], 0
        while at < len(values):
            first.append(at)
            best, at = self._segment(values, at, error)
            slope.append(best)
        self.first = np.array(first, np.int64)
        self.base = values[self.first]
        self.slope = np.array(slope)
        self.residual = (values - self._predicted(np.arange(len(values)))).astype(np.int8)

    @staticmethod
    def _segment(values: np.ndarray, begin: int, error: int) -> tuple[float, int]:
        """Slope of the longest segment from ``begin``, and the first rank after it: the cone of slopes shrinks until it is empty."""
        low, high, at = 0.0, np.inf, begin + 1
        while at < len(values):
            stop = min(at + STEP, len(values))
            run = np.arange(at, stop) - begin
            rise = (values[at:stop] - values[begin]).astype(float)
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            empty = np.flatnonzero(lows > highs)
            fits = int(empty[0]) if len(empty) else stop - at
            if fits:
                low, high = float(lows[fits - 1]), float(highs[fits - 1])
            at += fits
            if len(empty):
                break
        return (low + high) / 2 if np.isfinite(high) else low, at

    def _predicted(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.first, ranks, side="right") - 1
        return self.base[segment] + np.rint(self.slope[segment] * (ranks - self.first[segment])).astype(np.int64)

    def __getitem__(self, ranks: np.ndarray) -> np.ndarray:
        return self._predicted(ranks) + self.residual[ranks]


def boundaries(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts joined: all boundaries in order, each text's first rank among them, and its number of lines.

    A text of n lines has n + 1 boundaries, its own begin and the end of each line.
    """
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = np.append(0, ends[:-1])
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lines = np.union1d(np.flatnonzero(points == 10) + 1, ends[ends > starts])
    before = np.searchsorted(lines, starts, side="right")
    return (
        np.sort(np.concatenate([starts, lines])),
        before + np.arange(len(texts)),
        np.searchsorted(lines, ends, side="right") - before,
    )


def _numbers(key: str) -> list[int]:
    digest = hashlib.sha256(key.encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def cut(ids: list, texts: list[str], seed: int, rate: int, spm: int, error: int) -> list[tuple]:
    """``(lines, form, prefix, middle, output)`` of each text."""
    offsets, first, lines = boundaries(texts)
    index = RankIndex(offsets, error)
    drawn = [_numbers(f"{seed}:{'' if i is None else i}") for i in ids]
    ranks = np.array([sorted((h[0] % (n + 1), h[1] % (n + 1))) for h, n in zip(drawn, lines.tolist())], np.int64).reshape(-1, 2)
    places = index[first[:, None] + ranks] - index[first][:, None]
    found = []
    for text, n, h, (a, b) in zip(texts, lines.tolist(), drawn, places.tolist()):
        if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= rate:
            found.append((n, "plain", None, None, text))
        elif h[3] % 100 < spm:
            found.append((n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"))
        else:
            found.append((n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"))
    return found


def fill_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, error: int = ERROR
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row: its lines, how it is cut, and the new text.

    ``rate`` per cent of the texts are cut, ``spm`` per cent of those are written suffix
    first. Null and empty texts are plain and empty, with no lines. A null id is hashed as an empty one; rows
    repeated with one id are cut by the same numbers. A text of any length is cut whole, in
    the memory of one task: some eight bytes a character. An empty table gives an empty one; other columns aren't read.
    """

    def run(batches):
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for begin, stop in S.chunks(texts):
                found = cut(ids[begin:stop], texts[begin:stop], seed, rate, spm, error)
                n, form, prefix, middle, output = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, stop - begin),
                        pa.array(n, pa.int64()),
                        pa.array(form, pa.string()),
                        pa.array(prefix, pa.int64()),
                        pa.array(middle, pa.int64()),
                        pa.array(output, pa.string()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No cut text holds a mark, so the marks are where they were put."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


#: The query's rows, for DuckDB.
SQL = r"""
with texts as (
    select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as s from documents
),
units as (
    select *, case when t = '' then [] else regexp_extract_all(t, '[^\n]*\n|[^\n]+') end as u,
        cast('0x' || s[1:8] as bigint) as h1, cast('0x' || s[9:16] as bigint) as h2,
        cast('0x' || s[17:24] as bigint) as h3, cast('0x' || s[25:32] as bigint) as h4
    from texts
),
cuts as (
    select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
            when h4 % 100 < 50 then 'spm' else 'psm' end as form
    from units
),
parts as (
    select *, coalesce(array_to_string(u[1 : a], ''), '') as prefix, coalesce(array_to_string(u[a + 1 : b], ''), '') as middle,
        coalesce(array_to_string(u[b + 1 : n], ''), '') as suffix
    from cuts
)
select doc_id, cast(n as bigint) as n, form,
    case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(t) as restored_sha256
from parts
"""
