"""Token counts, with overlap resynchronisation for huge texts.

A text up to ``CHUNK`` characters is encoded whole. A longer one is encoded in chunks that
overlap, with offsets. Two neighbours are spliced at a position of their overlap where
both begin a token and which is proven stable: no vocabulary piece holds its two
characters side by side, so no merge of any context can reach across it, nor can
what lies beyond a chunk's ends change the tokens on this side. If an
overlap has no such position, it is widened until one is found or the text ends.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

CHUNK = 32_768
OVERLAP = 256
SPACE = "▁"  # stands for a space in the pieces


class Encoder:
    """A sentencepiece model and the pairs of characters that its pieces can join."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i).replace(SPACE, " ") for i in range(self.model.vocab_size()))
        self.joined = {piece[i : i + 2] for piece in pieces for i in range(len(piece) - 1)}

    def stable(self, text: str, at: int) -> bool:
        return text[at - 1 : at + 1] not in self.joined

    def starts(self, text: str, begin: int, stop: int) -> list[int]:
        """Where the tokens of a chunk begin, as places in the whole text."""
        data = text[begin:stop].encode()
        pieces = self.model.encode(text[begin:stop], return_type="proto").pieces
        # The library's offsets count bytes.
        place = np.cumsum((np.frombuffer(data + b" ", np.uint8) & 0xC0) != 0x80) - 1
        return (begin + place[[p.begin for p in pieces]]).tolist()

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if len(text) <= chunk:
            return len(self.model.encode(text))
        total, begin, splice = 0, 0, 0
        stop, now = chunk, None
        while True:
            now = now or self.starts(text, begin, stop)
            if stop >= len(text):
                return total + sum(s >= splice for s in now)
            width, found = overlap, None
            while found is None:
                # The next chunk begins ``width`` before the end of this one.
                next_begin = max(stop - width, splice)
                next_stop = min(next_begin + max(chunk, 2 * width), len(text))
                after = self.starts(text, next_begin, next_stop)
                common = set(now) & set(after)
                found = next(
                    (p for p in range(next_begin + 1, stop) if p > splice and p in common and self.stable(text, p)), None
                )
                if found is None:
                    if next_begin == splice:  # the whole chunk is one run: lengthen it instead
                        stop = min(stop + max(chunk, stop - begin), len(text))
                        now = self.starts(text, begin, stop)
                        if stop >= len(text):
                            return total + sum(s >= splice for s in now)
                        width = overlap
                    else:
                        width *= 2
            total += sum(splice <= s < found for s in now)
            begin, stop, splice, now = next_begin, next_stop, found, after


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_counts(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row: UTF-8 bytes, and tokens without begin or end.

    Null and empty texts have none of either. Null ids and repeated rows are counted like others; an
    empty table gives an empty one; other columns aren't read. Special strings in a text are
    ordinary text, as the library has it.
    """

    def run(batches):
        own = encoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = some.column(1).to_pylist()
                short = [i for i, t in enumerate(texts) if len(t) <= chunk]
                counts = [0] * len(texts)
                for i, ids in zip(short, own.model.encode([texts[i] for i in short], num_threads=1)):
                    counts[i] = len(ids)
                for i in set(range(len(texts))) - set(short):
                    counts[i] = own.count(texts[i], chunk, overlap)
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
