"""Directory ingest: source trees below a shared folder as a files table.

Spark's own file sources skip names starting with ``_`` or ``.``, which would
lose ``__init__.py`` and dotfiles.  Directories are listed in rounds: each round is one job
over the directories found so far, dealt out anew, and a task that has listed its share
hands the rest on to the next round.  So neither the driver nor the task that
happens to hold the largest repo or the deepest directory lists alone.

Files are read in pieces, with a running hash.  A file above ``hold_bytes`` is never held: it gives its
hash, its size and what the gate needs, but no content.
"""

from __future__ import annotations

import hashlib
import os
import stat
import sys
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpus_catalog import config as C
from corpus_catalog.schemas import FILES
from corpus_catalog.sources import tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What a round finds: files with their size, and directories still to be listed.
LISTING = T.StructType(
    [
        T.StructField("place", T.StringType()),  # relative to the folder
        T.StructField("bytes", T.LongType()),
        T.StructField("open", T.BooleanType()),
    ]
)
_LISTING_ARROW = to_arrow_schema(LISTING)
_FILES_ARROW = to_arrow_schema(FILES)
_SKIPPED = ".git"  # version-control data; a pointer file of this name is kept
_TASK_BYTES = 128 << 20
_BATCH_BYTES = 4 << 20
_PIECE_BYTES = 1 << 20
_PATH_BYTES = 1024  # a longer path is opened in steps, since systems limit its length
#: Directories that a task lists in the first round, and at most in a later one.
FIRST_SHARE, LARGEST_SHARE = 64, 16_384


@contextmanager
def _opened(root: str, place: str, flags: int) -> Iterator[int]:
    """Descriptor of ``place`` below ``root``, however long the path is."""
    fd = os.open(root, os.O_RDONLY if place else flags)
    try:
        parts = deque(place.split("/") if place else [])
        while parts:
            step = [parts.popleft()]
            size = len(os.fsencode(step[0]))
            while parts and size + len(os.fsencode(parts[0])) < _PATH_BYTES:
                size += len(os.fsencode(parts[0])) + 1
                step.append(parts.popleft())
            last, fd = fd, os.open("/".join(step), os.O_RDONLY if parts else flags, dir_fd=fd)
            os.close(last)
        yield fd
    finally:
        os.close(fd)


def _entries(root: str, place: str) -> Iterator[tuple[str, int | None]]:
    """Name and size of the files in a directory; None as size: a directory.  One that can't be listed is empty."""
    try:
        with _opened(root, place, os.O_RDONLY | os.O_DIRECTORY) as fd, os.scandir(fd) as entries:
            for entry in entries:
                try:
                    is_dir = entry.is_dir()
                except OSError:
                    is_dir = False
                if is_dir:
                    if entry.name != _SKIPPED and not entry.is_symlink():
                        yield entry.name, None
                    continue
                try:
                    status = entry.stat()
                except OSError:
                    yield entry.name, 0  # a dangling link is listed; reading it gives no content
                    continue
                if stat.S_ISREG(status.st_mode):  # no pipes, no devices
                    yield entry.name, status.st_size
    except OSError:
        return


def _list(root: str, share: int):
    """Lists the given directories and what is below, breadth first; hands on what is left of ``share`` directories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, listed, rows = deque(), 0, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [(), (), ()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LISTING_ARROW)], schema=_LISTING_ARROW)

        for found in batches:
            waiting.extend(found.column(0).to_pylist())
        while waiting and listed < share:
            place, listed = waiting.popleft(), listed + 1
            for name, size in _entries(root, place):
                below = f"{place}/{name}" if place else name
                if size is None:
                    waiting.append(below)
                else:
                    rows.append((below, size, False))
                if len(rows) >= 10_000:
                    yield batch()
        while waiting:
            rows.append((waiting.popleft(), None, True))
            if len(rows) >= 10_000:
                yield batch()
        if rows:
            yield batch()

    return run


def list_trees(spark: SparkSession, folder: str, first_share: int = FIRST_SHARE) -> DataFrame:
    """``(place, bytes)`` of every file below ``folder``, places relative to it; stored."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    path, share, rounds = tables.new_path(spark, "listing"), first_share, 0
    places = spark.range(1).select(F.lit("").alias("place"))
    while True:
        found = places.repartition(tasks, "place").mapInArrow(_list(folder, share), LISTING)
        found.write.parquet(f"{path}/round={rounds}")
        places = tables.read(spark, f"{path}/round={rounds}", LISTING).filter("open").select("place")
        if places.isEmpty():
            break
        rounds, share = rounds + 1, min(4 * share, LARGEST_SHARE)
    return tables.read(spark, path, LISTING).filter("not open").select("place", "bytes")


class _Lines:
    """Counts the lines of a file given in pieces, with all the line ends of text files."""

    ENDS = (b"\n", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\xc2\x85", b"\xe2\x80\xa8", b"\xe2\x80\xa9")
    PAIR = b"\r\n"  # one end, not two

    def __init__(self):
        self.ends, self.tail = 0, b""

    def _count(self, end: bytes, piece: bytes) -> int:
        reach = len(end) - 1
        across = (self.tail[-reach:] + piece[:reach]).count(end) if reach else 0
        return across + piece.count(end)

    def add(self, piece: bytes) -> None:
        self.ends += sum(self._count(end, piece) for end in self.ENDS) - self._count(self.PAIR, piece)
        self.tail = (self.tail + piece)[-3:]

    def total(self) -> int:
        return self.ends + (self.tail != b"" and not self.tail.endswith(self.ENDS))


def _read(root: str, place: str, hold_bytes: int) -> dict:
    """Content or, of a file too large to hold, what is known of it; hash, size and error."""
    hashed, size, window, lines, held = hashlib.sha256(), 0, b"", _Lines(), []
    try:
        with _opened(root, place, os.O_RDONLY | os.O_NONBLOCK) as fd:
            while piece := os.read(fd, _PIECE_BYTES):
                hashed.update(piece)
                size += len(piece)
                window += piece[: C.BINARY_WINDOW_BYTES - len(window)]
                lines.add(piece)
                if size <= hold_bytes:
                    held.append(piece)
                else:
                    held.clear()
    except FileNotFoundError:
        return {}
    except OSError as problem:
        return {"read_error": problem.strerror or type(problem).__name__}
    found = {"size": size, "source_hash": hashed.hexdigest()}
    if size <= hold_bytes:
        return found | {"content": b"".join(held)}
    return found | {"unheld": {"binary": b"\0" in window, "lines": lines.total()}}


def _contents(root: str, repo: str | None, hold_bytes: int):
    """Reads the listed files, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for place in batch.column(0).to_pylist():
                own, _, path = (repo, "", place) if repo else place.partition("/")
                found = _read(root, place, hold_bytes)
                rows.append({"repo": own, "path": path, **found})
                held += len(found.get("content") or b"")
                if held > _BATCH_BYTES or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_FILES_ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_FILES_ARROW)

    return run


def read_trees(spark: SparkSession, path: str, repo: str | None = None, hold_bytes: int = C.HOLD_BYTES) -> DataFrame:
    """Files table of a folder of repos, or with ``repo`` of that one repo; every executor must reach the folder.

    A dangling link has neither content nor error; a file that can't be read has its error.
    Files directly in a folder of repos belong to none and are left out.
    """
    listing = list_trees(spark, path)
    if repo is None:
        listing = listing.filter(F.col("place").contains("/"))
    cores = spark.sparkContext.defaultParallelism
    total = listing.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = max(cores, -(-total // _TASK_BYTES))
    return listing.select("place").repartition(tasks, "place").mapInArrow(_contents(path, repo, hold_bytes), FILES)
