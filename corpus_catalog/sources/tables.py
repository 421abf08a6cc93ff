"""Tables between steps: intermediate results, snapshots, documents."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from corpus_catalog.schemas import CACHE

_local_dirs: dict[str, str] = {}
_scratch = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="corpus-catalog-")
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpus_catalog/{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read Parquet without a schema inference job."""
    return spark.read.schema(schema).parquet(path)


def _at(spark: SparkSession, path: str):
    """File system and path object."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _at(spark, path)
    fs.delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a compact intermediate table to the shared folder and read it back.

    Cuts the lineage, so neither later branches nor a lost executor read the
    file contents again.
    """
    path = new_path(df.sparkSession, name)
    if getattr(_scratch, "paths", None) is not None:
        _scratch.paths.append(path)
    df.write.parquet(path)
    return read(df.sparkSession, path, df.schema)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drop the intermediate tables of this block when it ends.

    For work whose results are all written inside the block, such as one
    micro-batch of an endless stream.
    """
    outer, _scratch.paths = getattr(_scratch, "paths", None), []
    try:
        yield
    finally:
        paths, _scratch.paths = _scratch.paths, outer
        for path in paths:
            delete(spark, path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a table that is read in fewer tasks than there are cores.

    Only a table of a few files is moved; a large one already has many tasks.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


# --- numbered snapshots ------------------------------------------------------


def _snapshot_ids(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete snapshots below ``root``."""
    fs, base = _at(spark, root)
    if not fs.exists(base):
        return []
    found = []
    for status in fs.listStatus(base):
        name = status.getPath().getName()
        if name.startswith("snapshot=") and exists(spark, f"{root}/{name}/_SUCCESS"):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def snapshots(spark: SparkSession, root: str, before: int | None = None) -> list[int]:
    return [n for n in _snapshot_ids(spark, root) if before is None or n < before]


def snapshot_path(root: str, number: int) -> str:
    return f"{root}/snapshot={number}"


def write_snapshot(df: DataFrame, root: str, number: int | None = None, by: tuple = ()) -> int:
    """Write the next (or given) snapshot; a snapshot being read is never touched.

    Writing the same number again replaces it, which makes retries idempotent.
    """
    if number is None:
        existing = snapshots(df.sparkSession, root)
        number = existing[-1] + 1 if existing else 0
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(snapshot_path(root, number))
    return number


def read_snapshot(
    spark: SparkSession, root: str, schema: StructType, number: int | None = None
) -> DataFrame:
    """A snapshot, by default the latest; an empty frame if there is none."""
    if number is None:
        existing = snapshots(spark, root)
        if not existing:
            return spark.createDataFrame([], schema)
        number = existing[-1]
    return read(spark, snapshot_path(root, number), schema)


# --- documents ---------------------------------------------------------------


def write_documents(docs: DataFrame, path: str) -> None:
    """One text folder per repo; its files, in order by name, are the document, one part each.

    Parts are range partitioned, so those of a large document are written by several
    tasks, and files are named by task and place.  The text writer ends every file
    with the newline between the parts, and the last one with that of the document.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(docs.select("repo", "part", "content"), "document-parts")
    last = parts.groupBy("repo").agg(F.max("part").alias("last"))
    text = F.when(F.col("part") == F.col("last"), F.regexp_replace("content", r"\n\z", ""))
    (
        parts.join(last, "repo")
        # The newline before an empty last part ends the document.
        .filter((F.col("part") < F.col("last")) | (F.col("content") != "") | (F.col("part") == 0))
        .select("repo", "part", F.coalesce(text, "content").alias("content"))
        .repartitionByRange(n, "repo", "part")
        .sortWithinPartitions("repo", "part")
        .drop("part")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", 1)
        .partitionBy("repo")
        .text(path)
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents as written, ``(repo, part, content)``; joining the contents gives the document."""
    name = F.col("_metadata.file_name")
    files = spark.read.schema("value string, repo string").text(path, wholetext=True).select(
        "repo",
        F.regexp_extract(name, r"^part-([0-9]+)", 1).cast("bigint").alias("task"),
        F.regexp_extract(name, r"\.?c([0-9]+)\.txt", 1).cast("bigint").alias("place"),
        F.col("value").alias("content"),
    )
    # Numbered without the contents: a row per file.
    order = Window.partitionBy("repo").orderBy("task", "place")
    numbers = files.select("repo", "task", "place", (F.row_number().over(order) - 1).cast("bigint").alias("part"))
    return files.join(numbers, ["repo", "task", "place"]).select("repo", "part", "content")


# --- cache entries as JSON ------------------------------------------------------


def parse_cache(lines: DataFrame) -> DataFrame:
    """Cache rows from JSON ``value`` strings; a corrupt entry counts as absent."""
    entry = F.from_json("value", CACHE, {"mode": "PERMISSIVE"})
    return (
        lines.select(entry.alias("entry"))
        .select("entry.*")
        .filter(F.col("path").isNotNull() & F.col("approx_tokens").isNotNull())
    )
