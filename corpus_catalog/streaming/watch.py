"""Watch mode: rebuild as file versions and settings of repos arrive.

Two append-only streams: file versions ``(repo, path, content, deleted, ts)`` and setting
versions ``(repo, kind, path, content, deleted, ts)``.  Settings decide which files
belong to a repo, by the rules of a scan; when they change, the stored paths of their
repo are judged again, so that files come and go without a new version.

State is a log of compact rows without contents: one delta per micro-batch,
folded into a base now and then, so a batch writes what it changed and not the
whole state.  Rows lie in buckets of repos, and a batch reads the buckets it
touches.  Deltas are numbered by batch id; a repeated batch replaces its own delta and
changes nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corpus_catalog import config as C
from corpus_catalog.functions import text as X
from corpus_catalog.operators import cache as K
from corpus_catalog.operators.document import documents
from corpus_catalog.operators.inventory import BEST_EFFORT, scan
from corpus_catalog.operators.summarize import packed, summarize, unpacked
from corpus_catalog.plans.build import contents_of
from corpus_catalog.schemas import FILE_VERSIONS, SETTING_VERSIONS, SUMMARY
from corpus_catalog.sources import rules as R, tables

FILE = "file"
# Kinds of settings.  Mode (``git`` or ``best_effort``), ignore rules and submodule definitions are contents, with an
# empty path; a submodule marker is a pointer file; a tracked path is one of the version-control listing.
MODE, RULES, SUBMODULES, MARKER, TRACKED = "mode", "rules", "submodules", "marker", "tracked"

# State store that ``drop_superseded`` needs, and that suits any large state.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STATE = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("source_hash", T.StringType()),
        T.StructField("cache_hit", T.BooleanType()),
        T.StructField("admitted", T.BooleanType()),
        T.StructField("is_priority", T.BooleanType()),
        T.StructField("summary", SUMMARY),
    ]
)
# Of two versions with one time stamp, a deletion wins, then the larger hash.
VERSION_ORDER = ["ts", "deleted", "source_hash"]
DOCUMENTS = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("part", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("scan_hash", T.StringType()),
    ]
)


def _stream(spark: SparkSession, landing: str, schema: T.StructType, max_files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(landing)


def read_versions(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    """Stream of file versions from Parquet files below ``landing``."""
    return _stream(spark, landing, FILE_VERSIONS, max_files)


def read_settings(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    """Stream of setting versions from Parquet files below ``landing``."""
    return _stream(spark, landing, SETTING_VERSIONS, max_files)


def version_keys(versions: DataFrame) -> DataFrame:
    """Versions without contents."""
    return versions.select(
        "repo",
        "path",
        "ts",
        F.coalesce("deleted", F.lit(False)).alias("deleted"),
        X.source_hash(F.col("content")).alias("source_hash"),
    )


# --- repeated deliveries ---------------------------------------------------------


class _Newest(StatefulProcessor):
    """Passes the versions of one path that are newer than any seen before; state is the newest one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "micros long, deleted boolean, source_hash string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.newest.get()
        # Nulls first: a version without time stamp or content is older than one with.
        order = lambda v: tuple((x is not None, x) for x in v)
        last = order(known) if known else None
        for version in sorted({(r.micros, r.deleted, r.source_hash) for r in rows}, key=order):
            if last is None or order(version) > last:
                last, known = order(version), version
                yield Row(repo=key[0], path=key[1], micros=version[0], deleted=version[1], source_hash=version[2])
        self.newest.update(tuple(known))

    def close(self) -> None:
        pass


def drop_superseded(versions: DataFrame) -> DataFrame:
    """Versions that are newer than every earlier delivery of their path; needs the RocksDB state store.

    A repeated delivery is dropped after any time, as is a late version that a newer one
    has overtaken.  State holds one version per path ever seen, deleted ones included, so
    that an old version cannot revive them.  A return to older content with a newer time passes.
    """
    return (
        version_keys(versions)
        .withColumn("micros", F.unix_micros("ts"))
        .groupBy("repo", "path")
        .transformWithState(
            _Newest(),
            "repo string, path string, micros long, deleted boolean, source_hash string",
            "append",
            "None",
        )
        .select("repo", "path", F.timestamp_micros("micros").alias("ts"), "deleted", "source_hash")
    )


def drop_redelivered(versions: DataFrame, delay: str = "7 days") -> DataFrame:
    """Drop versions that arrive again within ``delay`` of their arrival, without Python.

    Time and deletion flag belong to the key: a file that returns to an older
    content is a new version. The watermark runs over the time of arrival, which
    a restarted batch keeps, so a first delivery of any age passes; state holds the
    keys that arrived within ``delay``, and a later redelivery passes again.
    """
    return (
        version_keys(versions)
        .withColumn("arrived", F.current_timestamp())
        .withWatermark("arrived", delay)
        .dropDuplicatesWithinWatermark(["repo", "path", "ts", "source_hash", "deleted"])
        .drop("arrived")
    )


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write what is available to Parquet, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


# --- state ---------------------------------------------------------------------------


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("repo"), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Log:
    """Newest row per key, as numbered deltas and a base, in buckets of repos."""

    root: str
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int

    @property
    def deltas(self) -> str:
        return f"{self.root}/deltas"

    @property
    def bases(self) -> str:
        return f"{self.root}/bases"

    def _read(self, spark: SparkSession, root: str, numbers: list[int]) -> DataFrame:
        placed = T.StructType([*self.schema.fields, T.StructField("snapshot", T.LongType()), T.StructField("bucket", T.IntegerType())])
        paths = [tables.snapshot_path(root, n) for n in numbers]
        return spark.read.schema(placed).option("basePath", root).parquet(*paths)

    def read(self, spark: SparkSession, before: int | None = None, repos: DataFrame | None = None) -> DataFrame:
        """Newest row per key of all batches below ``before``.

        ``repos`` holds the repos of interest; the buckets of others are not
        read, and other repos in the same buckets are dropped before anything is shuffled.
        """
        bases = tables.snapshots(spark, self.bases, before)
        since = bases[-1] if bases else -1
        deltas = [n for n in tables.snapshots(spark, self.deltas, before) if n > since]
        parts = [self._read(spark, root, numbers) for root, numbers in ((self.bases, bases[-1:]), (self.deltas, deltas)) if numbers]
        if not parts:
            return spark.createDataFrame([], self.schema)
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if repos is not None:
            # At most as many numbers as there are buckets.
            touched = [r[0] for r in repos.select(_bucket(self.buckets)).distinct().collect()]
            rows = rows.filter(F.col("bucket").isin(touched)).join(repos, "repo", "left_semi")
        # A batch has one row per key, so the later batch has the newer one.
        whole = F.struct(*self.schema.fieldNames())
        return rows.groupBy(*self.keys).agg(F.max_by(whole, "snapshot").alias("row")).select("row.*")

    def write(self, rows: DataFrame, number: int) -> None:
        tables.write_snapshot(self._placed(rows), self.deltas, number, by=("bucket",))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows dealt by bucket: few files each, and a large bucket split over several tasks."""
        placed = rows.select(*self.schema.fieldNames(), _bucket(self.buckets).alias("bucket"))
        return placed.hint("rebalance", "bucket")

    def written(self, spark: SparkSession, number: int) -> DataFrame:
        return self._read(spark, self.deltas, [number]).drop("snapshot", "bucket")

    def fold(self, spark: SparkSession, number: int) -> None:
        """Write a base of everything up to ``number``."""
        rows = self.read(spark, before=number + 1)
        tables.write_snapshot(self._placed(rows), self.bases, number, by=("bucket",))


def _newer(newest: DataFrame, known: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Rows of ``newest`` that come after those of ``known``, with the known columns ``keep`` as ``known_*``."""
    renamed = known.select(*keys, *(F.col(c).alias(f"known_{c}") for c in dict.fromkeys([*order, *keep])))
    theirs = F.struct(*(F.col(f"known_{c}") for c in order))
    found = newest.join(renamed, keys, "left")
    return found.filter(F.col("known_ts").isNull() | (F.struct(*order) > theirs))


def _without_contents(batch: DataFrame) -> DataFrame:
    """Versions of files with their hash, and of settings with their content; every use of a batch itself reads all contents."""
    is_file = F.col("kind") == FILE
    return batch.select(
        "kind",
        "repo",
        "path",
        "ts",
        F.coalesce("deleted", F.lit(False)).alias("deleted"),
        F.when(is_file, X.source_hash(F.col("content"))).alias("source_hash"),
        F.when(~is_file, F.col("content")).alias("content"),
    )


@dataclass(frozen=True)
class Watch:
    """Where a watch keeps its state, and its settings.

    ``landing`` holds the file versions for good; a path that changed settings admit is read
    from there.  Without it, such a path waits for its next version.
    """

    root: str
    landing: str | None = None
    default_rules: tuple[str, ...] = tuple(C.DEFAULT_IGNORE_RULES)
    fold_every: int = 20
    buckets: int = 64
    broadcast_rows: int = C.BROADCAST_ROWS
    part_bytes: int = C.PART_BYTES

    @property
    def files_log(self) -> Log:
        return Log(f"{self.root}/files", STATE, ("repo", "path"), self.buckets)

    @property
    def settings_log(self) -> Log:
        return Log(f"{self.root}/settings", SETTING_VERSIONS, ("repo", "kind", "path"), self.buckets)

    @property
    def documents(self) -> str:
        return f"{self.root}/documents"

    def files(self, spark: SparkSession) -> DataFrame:
        """The files that belong to their repos now."""
        return self.files_log.read(spark).filter("admitted and not deleted")

    def latest_documents(self, spark: SparkSession) -> DataFrame:
        """Newest document of every repo that still has files."""
        numbers = tables.snapshots(spark, self.documents)
        if not numbers:
            return spark.createDataFrame([], DOCUMENTS)
        every = (
            spark.read.schema(T.StructType([*DOCUMENTS.fields, T.StructField("snapshot", T.LongType())]))
            .option("basePath", self.documents)
            .parquet(*[tables.snapshot_path(self.documents, n) for n in numbers])
        )
        newest = every.groupBy("repo").agg(F.max("snapshot").alias("snapshot"))
        alive = self.files(spark).select("repo").distinct()
        return (
            every.join(newest, ["repo", "snapshot"], "left_semi")
            .join(alive, "repo", "left_semi")
            .drop("snapshot")
        )

    # --- one micro-batch -------------------------------------------------------

    def _settings_delta(self, arrived: DataFrame, number: int) -> DataFrame:
        """Setting versions that are newer than the known ones; written as this batch's delta."""
        spark, log = arrived.sparkSession, self.settings_log
        kept = arrived.select(
            "repo", "kind", F.coalesce("path", F.lit("")).alias("path"), "content",
            F.coalesce("deleted", F.lit(False)).alias("deleted"), "ts",
        )
        order = ["ts", "deleted", "content"]
        newest = kept.groupBy(*log.keys).agg(F.max_by(F.struct(*SETTING_VERSIONS.fieldNames()), F.struct(*order)).alias("row"))
        newest = tables.materialize(newest.select("row.*"), "settings")
        if newest.isEmpty():
            return newest
        known = log.read(spark, number, newest.select("repo").distinct())
        newer = _newer(newest, known, list(log.keys), order, []).select(*newest.columns)
        log.write(newer, number)
        return log.written(spark, number)

    def _admitted(self, paths: DataFrame, repos: DataFrame, number: int) -> DataFrame:
        """Those of ``paths`` that a scan under the settings known after batch ``number`` finds."""
        spark = paths.sparkSession
        known = self.settings_log.read(spark, number + 1, repos).filter("not deleted")
        settings = tables.materialize(known, "known-settings")

        def of(kind: str) -> DataFrame:
            return settings.filter(F.col("kind") == kind)

        text = F.col("content").cast("string")
        modes = repos.join(of(MODE).select("repo", text.alias("ignore_mode")), "repo", "left")
        rule_files = repos.join(of(RULES).select("repo", "content"), "repo", "left")
        return scan(
            paths,
            modes.select("repo", F.coalesce("ignore_mode", F.lit(BEST_EFFORT)).alias("ignore_mode")),
            of(TRACKED).select("repo", "path"),
            R.rules_by_repo(rule_files, list(self.default_rules)),
            R.submodule_names(of(SUBMODULES)),
            R.submodule_markers(of(MARKER)),
        )

    def _judged(self, newest: DataFrame, known: DataFrame, renewed: DataFrame, repos: DataFrame, number: int) -> DataFrame:
        """State rows to write: newer versions, and known paths of ``renewed`` repos that come or go.

        An admitted row without a summary has yet to be read.
        """
        same = F.col("source_hash").eqNullSafe(F.col("known_source_hash")) & ~F.col("deleted") & ~F.col("known_deleted")
        hit = F.coalesce(same & F.col("known_summary").isNotNull(), F.lit(False))
        arrived = _newer(newest, known, ["repo", "path"], VERSION_ORDER, ["summary"]).select(
            *newest.columns,
            hit.alias("cache_hit"),
            F.lit(None).cast("boolean").alias("before"),
            F.when(hit, F.col("known_summary")).alias("summary"),
        )
        stored = (
            known.join(renewed, "repo", "left_semi")
            .join(arrived.select("repo", "path"), ["repo", "path"], "left_anti")
            .select("repo", "path", *VERSION_ORDER, F.col("summary").isNotNull().alias("cache_hit"), F.col("admitted").alias("before"), "summary")
        )
        rows = tables.materialize(arrived.unionByName(stored), "to-judge")
        present = rows.filter("not deleted").select("repo", "path")
        found = self._admitted(present, repos, number).select("repo", "path", "is_priority", F.lit(True).alias("found"))
        judged = rows.join(found, ["repo", "path"], "left").withColumn("admitted", F.coalesce("found", F.lit(False)))
        return judged.filter("before is null or before <> admitted or admitted and summary is null").select(*STATE.fieldNames())

    def _summaries(self, files: DataFrame, missing: DataFrame) -> DataFrame:
        """``(repo, path, source_hash, summary)`` of the missing versions found among ``files``."""
        version, n = ["repo", "path", "source_hash"], missing.count()
        # Paths first: only contents of wanted paths are hashed.
        near = contents_of(files.filter("content is not null"), missing, n, self.broadcast_rows)
        hashed = near.withColumn("source_hash", X.source_hash(F.col("content")))
        # Summaries, not contents, are compared with the exact list, which is too long to be broadcast.
        read = contents_of(hashed, missing, n, self.broadcast_rows, tuple(version))
        found = packed(summarize(read.select("repo", "path", "content", "source_hash")))
        return found.dropDuplicates(version).join(missing, version, "left_semi")

    def _delta(self, judged: DataFrame, versions: DataFrame) -> DataFrame:
        """``judged`` with the summaries of the rows that lack them."""
        version = ["repo", "path", "source_hash"]
        to_read = F.col("admitted") & F.col("summary").isNull()
        done, misses = judged.filter(~to_read), judged.filter(to_read)
        missing = tables.materialize(misses.select(*version), "missing")
        if missing.isEmpty():
            return judged
        fresh = tables.materialize(self._summaries(versions, missing), "fresh")
        older = missing.join(fresh, version, "left_anti")
        if self.landing is not None and not older.isEmpty():
            landed = versions.sparkSession.read.schema(FILE_VERSIONS).option("recursiveFileLookup", "true").parquet(self.landing)
            fresh = fresh.unionByName(self._summaries(landed, tables.materialize(older, "older")))
        return done.unionByName(misses.drop("summary").join(fresh, version, "left").select(*STATE.fieldNames()))

    def process(self, batch: DataFrame, number: int) -> None:
        """Handle one micro-batch; everything it leaves behind is a numbered snapshot."""
        with tables.scratch(batch.sparkSession):
            self._process(batch, number)

    def _process(self, batch: DataFrame, number: int) -> None:
        spark, log = batch.sparkSession, self.files_log
        if "kind" not in batch.columns:
            batch = batch.withColumn("kind", F.lit(FILE))
        versions = batch.filter(F.col("kind") == FILE).select(*FILE_VERSIONS.fieldNames())
        arrived = tables.materialize(_without_contents(batch), "arrived")
        renewed = self._settings_delta(arrived.filter(F.col("kind") != FILE), number).select("repo").distinct()
        keys = arrived.filter(F.col("kind") == FILE).select("repo", "path", *VERSION_ORDER)
        newest = tables.materialize(K.latest(keys, VERSION_ORDER), "newest")
        repos = newest.select("repo").union(renewed).distinct()
        known = tables.materialize(log.read(spark, number, repos), "known")

        judged = tables.materialize(self._judged(newest, known, renewed, repos, number), "judged")
        log.write(self._delta(judged, versions), number)
        if not judged.isEmpty():
            self._document(known, number)
        if (number + 1) % self.fold_every == 0:
            log.fold(spark, number)
            self.settings_log.fold(spark, number)

    def _document(self, known: DataFrame, number: int) -> None:
        """Write the documents of the repos that batch ``number`` changed."""
        spark, keys = known.sparkSession, ["repo", "path"]
        written = self.files_log.written(spark, number)
        repos = written.select("repo").distinct()
        before = known.join(repos, "repo", "left_semi").join(written.select(*keys), keys, "left_anti")
        rows = before.unionByName(written).filter("admitted and not deleted and summary is not null")
        rows = tables.materialize(rows, "documented")
        modes = self.settings_log.read(spark, number + 1, repos).filter((F.col("kind") == MODE) & ~F.col("deleted"))
        modes = (
            rows.select("repo").distinct()
            .join(modes.select("repo", F.col("content").cast("string").alias("ignore_mode")), "repo", "left")
            .na.fill(BEST_EFFORT, ["ignore_mode"])
        )
        docs = documents(unpacked(rows), modes, self.part_bytes)
        tables.write_snapshot(docs.select(*DOCUMENTS.fieldNames()), self.documents, number)

    def start(
        self, versions: DataFrame, checkpoint: str, available_now: bool = False, settings: DataFrame | None = None
    ) -> StreamingQuery:
        """Watch both streams; a watch without settings can't get them later under one checkpoint."""
        stream = versions.withColumn("kind", F.lit(FILE))
        if settings is not None:
            stream = stream.unionByName(settings)
        writer = stream.writeStream.foreachBatch(self.process).option(
            "checkpointLocation", checkpoint
        )
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()
