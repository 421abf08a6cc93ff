"""The summary cache as a table in buckets of repos, of which a build reads and writes those it touches.

Buckets are Parquet partitions.  A change computes the new rows of the touched buckets,
writes them aside, and then lets Spark replace just those partitions (dynamic partition
overwrite).  The rows set aside are complete, so a change that was interrupted
while it replaced partitions is finished by the next one, or by the next read.

Every bucket that was ever written keeps a row without a repo, so that a bucket left empty is
replaced like any other.  One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpus_catalog import config as C
from corpus_catalog.operators.cache import upsert
from corpus_catalog.schemas import CACHE
from corpus_catalog.sources import tables

_STORED = T.StructType([*CACHE.fields, T.StructField("bucket", T.IntegerType())])


@dataclass(frozen=True)
class CacheTable:
    root: str
    buckets: int = C.CACHE_BUCKETS

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("repo"), F.lit(self.buckets)).cast("int")

    @property
    def _rows(self) -> str:
        return f"{self.root}/rows"

    @property
    def _aside(self) -> str:
        return f"{self.root}/aside"

    def _stored(self, spark: SparkSession) -> DataFrame:
        self._finish(spark)
        if not tables.exists(spark, self._rows):
            return spark.createDataFrame([], _STORED)
        return tables.read(spark, self._rows, _STORED).filter("repo is not null")

    def _touched(self, repos: DataFrame) -> DataFrame:
        """Buckets of some repos, a stored table of at most ``buckets`` rows."""
        return tables.materialize(repos.select(self._bucket().alias("bucket")).distinct(), "buckets")

    def _within(self, rows: DataFrame, touched: DataFrame) -> DataFrame:
        """Rows of the touched buckets; others are pruned when the join runs, since their list is broadcast and filtered."""
        return rows.join(F.broadcast(touched.filter(F.col("bucket") >= 0)), "bucket", "left_semi")

    def read(self, spark: SparkSession, repos: DataFrame | None = None) -> DataFrame:
        """All entries, or at least those of ``repos``: only their buckets are read."""
        rows = self._stored(spark)
        if repos is not None:
            rows = self._within(rows, self._touched(repos))
        return rows.select(*CACHE.fieldNames())

    def upsert(self, new: DataFrame) -> None:
        """Store entries, one per path; those of the same paths are replaced."""
        new = tables.materialize(new.select(*CACHE.fieldNames()), "entries")
        touched = self._touched(new)
        self._replace(upsert(self._within(self._stored(new.sparkSession), touched).drop("bucket"), new), touched)

    def purge(self, repos: DataFrame) -> DataFrame:
        """Remove all entries of some repos: ``(repo, removed)`` of those that had any."""
        repos = tables.materialize(repos.select("repo").distinct(), "purged")
        touched = self._touched(repos)
        rows = self._within(self._stored(repos.sparkSession), touched).drop("bucket")
        gone = rows.join(repos, "repo", "left_semi").groupBy("repo").agg(F.count(F.lit(1)).alias("removed"))
        removed = tables.materialize(gone, "removed")
        self._replace(rows.join(repos, "repo", "left_anti"), touched)
        return removed

    def _replace(self, rows: DataFrame, touched: DataFrame) -> None:
        """Set the whole new content of the touched buckets aside, then put it in their place."""
        spark = rows.sparkSession
        blank = touched.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in CACHE.fields), "bucket")
        whole = rows.select(*CACHE.fieldNames(), self._bucket().alias("bucket")).unionByName(blank)
        # A bucket that one repo fills is split over several tasks and files.
        whole.hint("rebalance", "bucket").write.mode("overwrite").parquet(self._aside)
        self._finish(spark)

    def _finish(self, spark: SparkSession) -> None:
        """Move what was set aside into the table; the same again if that was interrupted."""
        if not tables.exists(spark, f"{self._aside}/_SUCCESS"):
            return
        (
            tables.read(spark, self._aside, _STORED)
            .hint("rebalance", "bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket")
            .parquet(self._rows)
        )
        tables.delete(spark, self._aside)
