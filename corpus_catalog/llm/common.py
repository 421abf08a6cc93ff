"""What several operators share: stored tables, bindings in expressions, words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from corpus_catalog.sources import tables

#: The white space between words, and the letters that are lower-cased.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Work:
    """Tables written below ``spark.checkpoint.dir`` while an operator runs.

    They cut the lineage: a lost executor costs the tasks it ran, not the steps
    before. ``store`` drops its tables when the block ends; ``keep`` is for those
    that the operator's result still reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Work:
        return self

    def __exit__(self, *_) -> None:
        for _, path in self._paths.values():
            self._drop(path)

    def _write(self, df: DataFrame, name: str) -> str:
        path = tables.new_path(self.spark, f"{self.name}-{name}")
        df.write.option("compression", "zstd").parquet(path)
        return path

    def _drop(self, path: str) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = self._write(df, name)
        found = tables.read(self.spark, path, df.schema)
        self._paths[id(found)] = found, path
        return found

    def release(self, stored: DataFrame) -> None:
        """Drop a stored table that no later step reads."""
        self._drop(self._paths.pop(id(stored))[1])

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return tables.read(self.spark, self._write(df, name), df.schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, also where a lambda inside uses it often."""
    return F.transform(F.array(value), body)[0]


def key(docs: DataFrame, id_col: str) -> tuple[Column, str]:
    """The ids as numbers, or as they are if they are structs such as ``row_key``, and their type."""
    kind = docs.schema[id_col].dataType
    if isinstance(kind, StructType):
        return F.col(id_col), kind.simpleString()
    return F.col(id_col).cast("long"), "bigint"


def row_key(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Key of a row, never null: its id, nulls last, and a hash of all its values. Equal rows have one key."""
    values = [F.col(c) for c in docs.columns]
    return F.struct(
        F.col(id_col).isNull().alias("missing"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(*values, *(v.isNull() for v in values)).alias("row"),  # the hash itself skips nulls
    )


def short_row_key(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """``row_key``, or just the id where each row has one of its own. Both order rows alike."""
    number = F.col(id_col).cast("long")
    ids = docs.select(number.alias("id")).groupBy("id").count()
    return number if ids.filter("id is null or count > 1").isEmpty() else row_key(docs, id_col)


def free_name(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words between white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
