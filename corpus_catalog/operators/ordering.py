"""Order within groups of any size.

Row numbers and texts are ordered without gathering a group: the rows of large
groups are range partitioned, and what lies before a row is the sum over earlier
range partitions and over earlier rows of its own.  Results depend only on the rows,
not on the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpus_catalog import config as C
from corpus_catalog.sources.tables import materialize

_SEPARATORS = {"\n": "chr(10)", ", ": "', '", "": "''"}


def groups_above(rows: DataFrame, group: list[str], weight: Column, limit: int) -> DataFrame | None:
    """Groups whose weights sum to more than ``limit``; None if there are none.

    Sums are partial per task, so no group is gathered for it.
    """
    sums = rows.groupBy(*group).agg(F.sum(weight).alias("weight"))
    large = sums.filter(F.col("weight") > limit).select(*group)
    return None if large.isEmpty() else materialize(large, "large-groups")


def with_sum_before(rows: DataFrame, group: list[str], order: list, weight: str) -> DataFrame:
    """Add ``sum_before``: the weights of the earlier rows of each row's group."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written out, so that a retried task cannot see other range bounds.
    placed = materialize(
        rows.repartitionByRange(n, *group, *order).withColumn("run", F.spark_partition_id()),
        "ranged",
    )
    runs = placed.groupBy(*group, "run").agg(F.sum(weight).alias("run_weight"))
    # At most one row per group and range partition.
    earlier = Window.partitionBy(*group).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        *group, "run", F.coalesce(F.sum("run_weight").over(earlier), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy(*group, "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(weight).over(within), F.lit(0))
    return (
        placed.withColumn("within", before)
        .join(offsets, [*group, "run"])
        .withColumn("sum_before", F.col("offset") + F.col("within"))
        .drop("run", "offset", "within")
    )


def row_numbers(df: DataFrame, group: list[str], order: list, limit: int = C.WINDOW_ROWS) -> DataFrame:
    """Add ``row_no`` (bigint, from 1) within each group.

    One task numbers a group of up to ``limit`` rows; the numbers are the same either way.
    """
    single = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")
    large = groups_above(df, group, F.lit(1), limit)
    if large is None:
        return df.withColumn("row_no", single)
    rest = df.join(large, group, "left_anti").withColumn("row_no", single)
    many = df.join(large, group, "left_semi").withColumn("one", F.lit(1).cast("bigint"))
    numbered = with_sum_before(many, group, order, "one").withColumn("row_no", F.col("sum_before") + 1)
    return rest.unionByName(numbered.drop("one", "sum_before"))


def assemble(
    rows: DataFrame,
    group: list[str],
    order: list[str],
    separator: str = "\n",
    part_bytes: int = C.PART_BYTES,
) -> DataFrame:
    """Join the ``text`` of each group's rows in order: ``(group, part, content)``.

    One rule for all groups: a row belongs to the part in which it begins, counted in
    bytes of the whole text, separators included.  A part is ``part_bytes`` long at most, but for the end of
    its last row; part numbers ascend, and skip where a row spans more than a part.
    Joining the parts with the separator gives the whole text.

    A text of up to ``part_bytes`` is one part by this rule, so only longer ones are
    measured row by row.
    """
    size = F.octet_length("text").cast("bigint") + len(separator)
    lines = materialize(rows.withColumn("line_bytes", size), "lines")
    long = groups_above(lines, group, F.col("line_bytes"), part_bytes)
    placed = lines.withColumn("part", F.lit(0).cast("bigint"))
    if long is not None:
        begin = with_sum_before(lines.join(long, group, "left_semi"), group, order, "line_bytes")
        part = F.floor(F.col("sum_before") / part_bytes).cast("bigint")
        placed = placed.join(long, group, "left_anti").unionByName(
            begin.withColumn("part", part).drop("sum_before")
        )
    joined = F.expr(
        f"listagg(text, {_SEPARATORS[separator]}) within group (order by {', '.join(order)})"
    )
    return placed.groupBy(*group, "part").agg(joined.alias("content"))
