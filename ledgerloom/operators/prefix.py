"""Running sums and numbers over keys of any size.

Rows are dealt into ranges of (groups, order) with about as many rows each, each range is summed on
its own, and what the ranges before it add up to is added. So no task gets all rows of a group, however few groups there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store

#: Rows of a range, about.
ROWS = 1_000_000


def _ranged(df: DataFrame, keys: list[Column], rows: int) -> DataFrame:
    """``df`` with _part: the number of its range; ranges follow each other in the order of keys, and equal keys are in one.

    Checkpointed, so that a task that is run again finds its rows in the range where they were.
    """
    parts = max(-(-df.count() // rows), 1)
    return store.settled(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))


def _with_offsets(ranged: DataFrame, groups: list[str], within: Column, total: Column, out: str) -> DataFrame:
    """``ranged`` with ``within``, an expression over the window of a range and group, plus the ``total`` of the same group's ranges before."""
    totals = ranged.groupBy("_part", *groups).agg(total.alias("_total"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = totals.select(F.col("_part").alias("_of"), *[F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(groups)], F.sum("_total").over(before).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(f"`{g}`").eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)], F.col("_part") == F.col("_of"))
    columns = [F.col(f"`{c}`") for c in ranged.columns if c != "_part"]
    summed = ranged.withColumn("_own", within).join(offsets, same, "left")
    return summed.select(*columns, (F.col("_own") + F.coalesce("_before", F.lit(0))).alias(out))


def running_sum(df: DataFrame, groups: list[str], order: list[str], value: str, out: str = "running", rows: int = ROWS) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group up to each, in the order of ``order``; nulls add nothing.

    Rows of a group that are equal in all of ``order`` come in some order. Nulls in ``groups`` are a group.
    """
    ranged = _ranged(df, [F.col(f"`{c}`") for c in (*groups, *order)], rows)
    own = Window.partitionBy("_part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    added = F.coalesce(F.col(f"`{value}`"), F.lit(0).cast(df.schema[value].dataType))
    return _with_offsets(ranged, groups, F.sum(added).over(own), F.sum(added), out)


def numbered(df: DataFrame, order: list[str], out: str = "number", rows: int = ROWS) -> DataFrame:
    """``df`` with the place of each row, from 1, in the order of ``order``."""
    ranged = _ranged(df, [F.col(f"`{c}`") for c in order], rows)
    own = Window.partitionBy("_part").orderBy(*order)
    return _with_offsets(ranged, [], F.row_number().over(own).cast("long"), F.count("*"), out)
