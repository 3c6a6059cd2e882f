"""Scans along a key's rows in order, spread over tasks however many rows a key has.

A key's rows are cut into stretches of a fixed width of the order column. Windows run
inside a stretch; what the stretches before it come to is summarised in one row a
stretch, and a window over those rows gives each stretch its carry. A stretch of
distinct places has at most `WIDTH` rows, so no task's share grows with a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from unitweave.sources.work import settle

WIDTH = 1 << 16


def stretches(rows: DataFrame, order: str, width: int | None = None) -> DataFrame:
    """rows with `stretch`, which never falls as `order` (an integer, date or timestamp) rises; null where order is."""
    kind = dict(rows.dtypes)[order]
    place = F.unix_date(order) if kind == "date" else F.unix_seconds(F.col(order).cast("timestamp")) if kind.startswith("timestamp") else F.col(order)
    return rows.withColumn("stretch", F.call_function("div", place.cast("long"), F.lit(width or WIDTH)))


def inside(key: str, *order: str) -> WindowSpec:
    return Window.partitionBy(key, "stretch").orderBy(*order)


def up_to_here(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def carried(rows: DataFrame, key: str, **parts: tuple[Column, Callable[[Column], Column]]) -> DataFrame:
    """rows (with `stretch`) and, under each name, what the stretches before come to; null in a key's first.

    parts: name = (an aggregate of one stretch, the aggregate that joins stretches in order).
    """
    each = rows.groupBy(key, "stretch").agg(*[made.alias(name) for name, (made, _) in parts.items()])
    before = Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carry = each.select(F.col(key).alias("carry_key"), F.col("stretch").alias("carry_stretch"), *[join(F.col(name)).over(before).alias(name) for name, (_, join) in parts.items()])
    return rows.join(carry, F.col(key).eqNullSafe(F.col("carry_key")) & F.col("stretch").eqNullSafe(F.col("carry_stretch"))).drop("carry_key", "carry_stretch")


def last(x: Column) -> Column:
    return F.last(x, ignorenulls=True)


def numbered(rows: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """rows with `position`, from 0 in order over all rows, without bringing them together.

    Rows are sorted by ranges; a row's position is its place in its range after the sizes
    of the ranges before. The ranges are written once, so that positions stay.
    """
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    dealt = settle(dealt.withColumn("part", F.shiftright("place", 33)), "numbered")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"), F.min("place").alias("low"))  # a row for each range
    before = sizes.select(F.col("part").alias("of"), "low", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return dealt.join(before, F.col("part") == F.col("of")).withColumn("position", F.col("place") - F.col("low") + F.col("before")).drop("part", "of", "low", "before", "place")
