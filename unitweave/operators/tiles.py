"""Results that are products of rows, as tiles: arrays of one side's values that meet arrays of the other's.

What is shuffled is arrays, which grow with the rows; what is made from them grows with
the product. So tasks are given by number, which the adaptive planner leaves alone (by the size
of what they read it would choose one), and tiles are dealt over all of them. A tile's
rows come one value of the left side after the other, each with the same values of the right:
runs and repeats, which columnar files hold in a fraction of the space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values in an array, as a power of two; stripes of a key's arrays; stripes of arrays on the left and right side of a square.
SIDE, STRIPES, ROWS, COLUMNS = 8, 64, 8, 1024


def tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def blocks(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """key..., block, values: the values of a key in arrays of 2^SIDE at most, next to each other in order.

    Sorted by ranges of key and value, so a key with many values is no task of its own.
    Repeated and null values stay.
    """
    dealt = rows.select(*key, F.col(value).alias("value")).repartitionByRange(*key, "value").sortWithinPartitions(*key, "value")
    dealt = dealt.withColumn("block", F.shiftright(F.monotonically_increasing_id(), SIDE))
    held = F.transform(F.collect_list(F.struct("value")), lambda x: x["value"])
    return dealt.groupBy(*key, "block").agg(F.array_sort(held).alias("values"))


def squared(left: DataFrame, right: DataFrame, value: str, meet: Column) -> DataFrame:
    """Values of left (blocks; `value` is its array, one value a row here) and blocks of right that meet, each two once.

    The sides have no other name in common. A block goes to the cells of one row (left) or
    column (right) of a square, so two blocks have one cell in common, whatever they hold.
    Columns are narrow and rows high: the values of the right that a value of the left is followed by
    are few and come again with the next one, and both sides' values stay few for as long as a
    file's dictionary lasts. With columns as wide as rows, files take ten times the space when users are many.
    What a row of a generated stage makes is held until the next one is asked for, so blocks of
    left are taken apart, and sorted by the merge, before they meet: a value makes its own
    pairs in a cell, where a block would make all of its at once.
    """
    n = tasks(left)
    # Numbers of blocks have their task's in the high bits: hashed, as a remainder would be the same in every task.
    stripe = lambda k: F.pmod(F.hash("block"), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = left.withColumn("row", stripe(ROWS)).drop("block").withColumn("column", every(COLUMNS)).repartition(n, "row", "column").withColumn(value, F.explode(value))
    columns = right.withColumn("column_", stripe(COLUMNS)).drop("block").withColumn("row_", every(ROWS)).repartition(n, "row_", "column_")
    j = rows.hint("merge").join(columns, (F.col("row") == F.col("row_")) & (F.col("column") == F.col("column_")) & meet)
    return j.drop("row", "column", "row_", "column_")


def spread(tiles: DataFrame, left: str, right: str) -> DataFrame:
    """The rows of tiles: every value of array `left` with every one of array `right`, under these names.

    A stage is compiled up to a lambda, and what a row makes in one compiled stage is held at once: the
    lambda hands on a value of left at a time, so that what is held are its rows, not those of all tiles of a row.
    """
    each = F.transform(left, lambda x: x)
    return tiles.select(F.explode(each).alias(left), F.col(right).alias("others")).select(left, F.explode("others").alias(right))
