"""Products of rows: whole, and made by all tasks however little they read."""

import datetime
import random

from pyspark.sql import functions as F

from unitweave.operators import intervals, pairs


def made_by(df):
    """How many tasks make rows, and the rows."""
    parts = df.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    return len(parts), sum(r["count"] for r in parts)


def test_pairs_are_made_by_all_tasks(spark):
    rows = spark.range(3000).select(F.col("id").alias("user"), F.lit("x").alias("label"), F.lit(datetime.date(2024, 1, 1)).alias("date")).repartition(3)
    assert made_by(pairs.pairs(rows, pairs.Sym(("x",)))) == (4, 3000 * 2999 // 2)
    assert pairs.pairs(rows, pairs.Sym(("x",))).distinct().count() == 3000 * 2999 // 2


def test_every_pair_is_made_by_all_tasks(spark):
    rows = spark.range(3000).select((F.col("id") * 7 - 9000).alias("user"))
    assert made_by(pairs.every_pair(rows.unionByName(rows))) == (4, 3000 * 2999 // 2)
    few = spark.createDataFrame([(5,), (None,), (-3,), (5,), (9,)], "user long")
    assert sorted(map(tuple, pairs.every_pair(few).collect())) == [(-3, 5), (-3, 9), (5, 9)]


def test_pairs_of_two_sides_over_many_blocks(spark):
    rng = random.Random(5)
    of = {u: rng.choice(["p", "q", "pq", "r"]) for u in rng.sample(range(10**6), 1500)}
    rows = spark.createDataFrame([(u, label, datetime.date(2024, 1, 1)) for u, labels in of.items() for label in labels], "user long, label string, date date")
    got = pairs.pairs(rows, pairs.Asym((("p", ">=", 1),), (("q", ">=", 1),)))
    users = sorted(of)
    want = {(a, b) for i, a in enumerate(users) for b in users[i + 1 :] if "p" in of[a] and "q" in of[b] or "q" in of[a] and "p" in of[b]}
    found = list(map(tuple, got.collect()))
    assert len(found) == len(want) and set(found) == want


def test_a_stage_holds_pairs_of_one_user_at_a_time(spark):
    """Blocks of the left side are taken apart before they meet blocks of the right, in a stage of their own."""
    rows = spark.range(3000).select(F.col("id").alias("user"), F.lit("x").alias("label"), F.lit(datetime.date(2024, 1, 1)).alias("date"))
    plan = pairs.pairs(rows, pairs.Sym(("x",)))._jdf.queryExecution().sparkPlan().toString().splitlines()
    steps = [line for line in plan if "Generate explode" in line or "Join" in line]
    assert "Generate explode(b" in steps[0] and "SortMergeJoin" in steps[1] and "Generate explode(a" in steps[2]


def test_on_duty_is_made_by_all_tasks(spark):
    day = F.date_add(F.lit(datetime.date(2024, 1, 1)), (F.col("id") % 5).cast("int"))
    notes = spark.range(9000).select(F.when(F.col("id") > 0, F.col("id")).alias("note_id"), F.when(F.col("id") != 8999, 3).alias("crew"), day.alias("day")).distinct()
    roster = spark.range(600).select(F.lit(3).alias("crew"), day.alias("first_day"), F.date_add(day, 1).alias("last_day"), F.concat(F.lit("L"), F.col("id")).alias("lead"))
    got = intervals.on_duty(notes, roster)
    # Day 0 has the leads of one first day, the others of two; 1,800 notes each but for the one without a crew.
    want = 1800 * 120 + 3 * 1800 * 240 + 1799 * 240
    tasks, rows = made_by(got)
    assert tasks == 4 and rows == want
    assert got.where("note_id IS NULL").count() == 120  # a note without an id stays
    n, lead = F.col("note_id"), F.substring("lead", 2, 9).cast("int")
    assert got.where(~(n % 5 - lead % 5).isin(0, 1)).count() == 0 and got.where("note_id IS NOT NULL").distinct().count() == want - 120
