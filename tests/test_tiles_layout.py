"""The order in which products of rows are written."""

from itertools import groupby

from pyspark.sql import functions as F

from unitweave.operators import tiles


def test_few_values_follow_a_value_however_many_there_are(spark):
    """What follows a value comes again with the next one: files hold it in little space only while it is short."""
    left = tiles.blocks(spark.range(300).select(F.lit(0).alias("k"), "id"), ["k"], "id").select("block", F.col("values").alias("a"))
    right = tiles.blocks(spark.range(400_000).select(F.lit(0).alias("k"), "id"), ["k"], "id").select("block", F.col("values").alias("b"))
    rows = tiles.squared(left, right, "a", F.lit(True)).select(F.spark_partition_id().alias("task"), "a", F.size("b").alias("n")).collect()
    runs = [sum(r.n for r in run) for _, run in groupby(rows, key=lambda r: (r.task, r.a))]
    assert sum(runs) == 300 * 400_000 and sum(runs) / len(runs) < 1024


def test_a_stage_holds_what_one_note_makes(spark):
    """What spreads a tile's notes isn't compiled (no star in the plan) into the stage that spreads their leads."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = spark.range(5).select(F.array("id", F.lit(None)).alias("note_id"), F.array("id", "id").alias("lead")).repartition(2)
        got = tiles.spread(held, "note_id", "lead")
        steps = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate" in line]
        assert "*(" in steps[0] and "*(" not in steps[1] and len(steps) == 2
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(n, k) for k in range(5) for n in (k, k, None, None)], key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
