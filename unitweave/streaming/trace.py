"""The event log of runs: append-only JSON lines, read as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unitweave.operators import coverage, trees

EVENT = "run_id string, seq long, kind string, turn long, ok boolean, prompt_tokens long, completion_tokens long, seconds double, detail string, depth long, batch long, error string, response string, source_ref string, source_chars long, source_sha256 string, source_preview string"


def append(events: DataFrame, folder: str) -> None:
    """Adds events (EVENT) to the log; earlier files are never touched."""
    events.write.mode("append").json(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All events; lines that are blank or no JSON object have no run and are skipped."""
    return spark.read.schema(EVENT).json(folder).where("run_id IS NOT NULL")


def follow(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).json(folder).where("run_id IS NOT NULL")


def trajectory(events: DataFrame) -> DataFrame:
    """A row for each run: counts of what it did, in one pass; of a stream, running counts."""
    kind = F.col("kind")
    has = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("long")
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    some = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    return events.groupBy("run_id").agg(
        F.count("*").alias("events"),
        F.count_if(kind == "model_turn").alias("turns"),
        F.count_if(kind == "tool_call").alias("tool_calls"),
        F.count_if(kind == "subcall").alias("subcalls"),
        F.count_if((kind == "subcall") & ~F.coalesce("ok", F.lit(True))).alias("failed_subcalls"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"),
        F.max("turn").alias("last_turn"),
        some(kind == "finish").alias("finished"),
        some(kind == "tool_call").alias("used_the_tool"),
        (F.count_if(kind == "subcall") >= 4).alias("subcalls_at_least_4"),
        some((kind == "subcall") & (has("source_chars") > 0)).alias("made_a_sourced_subcall"),
        F.count_if(kind == "batch_start").alias("batches"),
        some(kind == "rlm_query").alias("recursion_observed"),
        F.coalesce(F.max(F.when(kind == "rlm_query", has("depth"))), F.lit(0)).cast("long").alias("recursion_depth"),
        some(kind.isin("tool_call", "subcall") & (F.coalesce(has("depth"), F.lit(0)) >= 1)).alias("child_did_work"),
        F.count_if(kind == "duplicate").alias("duplicates"),
        F.count_if(kind == "protocol_error").alias("protocol_errors"),
    )


def evidence(events: DataFrame, limit: int = 8) -> DataFrame:
    """run_id, seq, source_ref, source_chars, source_sha256, excerpt, said: the first calls of each run that failed not and answered something."""
    said = F.trim(F.coalesce("response", F.lit("")))
    good = events.where((F.col("kind") == "subcall") & F.col("error").isNull() & (said != "") & ~F.upper(said).startswith("NONE"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))
    return good.withColumn("rank", rank).where(F.col("rank") <= limit).select("run_id", "seq", "source_ref", "source_chars", "source_sha256", F.left(F.coalesce("source_preview", F.lit("")), F.lit(300)).alias("excerpt"), F.left(said, F.lit(300)).alias("said"))


def batch_of(events: DataFrame) -> DataFrame:
    """run_id, seq, batch: of each subcall the last batch that started before it, 0 before any."""
    e = events.where("kind IN ('subcall', 'batch_start')").withColumn("starts", F.col("kind") == "batch_start")
    return coverage.last_before(e, "run_id", "seq", "starts", "batch").select("run_id", "seq", F.coalesce("as_of", F.lit(0).cast("long")).alias("batch"))


def rolled_up(nodes: DataFrame) -> DataFrame:
    """node_id, calls, peak: sums and maxima over each node and all below it, of a tree of any depth (node_id, parent_id, calls, peak).

    A round adds to each node's sums those of the nodes that many levels below, so no node
    is expanded into its ancestors. A ring of nodes is an error.
    """

    def lift(known: DataFrame, jumps: DataFrame) -> DataFrame:
        higher = known.join(jumps, F.col("node_id") == F.col("node")).select(F.col("above").alias("node_id"), "calls", "peak")
        return known.unionByName(higher).groupBy("node_id").agg(F.sum("calls").alias("calls"), F.max("peak").alias("peak"))

    own = nodes.groupBy("node_id").agg(F.sum("calls").alias("calls"), F.max("peak").alias("peak"))
    return trees.climb(trees.edges_of(nodes), own, lift)


def attribution(facts: DataFrame) -> DataFrame:
    """facts (run_id, correct, subcalls, received, named, coverage) with two verdicts: where a search for one passage failed, and where an aggregate did."""
    none = F.col("subcalls") == 0
    needle = F.when(F.col("correct"), "answered").when(none, "no_delegation").when(F.col("received") == 0, "retrieval_failure").when(F.col("named") > 0, "synthesis_failure").otherwise("atomic_failure")
    aggregate = F.when(F.col("correct"), "answered").when(none, "no_delegation").when(F.col("coverage") < 0.98, "incomplete_coverage").otherwise("atomic_or_aggregation")
    return facts.withColumns({"needle_verdict": needle, "aggregate_verdict": aggregate})


def keep_trajectories(spark: SparkSession, folder: str, table: str, checkpoint: str) -> None:
    """Brings `table` (a new folder for each batch of new files) up to date with the log, then ends."""
    query = trajectory(follow(spark, folder)).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{table}/batch={k}")).start().awaitTermination()
