"""Runs kept up to date from the event log: one state a run, events in order whatever order they come in, and tables that grow by what changed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from unitweave.operators import coverage, provenance
from unitweave.sources.work import exists
from unitweave.streaming import trace

COUNTS = ("events", "turns", "tool_calls", "subcalls", "failed_subcalls", "tokens", "batches")
FACTS = ", ".join(f"{c} long" for c in COUNTS) + ", last_turn long, last_batch long, streak long, longest_streak long, finished boolean"
OUT = f"run_id string, {FACTS}, next_seq long, waiting long, closed boolean"
_EVENT = "kind string, ok boolean, tokens long, turn long, batch long"
_KINDS = {"model_turn": "turns", "tool_call": "tool_calls", "subcall": "subcalls", "batch_start": "batches"}
_NAMES = [f.split()[0] for f in FACTS.split(", ")]


def _add(facts: dict, event: tuple) -> None:
    """One more event, the next in order."""
    kind, ok, tokens, turn, batch = event
    facts["events"] += 1
    facts["tokens"] += tokens
    if kind in _KINDS:
        facts[_KINDS[kind]] += 1
    if turn is not None:
        facts["last_turn"] = max(facts["last_turn"], turn)
    if kind == "batch_start" and batch is not None:
        facts["last_batch"] = batch
    if kind == "subcall":
        facts["failed_subcalls"] += not ok
        facts["streak"] = 0 if ok else facts["streak"] + 1
        facts["longest_streak"] = max(facts["longest_streak"], facts["streak"])
    facts["finished"] = facts["finished"] or kind == "finish"


class Run(StatefulProcessor):
    """Events of one run by seq from `first`; those that come early wait in the state, those seen before are dropped.

    A run that hears nothing for `patience` milliseconds takes what waits, gaps or not, and is closed;
    a later event opens it again.
    """

    def __init__(self, first: int = 0, patience: int = 3_600_000):
        self.first, self.patience = first, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", f"{FACTS}, next_seq long")
        self.waiting = handle.getMapState("waiting", "seq long", _EVENT)
        self.timer = handle.getValueState("timer", "at long")

    def _load(self) -> tuple[dict, int]:
        if not self.facts.exists():
            return dict.fromkeys(_NAMES, 0) | {"last_turn": -1, "last_batch": 0, "finished": False}, self.first
        *values, at = self.facts.get()
        return dict(zip(_NAMES, values, strict=True)), at

    def _save(self, key: tuple, facts: dict, at: int, waiting: int, closed: bool) -> pd.DataFrame:
        values = [facts[n] for n in _NAMES]
        self.facts.update((*values, at))
        return pd.DataFrame([[key[0], *values, at, waiting, closed]], columns=["run_id", *_NAMES, "next_seq", "waiting", "closed"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        facts, at = self._load()
        early = {k[0]: v for k, v in self.waiting.iterator()}
        had = set(early)
        for part in rows:
            for seq, *event in part[["seq", "kind", "ok", "tokens", "turn", "batch"]].itertuples(index=False):
                if seq >= at:
                    kind, ok, tokens, turn, batch = (None if pd.isna(v) else v for v in event)
                    early.setdefault(int(seq), (kind, True if ok is None else bool(ok), int(tokens), None if turn is None else int(turn), None if batch is None else int(batch)))
        while at in early:
            _add(facts, tuple(early.pop(at)))
            at += 1
        for seq in had - set(early):
            self.waiting.removeKey((seq,))
        for seq in set(early) - had:
            self.waiting.updateValue((seq,), tuple(early[seq]))
        due = timerValues.getCurrentProcessingTimeInMs() + self.patience
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(due)
        self.timer.update((due,))
        yield self._save(key, facts, at, len(early), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        facts, at = self._load()
        early = {k[0]: v for k, v in self.waiting.iterator()}
        for seq in sorted(early):
            _add(facts, tuple(early[seq]))
            at = seq + 1
            self.waiting.removeKey((seq,))
        self.timer.clear()
        yield self._save(key, facts, at, 0, True)

    def close(self) -> None:
        pass


def runs(events: DataFrame, first: int = 0, patience: int = 3_600_000) -> DataFrame:
    """OUT: of a stream of events, a run's row each time it changes."""
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    e = events.where("seq IS NOT NULL").select("run_id", "seq", "kind", "ok", tokens.cast("long").alias("tokens"), "turn", "batch")
    return e.groupBy("run_id").transformWithStateInPandas(Run(first, patience), OUT, "Update", "ProcessingTime")


def batch_runs(events: DataFrame) -> DataFrame:
    """What the stream comes to when every event is there: OUT without next_seq, waiting and closed. A run's event that is there twice counts once."""
    once = events.where("seq IS NOT NULL").dropDuplicates(["run_id", "seq"])
    t = trace.trajectory(once).select("run_id", *COUNTS, F.coalesce("last_turn", F.lit(-1).cast("long")).alias("last_turn"), "finished")
    calls = once.where("kind = 'subcall'").withColumn("good", F.coalesce("ok", F.lit(True))).select("run_id", "seq", (~F.col("good")).alias("bad"), "good")
    longest = provenance.streaks(calls, "run_id", "seq", "bad", "good").withColumnsRenamed({"run_id": "l_run", "longest": "longest_streak"})
    after = coverage.runs(calls, "run_id", "seq", "good")
    now = after.groupBy("run_id").agg(F.max_by(F.when(F.col("good"), 0).otherwise(F.col("n")), "run").alias("streak")).withColumnRenamed("run_id", "n_run")
    last = once.where("kind = 'batch_start' AND batch IS NOT NULL").groupBy("run_id").agg(F.max_by("batch", "seq").alias("last_batch")).withColumnRenamed("run_id", "b_run")
    j = t.join(longest, F.col("run_id") == F.col("l_run"), "left").join(now, F.col("run_id") == F.col("n_run"), "left").join(last, F.col("run_id") == F.col("b_run"), "left")
    return j.na.fill(0, ["longest_streak", "streak", "last_batch"]).select("run_id", *_NAMES)


def keep_runs(spark: SparkSession, folder: str, table: str, checkpoint: str, first: int = 0, patience: int = 3_600_000) -> None:
    """Brings `table` up to date with the log in `folder` in one batch, then ends.

    One batch, since with timers on the clock there is always another one to run.

    Each batch adds the runs that it changed in a folder of its own, which a batch that
    runs again replaces; current() reads each run's last row.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = runs(trace.follow(spark, folder), first, patience).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(once=True)

    def upsert(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/version={k}")

    out.foreachBatch(upsert).start().awaitTermination()


def current(spark: SparkSession, table: str) -> DataFrame:
    """Each run's last row."""
    rows = spark.read.option("basePath", table).parquet(f"{table}/version=*") if exists(spark, table) else spark.createDataFrame([], OUT + ", version long")
    w = Window.partitionBy("run_id").orderBy(F.desc("version"), F.desc("next_seq"))
    return rows.withColumn("newest", F.row_number().over(w)).where("newest = 1").drop("newest", "version")


def compact(spark: SparkSession, table: str, into: str) -> DataFrame:
    """The current rows alone, in a new table that keep_runs() can go on with under later versions."""
    rows = spark.read.option("basePath", table).parquet(f"{table}/version=*")
    last = rows.agg(F.max("version")).first()[0]
    current(spark, table).write.mode("overwrite").parquet(f"{into}/version={last}")
    return current(spark, into)
