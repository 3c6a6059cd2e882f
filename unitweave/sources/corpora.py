"""Synthetic contexts by rule, with their truths, and the records that texts are made of."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitweave.operators.text import _each

DEPOTS = ("Aarhus", "Bilbao", "Cork", "Dresden", "Espoo", "Faro", "Gdynia")
CREWS = ("day", "night", "swing")
QUIET = ("Load matched the list.", "Nothing to report.", "Doors sealed on time.", "Driver signed for all pallets.")
STOPPED = ("Work stopped until the river fell.", "Unloading was called off for the day.", "The yard stood idle after the alarm.")
WORDS_ONLY = ("Rain fell, and loading went on.", "Fog at dawn did not hold anyone up.", "Work did not stop for the wind.")


def _pick(values: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


def records(spark: SparkSession, n: int, every: int = 11, offset: int = 4, trap_every: int = 7, trap_offset: int = 2) -> DataFrame:
    """index, depot, crew, note, stopped, trap, record: n records; every 11th, from 4 on, states a stoppage, others only use its words."""
    k = F.col("id")
    stopped = k % every == offset
    trap = ~stopped & (k % trap_every == trap_offset)
    note = F.when(stopped, _pick(STOPPED, k)).when(trap, _pick(WORDS_ONLY, k)).otherwise(_pick(QUIET, k))
    r = spark.range(n).select(k.alias("index"), _pick(DEPOTS, k).alias("depot"), _pick(CREWS, k).alias("crew"), note.alias("note"), stopped.alias("stopped"), trap.alias("trap"))
    text = F.format_string("=== Record %04d ===\nDepot: %s\nCrew: %s\nNote: %s", "index", "depot", "crew", "note")
    return r.withColumn("record", text)


def context(made: DataFrame) -> DataFrame:
    """ctx_id 0 and one text of records (index, record), joined by blank lines. For texts that fit a row."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "record"))), lambda x: x["record"]), "\n\n")
    return made.agg(whole.alias("text")).select(F.lit(0).alias("ctx_id"), "text")


def truths(made: DataFrame) -> DataFrame:
    """records, stoppages, traps, night_crew and keyword_count: what a search for the words of stoppages would count."""
    words = F.col("note").rlike("(?i)stop|idle|rain|fog|wind")
    return made.agg(F.count("*").alias("records"), F.count_if("stopped").alias("stoppages"), F.count_if("trap").alias("traps"), F.count_if(F.col("crew") == "night").alias("night_crew"), F.count_if(words).alias("keyword_count"))


def split_records(ctx: DataFrame) -> DataFrame:
    """ctx_id, index, record: texts cut before each line `=== Record N ===`; what comes before the first is left out."""
    cut = ctx.select("ctx_id", F.explode(F.split("text", r"(?==== Record \d+ ===)")).alias("record")).where(F.ltrim("record").startswith("=== Record"))
    return cut.select("ctx_id", F.regexp_extract("record", r"=== Record (\d+) ===", 1).cast("long").alias("index"), "record")


_LINE = re.compile(r"User: (\d+) \|\| Instance: (.*?)(?: \|\| Label: (.*))?$")


def dated_records(ctx: DataFrame) -> DataFrame:
    """ctx_id, index, start, end, user, question, label (null where a line has none), date: lines that begin with `Date: `, in order, with their spans."""

    def make(t: str) -> Iterator[tuple]:
        at = index = 0
        for raw in t.splitlines(keepends=True):
            line = raw.rstrip("\r\n")
            found = _LINE.search(line) if line.startswith("Date: ") else None
            if found:
                yield index, at, at + len(raw), int(found[1]), found[2].strip(), found[3] and found[3].strip(), line[6:].partition(" ||")[0]
                index += 1
            at += len(raw)

    made = _each(ctx, "index long, start long, end long, user long, question string, label string, day string", make)
    return made.withColumn("date", F.try_to_date("day", "MMM d, yyyy") if hasattr(F, "try_to_date") else F.to_date("day", "MMM d, yyyy")).drop("day")


def disagreements(plain: DataFrame, labelled: DataFrame) -> DataFrame:
    """ctx_id, index of records that only one side has, or whose user or question differ; texts that agree give no row."""
    key = ["ctx_id", "index"]
    p, q = (df.select(*key, F.struct("user", "question").alias(n)) for df, n in ((plain, "p"), (labelled, "q")))
    return p.join(q, key, "full").where(~F.col("p").eqNullSafe(F.col("q"))).select(*key)


def execute(plan: dict, rows: DataFrame) -> DataFrame:
    """A checked plan over rows: {"filters": {column: value, or [low, high] for dates and numbers}, "op": "sum" | "count" | "max" | "list", "column", "of"}.

    max gives the value of `column` in the row with the largest `of`. Unknown columns and
    operations are refused before anything runs.
    """
    columns = {*plan.get("filters", {}), *(plan[k] for k in ("column", "of") if plan.get(k))}
    if columns - set(rows.columns):
        raise ValueError(f"no column {', '.join(sorted(columns - set(rows.columns)))}")
    if plan.get("op") not in ("sum", "count", "max", "list"):
        raise ValueError(f"no operation {plan.get('op')!r}")
    for c, v in plan.get("filters", {}).items():
        rows = rows.where(F.col(c).between(*v) if isinstance(v, (list, tuple)) else F.col(c) == v)
    if plan["op"] == "count":
        return rows.agg(F.count("*").alias("value"))
    if plan["op"] == "sum":
        return rows.agg(F.coalesce(F.sum(plan["column"]), F.lit(0)).alias("value"))
    return rows.agg(F.max_by(plan["column"], plan["of"]).alias("value")) if plan["op"] == "max" else rows
