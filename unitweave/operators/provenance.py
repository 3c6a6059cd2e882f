"""Where a text that was sent came from: claims checked against bytes, places by digest, spans of records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitweave.functions.scalars import EDGE, preview
from unitweave.functions.text import digest
from unitweave.operators import coverage, scan
from unitweave.operators.intervals import holding

COMPLETE = 0.98


def sourced(text: Column) -> Column:
    """struct(chars, sha256, head, tail, preview): enough to find the text again in what it was cut from."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    return F.struct(n.cast("long").alias("chars"), digest(t).alias("sha256"), F.left(t, F.lit(EDGE)).alias("head"), F.when(n > EDGE, F.right(t, F.lit(EDGE))).otherwise("").alias("tail"), preview(t).alias("preview"))


def unitization(spans: DataFrame) -> DataFrame:
    """ctx_id, digest of how each text was cut: of `start-end` of its units in order, with semicolons."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))
    return spans.groupBy("ctx_id").agg(digest(F.array_join(each, ";")).alias("digest"))


def locate(ctx: DataFrame, records: DataFrame) -> DataFrame:
    """record_id, ctx_id, start, end: the first place of head at which the whole slice has the record's digest; null if none.

    records (record_id, ctx_id, chars, sha256, head). Each text meets its own records only.
    """
    joined = records.select("record_id", "ctx_id", "chars", "sha256", "head").join(ctx.select("ctx_id", "text"), "ctx_id").select("record_id", "ctx_id", "chars", "sha256", "head", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = []
            for n, want, head, text in zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True):
                at = text.find(head) if text and head and n and want else -1
                while at >= 0 and (at + n > len(text) or hashlib.sha256(text[at : at + n].encode("utf-8", "surrogatepass")).hexdigest()[:16] != want):
                    at = text.find(head, at + 1)
                starts.append(at if at >= 0 else None)
            found = pa.array(starts, pa.int64())
            ends = pa.array([None if a is None else a + n for a, n in zip(starts, batch.column(2).to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found, ends], ["record_id", "ctx_id", "start", "end"])

    kinds = dict(joined.dtypes)
    return joined.mapInArrow(run, f"record_id {kinds['record_id']}, ctx_id {kinds['ctx_id']}, start long, end long")


def verified(claims: DataFrame, ctx: DataFrame) -> DataFrame:
    """Claims (call_id, ctx_id, pos, start, end, sent) that hold: what the text has there, stripped, is in the sent text.

    Of several claims of one call with the same words, as many hold, in order of pos, as
    the sent text has occurrences that don't overlap.
    """
    body = F.regexp_replace(F.expr("substring(text, CAST(start + 1 AS INT), CAST(end - start AS INT))"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text"))
    c = claims.join(ctx.select("ctx_id", "text"), "ctx_id").where(inside).withColumn("body", body).where("body <> ''")
    nth = F.row_number().over(Window.partitionBy("call_id", "ctx_id", "body").orderBy("pos"))
    times = (F.length("sent") - F.length(F.replace("sent", F.col("body"), F.lit("")))) / F.length("body")
    return c.withColumn("nth", nth).where(F.col("nth") <= times).select(*claims.columns)


def spans_of(ctx: DataFrame, records: DataFrame, claims: DataFrame) -> DataFrame:
    """record_id, ctx_id, start, end: the recorded claims (record_id, start, end) made of this very text, else the place by digest.

    records: as for locate(), with provenance_of (the digest of the text that claims index).
    """
    texts = ctx.select("ctx_id", digest(F.col("text")).alias("own"), F.length("text").alias("n"))
    mine = records.join(texts, "ctx_id").where("provenance_of = own").select("record_id", "ctx_id", "n")
    held = claims.join(mine, "record_id")
    first = held.where("start >= 0 AND start < end AND end <= n").select("record_id", "ctx_id", "start", "end")
    rest = records.join(held.select("record_id").distinct(), "record_id", "left_anti")
    return first.unionByName(locate(ctx, rest).where("start IS NOT NULL"))


def credited(parts: DataFrame, ctx: DataFrame) -> DataFrame:
    """Delegated spans (ctx_id, start, end) of parts (part_id, ctx_id, part, complete): placed once in their text, and wholly read."""
    done = parts.where("complete").select("part_id", "ctx_id", "part")
    return coverage.place(done, ctx).where("placed_at IS NOT NULL").join(done.select("part_id", F.length("part").alias("chars")), "part_id").select("ctx_id", F.col("placed_at").alias("start"), (F.col("placed_at") + F.col("chars")).alias("end"))


def recursive_certificate(ctx: DataFrame, delegated: DataFrame) -> DataFrame:
    """ctx_id, chars, covered_fraction (six digits), complete, gaps of delegated spans (of, start, end); only texts with a span.

    `of` is the digest of the text that a span indexes.
    """
    texts = ctx.select("ctx_id", digest(F.col("text")).alias("own"), F.length("text").cast("long").alias("chars"))
    spans = delegated.join(texts, F.col("of") == F.col("own")).select("ctx_id", "start", "end")
    sizes = texts.select("ctx_id", "chars").join(spans.select("ctx_id").distinct(), "ctx_id", "left_semi")
    share = coverage.fraction(spans, sizes)
    gaps = coverage.gaps(spans, sizes).groupBy("ctx_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gaps"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return share.join(gaps, "ctx_id", "left").select("ctx_id", "chars", F.round("share", 6).alias("covered_fraction"), (F.col("share") >= COMPLETE).alias("complete"), F.coalesce("gaps", none).alias("gaps"))


def run_certificate(units: DataFrame, failed: DataFrame) -> DataFrame:
    """ctx_id, total_units, covered_units, failed_units of units (ctx_id, item, ...) and failed (ctx_id, item)."""
    f = failed.select("ctx_id", "item").distinct().withColumn("bad", F.lit(1))
    return units.join(f, ["ctx_id", "item"], "left").groupBy("ctx_id").agg(F.count("*").alias("total_units"), F.count_if(F.col("bad").isNull()).alias("covered_units"), F.count("bad").alias("failed_units"))


def by_containment(rows: DataFrame, records: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """row_id, index, value, ambiguous: the record (ctx_id, index, start, end) that lies in a row's span (row_id, ctx_id, start, end, value).

    A row that holds several records is ambiguous and credited to none; one with none is
    left out, as is a value that is no label.
    """
    r = records.select("ctx_id", "index", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    held = rows.select("row_id", F.col("ctx_id"), F.col("start").alias("from"), F.col("end").alias("to"), "value")
    j = holding(r, held, "ctx_id", "r_start", "from", "to", closed=True).where("r_end <= to")
    n = j.groupBy("row_id").agg(F.count("*").alias("n"), F.min("index").alias("index"), F.first("value").alias("value"))
    good = F.col("value").isin(*labels) if labels else F.lit(True)
    return n.where((F.col("n") > 1) | good).select("row_id", F.when(F.col("n") == 1, F.col("index")).alias("index"), "value", (F.col("n") > 1).alias("ambiguous"))


def semantic_basis(sweeps: DataFrame) -> DataFrame:
    """run_id, sweep_id, scope: of each run's sweeps (run_id, seq, sweep_id, operation, scope) the last map over its context, else its last map."""
    best = F.max_by(F.struct("sweep_id", "scope"), F.struct((F.col("scope") == "context").alias("c"), "seq"))
    return sweeps.where("operation = 'semantic_map'").groupBy("run_id").agg(best.alias("b")).select("run_id", "b.sweep_id", "b.scope")


def repeats(calls: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """calls with `repeated`: was a row with the same columns there before?"""
    return calls.withColumn("repeated", F.row_number().over(Window.partitionBy(key, *columns).orderBy(order)) > 1)


def streaks(turns: DataFrame, key: str, order: str, mark: str, reset: str) -> DataFrame:
    """key, longest: the longest run of marked rows; rows that neither mark nor reset don't break it."""
    t = scan.carried(scan.stretches(turns, order), key, earlier=(F.sum(F.col(reset).cast("int")), F.sum))
    t = t.withColumn("part", F.sum(F.col(reset).cast("int")).over(scan.up_to_here(scan.inside(key, order))) + F.coalesce("earlier", F.lit(0)))
    return t.groupBy(key, "part").agg(F.count_if(F.col(mark)).alias("n")).groupBy(key).agg(F.max("n").alias("longest"))


def is_cycle(mark: Column, lineage: Column) -> Column:
    """Is this question over this text already being answered above?"""
    return F.array_contains(lineage, mark)


def question_records(calls: DataFrame, records: DataFrame) -> DataFrame:
    """call_id, index: the records whose question is the call's, word for word."""
    return calls.select("call_id", F.trim("question").alias("q")).join(records.select("index", F.trim("question").alias("r")), F.col("q") == F.col("r")).select("call_id", "index")


def counters(truth: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """true_positives, false_positives, false_negatives, precision, recall, f1 of two sets of ids."""
    both = found.select(key).distinct().withColumn("f", F.lit(1)).join(truth.select(key).distinct().withColumn("t", F.lit(1)), key, "full")
    n = both.agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("true_positives"), F.count_if(F.col("t").isNull()).alias("false_positives"), F.count_if(F.col("f").isNull()).alias("false_negatives"))
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    rate = lambda d: F.when(d == 0, 0.0).otherwise(tp / d)
    return n.select("*", rate(tp + fp).alias("precision"), rate(tp + fn).alias("recall"), F.when(tp == 0, 0.0).otherwise(2 * tp / (2 * tp + fp + fn)).alias("f1"))

