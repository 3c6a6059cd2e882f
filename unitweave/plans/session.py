"""Analysis of large contexts: a strategy, the sweeps it needs, and a verdict that fails closed."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitweave.functions.text import digest
from unitweave.operators import provenance, text
from unitweave.operators.sweep import Judge, Sweeps
from unitweave.plans.budget import Budget
from unitweave.sources.work import settle

#: What each strategy requires to have run.
REQUIRED = {"auto": (), "classify": ("semantic_map",), "map": ("semantic_map", "semantic_search"), "recursive": ("rlm_map",)}
#: Strategies whose meaning includes completeness.
EXHAUSTIVE = ("classify", "map")


def grounded(strategy: str, sweeps: list[dict[str, Any]], observed: list[str] = (), recursive_complete: bool | None = None) -> tuple[bool | None, dict[str, Any] | None]:
    """Whether what a strategy requires has happened, and the one sweep that shows it.

    None where a strategy asserts nothing, or where delegation ran and nothing shows how much it
    covered. Operation and completeness come from one and the same sweep (operation,
    context_complete), the last that has both.
    """
    required = REQUIRED[strategy]
    if not required:
        return None, None
    if not any(op in required for op in [*observed, *(s["operation"] for s in sweeps)]):
        return False, None
    if strategy not in EXHAUSTIVE:
        return recursive_complete, None
    whole = [s for s in sweeps if s["operation"] in required and s["context_complete"] is True]
    return bool(whole), whole[-1] if whole else None


def satisfied(strategy: str, sweeps: list[dict[str, Any]], observed: list[str] = (), recursive_complete: bool | None = None) -> bool | None:
    """The verdict of grounded() alone."""
    return grounded(strategy, sweeps, observed, recursive_complete)[0]


def verdict_of(strategy: str, answered: bool, verdict: bool | None, basis: dict[str, Any] | None) -> tuple[str, bool]:
    """(status, answer_valid) of an answer that rests on the sweep `basis` (or on none).

    Only a verdict of False stops an answer from being valid. The status looks at the basis: an
    answer without one is unverified under auto, one on an incomplete sweep is partial.
    """
    if not answered:
        return "failed", False
    if verdict is False:
        return "partial", False
    if strategy == "recursive" and verdict is None or strategy == "auto" and basis is None:
        return "unverified", True
    return "complete" if basis is None or basis["status"] == "complete" else "partial", True


def rlm_map(spark: SparkSession, ctx: DataFrame, question: str, judge: Judge, folder: str, budget: Budget, slots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The question over parts of each context, all parts in one sweep.

    First: ctx_id, part, start, end, status (ok, empty, budget or error), usable, examined, total,
    positive. Second: the recursive certificate of each context by the parts that were wholly
    read. Each part is a node: the nodes left are shared between the contexts, and what is
    booked is the parts that were made. The sweep runs under a child's allowances.
    """
    left, n_ctx = budget.max_nodes - budget.ledger.nodes, max(1, ctx.count())
    n = slots or left // n_ctx
    if n * n_ctx > left or n < 1:
        raise ValueError(f"{max(1, n)} parts of each of {n_ctx} contexts need {max(1, n) * n_ctx} nodes; {left} are left")
    cut = settle(text.parts(ctx, n, text=True), "parts")
    own = budget.child()
    budget.ledger.nodes += max(0, cut.count() - 1)
    child = cut.select(F.concat_ws("/", F.col("ctx_id").cast("string"), F.col("part").cast("string")).alias("ctx_id"), "text")
    sweep = Sweeps(spark, folder, judge, own, question).semantic_search(child)
    done = sweep.rows.groupBy("ctx_id").agg(F.count("*").alias("examined"), F.count_if(F.col("value") == "true").alias("positive"))
    lost = sweep.failed.groupBy("ctx_id").agg(F.count("*").alias("lost"), F.bool_and(F.col("problem") == "unsent").alias("unsent"))
    key = F.concat_ws("/", F.col("ctx_id").cast("string"), F.col("part").cast("string"))
    p = cut.withColumn("key", key).join(done.withColumnRenamed("ctx_id", "key"), "key", "left").join(lost.withColumnRenamed("ctx_id", "key"), "key", "left").na.fill(0, ["examined", "positive", "lost"])
    total = F.col("examined") + F.col("lost")
    status = F.when(total == 0, "empty").when((F.col("examined") == 0) & F.coalesce("unsent", F.lit(False)), "budget").when(F.col("examined") == 0, "error").otherwise("ok")
    whole = (F.col("lost") == 0) & (total > 0)
    records = p.select("ctx_id", "part", "start", "end", status.alias("status"), whole.alias("usable"), "examined", total.alias("total"), "positive")
    spans = p.where(whole).join(ctx.select(F.col("ctx_id").alias("c"), digest(F.col("text")).alias("of")), F.col("ctx_id") == F.col("c")).select("of", "start", "end")
    return records, provenance.recursive_certificate(ctx, spans)


def analyze(spark: SparkSession, ctx: DataFrame, question: str, judge: Judge, folder: str, strategy: str = "auto", schema: dict | None = None, budget: Budget | None = None) -> dict[str, Any]:
    """Answers a question over contexts (ctx_id, text).

    strategy: map (which units meet the question), classify (a value of `schema` for each
    unit), recursive (over parts), auto (as map, nothing asserted). The result has status,
    answer_valid (verdict_of()), strategy_satisfied, the answer (a count, or
    counts by value), rows, the envelope, the ledger, and for recursive the parts.
    """
    if strategy not in REQUIRED:
        raise ValueError(f"a strategy is one of {', '.join(REQUIRED)}, not {strategy!r}")
    if strategy == "classify" and not schema:
        raise ValueError("classify needs a schema that lists the values")
    if not question or not question.strip():
        raise ValueError("a question is a text")
    budget = (budget or Budget(max_calls=2**31 - 1)).fresh()
    budget.spend_turn()
    out: dict[str, Any] = {"strategy": strategy, "question": question}
    if strategy == "recursive":
        parts, certificate = rlm_map(spark, ctx, question, judge, folder, budget)
        real = parts.where("total > 0")  # blank texts have nothing to read
        c = real.agg(F.coalesce(F.sum("positive"), F.lit(0)), F.coalesce(F.sum("examined"), F.lit(0))).first()
        shown = real.select("ctx_id").distinct().join(certificate.select("ctx_id", "complete"), "ctx_id", "left")
        all_, known = shown.agg(F.bool_and(F.coalesce("complete", F.lit(True))), F.bool_and(F.col("complete").isNotNull())).first()
        # A certificate that falls short says no; where a context has none, nothing is shown of it.
        verdict, basis = grounded(strategy, [], ["rlm_map"], False if all_ is False else True if known else None)
        out |= {"answer": c[0] if c[1] else None, "parts": parts, "certificate": certificate, "operations": ["rlm_map"]}
    else:
        sweeps = Sweeps(spark, folder, judge, budget, question)
        sweep = sweeps.semantic_map(ctx, question, schema) if strategy == "classify" else sweeps.semantic_search(ctx)
        e = sweep.envelope
        verdict, basis = grounded(strategy, [e])
        basis = basis or e
        counts = {r["value"]: r["count"] for r in sweep.rows.groupBy("value").count().collect()} if strategy == "classify" else e["positive_count"]
        out |= {"answer": counts if e["valid"] else None, "rows": sweep.rows, "failed": sweep.failed, "envelope": e, "operations": [sweep.operation]}
    status, valid = verdict_of(strategy, out["answer"] is not None, verdict, basis)
    coverage = {k: basis.get(k) for k in ("operation", "scope", "status", "valid", "total", "complete", "context_complete", "sweep_id", "retry_exhausted", "rows_ref", "rows_digest")} if basis else None
    return out | {"status": status, "answer_valid": valid, "strategy_satisfied": verdict, "coverage": coverage, "ledger": budget.ledger.snapshot()}
