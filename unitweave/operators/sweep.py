"""Sweeps: one validated value for each item, from a judge that answers requests of many items.

Items are the units of contexts, or texts that the caller supplies. They are placed into
requests: a segment's units (split where a reply could not hold them), or supplied
texts in order until a size is reached. Replies are text in a line format, so parsing and
salvage are always exercised. What a first wave leaves unresolved goes into one
narrower second wave, and once more if the caller asks.

The state of a sweep is a function of its items and the replies of its waves, which are
written tables: no recomputation asks a judge twice, and no value is ever replaced by
a later wave's. A sweep's identity is its content, so the same request finds the same
tables again.
"""

from __future__ import annotations

import hashlib
import json
import urllib.request
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitweave.functions import text as layout
from unitweave.functions.leaf import parse_replies
from unitweave.operators import scan
from unitweave.operators.identity import content_digest, hashed
from unitweave.operators.text import _each
from unitweave.plans.budget import Budget
from unitweave.plans.schema import Leaf, parse
from unitweave.sources.work import exists, remove

Judge = Callable[[DataFrame], DataFrame]
REQUEST_CHARS, MAX_SOURCE = 4_000, 12_000
#: How many permitted lines a request shows.
SHOWN = 12


def rule_judge(rule: Callable[[Column], Column]) -> Judge:
    """A judge by a column expression over an item's source: the deterministic stand-in for a model."""

    def judge(requests: DataFrame) -> DataFrame:
        line = F.transform("items", lambda x: F.concat(F.lit("item "), x["item"].cast("string"), F.lit(": "), F.coalesce(rule(x["source"]), F.lit("null"))))
        return requests.select("request", F.array_join(line, "\n").alias("reply"))

    return judge


def replay_judge(replies: DataFrame) -> Judge:
    """A judge that looks its replies (request, reply) up; a request without one is an error."""

    def judge(requests: DataFrame) -> DataFrame:
        found = requests.select("request").join(replies.select(F.col("request").alias("r"), "reply"), F.col("request") == F.col("r"), "left")
        missing = F.raise_error(F.concat(F.lit("no reply is recorded for request "), F.col("request"))).cast("string")
        return found.select("request", F.when(F.col("r").isNull(), missing).otherwise(F.col("reply")).alias("reply"))

    return judge


def fault_judge(judge: Judge, broken: Callable[[Column], Column], *waves: int) -> Judge:
    """Another judge's replies, changed by an expression in some waves (a null reply is one that never came)."""
    ends = [f"#{k}" for k in waves or (1,)]

    def faulty(requests: DataFrame) -> DataFrame:
        hit = F.array_contains(F.array(*map(F.lit, ends)), F.concat(F.lit("#"), F.substring_index("request", "#", -1)))
        return judge(requests).withColumn("reply", F.when(hit, broken(F.col("reply"))).otherwise(F.col("reply")))

    return faulty


def http_judge(url: str, model: str, max_in_flight: int = 4, max_tokens: int = 1024, timeout: float = 120.0, headers: dict[str, str] | None = None) -> Judge:
    """A judge behind a chat endpoint; requests are dealt to max_in_flight tasks. A call that fails has a reply that says so."""

    def judge(requests: DataFrame) -> DataFrame:
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                replies = []
                for instruction, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    content = f"{instruction}\n\n<source>\n{source}\n</source>"
                    body = json.dumps({"model": model, "temperature": 0, "max_tokens": max_tokens, "messages": [{"role": "user", "content": content}]}).encode()
                    try:
                        call = urllib.request.Request(url, body, {"Content-Type": "application/json", **(headers or {})})
                        with urllib.request.urlopen(call, timeout=timeout) as answer:
                            replies.append(json.load(answer)["choices"][0]["message"]["content"])
                    except Exception as e:  # noqa: BLE001
                        replies.append(f"ERROR: {type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replies, pa.string())], ["request", "reply"])

        return requests.select("request", "instruction", "source").repartition(max_in_flight).mapInArrow(ask, "request string, reply string")

    return judge


def describe(leaf: Leaf) -> str:
    if leaf.base == "boolean":
        said = "yes or no"
    elif leaf.base == "enum":
        said = "one of: " + ", ".join(leaf.values)
    elif leaf.base == "text":
        said = "a short text on one line"
    else:
        said = "a JSON object with " + ", ".join(f'"{name}" ({describe(f)})' for name, f in leaf.fields)
    return said + (", or null" if leaf.nullable else "")


def contract(instruction: str, leaf: Leaf) -> str:
    """What a request asks: the criterion, delimited, and the lines that an answer may have."""
    if leaf.base == "object":
        shown = ["item N: {" + ", ".join(f'"{name}": ...' for name, _ in leaf.fields) + "}", *(f'"{name}": {describe(f)}' for name, f in leaf.fields)]
    else:
        allowed = ("yes", "no") if leaf.base == "boolean" else leaf.values
        shown = [f"item N: {v}" for v in allowed[:SHOWN]] + ([f"and in the same way: {', '.join(allowed[SHOWN:])}"] if len(allowed) > SHOWN else [])
    if leaf.nullable:
        shown.append("item N: null")
    return "\n".join([f"<criterion>\n{instruction}\n</criterion>", "Judge each numbered item of the source by the criterion, which says nothing about the form of your answer.", "Write one line for each item asked for, with its number, and nothing else:", *shown])


def contract_fingerprint() -> str:
    """Of the wording that judges read, whatever the criterion."""
    forms = [parse({"type": "boolean"}), parse({"type": "string", "enum": [f"label {k}" for k in range(SHOWN + 2)]}), parse({"type": "object", "properties": {"a": {"type": "boolean"}, "b": {"type": "string"}}})]
    return hashlib.sha256("\n\n".join(contract("<criterion>", f) for f in forms).encode()).hexdigest()


PLACED = ["ctx_id", "item", "start", "end", "source", "ref"]


def context_items(ctx: DataFrame, leaf: Leaf, target: int = 4_000, low: int = 400, high: int = 12_000) -> DataFrame:
    """PLACED: the units of contexts. A unit goes with the segment that holds its start; a segment of more units than a reply holds is split, and its refs get a suffix."""
    cap = leaf.items_per_request()

    def make(t: str) -> Iterator[tuple]:
        ends = layout.unit_ends(t, layout.structure(t))
        starts = [0, *ends[:-1]] if ends else []
        firsts = [a for a, _, _ in layout.segment_spans(ends, low, target, high)]
        homes = [bisect_right(firsts, a) - 1 for a in starts]
        sizes, seen = Counter(homes), Counter()
        for k, (a, b, home) in enumerate(zip(starts, ends, homes, strict=True)):
            suffix = f".{seen[home] // cap}" if sizes[home] > cap else ""
            seen[home] += 1
            yield k, a, b, t[a:b].strip(), f"s{home:04d}{suffix}"

    return _each(ctx, "item long, start long, end long, source string, ref string", make)


def provided_items(items: DataFrame, leaf: Leaf) -> DataFrame:
    """PLACED (without spans): texts (ctx_id, item, source) in order, a request closed before it has too many characters or items.

    One pass over each context's items in order, with no more than a request in memory.
    """
    cap = leaf.items_per_request()
    kept = items.select("ctx_id", F.col("item").cast("long").alias("item"), F.coalesce("source", F.lit("")).alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, number, size, count = object(), 0, 0, 0
        for batch in batches:
            refs, texts = [], []
            for ctx_id, item, source in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                body = source.strip()
                n = len(f"[item {item}]\n{body}")
                if ctx_id != of:
                    of, number, size, count = ctx_id, 0, 0, 0
                elif size + n > REQUEST_CHARS or count == cap:
                    number, size, count = number + 1, 0, 0
                size, count = size + n, count + 1
                refs.append(f"i{number:04d}")
                texts.append(body)
            none = pa.nulls(len(refs), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), none, none, pa.array(texts, pa.string()), pa.array(refs, pa.string())], PLACED)

    kind = kept.schema["ctx_id"].dataType.simpleString()
    return kept.repartition("ctx_id").sortWithinPartitions("ctx_id", "item").mapInArrow(run, f"ctx_id {kind}, item long, start long, end long, source string, ref string")


def requests(placed: DataFrame, instruction: str, leaf: Leaf, wave: int = 1) -> DataFrame:
    """request, ctx_id, ref, items, instruction, source: one row for each request of a wave, which names its items; a later one says what was wrong with earlier answers (`why`)."""
    why = F.col("why") if "why" in placed.columns else F.lit(None).cast("string")
    wrong = F.array_sort(F.collect_list(F.when(why.isNotNull(), F.struct("item", why.alias("why")))))
    r = placed.groupBy("ctx_id", "ref").agg(F.array_sort(F.collect_list(F.struct("item", "source"))).alias("items"), wrong.alias("wrong"))
    ids = F.array_join(F.transform("items", lambda x: x["item"].cast("string")), ", ")
    asked = F.concat(F.lit(contract(instruction, leaf) + "\nThe items: "), ids)
    told = F.transform("wrong", lambda x: F.concat(F.lit("\nitem "), x["item"].cast("string"), F.lit(": "), x["why"]))
    asked = F.concat(asked, F.when(F.size("wrong") > 0, F.concat(F.lit("\nEarlier answers that could not be used:"), F.array_join(told, ""))).otherwise(""))
    name = F.concat(F.col("ctx_id").cast("string"), F.lit("/"), "ref", F.lit(f"#{wave}"))
    return r.select(name.alias("request"), "ctx_id", "ref", "items", asked.alias("instruction"), F.array_join(_shown(F.col("items")), "\n\n").alias("source"))


def _shown(items: Column) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit("[item "), x["item"].cast("string"), F.lit("]\n"), x["source"]))


@dataclass
class Sweep:
    sweep_id: str
    operation: str
    rows: DataFrame  # ctx_id, item, value, source, start, end
    failed: DataFrame  # ctx_id, item, source, start, end, ref, problem, why
    envelope: dict[str, Any]


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def _unasked(items: DataFrame) -> DataFrame:
    """The state before the first wave."""
    return items.selectExpr("*", "false AS presented", "false AS returned", "false AS ok", "CAST(NULL AS STRING) AS value", "'unsent' AS problem", "CAST(NULL AS STRING) AS why")


def _read(wave: DataFrame, leaf: Leaf) -> DataFrame:
    """request, ctx_id, item, presented, problem, value, why: what a wave says of each item it asked for."""
    wanted = wave.select(F.col("request").alias("fragment"), "ctx_id", F.explode("ids").alias("item"), F.col("reply").isNotNull().alias("presented"))
    p = parse_replies(wave.select(F.col("request").alias("fragment"), F.coalesce("reply", F.lit("")).alias("reply")), wanted.select("fragment", "item"), leaf)
    p = p.where("problem IS NULL OR problem <> 'foreign'")
    return wanted.join(p, ["fragment", "item"]).select(F.col("fragment").alias("request"), "ctx_id", "item", "presented", "problem", "value", "why")


def _after(state: DataFrame, said: DataFrame) -> DataFrame:
    """state with presented, returned, ok, value, problem, why after one more wave; the first valid value stays."""
    good = F.col("problem").isNull()
    s = said.groupBy("ctx_id", "item").agg(
        F.bool_or("presented").alias("p"), F.bool_or(F.col("presented") & (good | (F.col("problem") != "missing"))).alias("r"), F.bool_or(good).alias("o"),
        F.max(F.when(good, F.struct("value")))["value"].alias("v"), F.max("problem").alias("last"), F.max("why").alias("w"),
    )
    j = state.join(s, ["ctx_id", "item"], "left").na.fill(False, ["p", "r", "o"])
    presented, ok = F.col("presented") | F.col("p"), F.col("ok") | F.col("o")
    problem = F.when(ok, None).when(~presented, "unsent").otherwise(F.coalesce("last", "problem"))
    return j.select(*PLACED, presented.alias("presented"), (F.col("returned") | F.col("r")).alias("returned"), ok.alias("ok"), F.when(F.col("ok"), F.col("value")).otherwise(F.col("v")).alias("value"), problem.alias("problem"), F.when(~ok, F.coalesce("w", "why")).alias("why"))


def note(e: dict[str, Any]) -> str:
    """What to do with a sweep, by what happened to it."""
    if e["status"] == "complete":
        return "Every item has a value; count over the rows."
    if e["status"] == "unsent":
        return f"None of the {e['total']} items was sent: the budget is spent, and nothing was learnt about the request."
    again = "The one further pass has been used." if e["retry_exhausted"] else "retry_failed() sends the others once more."
    if e["status"] == "failed":
        return f"No item has a value. {again}"
    return f"{e['valid']} of {e['total']} items have a value; totals cover only these and must say so. {again}"


class Sweeps:
    """Runs sweeps in a folder and finds them again. Waves are tables in folder/<sweep id>/<attempt>."""

    def __init__(self, spark: SparkSession, folder: str, judge: Judge, budget: Budget | None = None, question: str | None = None):
        self.spark, self.folder, self.judge, self.budget, self.question = spark, folder.rstrip("/"), judge, budget or Budget(max_calls=2**31 - 1), question
        self.done: list[Sweep] = []

    @staticmethod
    def identity(operation: str, instruction: str, schema: dict, placed: DataFrame, kind: str) -> str:
        """Of the request and a tree of hashes of its items with their bounds, in any order of rows."""
        return hashlib.sha256(json.dumps([operation, instruction, schema, kind, content_digest(placed, "ctx_id", "item", "start", "end", "source")], sort_keys=True).encode()).hexdigest()

    def semantic_map(self, ctx: DataFrame, instruction: str, schema: dict, items: DataFrame | None = None, operation: str = "semantic_map") -> Sweep:
        """A value for each unit of ctx, or for each of `items` (ctx_id, item, source), which cover nothing but themselves."""
        if isinstance(instruction, dict) or isinstance(schema, str):
            raise TypeError("the instruction comes before the schema")
        if not isinstance(instruction, str) or not instruction.strip():
            raise TypeError("an instruction is a text that says what to judge")
        leaf, kind = parse(schema), "context" if items is None else "provided_items"
        placed = context_items(ctx, leaf) if items is None else provided_items(items, leaf)
        made = f"{self.folder}/items-{uuid.uuid4().hex}"
        _write(placed, made)
        sweep_id = self.identity(operation, instruction, schema, self.spark.read.parquet(made), kind)
        found = self._load(sweep_id)
        if found and found["status"] in ("complete", "partial"):
            remove(self.spark, made)
            return self._publish(found | {"cache_hit": True})
        attempt = 0 if not found else found["attempt"] + 1
        e = {"sweep_id": sweep_id, "items": made, "operation": operation, "instruction": instruction, "schema": schema, "scope": kind, "attempt": attempt, "waves": 0, "reused": 0, "retry_exhausted": bool(found and found["retry_exhausted"])}
        for _ in range(2):
            if e["waves"] and self._counts(e)["unresolved"] == 0:
                break
            e = self._wave(e)
        return self._publish(self._save(e) | {"cache_hit": False})

    def semantic_search(self, ctx: DataFrame, goal: str | None = None) -> Sweep:
        """Which units meet the goal; by default the question of the session, word for word."""
        goal = goal if goal is not None else self.question
        if not goal:
            raise ValueError("a search needs a goal, or a session with a question")
        return self.semantic_map(ctx, goal, {"type": "boolean"}, operation="semantic_search")

    def retry_failed(self, sweep: Sweep | str) -> Sweep:
        """One further pass over what a sweep left unresolved; after that, the sweep as it is."""
        sweep_id = sweep.sweep_id if isinstance(sweep, Sweep) else sweep
        e = self._load(sweep_id) if isinstance(sweep_id, str) and sweep_id else None
        if not e:
            raise ValueError(f"no sweep {sweep_id!r} here")
        if e["retry_exhausted"]:
            return self._publish(e | {"cache_hit": False})
        e["retry_exhausted"] = True
        self._save(e)  # used up even if the pass fails
        if self._counts(e)["unresolved"]:
            e = self._wave(e)
        return self._publish(self._save(e) | {"cache_hit": False, "operation_run": "retry_failed"})

    def _state(self, e: dict) -> DataFrame:
        """The items with what is known of each. A wave writes those that it asked for; what had a value before stays in the table of its wave."""
        return self._waves(f"{e['sweep_id']}/{e['attempt']}", e["waves"]) if e["waves"] else _unasked(self.spark.read.parquet(e["items"]))

    def _waves(self, path: str, last: int) -> DataFrame:
        states = [self.spark.read.parquet(f"{self.folder}/{path}/state-{k}") for k in range(1, last + 1)]
        return reduce(DataFrame.unionByName, [*(s.where("ok") for s in states[:-1]), states[-1]])

    def _wave(self, e: dict) -> dict:
        """Sends what is unresolved, as far as calls are left, in order; a request without a reply counts as not sent.

        A request that an earlier sweep in this folder had answered whole is not sent again: its
        reply is taken, whatever sweep asked, since its words and items are the same.
        """
        k, path = e["waves"] + 1, f"{self.folder}/{e['sweep_id']}/{e['attempt']}"
        leaf, kept = parse(e["schema"]), f"{self.folder}/replies"
        state = self._state(e).where("NOT ok")
        todo = requests(state.select(*PLACED, "why"), e["instruction"], leaf, k).withColumn("asked", hashed(F.col("instruction"), F.col("source")))
        _write(todo.drop("source"), f"{path}/asked-{k}")
        todo = self.spark.read.parquet(f"{path}/asked-{k}").withColumns({"source": F.array_join(_shown(F.col("items")), "\n\n"), "ids": F.col("items.item")})
        columns = ["request", "ctx_id", "ref", "ids", "asked", "reply"]
        fresh, old = todo, None
        if exists(self.spark, f"{kept}/_SUCCESS"):
            known = self.spark.read.parquet(kept).groupBy(F.col("asked").alias("a")).agg(F.min("reply").alias("reply"))
            old = todo.join(known, F.col("asked") == F.col("a")).select(*columns)
            fresh = todo.join(known, F.col("asked") == F.col("a"), "left_anti")
        n = fresh.count()
        granted = self.budget.ledger.reserve(n, self.budget.max_calls)
        sent = fresh if granted == n else scan.numbered(fresh, "request").where(F.col("position") < granted).drop("position")
        replies = self.judge(sent).select(F.col("request").alias("r"), "reply")
        answered = sent.join(replies, F.col("request") == F.col("r"), "left").select(*columns)
        table = f"{path}/wave-{k}"
        _write(answered if old is None else answered.unionByName(old), table)
        wave = self.spark.read.parquet(table)
        self.budget.ledger.release(wave.where("reply IS NULL").count())
        _write(_read(wave, leaf), f"{path}/said-{k}")
        said = self.spark.read.parquet(f"{path}/said-{k}")
        _write(_after(state, said), f"{path}/state-{k}")
        whole = said.groupBy(F.col("request").alias("w")).agg(F.bool_and(F.col("problem").isNull()).alias("whole")).where("whole")
        wave.join(whole, F.col("request") == F.col("w"), "left_semi").select("asked", "reply").write.mode("append").parquet(kept)
        return e | {"waves": k, "reused": e.get("reused", 0) + todo.count() - n}

    def _counts(self, e: dict) -> dict:
        state = self._state(e)
        c = state.agg(F.count("*"), F.count_if("presented"), F.count_if("returned"), F.count_if("ok"), F.count_if(F.col("ok") & (F.col("value") == "true")), F.countDistinct(F.when(~F.col("ok") & F.col("presented"), F.struct("ctx_id", "ref")))).first()
        total, presented, returned, valid, positive, errors = c
        status = "unsent" if not presented else "complete" if valid == total else "partial" if valid else "failed"
        complete = total > 0 and valid == total
        out = {"total": total, "presented": presented, "returned": returned, "valid": valid, "unsent": total - presented, "unresolved": total - valid, "parse_errors": errors, "status": status if total else "failed", "complete": complete, "context_complete": complete if e["scope"] == "context" else None}
        return out | ({"examined_items": valid, "positive_count": positive} if e["operation"] == "semantic_search" else {})

    def _save(self, e: dict) -> dict:
        e = e | self._counts(e)
        if e["valid"]:
            e |= {"rows_digest": content_digest(self._state(e).where("ok"), "ctx_id", "item", "value", "source"), "rows_ref": self._rows_ref(e)}
        made = self.spark.range(1).select(F.lit(json.dumps(e)).alias("envelope"))
        made.write.mode("overwrite").parquet(f"{self.folder}/{e['sweep_id']}/envelope")
        return e

    def _rows_ref(self, e: dict) -> str:
        """Where the rows with a value are: a table, by path and wave, that rows_of() reads again."""
        return f"{e['sweep_id']}/{e['attempt']}/state-{e['waves']}"

    def rows_of(self, ref: str) -> DataFrame:
        """The rows behind an envelope's rows_ref."""
        path, last = ref.rsplit("/state-", 1)
        return self._waves(path, int(last)).where("ok").select("ctx_id", "item", "value", "source", "start", "end")

    def _load(self, sweep_id: str) -> dict | None:
        path = f"{self.folder}/{sweep_id}/envelope"
        return json.loads(self.spark.read.parquet(path).first().envelope) if exists(self.spark, f"{path}/_SUCCESS") else None

    def _publish(self, e: dict) -> Sweep:
        """The sweep as tables, also as the views semantic_rows and, of a search, search_results."""
        state = self._state(e)
        rows = state.where("ok").select("ctx_id", "item", "value", "source", "start", "end")
        failed = state.where("NOT ok").select("ctx_id", "item", "source", "start", "end", "ref", "problem", "why")
        done = Sweep(e["sweep_id"], e["operation"], rows, failed, e | {"note": note(e)})
        rows.createOrReplaceTempView("semantic_rows")
        if e["operation"] == "semantic_search":
            rows.withColumnRenamed("value", "decision").createOrReplaceTempView("search_results")
        self.done.append(done)
        return done

    def llm_query(self, instruction: str, source: str) -> str:
        """One call with a source of 1 to MAX_SOURCE characters."""
        if not source or not source.strip():
            raise ValueError("a call needs a source")
        if len(source) > MAX_SOURCE:
            raise ValueError(f"a source has at most {MAX_SOURCE} characters, not {len(source)}; sweep it, or cut it first")
        if not self.budget.ledger.reserve(1, self.budget.max_calls):
            raise RuntimeError("max_calls")
        job = self.spark.createDataFrame([("call", instruction, source)], "request string, instruction string, source string").withColumn("items", F.array(F.struct(F.lit(0).cast("long").alias("item"), F.col("source").alias("source"))))
        return self.judge(job).first().reply

    def llm_query_batched(self, jobs: DataFrame, path: str) -> DataFrame:
        """job_seq, reply, sent of jobs (job_seq, instruction, source), written to path.

        Jobs without a usable source are refused (their reply says why) and cost nothing; the others
        are sent in order as far as calls are left. Read in order of job_seq.
        """
        n = F.length(F.trim(F.coalesce("source", F.lit(""))))
        why = F.when(n == 0, "ERROR: ValueError: a call needs a source").when(F.length("source") > MAX_SOURCE, f"ERROR: ValueError: a source has at most {MAX_SOURCE} characters")
        all_ = jobs.select("job_seq", "instruction", "source", why.alias("refused"))
        usable = all_.where("refused IS NULL")
        granted = self.budget.ledger.reserve(usable.count(), self.budget.max_calls)
        chosen = scan.numbered(usable, "job_seq").where(F.col("position") < granted).select(F.col("job_seq").cast("string").alias("request"), "instruction", "source", F.array(F.struct(F.lit(0).cast("long").alias("item"), F.col("source").alias("source"))).alias("items"))
        replies = self.judge(chosen).select("request", "reply")
        out = all_.join(replies, all_["job_seq"].cast("string") == replies["request"], "left").select("job_seq", F.coalesce("reply", "refused").alias("reply"), F.col("request").isNotNull().alias("sent"))
        out.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def below(self, budget: Budget) -> Sweeps:
        """The same folder and judge under another budget."""
        return Sweeps(self.spark, self.folder, self.judge, budget, self.question)

