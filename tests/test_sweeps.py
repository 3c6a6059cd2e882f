"""Sweeps, budgets and sessions against a deterministic judge."""

import http.server
import json
import threading

import pytest

from pyspark.sql import functions as F

from unitweave.operators import sweep
from unitweave.plans import session
from unitweave.plans.budget import Budget
from unitweave.plans.schema import parse

RULE = sweep.rule_judge(lambda s: F.when(F.contains(s, F.lit("handover")), "yes").otherwise("no"))
TEXT = "\n".join(f"shift {k} {'handover' if k % 3 == 0 else 'routine'} by tech{k % 4}" for k in range(600))


@pytest.fixture(scope="module")
def ctx(spark):
    return spark.createDataFrame([(1, TEXT), (2, "one handover\n\n"), (3, " \n"), (4, None)], "ctx_id int, text string")


def broken(digit):
    return lambda r: F.regexp_replace(r, rf"item (\d*){digit}: \w+", f"item $1{digit}: maybe")


def test_items_and_requests(spark, ctx):
    leaf = parse({"type": "boolean"})
    items = sweep.context_items(ctx, leaf)
    got = items.orderBy("ctx_id", "item").collect()
    assert len(got) == 601 and all(TEXT[r.start : r.end].strip() == r.source for r in got if r.ctx_id == 1)
    req = sweep.requests(items, "is it a handover?", leaf).orderBy("request").collect()
    assert sum(len(r["items"]) for r in req) == 601 and all(len(r["items"]) <= leaf.items_per_request() for r in req)
    assert req[0].source.startswith("[item 0]\nshift 0 handover") and "<criterion>\nis it a handover?\n</criterion>" in req[0].instruction and "item N: yes" in req[0].instruction
    small = sweep.context_items(ctx, parse({"type": "object", "properties": {f"f{k}": {"enum": ["x" * 200]} for k in range(4)}}))
    refs = [r.ref for r in small.where("ctx_id = 1").orderBy("item").collect()]
    assert refs[0] == "s0000.0" and len(set(refs)) > len({r.ref for r in got}) and max(refs.count(x) for x in set(refs)) == 4
    given = spark.createDataFrame([(k % 2, k, "word " * (k % 300)) for k in range(400)], "ctx_id int, item int, source string")
    by_request = {}
    for r in sweep.provided_items(given, leaf).orderBy("ctx_id", "item").collect():
        by_request.setdefault((r.ctx_id, r.ref), []).append(len(f"[item {r.item}]\n{r.source}"))
    assert all(sum(v) <= 4000 or len(v) == 1 for v in by_request.values())
    keys = sorted(by_request)
    assert all(sum(by_request[a]) + by_request[b][0] > 4000 for a, b in zip(keys, keys[1:], strict=False) if a[0] == b[0])
    assert len(sweep.contract_fingerprint()) == 64 and "or null" in sweep.describe(parse({"type": ["boolean", "null"]}))


def test_sweep_cache_and_retry(spark, ctx, tmp_path):
    runs = sweep.Sweeps(spark, str(tmp_path / "a"), RULE, question="is it a handover?")
    s = runs.semantic_search(ctx)
    e = s.envelope
    assert (e["status"], e["total"], e["valid"], e["positive_count"], e["context_complete"], e["cache_hit"]) == ("complete", 601, 601, 201, True, False)
    assert s.rows.where("ctx_id = 1 AND value = 'true'").count() == 200 and spark.table("search_results").count() == 601
    again = sweep.Sweeps(spark, str(tmp_path / "a"), sweep.replay_judge(spark.createDataFrame([], "request string, reply string"))).semantic_search(ctx, "is it a handover?")
    assert again.envelope["cache_hit"] and again.envelope["rows_digest"] == e["rows_digest"]
    with pytest.raises(Exception, match="no reply is recorded"):
        sweep.Sweeps(spark, str(tmp_path / "b"), sweep.replay_judge(spark.createDataFrame([], "request string, reply string"))).semantic_search(ctx, "x")
    assert sweep.Sweeps(spark, str(tmp_path / "a"), RULE).semantic_map(ctx, "is it a handover?", {"type": "boolean"}).sweep_id != s.sweep_id

    once = sweep.Sweeps(spark, str(tmp_path / "c"), sweep.fault_judge(RULE, broken(5), 1)).semantic_search(ctx, "q")
    assert once.envelope["status"] == "complete" and once.envelope["waves"] == 2
    runs = sweep.Sweeps(spark, str(tmp_path / "d"), sweep.fault_judge(RULE, broken(5), 1, 2))
    s = runs.semantic_search(ctx, "q")
    assert s.envelope["status"] == "partial" and s.envelope["valid"] == 541 and s.envelope["returned"] == 601 and s.envelope["context_complete"] is False
    assert {r.item % 10 for r in s.failed.collect()} == {5} and {r.problem for r in s.failed.collect()} == {"invalid"} and "retry_failed" in s.envelope["note"]
    third = runs.retry_failed(s)
    assert third.envelope["status"] == "complete" and third.envelope["retry_exhausted"] and third.envelope["waves"] == 3
    assert runs.retry_failed(s.sweep_id).envelope["waves"] == 3 and runs.semantic_search(ctx, "q").envelope["cache_hit"]
    with pytest.raises(ValueError):
        runs.retry_failed("unknown")
    repeated = sweep.fault_judge(RULE, lambda r: F.concat(r, F.lit("\nitem 0: yes\nitem 9999: yes")), 1)
    first = sweep.Sweeps(spark, str(tmp_path / "e"), repeated).semantic_search(ctx, "q")
    assert first.envelope["status"] == "complete"  # item 0 twice: dropped, and asked again
    none = sweep.Sweeps(spark, str(tmp_path / "f"), sweep.fault_judge(RULE, lambda r: F.lit("what?"), 1, 2, 3)).semantic_search(ctx, "q")
    assert (none.envelope["status"], none.envelope["presented"], none.envelope["valid"]) == ("failed", 601, 0)
    for bad in (({"type": "boolean"}, "x"), ("", {"type": "boolean"}), (["a"], {"type": "boolean"})):
        with pytest.raises(TypeError):
            runs.semantic_map(ctx, *bad)
    empty = runs.semantic_search(ctx.where("ctx_id = 3"), "q").envelope
    assert empty["total"] == 0 and not empty["complete"] and empty["context_complete"] is False


def test_provided_items_cover_only_themselves(spark, ctx, tmp_path):
    items = spark.createDataFrame([(0, k, f"note {k} {'handover' if k < 7 else ''}") for k in range(50)], "ctx_id int, item long, source string")
    s = sweep.Sweeps(spark, str(tmp_path), RULE).semantic_map(ctx, "q", {"type": "boolean"}, items)
    assert s.envelope["context_complete"] is None and s.envelope["complete"] and s.rows.where("value = 'true' AND start IS NULL").count() == 7


def test_budget_cuts_in_order(spark, ctx, tmp_path):
    budget = Budget(max_calls=2)
    s = sweep.Sweeps(spark, str(tmp_path / "a"), RULE, budget).semantic_search(ctx, "q")
    e = s.envelope
    assert e["status"] == "partial" and 0 < e["presented"] < 601 and e["unsent"] == 601 - e["presented"] and budget.ledger.calls == 2
    assert {r.problem for r in s.failed.collect()} == {"unsent"}
    spent = sweep.Sweeps(spark, str(tmp_path / "b"), RULE, Budget(max_calls=0)).semantic_search(ctx, "q").envelope
    assert spent["status"] == "unsent" and spent["presented"] == 0 and "nothing was learnt" in spent["note"]
    lost = Budget(max_calls=100)
    sweep.Sweeps(spark, str(tmp_path / "c"), sweep.fault_judge(RULE, lambda r: F.lit(None).cast("string"), 1, 2), lost).semantic_search(ctx, "q")
    assert lost.ledger.calls == 0  # what got no reply is given back
    runs = sweep.Sweeps(spark, str(tmp_path / "d"), RULE, Budget(max_calls=3))
    jobs = spark.createDataFrame([(k, "q", None if k == 1 else "x" * 12_001 if k == 2 else f"handover {k}") for k in range(7)], "job_seq int, instruction string, source string")
    got = {r.job_seq: (r.reply, r.sent) for r in runs.llm_query_batched(jobs, str(tmp_path / "jobs")).collect()}
    assert [got[k][1] for k in range(7)] == [True, False, False, True, True, False, False] and got[0][0] == "item 0: yes" and got[1][0].startswith("ERROR") and got[6] == (None, False)
    with pytest.raises(RuntimeError):
        runs.llm_query("q", "text")
    for bad in ("", " ", "x" * 12_001):
        with pytest.raises(ValueError):
            runs.llm_query("q", bad)
    assert sweep.Sweeps(spark, str(tmp_path), RULE).llm_query("q", "handover") == "item 0: yes"


def test_budget_of_nodes():
    b = Budget(max_turns=4, max_nodes=3, max_depth=1)
    b.spend_turn()
    child = b.child()
    assert child.max_turns == 2 and child.depth == 1 and child.exhausted() is None and child.may_recurse() == "max_depth"
    child.spend_turn()
    child.spend_turn()
    assert child.exhausted() == "max_turns" and b.exhausted() is None and b.ledger.turns == 3  # a node's turns are its own
    b.child()
    assert b.ledger.nodes == 3 and b.exhausted() is None and b.may_recurse() == "max_nodes"
    with pytest.raises(RuntimeError):
        b.child()
    b.ledger.nodes += 1
    assert b.exhausted() == "max_nodes" and b.fresh().exhausted() is None
    b.ledger.tokens = b.max_tokens
    assert b.exhausted() == "max_tokens" and b.ledger.reserve(5, 3) == 3 and b.ledger.reserve(1, 3) == 0
    b.ledger.release(1)
    assert b.ledger.snapshot()["calls"] == 2


def test_http_judge(spark, ctx, tmp_path):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
            ids = [x.split("]")[0] for x in said.split("[item ")[1:]]
            body = json.dumps({"choices": [{"message": {"content": "\n".join(f"item {i}: no" for i in ids)}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1/chat/completions"
    e = sweep.Sweeps(spark, str(tmp_path / "a"), sweep.http_judge(url, "m")).semantic_search(ctx.where("ctx_id = 2"), "q").envelope
    server.shutdown()
    assert (e["status"], e["positive_count"]) == ("complete", 0)
    e = sweep.Sweeps(spark, str(tmp_path / "b"), sweep.http_judge("http://127.0.0.1:9/none", "m", timeout=2)).semantic_search(ctx.where("ctx_id = 2"), "q").envelope
    assert e["status"] == "failed" and e["presented"] == e["total"] == 1


def test_analyze(spark, ctx, tmp_path):
    run = lambda name, **kw: session.analyze(spark, ctx, "is it a handover?", kw.pop("judge", RULE), str(tmp_path / name), **kw)
    r = run("map", strategy="map")
    assert (r["status"], r["answer"], r["answer_valid"], r["strategy_satisfied"]) == ("complete", 201, True, True)
    r = run("auto")
    assert (r["status"], r["answer"], r["answer_valid"], r["strategy_satisfied"]) == ("complete", 201, True, None)
    assert r["coverage"]["complete"] and r["coverage"]["rows_digest"] and r["rows"].count() == 601
    r = run("auto part", judge=sweep.fault_judge(RULE, broken(5), 1, 2))
    assert (r["status"], r["answer_valid"]) == ("partial", True)
    r = run("part", strategy="map", judge=sweep.fault_judge(RULE, broken(5), 1, 2))
    assert (r["status"], r["answer_valid"]) == ("partial", False)
    r = run("none", strategy="map", budget=Budget(max_calls=0))
    assert (r["status"], r["answer"], r["answer_valid"]) == ("failed", None, False)
    r = run("kinds", strategy="classify", schema={"type": "string", "enum": ["Yes", "No"]})
    assert r["answer"] == {"Yes": 201, "No": 400} and r["status"] == "complete"
    r = run("tree", strategy="recursive", budget=Budget(max_nodes=40))
    parts = r["parts"].where("ctx_id = 1").orderBy("part").collect()
    assert (r["status"], r["answer"]) == ("complete", 201)
    assert len(parts) == 4 and all(p.usable and p.status == "ok" for p in parts) and sum(p.positive for p in parts) == 200
    assert r["certificate"].where("ctx_id = 1").first().complete
    assert session.satisfied("classify", [{"operation": "semantic_map", "context_complete": None}, {"operation": "semantic_search", "context_complete": True}]) is False
    assert r["ledger"]["nodes"] == 1 + r["parts"].count()
    with pytest.raises(ValueError, match="parts of each of 4 contexts"):
        run("few", strategy="recursive", budget=Budget(max_nodes=4))
    r = run("half", strategy="recursive", budget=Budget(max_nodes=40), judge=sweep.fault_judge(RULE, broken(5), 1, 2))
    assert (r["status"], r["answer_valid"], r["strategy_satisfied"]) == ("unverified", True, None) and r["answer"]  # no part was wholly read: nothing shows what was covered
    assert session.satisfied("recursive", [], ["rlm_map"], None) is None and session.satisfied("map", []) is False
    for bad in ({"strategy": "x"}, {"strategy": "classify"}):
        with pytest.raises(ValueError):
            run("bad", **bad)


def test_every_verdict():
    """All strategies, sweeps and certificates against the rule, written out."""
    kinds = [("semantic_map", True), ("semantic_map", False), ("semantic_map", None), ("semantic_search", True), ("semantic_search", False)]
    make = lambda k: {"operation": kinds[k][0], "context_complete": kinds[k][1], "status": "complete" if kinds[k][1] is not False else "partial", "n": k}
    for strategy in session.REQUIRED:
        for chosen in [(), *((k,) for k in range(5)), *((a, b) for a in range(5) for b in range(5))]:
            for delegated in (False, True):
                for certificate in (None, False, True):
                    sweeps, observed = [make(k) for k in chosen], ["rlm_map"] if delegated else []
                    verdict, basis = session.grounded(strategy, sweeps, observed, certificate)
                    if strategy == "auto":
                        want, shown = None, None
                    elif strategy == "recursive":
                        want, shown = (certificate if delegated else False), None
                    else:
                        fit = [k for k in chosen if kinds[k][1] is True and (strategy == "map" or kinds[k][0] == "semantic_map")]
                        want, shown = bool(fit), fit[-1] if fit else None
                    assert verdict is want and (basis["n"] if basis else None) == shown
                    basis = basis or (sweeps[-1] if sweeps else None)
                    for answered in (False, True):
                        status, valid = session.verdict_of(strategy, answered, verdict, basis)
                        if not answered:
                            assert (status, valid) == ("failed", False)
                        elif want is False:
                            assert (status, valid) == ("partial", False)
                        elif (strategy == "recursive" and want is None) or (strategy == "auto" and not basis):
                            assert (status, valid) == ("unverified", True)
                        else:
                            assert (status, valid) == ("complete" if not basis or basis["status"] == "complete" else "partial", True)


def test_one_changed_unit_asks_one_request_again(spark, ctx, tmp_path):
    """Requests with the same words and items take the replies that earlier sweeps had."""
    asked = []

    def counting(requests):
        asked.append(requests.count())
        return RULE(requests)

    first = sweep.Sweeps(spark, str(tmp_path), counting).semantic_search(ctx, "q")
    n = asked[-1]
    assert n > 3 and first.envelope["reused"] == 0
    edited = spark.createDataFrame([(1, TEXT.replace("shift 300 handover", "shift 300 routine!")), (2, "one handover\n\n")], "ctx_id int, text string")
    budget = Budget(max_calls=1)
    second = sweep.Sweeps(spark, str(tmp_path), counting, budget).semantic_search(edited, "q")
    assert asked[-1] == 1 and second.envelope["reused"] == n - 1 and budget.ledger.calls == 1
    assert second.envelope["status"] == "complete" and second.envelope["positive_count"] == first.envelope["positive_count"] - 1
    assert second.sweep_id != first.sweep_id and second.envelope["rows_digest"] != first.envelope["rows_digest"]
    rows = sweep.Sweeps(spark, str(tmp_path), counting).rows_of(second.envelope["rows_ref"])
    assert rows.count() == 601 and sorted(rows.collect()) == sorted(second.rows.collect())
    third = sweep.Sweeps(spark, str(tmp_path), counting).semantic_search(edited, "another question")
    assert asked[-1] == n and third.envelope["reused"] == 0  # other words


def test_replies_that_were_not_whole_are_not_kept(spark, ctx, tmp_path):
    sweep.Sweeps(spark, str(tmp_path), sweep.fault_judge(RULE, lambda r: F.lit("what?"), 1, 2)).semantic_search(ctx, "q")
    again = sweep.Sweeps(spark, str(tmp_path), RULE).semantic_search(ctx, "q").envelope
    assert (again["status"], again["reused"], again["attempt"]) == ("complete", 0, 1)


def test_the_second_wave_is_told_what_was_wrong(spark, tmp_path):
    small = spark.createDataFrame([(1, "\n".join(f"shift {k} handover" for k in range(12)))], "ctx_id int, text string")
    s = sweep.Sweeps(spark, str(tmp_path), sweep.fault_judge(RULE, broken(5), 1, 2)).semantic_search(small, "q")
    assert [(r.item, r.problem, r.why) for r in s.failed.collect()] == [(5, "invalid", "'maybe' is not yes or no")]
    path = f"{tmp_path}/{s.sweep_id}/0"
    first, second = (spark.read.parquet(f"{path}/asked-{k}").first().instruction for k in (1, 2))
    assert "could not be used" not in first
    assert second.endswith("The items: 5\nEarlier answers that could not be used:\nitem 5: 'maybe' is not yes or no")


@pytest.mark.parametrize(("raw", "value", "problem"), [
    ('{"a": "Yes.", "b": "x"}', '{"a":"true","b":"x"}', None), ('{"a": null, "b": null}', None, "a may not be null"), ('{"b": "line\\nline", "c": 1, "d": 2}', None, "a is missing; b has more than one line; c is not asked for; d is not asked for"),
    ('{"a": {"x": 1}, "b": ""}', None, """a '{"x":1}' is not yes or no; b is empty"""), ("[1]", None, "is no JSON object"), ("{x}", None, "is no valid JSON"), ("", None, "is empty"), (None, None, "is empty"), ("{}", None, "a is missing; b is missing"),
])
def test_all_problems_of_an_object(spark, raw, value, problem):
    from unitweave.functions.leaf import validate

    leaf = parse({"type": "object", "properties": {"a": {"type": "boolean"}, "b": {"type": ["string", "null"]}}})
    r = spark.createDataFrame([(raw,)], "raw string").select(validate(F.col("raw"), leaf).alias("r")).first().r
    assert (r.ok, r.value, r.problem) == (problem is None, value, problem)


def test_later_waves_write_only_what_they_asked_for(spark, tmp_path):
    """A value stays in the table of its wave; texts are in what a wave asks and in its state, once each."""
    rule = sweep.rule_judge(lambda x: F.when(F.contains(x, F.lit("a")), "yes").otherwise("no"))
    faulty = sweep.fault_judge(rule, lambda r: F.regexp_replace(r, r"(?m)^item (\d*3): \w+", "item $1: maybe"), 1, 2)
    items = spark.createDataFrame([(1, k, f"text {k} " + "abc"[k % 3]) for k in range(40)], "ctx_id int, item long, source string")
    runs = sweep.Sweeps(spark, str(tmp_path), faulty)
    s = runs.semantic_map(None, "is there an a?", {"type": "boolean"}, items)
    s = runs.retry_failed(s)
    path = f"{tmp_path}/{s.sweep_id}/0"
    assert [spark.read.parquet(f"{path}/state-{k}").count() for k in (1, 2, 3)] == [40, 4, 4]
    assert "source" not in spark.read.parquet(f"{path}/asked-1").columns and "items" not in spark.read.parquet(f"{path}/wave-1").columns
    want = [(k, str(k % 3 == 0 or "a" in f"text {k} ").lower(), f"text {k} " + "abc"[k % 3]) for k in range(40)]
    for rows in (s.rows, runs.rows_of(s.envelope["rows_ref"])):
        assert sorted((r.item, r.value, r.source) for r in rows.collect()) == want
    assert s.envelope["status"] == "complete" and s.envelope["waves"] == 3
