"""Delivery, certificate trees, artifacts and the event log."""

import json

import pytest

from pyspark.sql import functions as F

from unitweave.functions import scalars
from unitweave.operators import coverage, delivery
from unitweave.sources.artifacts import Artifacts, Submission
from unitweave.streaming import trace


def issues(df):
    return {(r.answer_id, r.code): (r.n, list(r.lines)) for r in df.collect()}


def test_pair_lines(spark):
    texts = ["", "(1, 2)\n(2, 10)\n", "(1, 2)\n\n(3, 4)", "\n", "1, 2\n(5,3)\nx (1, 2)", "(1, 2)\n1,2\n( 1 , 2 )", None, "(9, 10)\n(99999999999999999999, 100000000000000000000)\n(4, 4)"]
    got = issues(delivery.check_pairs(spark.createDataFrame(list(enumerate(texts)), "answer_id int, text string")))
    assert got == {(2, "pair_line_required"): (1, []), (3, "pair_line_required"): (1, []), (4, "pair_parentheses_required"): (1, [1]), (4, "pair_order"): (1, [2]), (4, "invalid_pair_line"): (1, [3]), (5, "pair_parentheses_required"): (1, [2]), (5, "duplicate_pair"): (2, [2, 3]), (7, "pair_order"): (1, [3])}


def test_records(spark):
    spec = delivery.Records(("integer", "number"), "|", "[", "]", ascending=True, allow_empty=False)
    texts = ["[1|2.5]\n[3|4]", "", None, "1|2\n[1]\n[a|2]\n[5|4]\n[1|2]", "[1|nan]\n[1|2]\n[1| 2]"]
    answers = spark.createDataFrame(list(enumerate(texts)), "answer_id int, text string")
    got = issues(delivery.check_records(answers, spec))
    assert got == {(1, "records_required"): (1, []), (2, "records_required"): (1, []), (3, "record_delimiters"): (1, [1]), (3, "field_count"): (1, [2]), (3, "field_type"): (1, [3]), (3, "record_order"): (1, [4]), (3, "duplicate_record"): (1, [5]), (4, "numeric_order_type"): (1, [1]), (4, "duplicate_record"): (1, [3])}
    rows = spark.createDataFrame([(1, 0, ["5", "2"]), (1, 1, ["1", "9"]), (1, 2, ["2", "5"])], "answer_id int, pos int, fields array<string>")
    made = delivery.render_records(rows, spec)
    assert made.first().text == "[2|5]\n[1|9]"
    assert delivery.check_records(made, spec).count() == 0
    for bad in ((("date",), ","), (("integer",), ""), (("integer",) * 9, ",")):
        with pytest.raises(ValueError):
            delivery.Records(*bad)
    found = delivery.check_json(spark.createDataFrame([(1, "[1]"), (2, "{"), (3, '{"a": 1}'), (4, None)], "answer_id int, text string"), "array").collect()
    assert {(r.answer_id, r.code) for r in found} == {(2, "invalid_json"), (3, "json_root"), (4, "invalid_json")}


def test_differences_and_status(spark):
    c = spark.createDataFrame([(1, 1, 2), (1, 3, 4), (2, 1, 2)], "answer_id int, a int, b int")
    p = spark.createDataFrame([(1, 1, 2), (1, 5, 6), (1, 7, 8), (2, 1, 2)], "answer_id int, a int, b int")
    assert [tuple(r) for r in delivery.differences(c, p).collect()] == [(1, 1, 2)]
    t = spark.createDataFrame([("x", 1, 0.5, 0.6, 0.4), ("x", 1, 0.1, 0.6, 0.4), ("x", 1, 0.1, 0.2, 0.4), ("", 1, 1.0, 1.0, 0.0), ("x", 0, 1.0, 1.0, 0.0)], "answer string, predicted int, s double, l double, f double")
    assert [r[0] for r in t.select(delivery.task_status(t.answer, t.predicted, t.s, t.l, t.f)).collect()] == ["above_floor", "invalid_format", "at_or_below_floor", "failed", "failed"]


def test_places(spark):
    ctx = spark.createDataFrame([(1, "aaa b é\U0001f600c"), (2, None)], "ctx_id int, text string")
    parts = spark.createDataFrame([(1, 1, "aa"), (2, 1, "b"), (3, 1, "c"), (4, 1, "x"), (5, 2, "a"), (6, 1, ""), (7, 1, None)], "part_id int, ctx_id int, part string")
    assert {r.part_id: r.placed_at for r in coverage.place(parts, ctx).collect()} == {1: None, 2: 4, 3: 8, 4: None, 5: None, 6: None, 7: None}
    claims = spark.createDataFrame([(1, 1, "aa", 1, 3), (2, 1, "aa", 2, 4), (3, 1, "c", 8, 9), (4, 1, "c", 8, 10)], "part_id int, ctx_id int, part string, start long, end long")
    assert {r.part_id: r.placed_at for r in coverage.verify_spans(claims, ctx).collect()} == {1: 1, 2: None, 3: 8, 4: None}


def test_trees(spark):
    nodes = spark.createDataFrame([("r", None, None, 100), ("c", "r", 50, 50), ("g", "c", 0, 20), ("q", None, None, 10), ("u", "q", None, 10), ("z", None, None, 10), ("y", "z", 0, 10), ("x", "y", 0, 5)], "node_id string, parent_id string, placed_at long, chars long")
    spans = spark.createDataFrame([("r", 0, 50), ("c", 20, 50), ("g", 0, 20), ("q", 0, 10), ("u", 0, 10), ("z", 0, 10), ("y", 0, 10), ("x", 0, 5)], "node_id string, start long, end long")
    failed = spark.createDataFrame([("x",)], "node_id string")
    got = {r.node_id: r.covers for r in coverage.tree_certificate(spans, nodes, failed).collect()}
    assert got == {"r": True, "c": True, "g": True, "q": False, "u": True, "z": False, "y": False, "x": False}


def test_artifacts(spark, tmp_path):
    store = Artifacts(spark, str(tmp_path / "a"))
    ref = store.save_text("answer", "x\ny é")
    assert ref == "artifact://answer" and store.load_text(ref) == "x\ny é"
    with pytest.raises(KeyError):
        store.load("absent")
    for bad in ("a/b", "", "..", "x" * 121):
        with pytest.raises(ValueError):
            store.load(bad)
    with pytest.raises(Exception, match="(?i)exist"):
        store.save_text("answer", "again")


def test_values_and_records(spark, tmp_path):
    store = Artifacts(spark, str(tmp_path / "a"))
    ref = store.save_value("v", {"b": (1, 2.5), "a": None})
    assert store.resolve(ref) == {"a": None, "b": [1, 2.5]} and store.resolve("plain") == "plain" and store.resolve([1]) == [1]
    with pytest.raises(KeyError):
        store.resolve("artifact://absent")
    for value, kind in ((None, "null"), (True, "boolean"), (3, "integer"), (1.5, "number"), ("x", "string"), ([1], "array"), ({"k": "é" * 90}, "object")):
        for limit in (20_000, 0):
            record = store.record(value, limit=limit)
            assert record["json_type"] == kind and store.read_record(record) == value and record["storage"] == ("inline" if limit else "artifact")
    with pytest.raises(ValueError):
        store.read_record(store.record("x") | {"value": "y"})
    for bad in (float("nan"), {1: 2}, {"a": [object()]}):
        with pytest.raises(TypeError, match="value"):
            store.record(bad)
    answers = spark.createDataFrame([(1, ref), (2, "artifact://gone"), (3, "text")], "answer_id int, text string")
    assert [r.answer_id for r in store.undelivered(answers, spark.createDataFrame([(ref,)], "ref string")).collect()] == [2]


def test_submission(spark, tmp_path):
    for k, value in enumerate(([], 0, None, {"a": 1})):
        s = Submission(spark, str(tmp_path / f"s{k}"))
        with pytest.raises(KeyError):
            s.answer()
        s.submit(value)
        assert s.committed() and s.answer() == value
        with pytest.raises(RuntimeError):
            s.submit(1)
    s = Submission(spark, str(tmp_path / "t"))
    s.submit(spark.range(3))
    assert s.answer().count() == 3


def test_modes_and_scalars(spark):
    for mode, contract in (("raw", False), ("validate_only", True), ("constrained", True)):
        delivery.check_mode(mode, contract)
    for mode, contract in (("raw", True), ("validate_repair", False), ("other", True)):
        with pytest.raises(ValueError):
            delivery.check_mode(mode, contract)
    a = spark.createDataFrame([(1, "5"), (2, " -1_000 "), (3, "5 6"), (4, None), (5, "1e5"), (6, "1\n2")], "answer_id int, text string")
    assert {r.answer_id for r in delivery.check_scalar(a, "integer").collect()} == {3, 4, 5, 6} and {r.answer_id for r in delivery.check_scalar(a, "number").collect()} == {3, 4, 6}
    assert scalars.shape({"a": [1, "xy"], "b": None}) == "dict[2] of list[2] of int | str[2 chars] | null" and scalars.as_text(["a", "b"]) == "a\n\nb"
    for bad in ([], ["a", {"x": 1}], 5, {"x": 1}):
        with pytest.raises(ValueError):
            scalars.as_text(bad)
    assert spark.range(1).select(scalars.without(F.lit("at /home/me/x and /home"), "/home", "/home/me").alias("v")).first().v == "at <host>/x and <host>"
    assert scalars.plan_key(spark.range(5).where("id > 1")) == scalars.plan_key(spark.range(5).where("id > 1")) and scalars.frame_shape(spark.range(1)) == "struct<id:bigint>"


def test_event_log(spark, tmp_path):
    log, out = tmp_path / "log", tmp_path / "out"
    log.mkdir()
    rows = [{"run_id": "a", "seq": 0, "kind": "model_turn", "turn": 1, "prompt_tokens": 5}, {"run_id": "a", "seq": 1, "kind": "subcall", "ok": False}, {"run_id": "b", "seq": 0, "kind": "finish"}]
    (log / "1.json").write_text("\n".join(map(json.dumps, rows[:2])) + "\n\n")
    trace.keep_trajectories(spark, str(log), str(out), str(tmp_path / "c"))
    (log / "2.json").write_text(json.dumps(rows[2]) + "\n")
    trace.keep_trajectories(spark, str(log), str(out), str(tmp_path / "c"))
    want = sorted(map(tuple, trace.trajectory(trace.read(spark, str(log))).collect()))
    assert [(r[0], r[1], r[2], r[4], r[5], r[6], r[9]) for r in want] == [("a", 2, 1, 1, 1, 5, False), ("b", 1, 0, 0, 0, 0, True)]
    assert sorted(map(tuple, spark.read.parquet(str(out / "batch=1")).collect())) == want
