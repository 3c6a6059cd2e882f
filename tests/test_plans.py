"""Corpora, plans, manifests, presentations and the workbench."""

import pytest

from pyspark.sql import functions as F

from unitweave.operators import sweep
from unitweave.plans import manifest, presentation
from unitweave.plans.workbench import Workbench
from unitweave.sources import corpora


def test_corpus(spark, tmp_path):
    made = corpora.records(spark, 300)
    t = corpora.truths(made).first()
    assert (t.records, t.stoppages, t.night_crew) == (300, 27, 100) and t.keyword_count > t.stoppages > 0 < t.traps
    ctx = corpora.context(made)
    cut = corpora.split_records(ctx).orderBy("index").collect()
    assert [c["index"] for c in cut] == list(range(300)) and cut[4].record.startswith("=== Record 0004 ===\nDepot: Espoo")
    judge = sweep.rule_judge(lambda s: F.when(F.exists(F.array(*map(F.lit, corpora.STOPPED)), lambda x: F.contains(s, x)), "yes").otherwise("no"))
    e = sweep.Sweeps(spark, str(tmp_path), judge).semantic_search(ctx, "did work stop?").envelope
    assert (e["total"], e["positive_count"], e["status"]) == (300, 27, "complete")


def test_dated_records(spark):
    plain = "preamble\nDate: Feb 02, 2023 || User: 10 || Instance: how far?\r\nDate: nonsense\nDate: Mar 2, 2023 || User: 7 || Instance: why || not"
    labelled = "Date: Feb 02, 2023 || User: 10 || Instance: how far? || Label: entity\nDate: Mar 2, 2023 || User: 7 || Instance: why || not || Label:  x "
    a, b = (corpora.dated_records(spark.createDataFrame([(0, t)], "ctx_id int, text string")) for t in (plain, labelled))
    got = a.orderBy("index").collect()
    assert [(r.user, r.question, r.label, str(r.date), plain[r.start : r.end][:5]) for r in got] == [(10, "how far?", None, "2023-02-02", "Date:"), (7, "why || not", None, "2023-03-02", "Date:")]
    assert [r.label for r in b.orderBy("index").collect()] == ["entity", "x"] and corpora.disagreements(a, b).count() == 0
    assert corpora.disagreements(a, b.where("index = 0").withColumn("user", F.lit(9).cast("long"))).count() == 2


def test_checked_plans(spark):
    rows = spark.createDataFrame([(1, "a", 5.0, "paid"), (2, "b", 7.0, "void"), (3, "a", 9.0, "paid"), (4, "c", 8.0, "void")], "id int, dep string, amount double, status string")
    run = lambda **p: corpora.execute(p, rows).collect()
    assert run(op="sum", column="amount", filters={"status": "paid"})[0].value == 14 and run(op="count", filters={"dep": "a"})[0].value == 2
    assert run(op="max", column="id", of="amount", filters={"status": "void"})[0].value == 4 and len(run(op="list", filters={"amount": [6, 8]})) == 2
    assert run(op="sum", column="amount", filters={"dep": "none"})[0].value == 0
    for bad in ({"op": "drop"}, {"op": "sum", "column": "x"}):
        with pytest.raises(ValueError):
            corpora.execute(bad, rows)


def test_manifests(spark, tmp_path):
    a, b = manifest.build(spark, task=1), manifest.build(spark, task=2)
    assert manifest.differences(a, b) == ["facts.task"] and manifest.signature(a) != manifest.signature(b) and manifest.differences(a, manifest.build(spark, task=1)) == []
    manifest.write(spark, a, str(tmp_path / "m"))
    assert manifest.read(spark, str(tmp_path / "m")) == a
    with pytest.raises(Exception, match="(?i)exist"):
        manifest.write(spark, b, str(tmp_path / "m"))
    rows = [(k, "s", True, f"({k}, 9)", 0.5, 0.50001) for k in (1, 2, 3)]
    good = spark.createDataFrame(rows, "task int, signature string, clean boolean, answer string, f1 double, recomputed_f1 double").withColumn("answer_sha256", F.sha2("answer", 256))
    assert manifest.consolidation_problems(good, [1, 2, 3]).count() == 0
    bad = good.where("task < 3").unionByName(good.where("task = 1")).unionByName(good.where("task = 2").withColumns({"task": F.lit(9), "signature": F.lit("t"), "clean": F.lit(False), "f1": F.lit(0.9), "answer": F.lit("x")}))
    got = {(r.problem, r.detail) for r in manifest.consolidation_problems(bad, [1, 2, 3]).collect()}
    assert got == {("mixed manifests", "2"), ("changed code", "9"), ("duplicate task", "1"), ("missing task", "3"), ("unknown task", "9"), ("answer digest", "9"), ("score", "9")}


def test_presentations(spark):
    pairs = {"kind": "records", "fields": ["integer", "integer"], "separator": ", ", "prefix": "(", "suffix": ")", "ascending": True}
    assert presentation.render(spark, [[5, 2], (1, 9), [2, 5]], pairs) == "(2, 5)\n(1, 9)" and presentation.render(spark, [], pairs) == ""
    assert presentation.render(spark, {"b": 1, "a": [None]}, {"kind": "json"}) == '{"a":[null],"b":1}'
    assert presentation.render(spark, 5, {"kind": "scalar", "value_type": "integer"}) == "5" and presentation.render(spark, "x\ny", {"kind": "free_text"}) == "x\ny"
    for value, spec in (([[1]], pairs), ([1], {"kind": "json"}), ("x", {"kind": "scalar", "value_type": "number"}), ([1], {"kind": "free_text"}), ([["a", "b"]], pairs | {"ascending": False})):
        with pytest.raises(ValueError):
            presentation.render(spark, value, spec)
    for bad in ({}, {"kind": "table"}, {"kind": "json", "fields": 1}, {"kind": "json", "root": "x"}, {"kind": "scalar"}, {"kind": "records", "fields": [], "separator": ","}):
        with pytest.raises((ValueError, TypeError)):
            presentation.normalise(bad)
    say = lambda text: lambda requests: requests.select("request", F.lit(text).alias("reply"))
    assert presentation.infer(spark, say('{"kind": "scalar", "value_type": "integer"}'), "how many?")["spec"] == {"kind": "scalar", "value_type": "integer"}
    wrong = presentation.infer(spark, say('{"kind": "poem"}'), "how many?")
    assert wrong["spec"] == {"kind": "free_text"} and wrong["problem"]


def test_workbench(spark):
    spark.range(7).createOrReplaceTempView("numbers_here")
    w = Workbench(spark, sample=2)
    first = w.execute("SELECT sum(id) AS s FROM numbers_here")
    assert first["ok"] and first["sample"] == [{"s": 21}] and first["repeated"] is None and first["schema"] == "struct<s:bigint>"
    assert w.execute("SELECT sum(id)   AS s FROM numbers_here")["repeated"] == 0 and len(w.execute("SELECT * FROM numbers_here")["sample"]) == 2
    bad = w.execute("SELECT nothing FROM nowhere")
    assert not bad["ok"] and "numbers_here" in bad["tables"] and len(w.turns) == 4
    w.isolate()
