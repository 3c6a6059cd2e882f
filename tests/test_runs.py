"""The stream of runs equals the batch over all events: out of order, twice, over restarts, with gaps."""

import random

import pytest

from unitweave.streaming import runs, trace

KINDS = ["model_turn", "tool_call", "subcall", "subcall", "subcall", "batch_start", "finish", "other"]


def log(seed, sizes):
    rng, rows = random.Random(seed), []
    for run, n in sizes.items():
        for seq in range(n):
            kind = rng.choice(KINDS)
            rows.append((run, seq, kind, rng.choice([None, rng.randrange(9)]), rng.choice([True, False, False, None]), rng.choice([None, 5]), rng.choice([None, 7]), rng.choice([None, rng.randrange(30)])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "run_id string, seq long, kind string, turn long, ok boolean, prompt_tokens long, completion_tokens long, batch long").selectExpr("*", "CAST(NULL AS DOUBLE) AS seconds")


def test_in_batches_out_of_order_and_again(spark, tmp_path):
    rows = log(1, {"a": 80, "b": 7, "c": 1})
    order = rows[:]
    random.Random(2).shuffle(order)
    folder, table, checkpoint = (str(tmp_path / x) for x in ("log", "table", "checkpoint"))
    for at in range(0, len(order), 30):
        part = order[at : at + 30] + order[max(0, at - 5) : at]  # some come twice
        trace.append(frame(spark, part), folder)
        runs.keep_runs(spark, folder, table, checkpoint)  # each time a restart from the checkpoint
    got = {r.run_id: r for r in runs.current(spark, table).collect()}
    want = {r.run_id: r for r in runs.batch_runs(frame(spark, rows)).collect()}
    assert set(got) == set(want) == {"a", "b", "c"}
    for run, w in want.items():
        assert {n: got[run][n] for n in w.asDict()} == w.asDict()
        assert (got[run].waiting, got[run].closed, got[run].next_seq) == (0, False, sum(r[0] == run for r in rows))
    small = str(tmp_path / "small")
    assert sorted(runs.compact(spark, table, small).collect()) == sorted(runs.current(spark, table).collect())
    changed = spark.read.option("basePath", table).parquet(f"{table}/version=*").groupBy("version").count().collect()
    assert len(changed) > 2 and all(r["count"] <= 3 for r in changed)


def test_early_events_wait_and_silence_closes(spark, tmp_path):
    rows = log(3, {"gap": 12})
    folder, table, checkpoint = (str(tmp_path / x) for x in ("log", "table", "checkpoint"))
    trace.append(frame(spark, [r for r in rows if r[1] not in (4, 9)]), folder)
    runs.keep_runs(spark, folder, table, checkpoint, patience=0)
    first = spark.read.parquet(f"{table}/version=0").where("NOT closed").first()
    assert (first.next_seq, first.waiting, first.events) == (4, 6, 4)
    trace.append(frame(spark, [(("other"), *rows[0][1:])]), folder)  # another run's event starts a batch, and time has passed
    runs.keep_runs(spark, folder, table, checkpoint, patience=0)
    last = runs.current(spark, table).where("run_id = 'gap'").first()
    want = runs.batch_runs(frame(spark, [r for r in rows if r[1] not in (4, 9)])).first()
    assert last.closed and last.waiting == 0 and {n: last[n] for n in want.asDict()} == want.asDict()


@pytest.mark.parametrize("sizes", [{}, {"x": 3}])
def test_batch_alone(spark, sizes):
    got = runs.batch_runs(frame(spark, log(4, sizes))).collect()
    assert len(got) == len(sizes)
