"""Scans in stretches, trees of any depth, interval joins, hash trees and recursion against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from unitweave.operators import coverage, identity, intervals, provenance, scan, sweep, trees
from unitweave.plans import recursion
from unitweave.plans.budget import Budget
from unitweave.streaming import trace


@pytest.fixture(params=[3, 1 << 16])
def width(request, monkeypatch):
    """Stretches so narrow that every key has many, and the usual ones."""
    monkeypatch.setattr(scan, "WIDTH", request.param)


def islands(spans):
    out = []
    for a, b in sorted(s for s in spans if s[1] is not None and s[0] is not None and s[1] > s[0]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def test_unions_and_gaps(spark, width):
    rng = random.Random(1)
    spans = [(rng.choice([1, 1, 1, 2, None]), a := rng.randrange(-5, 60), a + rng.choice([0, 1, 2, 9, 40, -3])) for _ in range(150)] + [(2, None, 5), (2, 5, None), (3, 7, 7)]
    df = spark.createDataFrame(spans, "ctx_id int, start long, end long")
    want = {(k, *s) for k in {s[0] for s in spans} for s in islands([x[1:] for x in spans if x[0] == k])}
    assert {tuple(r) for r in coverage.union(df).collect()} == want
    sizes = {1: 120, 2: 80, 3: 30, 4: 0}
    got = {tuple(r) for r in coverage.gaps(df.where("start >= 0"), spark.createDataFrame(list(sizes.items()), "ctx_id int, chars long")).collect()}
    want = set()
    for k, n in sizes.items():
        at = 0
        for a, b in islands([x[1:] for x in spans if x[0] == k and x[1] is not None and x[1] >= 0]):
            if a > at and a <= n:
                want.add((k, at, a))
            at = max(at, b)
        if at < n:
            want.add((k, at, n))
    assert {g for g in got if g[2] <= sizes[g[0]]} == want


def test_runs_marks_and_streaks(spark, width):
    rng = random.Random(2)
    rows = [(k, i * 2, rng.choice(["a", "a", "b", None]), rng.random() < 0.1, rng.random() < 0.3) for k, n in (("hot", 300), ("x", 5), (None, 7), ("one", 1)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, at long, kind string, mark boolean, bad boolean")
    by_key = defaultdict(list)
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        by_key[r[0]].append(r)
    runs, asof, streaks = set(), set(), set()
    for key, own in by_key.items():
        n, run, last, longest, here = 0, 0, None, 0, 0
        for j, (_, at, kind, mark, bad) in enumerate(own):
            if j and kind != own[j - 1][2]:
                runs.add((key, run, own[j - 1][2], n))
            if not j or kind != own[j - 1][2]:
                run, n = run + 1, 0
            n += 1
            if mark:
                last = at
            else:
                asof.add((key, at, last))
            here = 0 if mark else here
            here += bad
            longest = max(longest, here)
        runs.add((key, run, own[-1][2], n))
        streaks.add((key, longest))
    assert {tuple(r) for r in coverage.runs(df, "key", "at", "kind").collect()} == runs
    assert {tuple(r) for r in coverage.last_before(df, "key", "at", "mark", "at").select("key", "at", "as_of").collect()} == asof
    assert {tuple(r) for r in provenance.streaks(df, "key", "at", "bad", "mark").collect()} == streaks


def test_a_hot_key_is_spread(spark, monkeypatch):
    """Half of all spans in one text: no task of the scan has more than its stretches."""
    monkeypatch.setattr(scan, "WIDTH", 1000)
    df = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("ctx_id"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"))
    sizes = scan.stretches(df, "start").groupBy("ctx_id", "stretch").count().agg(F.max("count")).first()[0]
    assert sizes <= 1000 and coverage.union(df).where("ctx_id = 0").count() == 20_000


def test_dates_and_times_have_stretches(spark):
    df = spark.sql("SELECT 'k' AS key, DATE'2024-01-01' + INTERVAL 1 DAY * id AS at, TIMESTAMP'2024-01-01 00:00:00' + INTERVAL 1 HOUR * id AS ts, id % 3 AS v FROM range(50)")
    for order in ("at", "ts"):
        assert coverage.runs(df.withColumn("at", F.col("at").cast("date")), "key", order, "v").count() == 50


def test_positions(spark):
    rows = [(random.Random(i).randrange(10**6), i) for i in range(3000)]
    got = scan.numbered(spark.createDataFrame(rows, "a long, i long").repartition(7), "a", "i", parts=5)
    assert [r.i for r in got.orderBy("position").collect()] == [i for _, i in sorted(rows)]
    assert sorted(r.position for r in got.collect()) == [*range(3000)]


def test_a_budget_is_no_limit(spark, capsys):
    jobs = spark.range(100_000).select((F.lit(100_000) - F.col("id")).alias("job_seq"))
    kept = Budget(max_calls=90_000).admit(jobs).where("sent")
    assert kept.count() == 90_000 and kept.agg(F.max("job_seq")).first()[0] == 90_000
    kept.explain()
    assert "TakeOrdered" not in capsys.readouterr().out


def forest(n, seed=0):
    rng = random.Random(seed)
    return [(i, None if i < 2 else rng.choice([i - 1, i - 1, rng.randrange(i)])) for i in range(n)]


def above(nodes):
    parent = dict(nodes)
    for i, _ in nodes:
        at, d = parent[i], 1
        while at is not None:
            yield i, at, d
            at, d = parent.get(at), d + 1


def test_ancestors_and_sums(spark):
    nodes = [*forest(120), (500, 499)]  # 499 has no row of its own
    df = spark.createDataFrame([(i, p, i % 7, i % 5) for i, p in nodes], "node_id long, parent_id long, calls long, peak long")
    want = set(above(nodes))
    assert max(d for *_, d in want) > 15
    assert {tuple(r) for r in trees.ancestors(df).collect()} == want
    sums = {i: [(i % 7, i % 5)] for i, _ in nodes} | {499: []}
    for i, a, _ in want:
        sums[a].append((i % 7, i % 5))
    assert {tuple(r) for r in trace.rolled_up(df).collect()} == {(i, sum(c for c, _ in v), max(p for _, p in v)) for i, v in sums.items()}


@pytest.mark.parametrize("ring", [[(1, 1)], [(1, 2), (2, 3), (3, 1)], [(1, 2), (2, 1), (3, 1), (4, 3), (5, None)]])
def test_rings_are_errors(spark, ring):
    with pytest.raises(ValueError, match="above themselves"):
        trees.ancestors(spark.createDataFrame(ring, "node_id long, parent_id long"))


def test_unions_of_few_and_of_many_spans(spark, width):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), a := rng.randrange(200), a + rng.randrange(-1, 6)) for _ in range(120)] + [(4, 5, 6), (5, 7, 9), (5, 9, 12), (5, 7, 8), (6, None, 3), (6, 3, None)]
    got = coverage.union_written(spark.createDataFrame(rows, "ctx_id long, start long, end long"))
    texts = defaultdict(list)
    for c, a, b in rows:
        texts[c].append((a, b))
    assert sorted(map(tuple, got.collect())) == sorted((c, a, b) for c in (1, 2, 3, 4, 5) for a, b in islands(texts[c]))


def test_certificates_of_a_forest_from_one_ladder(spark, width, monkeypatch):
    """Deep, with unplaced nodes and failed ones; the jumps are written once for spans and for what is bad."""
    rng = random.Random(9)
    nodes = [(i, p, rng.choice([None, 0, 10, 30, 60]) if i % 5 == 0 else rng.randrange(40)) for i, p in forest(60, 4)]
    spans = [(i, rng.randrange(30), rng.randrange(40, 110)) for i in range(60) if i % 7] + [(None, 0, 100), (1000, 0, 100)]
    failed = {k for k in range(60) if k % 23 == 22}
    parent, at, read = {i: p for i, p, _ in nodes}, {i: a for i, _, a in nodes}, defaultdict(list)
    for i, a, b in spans:
        while i is not None:
            read[i].append((a, b))
            if at.get(i) is None or parent[i] is None:
                break
            a, b, i = a + at[i], b + at[i], parent[i]
    bad = {i for i, *_ in nodes if i in failed or sum(b - a for a, b in islands(read[i])) < 98}
    bad |= {p for i, p, a in nodes if p is not None and a is None}
    for i in sorted(bad):
        while i is not None:
            bad.add(i)
            i = parent[i]
    written, settle = [], trees.settle
    monkeypatch.setattr(trees, "settle", lambda df, name: (written.append(name), settle(df, name))[1])
    df = spark.createDataFrame([(*n, 100) for n in nodes], "node_id long, parent_id long, placed_at long, chars long")
    got = coverage.tree_certificate(spark.createDataFrame(spans, "node_id long, start long, end long"), df, spark.createDataFrame([(k,) for k in failed], "node_id long"))
    assert sorted(map(tuple, got.collect())) == [(i, i not in bad) for i in range(60)] and 0 < len(bad) < 60
    assert len([n for n in written if n == "jumps-0"]) == 1


def test_spans_of_four_nested_nodes_reach_the_root(spark):
    """Each inside the one above at 10; the deepest read to a tenth: none above it covers."""
    nodes = [(1, None, None, 100), (2, 1, 0, 100), (3, 2, 0, 100), (4, 3, 0, 100)]
    df = spark.createDataFrame(nodes, "node_id long, parent_id long, placed_at long, chars long")
    spans = spark.createDataFrame([(1, 0, 100), (2, 0, 100), (3, 0, 100), (4, 0, 10)], "node_id long, start long, end long")
    none = df.select("node_id").limit(0)
    assert {tuple(r) for r in coverage.tree_certificate(spans, df, none).collect()} == {(k, False) for k in (1, 2, 3, 4)}
    deep = coverage.lifted(spans.where("node_id = 4"), df.withColumn("placed_at", F.col("placed_at") + 10))
    assert {tuple(r) for r in deep.collect()} == {(4, 0, 10), (3, 10, 20), (2, 20, 30), (1, 30, 40)}
    full = spans.withColumn("end", F.lit(100))
    assert all(r.covers for r in coverage.tree_certificate(full, df, none).collect())
    cut = df.withColumn("placed_at", F.when(F.col("node_id") != 3, F.col("placed_at")))  # a node in the middle isn't placed
    assert {tuple(r) for r in coverage.tree_certificate(full, cut, none).collect()} == {(1, False), (2, False), (3, True), (4, True)}
    assert {r.ctx_id for r in coverage.lifted(spans.where("node_id = 4"), cut).collect()} == {4, 3}
    failed = df.where("node_id = 4").select("node_id")
    assert not any(r.covers for r in coverage.tree_certificate(full, df, failed).collect())


@pytest.mark.parametrize("closed", [False, True])
def test_intervals(spark, closed):
    rng = random.Random(4)
    held = [(rng.choice("ab") if rng.random() < 0.95 else None, a := rng.randrange(-3000, 10**rng.randrange(2, 7)), a + rng.choice([0, -1, 1, 63, 64, 65, 512, 513, 10**5, 10**6]), i) for i in range(300)]
    places = [(rng.choice(["a", "b", "c", None]), rng.choice([rng.randrange(-3500, 10**6), held[rng.randrange(300)][1], held[rng.randrange(300)][2]]), i) for i in range(400)] + [("a", None, 999)]
    got = intervals.holding(spark.createDataFrame(places, "key string, at long, p int"), spark.createDataFrame(held, "key string, start long, end long, i int"), "key", "at", closed=closed)
    assert set(got.columns) == {"key", "at", "p", "start", "end", "i"}
    rows = [(r.p, r.i) for r in got.collect()]
    want = {(p, i) for k, at, p in places for h, a, b, i in held if k is not None and k == h and at is not None and a <= at and (at <= b if closed else at < b) and (a < b or closed and a <= b)}
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 1000


def test_one_text_of_a_million_units(spark):
    """What is compared stays near what is found: joined rows before the last test are at most twenty times the result."""
    units = spark.range(1_000_000).select(F.lit(1).alias("ctx_id"), (F.col("id") * 50).alias("start"), F.col("id").alias("item"))
    segs = spark.range(12_500).select(F.lit(1).alias("ctx_id"), (F.col("id") * 4000).alias("from"), ((F.col("id") + 1) * 4000).alias("to"), F.col("id").alias("ref"))
    got = intervals.holding(units, segs, "ctx_id", "start", "from", "to")
    assert got.count() == 1_000_000 and got.where("ref <> item div 80").isEmpty()


def test_roster_in_two_hops(spark):
    notes = spark.sql("SELECT * FROM VALUES (1, 'night', DATE'2024-03-12'), (2, 'night', DATE'2024-03-17'), (3, 'day', DATE'2024-03-10'), (4, 'night', DATE'2024-05-01'), (5, NULL, DATE'2024-03-12') t(note_id, crew, day)")
    roster = spark.sql("SELECT * FROM VALUES ('night', DATE'2024-03-10', DATE'2024-03-16', 'T'), ('night', DATE'2024-03-17', DATE'2024-03-23', 'P'), ('day', DATE'2024-03-10', DATE'2024-03-16', 'R'), ('day', DATE'2024-03-03', DATE'2024-03-10', 'S') t(crew, first_day, last_day, lead)")
    assert sorted(tuple(r) for r in intervals.on_duty(notes, roster).collect()) == [(1, "T"), (2, "P"), (3, "R"), (3, "S")]


def test_digests_are_the_contents(spark):
    rows = [(k, i, f"t{i * k}") for k in (1, 2, 30) for i in range(2500 if k == 2 else 40)]
    make = lambda r, n: identity.content_digest(spark.createDataFrame(r, "k int, i long, t string").repartition(n), "k", "i", "t")
    one = make(rows, 1)
    assert one == make(rows[::-1], 5) and len(one) == 64
    changed = [(k, i, t + "x" if (k, i) == (2, 2000) else t) for k, i, t in rows]
    assert len({one, make(changed, 3), make(rows[:-1], 3), make([(1, 0, None)], 1), make([(1, 0, "")], 1)}) == 5
    assert identity.content_digest(spark.createDataFrame([], "k int, i long, t string"), "k", "i", "t") == ""


RULE = sweep.rule_judge(lambda s: F.when(F.contains(s, F.lit("handover")), "yes").otherwise("no"))
TEXT = "\n".join(f"shift {k} {'handover' if k % 3 == 0 else 'routine'} by tech{k % 4}" for k in range(900))


def test_recursion_in_three_levels(spark, tmp_path):
    ctx = spark.createDataFrame([("1", TEXT), ("2", "one handover"), ("3", " \n"), ("4", None)], "ctx_id string, text string")
    budget = Budget(max_nodes=50, max_depth=2)
    e = recursion.explore(spark, ctx, "is it a handover?", RULE, str(tmp_path), budget, recursion.by_segments(2, 5_000))
    nodes = {r.node_id: r for r in e.nodes.collect()}
    assert max(r.depth for r in nodes.values()) == 2 and {r.status for r in nodes.values()} == {"expanded", "answered", "empty"}
    assert budget.ledger.nodes == 1 + sum(r.depth > 0 for r in nodes.values())
    totals = {r.node_id: (r.examined, r.positive) for r in e.totals.collect()}
    assert totals["1"] == (900, 300) and totals["2"] == (1, 1) and totals["3"] == (0, 0)
    assert all(totals[k][1] == sum(totals[c][1] for c, r in nodes.items() if r.parent_id == k) for k, r in nodes.items() if r.status == "expanded")
    covers = {r.node_id: r.covers for r in e.certificate.collect()}
    assert covers["1"] and covers["2"] and covers["3"] and "4" not in covers


def test_recursion_stops_at_rings_and_limits(spark, tmp_path):
    """A child with its parent's question and text is refused, one with a sibling's text is not sent again, and children beyond the nodes left are named."""
    ctx = spark.createDataFrame([("1", TEXT[:3000]), ("2", TEXT[3000:6000])], "ctx_id string, text string")

    def expand(nodes):
        halves = F.array(F.struct(F.lit("a").alias("child"), F.substring("text", 1, 1500).alias("text")), F.struct(F.lit("b").alias("child"), F.substring("text", 1, 1500).alias("text")), F.struct(F.lit("c").alias("child"), F.col("text").alias("text")), F.struct(F.lit("d").alias("child"), F.substring("text", 1501, 1500).alias("text")))
        return nodes.where(F.length("text") > 2000).select("node_id", "question", F.explode(halves).alias("h")).select("node_id", "h.child", "question", "h.text", F.lit(None).cast("long").alias("placed_at"))

    budget = Budget(max_nodes=6, max_depth=2)
    e = recursion.explore(spark, ctx, "is it a handover?", RULE, str(tmp_path), budget, expand)
    status = {r.node_id: (r.status, r.same_as, r.placed_at) for r in e.nodes.collect()}
    assert status["1/c"][0] == status["2/c"][0] == "cycle" and status["1"][0] == status["2"][0] == "expanded"
    assert status["1/a"] == ("answered", None, 0) and status["1/b"] == ("reused", "1/a", 0) and status["1/d"][0] == "answered"
    assert status["2/a"][0] == "answered" and status["2/b"][0] == "reused" and status["2/d"][0] == "max_nodes" and budget.ledger.nodes == 6
    totals = {r.node_id: r.positive for r in e.totals.collect()}
    assert totals["1"] == totals["1/a"] * 2 + totals["1/d"] and totals["2/b"] == totals["2/a"] > 0
    covers = {r.node_id: r.covers for r in e.certificate.collect()}
    assert covers["1/a"] and covers["1/b"] and not covers["1"] and not covers["2"]  # a refused child is no coverage
