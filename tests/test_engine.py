"""The engine's operators against plain Python on literal fixtures."""

import datetime
import random
import re

import pytest

from pyspark.sql import functions as F

from unitweave.functions.leaf import parse_replies, validate
from unitweave.functions.text import bare
from unitweave.operators import coverage, pairs, text
from unitweave.plans import pair_specs
from unitweave.plans.budget import Budget
from unitweave.plans.schema import parse

TEXTS = [
    "", "\n\n\n", "\n\nalpha\nbeta\n", "alpha\n\n\nbeta\n", "alpha\nbeta\n\n\n", "a || b\nc || d\n\n\ne || f\n", "# One\n\ntext\n\n# Two\n\nmore\n",
    "def f():\n    pass\n\n\ndef g():\n    pass\n", "x\r\ny\x85z w", "--- doc\nbody\n=== other\n\nnext", "".join(f"r{i} | a | b\n" for i in range(9)), "é\U0001f600a\nb", "word " * 900,
    "\n".join(f"line {i} " + "x" * (i * 37 % 500) for i in range(120)), "short\n" + "y" * 30_000 + "\ntail\n",
]


@pytest.fixture(scope="module")
def ctx(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "ctx_id int, text string")


def test_structure_units_segments(ctx, spark):
    """Properties of the layout: what tiles, what is blank, where cuts may be, how large segments are."""
    found = {r.ctx_id: r.structure for r in text.kinds(ctx).collect()}
    assert [found[k] for k in (11, 3, 6, 7, 10)] == ["lines", "paragraphs", "sections", "code", "rows"]
    units = {k: [] for k in range(len(TEXTS))}
    for r in text.units(ctx).orderBy("ctx_id", "item").collect():
        units[r.ctx_id].append(r)
    for k, t in enumerate(TEXTS):
        assert "".join(u.source for u in units[k]) == (t if t.strip() else "")
        assert [u.item for u in units[k]] == list(range(len(units[k]))) and all(u.source.strip() and t[u.start : u.end] == u.source for u in units[k])
    starts = lambda k: [u.source.split()[0] for u in units[k]]
    assert starts(2) == ["alpha", "beta"][: len(units[2])] and starts(6) == ["#", "text", "#", "more"] and starts(7) == ["def", "def"] and starts(8) == ["x", "y", "z"]
    assert starts(9)[0] == "---" and "===" in starts(9) and len(units[10]) == 9
    for low, target, high in ((400, 4000, 12000), (80, 400, 700)):
        segs = text.segments(ctx, low=low, target=target, high=high, text=True)
        own = {k: [] for k in range(len(TEXTS))}
        for r in segs.orderBy("ctx_id", "seg_no").collect():
            own[r.ctx_id].append(r)
        for k, t in enumerate(TEXTS):
            s, ends = own[k], {u.end for u in units[k]}
            assert "".join(x.text for x in s) == (t if t.strip() else "") and [x.ref for x in s] == [f"s{i:04d}" for i in range(len(s))]
            large = [u for u in units[k] if u.end - u.start > high]
            inside = lambda e: any(u.start < e < u.end and (e - u.start) % high == 0 for u in large)
            assert all(x.end in ends or inside(x.end) for x in s)  # cut at units, or every `high` characters of a large one
            begins = {u.start for u in large}
            for i, x in enumerate(s[:-1]):
                assert x.end - x.start >= target or x.end in begins  # closed by size, or before a large unit
            for i, x in enumerate(s[:-1]):  # and no earlier unit would have closed it
                earlier = [e for e in ends if x.start < e < x.end]
                assert all(e - x.start < target for e in earlier) or i == len(s) - 2 and x.end == len(t)
            assert len(s) < 2 or s[-1].end - s[-1].start >= low
            pieces = ends | {u.start + j for u in large for j in range(0, u.end - u.start, high) if u.start + j}
            assert [x.units for x in s] == [sum(x.start < e <= x.end for e in pieces) for x in s]
        ok = {r.ctx_id: r.tiles for r in text.tiles(segs, ctx).collect()}
        assert all(ok[k] == bool(t.strip() or not t) for k, t in enumerate(TEXTS))
        for slots in (1, 3):
            made = {k: [] for k in range(len(TEXTS))}
            for r in text.parts(ctx, slots, low=low, target=target, high=high, text=True).orderBy("ctx_id", "part").collect():
                made[r.ctx_id].append(r)
            for k, t in enumerate(TEXTS):
                assert "".join(p.text for p in made[k]) == t and len(made[k]) <= slots
                ends = [x.end for x in own[k]]
                for i, p in enumerate(made[k][:-1], 1):
                    far = abs(p.end - len(t) * i / slots)
                    assert p.end in ends and all(abs(e - len(t) * i / slots) >= far for e in ends if p.start < e < len(t))
    with pytest.raises(ValueError):
        text.segments(ctx, low=5, target=4, high=9)
    sizes = [len(r.text) for r in text.partition(ctx.where("ctx_id = 13"), 900).collect()]
    assert sum(sizes) == len(TEXTS[13]) and all(s <= 2700 for s in sizes)


def test_store_refs_and_lint(ctx, spark, tmp_path):
    store = text.ContextStore(spark, str(tmp_path))
    m = store.bind(ctx, target=400, low=80, high=None)
    assert m.count() == len(TEXTS) and store.band == {"target": 400, "low": 80}
    first = store.segments()
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, text.segments(ctx, target=400, low=80).collect()))
    assert store.segments().inputFiles() == first.inputFiles()  # read again, not made again
    for r in store.by_ref("s0001").collect():
        assert store.read("s0001").where(f"ctx_id = {r.ctx_id}").first().text == TEXTS[r.ctx_id][r.start : r.end]
    gone = store.read("s0999").where("ctx_id = 13").first()
    assert gone.text is None and gone.problem.startswith("no segment 's0999'; there are s0000 to s")
    joined = text.to_segments(text.units(ctx, source=False), text.segments(ctx)).collect()
    assert len(joined) == text.units(ctx).count() and {r.ref for r in joined if r.ctx_id == 12} == {"s0000"}
    assert [text.empty_alternative(p) for p in ("a||b", r"a\||b", "[|]|b", "[||]", "a|b", r"\\||")] == [True, False, False, False, False, True]
    for bad in ("(", "a||b", "x*"):
        with pytest.raises(ValueError):
            text.search(ctx, bad, regex=True)
    hits = text.search(ctx, "line 1")
    refs = {r.ctx_id: r for r in text.search_refs(hits).collect()}
    assert refs[13].returned == min(40, refs[13].matches) and refs[13].refs == sorted({r.ref for r in hits.collect()})


def test_search_read(ctx):
    for pattern, regex in (("a", False), (r"\w+ \|", True), ("E", False), ("(", False), ("\n", False)):
        got = {}
        for r in text.search(ctx, pattern, regex).collect():
            got.setdefault(r.ctx_id, []).append((r.hit, r.start, r.line, r.excerpt, r.matches))
            assert TEXTS[r.ctx_id] and (r.ref is None) == (not TEXTS[r.ctx_id].strip())
        for k, t in enumerate(TEXTS):
            m = list(re.finditer(pattern if regex else re.escape(pattern), t, re.I))
            want = [(i, x.start(), t.count("\n", 0, x.start()) + 1, t[max(0, x.start() - 80) : x.start() + 160].replace("\n", " ⏎ "), len(m)) for i, x in enumerate(m[:40])]
            assert sorted(got.get(k, [])) == want
    assert {r.ctx_id: r.text for r in text.read(ctx, -3, 7).collect()} == {k: t[:7] for k, t in enumerate(TEXTS)}
    assert {r.ctx_id: r.text for r in text.read(ctx, 4).collect()} == {k: t[4:] for k, t in enumerate(TEXTS)}
    m = {r.ctx_id: r for r in text.manifest(ctx).collect()}
    assert m[0].structure == "empty" and m[0].lines == 0 and m[3].lines == 5 and m[12].segments == 1


def test_coverage(spark):
    rng = random.Random(4)
    spans = [(k, a, a + rng.randint(-2, 9)) for k in range(5) for a in (rng.randint(0, 60) for _ in range(9))]
    s = spark.createDataFrame(spans, "ctx_id int, start long, end long")
    sizes = spark.createDataFrame([(k, 80) for k in range(6)] + [(9, 0)], "ctx_id int, chars long")
    inside = {k: {x for c, a, b in spans if c == k for x in range(a, b)} for k in range(6)}
    got = {k: set() for k in range(6)}
    for r in coverage.union(s).collect():
        assert not got[r.ctx_id] & set(range(r.start, r.end))
        got[r.ctx_id] |= set(range(r.start, r.end))
    assert got == inside
    free = {k: set() for k in range(6)}
    for r in coverage.gaps(s, sizes).collect():
        free[r.ctx_id] |= set(range(r.start, r.end))
    assert free == {k: set(range(80)) - inside[k] for k in range(6)}
    share = {r.ctx_id: r.share for r in coverage.fraction(s, sizes).collect()}
    assert share[9] == 0 and all(share[k] == pytest.approx(len(inside[k]) / 80) for k in range(6))
    whole = coverage.fraction(spark.createDataFrame([(1, 0, 80), (2, 0, 79)], "ctx_id int, start long, end long"), sizes)
    c = {r.ctx_id: r.covers for r in coverage.certificate(whole, spark.createDataFrame([(1,)], "ctx_id int")).collect()}
    assert not c[1] and c[2] and not c[9] and not c[0]


LABELLED = "Date: Feb 02, 2023 || User: 10 || Instance: q || Label: entity\nDate: Mar 02, 2023 || User: 10 || Instance: q || Label: abbreviation\nDate: Apr 02, 2023 || User: 20 || Instance: q || Label: entity\nnoise\nDate: May 2, 2023 || User: 30 || Instance: q || Label: location"


def test_pairs(spark):
    e = pairs.entries(spark.createDataFrame([(LABELLED,)], "text string"))
    assert sorted(map(tuple, e.collect()))[0] == (10, "abbreviation", datetime.date(2023, 3, 2)) and e.count() == 4
    get = lambda spec: sorted(map(tuple, pairs.pairs(e, spec).collect()))
    asym = pairs.Asym((("entity", ">=", 1), ("abbreviation", ">=", 1)), (("entity", "==", 1),))
    dated = pairs.Sym(("entity", "numeric value"), ("entity", "before", "2023-03-15"))
    assert get(asym) == [(10, 20)] and get(dated) == [] and get(pairs.Sym(("entity",))) == [(10, 20)]
    for spec in (asym, dated, pairs.Sym(("entity", "location"))):
        assert pairs.pair_count(e, spec).first().n_pairs == len(get(spec))
    df = lambda rows: spark.createDataFrame(rows, "a long, b long")
    assert tuple(pairs.f1(df([(1, 2), (1, 3)]), df([(1, 2)])).first())[3:5] == (0.5, 1.0)
    assert pairs.f1(df([]), df([])).first().f1 == 1.0
    assert pairs.f1(df([(1, 2), (1, 3), (2, 3)]), df([(1, 2)])).first().precision == 0.3333
    values = ['[[3, 1], ["2", "1"], [1, 3]]', "[]", "[[1, 1]]", "[[1, 2, 3]]", "[[true, 2]]", "[[1.5, 2]]", "[1, 2]", "no", "[[1, null]]", None, "[[1, 2]] x"]
    got = spark.createDataFrame(list(enumerate(values)), "k int, v string").select("k", pairs.pairs_from_value(F.col("v")).alias("p")).orderBy("k").collect()
    assert [r.p and [tuple(x) for x in r.p] if r.p is not None else None for r in got] == [[(1, 2), (1, 3)], [], *[None] * 9]
    loose = ["22740 35839", '["26503, 92741", "x", "1 2 3", "5  4"]', "10\n20", "(2, 1)\n 3 , 4 \n5,6,7", 'years are "2024, 2025"', None]
    got = pairs.parse_answer_loose(spark.createDataFrame(list(enumerate(loose)), "k int, text string"), key="k").collect()
    assert {tuple(r) for r in got} == {(0, 22740, 35839), (1, 26503, 92741), (1, 4, 5), (3, 1, 2), (3, 3, 4)}
    assert pairs.spec_f1(e, asym, pairs.Sym(("entity", "location"))).first() == pairs.f1(pairs.pairs(e, asym), pairs.pairs(e, pairs.Sym(("entity", "location")))).first()
    one = pair_specs.spec({"kind": "asym", "a": [["entity", ">=", 1]], "b": [["location", "==", 2]]})
    assert one == pairs.Asym((("entity", ">=", 1),), (("location", "==", 2),))
    ask = {"task": 4, "query": "In which both users have at least one human being or location; human being instances must be after January 6, 2023", "spec": {"kind": "sym", "any": ["human being", "location"], "date_rule": ["human being", "after", "2023-01-06"]}}
    assert pair_specs.check([ask]) == [] and pair_specs.spec(ask["spec"]) == pair_specs.TASKS[4]
    wrong = [ask | {"query": "the other user has a human being"}, ask | {"spec": ask["spec"] | {"date_rule": None}}, {"task": 1, "query": "x", "spec": {"kind": "asym", "a": [["entity", ">=", 1]], "b": []}}]
    assert [len(pair_specs.check([w])) for w in wrong] == [3, 1, 2]
    for answer, strict, listed in (("(22740, 35839)\n(35839, 52032)", 2, 2), ('[["35839", "22740"]]', 0, 1), ("22740 35839", 0, 0)):
        a = spark.createDataFrame([(answer,)], "text string")
        assert (pairs.parse_answer(a).count(), pairs.parse_answer(a, pairs.LISTED).count()) == (strict, listed)


def test_leaf(spark):
    enum = parse({"type": "string", "enum": ["human being", "entity"]})
    said = ["human being", "  HUMAN BEING  ", '"human being"', "**human being**", "human being.", "human", "a human being", "", "null", None]
    got = spark.createDataFrame(list(enumerate(said)), "k int, x string").select("k", validate(F.col("x"), enum).alias("r")).orderBy("k").collect()
    assert [r.r.value for r in got] == ["human being"] * 5 + [None] * 5 and [r.r.ok for r in got] == [True] * 5 + [False] * 5
    obj = parse({"type": "object", "properties": {"label": {"enum": ["a", "b"]}, "who": {"type": "string"}}})
    said = ['{"label": "A", "who": "tech0"}', '{"label": "c", "who": "x"}', '{"label": "a"}', '{"label": "a", "who": "x", "z": 1}', "no", '{"label": "a", ']
    got = spark.createDataFrame(list(enumerate(said)), "k int, x string").select("k", validate(F.col("x"), obj).alias("r")).orderBy("k").collect()
    assert [r.r.value for r in got] == ['{"label":"a","who":"tech0"}'] + [None] * 5
    assert spark.range(1).select(bare(F.lit(' **"x".** ')).alias("v")).first().v == "x"
    assert parse({"type": "boolean"}).items_per_request() == 284
    for bad, error in (({"type": "number"}, NotImplementedError), ({"type": "string", "enum": ["a", "A"]}, ValueError), ({"type": "object", "properties": {"t": {"type": "string"}}}, ValueError), ("x", TypeError)):
        with pytest.raises(error):
            parse(bad)
    assert parse({"type": ["string", "null"], "enum": ["a", None]}).nullable and not parse({"type": "string", "enum": ["a", None]}).nullable


def test_replies(spark):
    replies = spark.createDataFrame([("f", "item 0: a\nitem 0: a\nitem 1 - b\nitem 99: a\nitem 3: zzz"), ("g", "item 1:\nitem 2: a")], "fragment string, reply string")
    wanted = spark.createDataFrame([("f", k) for k in range(4)] + [("g", 1), ("g", 2)], "fragment string, item long")
    got = {(r.fragment, r.item): (r.problem, r.value) for r in parse_replies(replies, wanted, parse({"type": "string", "enum": ["a", "b"]})).collect()}
    assert got == {("f", 0): ("repeated", None), ("f", 1): (None, "b"), ("f", 2): ("missing", None), ("f", 3): ("invalid", None), ("f", 99): ("foreign", None), ("g", 1): ("invalid", None), ("g", 2): ("missing", None)}


def test_admission(spark):
    jobs = spark.createDataFrame([(k,) for k in range(6)], "job_seq long")
    assert [r.sent for r in Budget(max_calls=3).admit(jobs).orderBy("job_seq").collect()] == [True] * 3 + [False] * 3
