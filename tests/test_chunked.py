"""Units and segments of chunked texts are those of the whole, for all structures and cuts."""

import random

import pytest

from unitweave.functions import text as layout
from unitweave.operators import chunked, text

PIECES = {
    "code": ["def f(x):\n", "    return x\n", "class A:\n", "async def g():\n", "\n", "  \n", "x = 1\n", "=====\n", "\n\n\n"],
    "sections": ["# One\n", "## Two words\n", "####### no\n", "text of it\n", "\n", " \t\n", "---\n", "\n\n\n\n"],
    "rows": ["a|b|c\n", "1\t2\t3\r\n", "x|y|z\r", "=== \n", "\r\n", "\n"],
    "paragraphs": ["some words here", "\n", "\n", " \n", "\t", "more\n", "\x0cpage\n", "<|doc|>\n", "\n\n", "é\u2028ü"],
    "lines": ["one line\n", "another one\r\n", "\x0b", "a\x1cb", "\u2029", "\r", "no end ", "---x\n", "\x85", " \n"[1:]],
}


def cut(t, rng, least):
    out, at = [], 0
    while at < len(t):
        n = rng.randrange(least, least + 40)
        out.append(t[at : at + n])
        at += n
    if len(out) > 1 and len(out[-1]) < chunked.LOOK and rng.random() < 0.5:
        out[-2:] = ["".join(out[-2:])]
    return out


@pytest.fixture(scope="module")
def made(spark):
    rng, texts = random.Random(5), {}
    for kind, pieces in PIECES.items():
        for k in range(12):
            t = "".join(rng.choice(pieces) for _ in range(rng.randrange(8, 120)))
            if kind == "rows":
                t = "a|b|c\n" * 60 + t
            texts[f"{kind}/{k}"] = (" \n" if k % 5 == 0 else "") + t
    texts |= {"blank": " \n\n " * 20, "one": "x", "long": "y" * 700 + "\n" + "z" * 50, "spaces": "a" + " " * 300 + "b\n\n" + "\n" * 101 + "c"}
    chunks = [(name, k, c) for name, t in texts.items() for k, c in enumerate(cut(t, rng, chunked.LOOK))]
    rng.shuffle(chunks)
    return texts, spark.createDataFrame(chunks, "ctx_id string, chunk int, text string").persist()


def test_the_machine_of_blank_lines():
    rng = random.Random(1)
    for _ in range(2000):
        t = "".join(rng.choice("\n\n \tx") for _ in range(rng.randrange(1, 14)))
        want = [m.end() for m in layout._BLANK.finditer(t)]
        at, state, got = 0, 0, []
        while at < len(t):
            n = rng.randrange(1, 5)
            ends, new = chunked._blank_machine(t[at : at + n], state)
            name = chunked._function(t[at : at + n])[0]
            assert new == {chunked.KEEP: state, chunked.SWAP: 1 - state, chunked.ZERO: 0, chunked.ONE: 1}[name]
            got += [at + e for e in ends]
            at, state = at + n, new
        assert got == want, repr(t)


def test_units(made):
    texts, chunks = made
    want = set()
    for name, t in texts.items():
        ends = layout.unit_ends(t, layout.structure(t))
        want |= {(name, k, a, b) for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False))}
    assert {layout.structure(t) for t in texts.values()} == {*PIECES}
    got = {tuple(r) for r in chunked.units(chunks).collect()}
    assert got == want, sorted(got ^ want)[:6]


@pytest.mark.parametrize(("target", "low", "high", "width"), [(40, 10, 120, 50), (60, 60, 60, 61), (25, 5, 30, 400), (4000, 400, 12_000, 1 << 20)])
def test_segments(spark, made, target, low, high, width):
    texts, chunks = made
    whole = spark.createDataFrame(list(texts.items()), "ctx_id string, text string")
    want = {(r.ctx_id, r.seg_no, r.ref, r.start, r.end, r.units) for r in text.segments(whole, target, low, high).collect()}
    got = {tuple(r) for r in chunked.segments(chunks, target, low, high, width).collect()}
    assert got == want, sorted(got ^ want)[:8]


def test_small_chunks_are_refused(spark):
    with pytest.raises(ValueError, match="characters"):
        chunked.units(spark.createDataFrame([("a", 0, "x" * 30), ("a", 1, "y"), ("a", 2, "z" * 30)], "ctx_id string, chunk int, text string"))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "ctx_id string, chunk int, text string")
    assert chunked.units(none).collect() == [] and chunked.segments(none).collect() == []
