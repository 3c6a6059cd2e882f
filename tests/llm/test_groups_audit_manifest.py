"""Circulant groups, source divergence and the Merkle manifest against brute force, on odd tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from unitweave.llm import circulant, divergence, merkle, overlap_join
from unitweave.llm.common import crc32_divides
from unitweave.llm.queries import op12_source_divergence, op13_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls long, bucket string, term string, grp string, at long"
BASE = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood today with a friend who sings old songs"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [
    None, "", "  \n\t", "one", "One", "two words", "Two  words", BASE, BASE.upper(), BASE + " indeed", BASE + " now", BASE[:-10], "a b c d", "a b c e", LONG, LONG + " end", "straße Über alles naïve", "x" * 200_000,
    "don't stop-here 12 3a4 \x00 z\x7fz", "\U0001f600 emoji \U0001f600 text", "the the the the",
]


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, ["en", "de", None, ""][i % 4], ["a", "b", None, "ß", "a", "a"][i % 6], None if i % 5 == 0 else i * 3, 7, "b", "t", "g", 1) for i, t in enumerate(TEXTS * 3)]
    same_id = (5, "quite another text with the same number as before", "en", "c", 1, 0, "", "", "", 0)
    return [*found, found[7], found[7], same_id, (None, BASE, "en", "a", 1, 0, "", "", "", 0), (900, "alone", "xx", "s", 2**63 - 1, 0, "", "", "", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs_of_words(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(ws)} if len(ws) == 1 else {tuple(ws[i : i + 2]) for i in range(len(ws) - 1)}


def groups_by_brute_force(rows):
    """rows (doc_id, text) -> per row: doc_id, n, component, kept."""
    sets = [(i, pairs_of_words(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    # An empty row of an id is linked with nothing, whatever other rows of the id are.
    return sorted(((i, len(s), None if i is None else root(i) if s else i, True if i is None or not s else root(i) == i) for i, s in sets), key=str)


def test_groups(docs, rows, empty):
    found = circulant.near_groups(docs).collect()
    assert sorted((tuple(r) for r in found), key=str) == groups_by_brute_force([r[:2] for r in rows])
    assert circulant.near_groups(empty).collect() == []


@pytest.mark.parametrize("settings", [{}, {"large": 2, "block": 3}, {"turns": 1, "block": 4}])
def test_groups_whose_leaders_are_linked_with_few(spark, settings):
    """Chains, in which only neighbours are links, stars, and sets just below the limit: every leader misses most of its bucket."""
    rng, texts = random.Random(3), []
    for family in range(4):
        words = [f"f{family}w{k}" for k in range(60)]
        for step in range(12):  # a chain: each step renews two words
            texts.append(" ".join(words))
            for k in rng.sample(range(60), 2):
                words[k] = f"f{family}s{step}k{k}"
        hub = [f"h{family}w{k}" for k in range(60)]
        for leaf in range(8):  # a star: its leaves are far from each other
            other = hub[:]
            for k in rng.sample(range(60), 3):
                other[k] = f"h{family}l{leaf}k{k}"
            texts.append(" ".join(other))
        texts.append(" ".join(hub))
    rng.shuffle(texts)
    rows = [*enumerate(texts)]
    want = groups_by_brute_force(rows)
    got = circulant.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), **settings).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert len({w[2] for w in want}) < len(want) / 2


def test_signatures_are_least_places_of_a_turned_table():
    maker = circulant.Circulant(24, seed=5, cells=1 << 10)
    s = np.unique(np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64))
    pi = [int(r[0]) for r in maker.rows[: 1 << 10]]
    assert sorted(pi) == [*range(1 << 10)] and sorted(maker.sigma.tolist()) == [*range(1 << 10)]
    want = [min(pi[(int(maker.sigma[int(x) & 1023]) + k) % 1024] for x in s) for k in range(24)]
    assert maker.signature(s).tolist() == want
    # In slabs as at once.
    many = np.unique(np.random.default_rng(2).integers(0, 2**63, 3 * circulant._SLAB + 5).astype(np.uint64))
    assert (maker.signature(many) == maker.rows[maker.sigma[(many & maker.cells).astype(int)]].min(axis=0)).all()


def test_coordinates_agree_as_often_as_sets_do():
    """Agreement of coordinates estimates Jaccard, and pairs at the limit share a band practically always."""
    maker, rng, shares, missed = circulant.Circulant(160), np.random.default_rng(4), [], 0
    for _ in range(200):
        base = np.unique(rng.integers(0, 2**63, 180).astype(np.uint64))
        n = len(base)
        a, b = base[: n - n // 10], base[n // 10 :]  # 8 parts of 10 in both
        x, y = maker.signature(a), maker.signature(b)
        shares.append((x == y).mean())
        kx, ky = circulant.band_keys(np.stack([x, y]), 4)
        missed += not (kx == ky).any()
    assert abs(np.mean(shares) - len(np.intersect1d(a, b)) / n) < 0.01 and missed == 0


def test_parity_of_the_shared_filter():
    s = np.unique(np.random.default_rng(9).integers(0, 2**63, 100).astype(np.uint64))
    assert len(overlap_join.parity(s)) == 16


def audit_by_brute_force(rows, least=3, top=200):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source, found = lang or "", source or "", terms(text)
        df[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = []
    utf8 = lambda x: (-x[0], x[1].encode())
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s), key=utf8)
            out += [(lang, s, "pair", o, v, k) for k, (v, o) in enumerate(pairs, 1)]
            best = sorted(((f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]), key=utf8)[:top]
            out += [(lang, s, "term", t, v, k) for k, (v, t) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"chunk_bytes": 1}, {"chunk_bytes": 300, "least": 2, "top": 3}])
def test_audit(docs, rows, empty, settings):
    want = audit_by_brute_force(rows, **{k: v for k, v in settings.items() if k in ("least", "top")})
    assert sorted(tuple(r) for r in divergence.audit(docs, **settings).collect()) == want
    assert divergence.audit(empty, **settings).collect() == []


@pytest.mark.parametrize(("few", "slab"), [(0, 1 << 20), (50_000, 3)])
def test_audit_of_many_sources(spark, monkeypatch, few, slab):
    """Groups without terms, a language without kept terms, ties of values; with many groups, and with sums sent early."""
    monkeypatch.setattr(divergence, "FEW_GROUPS", few)
    monkeypatch.setattr(divergence, "_SLAB", slab)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["ab", "Cd", "éf", "g", "hi", "jk"]) for _ in range(rng.randrange(9))), "en", f"s{rng.randrange(14)}", 1) for i in range(150)]
    rows += [(1000, "only here", "fr", "s1", 1), (1001, None, "fr", "s2", 1), (1002, "12 34", "en", "none", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == audit_by_brute_force(rows)


def test_audit_counts_as_the_automaton_must(spark):
    """A term that stands in another one, at the ends, and twice in a row."""
    rows = [("en", "s", t) for t in ["ab abc ab ab", "abc", "ab", "abc ab", "b"] * 3]
    read = divergence.chunks(spark.createDataFrame(rows, "lang string, source string, text string"), 1 << 20).collect()
    vocabulary = [(0, "en", None, t, 1, True, None) for t in ("ab", "abc", "b")] + [(0, "en", "s", None, None, None, bytes(r.body)) for r in read if r.body]
    found = Counter()
    for r in divergence.recount(spark.createDataFrame(vocabulary, "chunk long, lang string, source string, term string, df long, first boolean, body binary").coalesce(1)).collect():
        found[r.source, r.term] += r.n
    assert found == {("s", "ab"): 15, ("s", "abc"): 9, ("s", "b"): 3, ("s", None): 0, (None, None): 3}


def test_sums_are_exact_and_shares_beyond_64_bits():
    sums = divergence.Sums(1)
    for k in range(50):
        sums.add(np.array([3, 1, 3]), np.array([2**61 // 50, k, 1]))
    assert [c.tolist() for c in sums.settle()] == [[1, 3], [sum(range(50)), 50 * (2**61 // 50 + 1)]]
    count, total, kept = (np.array([x], np.int64) for x in (10**16, 3 * 10**16, 7))
    assert divergence.shares(count, total, kept).tolist() == [1 + 10**9 * (10**16 + 1) // (3 * 10**16 + 7)]


H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def manifest_by_brute_force(rows, bad):
    def leaf(doc_id, text, lang, source, n_chars):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    def levels(nodes):
        found = [nodes]
        while len(found[-1]) > 1:
            found.append([H("".join(found[-1][k : k + 2])) for k in range(0, len(found[-1]), 2)])
        return found

    def path(tree, at):
        for low in tree[:-1]:
            run = at // 2 * 2
            yield [("L" if k < at else "R", low[k]) for k in (run, run + 1) if k != at and k < len(low)]
            at //= 2

    by_lang = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        by_lang[lang].append((doc_id is not None, doc_id or 0, leaf(doc_id, text, lang, source, n_chars), leaf(doc_id, text, lang, source, None if n_chars is None else n_chars + bad(doc_id)), doc_id))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([r[2] for r in sorted(by_lang[x], key=lambda r: r[:3])]) for x in langs}
    top, out = levels([trees[x][-1][0] for x in langs]), []
    for g, x in enumerate(langs):
        for k, (_, _, own, shown, doc_id) in enumerate(sorted(by_lang[x], key=lambda r: r[:3])):
            steps = [*path(trees[x], k), *path(top, g)]
            folded = shown
            for step in steps:
                folded = H("".join([d for side, d in step if side == "L"] + [folded] + [d for side, d in step if side == "R"]))
            out.append((doc_id, own, trees[x][-1][0], top[-1][0], H("".join(d for s in steps for _, d in s)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def bad(doc_id):
    return int(doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0)


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest(docs, rows, empty, height):
    got = merkle.manifest(docs, tampered=crc32_divides(docs["doc_id"], 7), height=height).collect()
    want = manifest_by_brute_force(rows, bad)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert any(not w[-1] for w in want) and any(w[-1] for w in want)
    assert merkle.manifest(empty, height=height).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 65])
def test_manifest_of_n_rows(spark, n):
    rows = [(i, f"text {i}", "en" if i % 3 else f"l{i % 2}", "s", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((tuple(r) for r in merkle.manifest(docs, height=2).collect()), key=str) == manifest_by_brute_force(rows, lambda _: 0)


def test_a_changed_sibling_is_found():
    """A proof holds for its own leaf only, and each entry of it matters."""
    leaves = [H(str(k)) for k in range(11)]
    levels = merkle.run_levels(leaves, 11, 30)
    for k, leaf in enumerate(leaves):
        path = merkle.run_path(levels, k)
        assert merkle.fold(leaf, path) == levels[-1][0]
        assert merkle.fold(leaves[k - 1], path) != levels[-1][0]
        for at, step in enumerate(path):
            if step != merkle.ALONE:
                assert merkle.fold(leaf, [*path[:at], step[0] + H("x"), *path[at + 1 :]]) != levels[-1][0]


def test_a_vertex_that_misses_a_child_stops():
    with pytest.raises(RuntimeError, match="exactly once"):
        merkle._complete(((0, 0), [(0, "a", 3), (2, "b", 3)]), 2)


def test_queries_read_whole_tables(spark, tmp_path, docs, rows):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert op13_merkle_manifest(spark, str(tmp_path)).count() == len(rows)
    assert sorted(tuple(r) for r in op12_source_divergence(spark, str(tmp_path)).collect()) == audit_by_brute_force(rows)
