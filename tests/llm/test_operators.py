"""The ten operators against brute force, on small tables with nulls, ties, repeats and odd texts."""

import itertools
import math
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from unitweave.llm import backoff_lm, bitplane, exact_topk, lexpack, licenses, mixing, overlap_join, puquality, quality_rules, surrogates
from unitweave.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(6000))
BASE = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood today with a friend who sings old songs"
TEXTS = [
    None, "", "   \n\t", "one", "Two words", BASE, BASE.upper(), BASE + " indeed", BASE + " now", "a b c d", "A b  c\nd", LONG, LONG + " end", LONG[:9000],
    "x y   z", "émentelle ciónque über straße " * 30, "line one here\nline one here\nline two", "*** ### $$$ " * 40, "the the the the the the the", "\U0001f600 emoji \U0001f600 text's don't 12 345\r\n  end ",
]
SOURCES = ["a", "b", None, "c", "a", "a", "a"]


@pytest.fixture(scope="module")
def rows():
    found = [(i * 7 % 101, t, ["en", "de", None][i % 3], SOURCES[i % 7], None, "clash", i) for i, t in enumerate(TEXTS * 2)]
    found = [(i, *r[1:]) for i, r in enumerate(found)]
    return [*found, found[5], (None, BASE, "en", "a", 1, "k", 2)]  # a repeated row, a null id


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def encode(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(tokenizer_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_mix(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, free = 1.5 * sum(size.values()), {}, set(order)
    while True:  # clamp and deal again until none is above
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= over
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] * 2 >= r.taken >= 0 and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 2
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(empty).count() == 0
    again = mixing.repeat_documents(docs)
    assert again.columns == docs.columns
    assert sum(len(words(r.text)) for r in again.collect()) == sum(taken.values())
    assert mixing.repeat_documents(empty).count() == 0


def test_mix_cuts_one_document_a_source(spark):
    """Rows without an id share a hash: all but one are taken whole or not at all, and the targets are met."""
    texts = [" ".join(f"w{k}" for k in range(1 + i % 9)) for i in range(60)]  # each text several times
    rows_ = [(None, t, s) for s in "abc" for t in texts * (1 if s == "b" else 4)] + [(k, "one two three", "b") for k in range(5)]
    table = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    got = mixing.mix(table).collect()
    partial, taken, target = Counter(), Counter(), {}
    for r in got:
        partial[r.source] += 0 < r.extra < r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(got) == len(rows_) and max(partial.values()) == 1
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target) and any(0 < r.extra for r in got)
    again = Counter()
    for r in mixing.repeat_documents(table).collect():
        again[r.source] += len(words(r.text))
    assert again == taken


def test_mix_of_small_sources_as_its_sql(spark):
    """Also where a rounded target is a whole number of epochs (sources of 5 and 4 words)."""
    import duckdb

    rng = np.random.default_rng(8)
    cases = [[5, 4], [7, 1], [3, 3, 3], [0, 6], [1], [100, 1, 2, 40]] + [rng.integers(0, 12, rng.integers(1, 5)).tolist() for _ in range(6)]
    for case, sizes in enumerate(cases):
        found = []
        for k, size in enumerate(sizes):  # each source's words in documents of 1 to 3
            while size > 0:
                n = min(size, 1 + len(found) % 3)
                found.append((1000 * case + len(found), " ".join(["w"] * n), f"s{k}"))
                size -= n
            found.append((1000 * case + len(found), "", f"s{k}"))
        documents = spark.createDataFrame(found, "doc_id long, text string, source string")
        got = mixing.mix(documents).select("doc_id", "size", "source_size", "target", "taken").collect()
        con = duckdb.connect()
        con.register("documents", documents.toPandas())
        assert sorted(map(tuple, got)) == sorted(con.execute(mixing.ORACLE).fetchall())
        assert len(sizes) != 2 or sizes != [5, 4] or sorted(Counter({s: sum(r.taken for r in got if r.source_size == s) for s in (5, 4)}).items()) == [(4, 4), (5, 10)]


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_planes(plane):
    rng = np.random.default_rng(1)
    for top, n in ((1, 5), (50257, 4096), (1 << 32, 777), (2, 0)):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
        assert (bitplane.from_planes(bitplane.to_planes(ids, plane), n, plane) == ids).all()


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_shards(docs, rows, empty, plane):
    got = bitplane.read_shards(bitplane.write_shards(docs, tokenizer_path(), end_id=2, block=512, plane=plane)).collect()
    want = [(r[0], len(i) + 1, crc([*i, 2])) for r, i in zip(rows, encode([r[1] for r in rows]), strict=True)]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((w[0] if w[0] is not None else -1, *w[1:]) for w in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert bitplane.read_shards(bitplane.write_shards(empty, tokenizer_path(), end_id=2)).count() == 0


def test_pu_quality(spark, empty):
    good = [(i, " ".join(f"wort{(i * j) % 91} und" for j in range(60)) + ".", "en", "s", 1, "k", 1) for i in range(300)]
    bad = [(1000 + i, " ".join(f"WORT{(i * j) % 91}!!" for j in range(60)), "en", "s", 1, "k", 1) for i in range(150)]
    docs = spark.createDataFrame([*good, *bad, (5000, None, None, None, None, None, None), (5001, "", "", "", 0, "", 0), (None, "x", "", "", 0, "", 0)], SCHEMA)
    labels = spark.createDataFrame([(d[0], int(d[0] < 1000), 0) for d in [*good, *bad][::2]] + [(None, 1, 0), (3, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in puquality.classify(docs, labels).collect()}
    assert len(got) == 453 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in got if d is not None)
    right = [got[d].predicted == (d < 1000) for d in got if d is not None and d < 5000 and got[d].held_out]
    assert sum(right) / len(right) > 0.95
    none = labels.limit(0)
    assert {r.score for r in puquality.classify(docs, none).collect()} == {0.5}
    assert puquality.classify(empty, none).count() == 0


def test_pu_rows_against_dense_matrices():
    import pyarrow as pa

    x = np.stack([puquality.features(t) for t in (TEXTS[0], TEXTS[1], TEXTS[5], TEXTS[11], TEXTS[17], "x" * 300_000, "ß" * 5 + " Ωmega 12,3")])
    at = [np.flatnonzero(r) for r in x]
    rows_ = puquality.Rows(pa.array([a.astype("<u2").tobytes() for a in at]).slice(1), pa.array([r[a].astype("<f2").tobytes() for r, a in zip(x, at, strict=True)]).slice(1))
    x, w, of = x.astype(np.float16).astype(float)[1:], np.random.default_rng(1).normal(size=puquality.SIZE + 1), np.arange(6.0)
    assert rows_.scores(w) == pytest.approx(x @ w[:-1] + w[-1], abs=1e-9)
    assert rows_.sums(of) == pytest.approx(np.concatenate([x.T @ of, [of.sum()]]), abs=1e-9)


def test_pu_minimum_and_prior():
    a = np.diag([1.0, 50.0, 3.0])
    found = puquality.minimise(lambda w: (float((w - 1) @ a @ (w - 1)) / 2 + 1, a @ (w - 1)), np.zeros(3), np.ones(3), 50)
    assert found == pytest.approx(np.ones(3), abs=0.02)
    rng = np.random.default_rng(2)
    hist = lambda g: np.bincount(np.clip((g + 8) * 100, 0, 1999).astype(int), minlength=2000)
    for prior in (0.2, 0.5, 0.9):
        text = np.where(rng.random(20000) < prior, rng.normal(2, 1, 20000), rng.normal(-2, 1, 20000))
        assert puquality.prior_of(hist(rng.normal(2, 1, 5000)), hist(text)) == pytest.approx(prior, abs=0.05)
    assert puquality.prior_of(np.zeros(5), np.ones(5)) == 0.5


def test_pu_keeps_rows_whole(spark, rows, empty):
    """Repeated rows, null ids, clashing names: the rows that stay are rows of the table, each as often as its scores say."""
    mine = [*rows * 3, *[(3000 + k, f"Quite a plain sentence, number {k}, about nothing much.\nAnd another one.", "en", "s", 1, "k", k) for k in range(60)], *[(4000 + k, f"BUY!! {k}$$$ NOW!! " * 9, "en", "s", 1, "k", k) for k in range(30)]]
    table = spark.createDataFrame(mine, SCHEMA).withColumnRenamed("n", "score").withColumnRenamed("key", "x")
    labels = spark.createDataFrame([(3000 + k, 1, 0) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    kept = puquality.keep_good(table, labels)
    assert kept.columns == table.columns
    verdict = Counter(r.doc_id for r in puquality.classify(table, labels).where("predicted = 1").collect())
    got = [tuple(r) for r in kept.collect()]
    assert Counter(g[0] for g in got) == verdict and not Counter(got) - Counter(map(tuple, mine))
    assert sum(3000 <= g[0] < 3060 for g in got if g[0] is not None) == 60 and sum(g[0] >= 4000 for g in got if g[0] is not None) == 0
    assert puquality.keep_good(empty, labels).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    v = [(i, rng.normal(size=8).round(2).tolist()) for i in range(700)]
    v += [(i, [0.5] * 8) for i in range(700, 730)]  # ties
    v += [(900, None), (1000, [float("nan")] + [0.1] * 7), (1100, [None] + [0.1] * 7), (1200, [1.0, 2.0]), (1201, [1.0, 1.0]), (1300, []), (None, [0.1] * 8), (55, [0.3] * 8)]
    vectors = spark.createDataFrame([(a, b, 0) for a, b in v], "vec_id long, embedding array<float>, label int")
    got = exact_topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), tile_rows=64, block_rows=4).collect()
    ok = [(a, [math.floor(1024 * float(np.float32(x))) for x in b]) for a, b in v if a is not None and b and all(x is not None and math.isfinite(x) for x in b)]
    want = []
    for q, e in ok:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(e, f, strict=True)), c) for c, f in ok if c != q and len(f) == len(e))[:10]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert exact_topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    big = spark.createDataFrame([(100, [2e6, 1.0]), (1, [2e6, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in exact_topk.top_k(big, big.where("vec_id = 100"), scale=1024).collect()] == [(100, 1, 1, (2 * 10**6 * 1024) ** 2 + 1024 * 2048)]


def test_packing(docs, rows, empty):
    got = lexpack.pack(docs, tokenizer_path(), shard_docs=10).collect()
    ids = [[*i, 0] for i in encode([r[1] for r in rows])]
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for d in {r[0] for r in rows}:
        own = [i for r, i in zip(rows, ids, strict=True) if r[0] == d]
        pieces = sorted(by_doc[d], key=lambda r: r.start)
        assert sum(p.length for p in pieces) == sum(map(len, own)) and all(p.doc_tokens == len(own[0]) for p in pieces)
        assert all(p.ids_crc32 == crc(own[0][p.start : p.start + p.length]) for p in pieces)
        cover = Counter(x for p in pieces for x in range(p.start, p.start + p.length))
        assert cover == Counter({k: len(own) for k in range(len(own[0]))})
        assert len({p.row_id for p in pieces}) == len(own)  # copies of one id are told apart
    used = 0
    for _, pieces in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for p in pieces:
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0
        used += at
    assert used == sum(map(len, ids))
    assert lexpack.pack(empty, tokenizer_path()).count() == 0


def bm25(tails, query, df):
    """Scores of all tails for the tokens of one, written out."""
    n, mean, out = len(tails), sum(map(len, tails)) / len(tails), []
    for t in tails:
        tf, s = Counter(t), 0.0
        for w in set(query):
            if tf[w]:
                s += max(0.0, math.log((n - df[w] + 0.5) / (df[w] + 0.5))) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean))
        out.append(round(s, 9))
    return out


def test_packing_fills_windows_with_neighbours(spark):
    """Against a plain greedy packing by whole BM25 scores, with all terms and tails nominated."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"{'abcde'[k % 5]}word{w}" for w in rng.integers(0, 80, rng.integers(0, 420))) for k in range(60)]
    texts += [texts[3], texts[3], texts[7] + " and more", None, ""]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [[*i, 0] for i in encode(texts)]
    tails = [i[len(i) // 256 * 256 :] for i in ids]
    tails = [t for t in tails if t]
    place = lexpack.places([np.array(t, "<u4") for t in tails])
    tails = [tails[k] for k in np.argsort(place, kind="stable")]
    df = Counter(w for t in tails for w in set(t))
    used, windows, row, room, seed, at = set(), [], [], 256, None, 0
    while seed is not None or len(used) < len(tails):
        if seed is None:
            seed, at = min(k for k in range(len(tails)) if k not in used), 0
        used.add(seed)
        score = bm25(tails, tails[seed], df)
        queue = [seed, *sorted((k for k in range(len(tails)) if k not in used), key=lambda k: (-score[k], k))]
        seed = None
        for k in queue:
            used.add(k)
            part = tails[k][at : at + room]
            row, room, at = row + part, room - len(part), at + len(part)
            if not room:
                windows.append(row)
                row, room = [], 256
                seed, at = (k, at) if at < len(tails[k]) else (None, 0)
                break
            at = 0
    rest = []
    for bit in range(8, -1, -1):
        if len(row) >> bit & 1:
            rest.append(row[: 1 << bit])
            row = row[1 << bit :]
    pieces = lexpack.pack(table, tokenizer_path(), window=256, terms=10_000, nominated=1_000).where("shard IS NOT NULL").orderBy("sequence_id", "offset").collect()
    got = [sum((ids[p.doc_id][p.start : p.start + p.length] for p in own), []) for _, own in itertools.groupby(pieces, key=lambda p: p.sequence_id)]
    assert got == windows + rest


def test_nominated_neighbours():
    """The rarest terms find most of the best neighbours of a brute-force search, ranked by whole scores."""
    rng = np.random.default_rng(0)
    words_ = (rng.zipf(1.3, (900, 120)) % 3000).astype("<u2")
    words_[450:] = np.where(rng.random((450, 120)) < 0.3, words_[:450], words_[450:])
    tails = [t[: rng.integers(20, 120)] for t in words_]
    df = np.zeros(1 << 16, np.int64)
    for t in tails:
        df[np.unique(t)] += 1
    index = lexpack.ShardIndex(tails, float(np.mean([len(t) for t in tails])), lexpack.inverse_frequencies(len(tails), df), 64, 48)
    counts, found = Counter({w: int(df[w]) for w in np.flatnonzero(df).tolist()}), 0
    for k in range(0, 900, 45):
        score = bm25([t.tolist() for t in tails], tails[k].tolist(), counts)
        used = np.zeros(900, bool)
        used[[k, 3]] = True
        got = list(index.neighbours(k, used))
        assert sorted(got) == [j for j in range(900) if not used[j]]
        assert [score[j] for j in got[:48]] == sorted((score[j] for j in got[:48]), reverse=True)
        least = sorted((s for j, s in enumerate(score) if not used[j]), reverse=True)[9]
        found += sum(score[j] >= least for j in got[:10])
    assert found >= 0.9 * 200


def test_licenses(spark, docs, rows, empty):
    mit = licenses.KNOWN["MIT"]
    odd = mit.replace("MIT License", "The MIT Licence").replace("sublicense", "sub-license").upper()
    texts = [mit, mit.replace("Copyright (c) holder", "Copyright 2020-2024 Somebody Else\n(c) another\n"), odd.replace("THE MIT LICENCE", "mit   licence"), "Released under the MIT Licence", mit + " and more", "", None, "Copyright 1999 me"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k].license_id for k in range(8)] == ["MIT", "MIT", "MIT", "notice MIT", None, None, None, None]
    assert got[5].digest == got[7].digest and got[6].digest is None
    assert licenses.scan(docs).count() == len(rows) and licenses.scan(empty).count() == 0


def test_licenses_as_they_are_usually_written(spark):
    """Wrapped at any width, with usual titles and named holders; lines of the wording that begin with 'copyright' stay."""
    texts, want = [], []
    for name in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "MIT-0", "Zlib", "BSL-1.0"):
        body = (licenses.KNOWN | licenses.MORE)[name].replace("Copyright (c) holder\n", "")
        title, _, rest = body.partition("\n") if name not in ("Unlicense", "Zlib") else ("", "", body)
        for width in range(40, 101, 4):
            wrapped = "\n\n".join(textwrap.fill(part, width) for part in rest.split("\n"))
            for head in (title, "", "The MIT License (MIT)" if name == "MIT" else title):
                texts.append(f"{head}\n\nCopyright (c) 2020, Some Body\nAll rights reserved.\n\n{wrapped}\n")
                want.append(name)
    bsd = licenses.KNOWN["BSD-3-Clause"].partition("\n")[2].replace("the name of the copyright holder", "the name of Acme Inc.").replace("3. Neither", "* Neither")
    header = "\n".join(f"{mark} {x}".rstrip() for mark in ("//",) for x in textwrap.wrap(licenses.KNOWN["ISC"].partition("\n")[2], 60))
    texts += ["// Copyright (c) 1999 Some Body\n// All rights reserved.\n//\n" + header, "/*\n * Copyright 2001 X\n *\n" + header.replace("//", " *") + "\n */", "# (c) 2020 Y\n" + header.replace("//", "#")]
    want += ["ISC"] * 3
    isc = "copyright notice and this permission notice appear in all copies."
    texts += [bsd, licenses.KNOWN["ISC"].replace(isc, "\n" + isc), licenses.KNOWN["ISC"].replace("hereby granted", "hereby refused"), "copyright holder of this", "MIT License"]
    want += ["BSD-3-Clause", "ISC", None, None, None]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(k, (got[k] or "").removesuffix(" (no title)") or None) for k in range(len(texts))] == list(enumerate(want))
    twice = spark.createDataFrame([(0, "licence licence licence modelled modelled"), (1, "license license license modeled modeled")], "doc_id long, text string")
    assert len({r.digest for r in licenses.scan(twice.unionByName(twice)).collect()}) == 1
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"} <= {r.license_id for r in licenses.known_forms(spark).collect()}


def test_rules(docs, rows, empty):
    got = quality_rules.apply_rules(docs).collect()
    want = []
    for r in rows:
        w, lines = words(r[1]), [x for x in (r[1] or "").split("\n") if words(x)]
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        want.append((r[0] if r[0] is not None else -1, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r[1] or ""), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules.apply_rules(empty).count() == 0


def test_verdicts_by_plain_counting(docs, rows):
    """kept on the odd rows: sketches, shrinkage and fences with whole numbers in Python."""
    measures = {"word_length": (1, 0, 100, 60, True), "symbols": (2, 0, 1000, 80, False), "dup_lines": (3, 5, 1000, 80, False), "repeats": (4, 0, 1000, 80, False)}
    low = lambda v: v if v < 64 else v >> v.bit_length() - 6 << v.bit_length() - 6
    base = [(r[0], r[2], r[3], quality_rules.base_measures(r[1])) for r in rows]
    fails = lambda m: m[0] < 50 or 100 * m[4] > 50 * m[0]
    value = lambda m, x: m[x[0]] * x[2] // max(1, m[x[1]])
    kept = {}
    for k, (doc, lang, source, m) in enumerate(base):
        good = not fails(m)
        for x in measures.values() if good else ():
            every = [(o[1], o[2], low(value(o[3], x))) for o in base if not fails(o[3])]
            a, lg, own = Counter(e[2] for e in every), Counter(e[2] for e in every if e[0] == lang), Counter(e[2] for e in every if e[:2] == (lang, source))
            w = {b: own[b] * (lg.total() + 50) * a.total() + 50 * (lg[b] * a.total() + 50 * a[b]) for b in a}
            upto = list(itertools.accumulate(w[b] for b in sorted(a)))
            q1, q3 = (next(b for b, u in zip(sorted(a), upto, strict=True) if u * 4 >= upto[-1] * q) for q in (1, 3))
            spread = max(q3 - q1, x[3])
            good = good and value(m, x) <= q3 + 3 * spread and (not x[4] or value(m, x) >= q1 - 3 * spread)
        kept[k] = (-1 if doc is None else doc, m[:5], good)
    got = quality_rules.apply_rules(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, tuple(r)[1:6], r.kept) for r in got) == sorted(kept.values())
    assert any(v[2] for v in kept.values())


def test_adaptive_limits(spark):
    text = lambda k, mark: " ".join(f"word{(k * 31 + j * j) % 503}{mark if j % 2 else ''}" for j in range(80))
    rows = [(k, text(k, ""), "en", "calm") for k in range(200)] + [(1000 + k, text(k, "#"), "en", "tags") for k in range(200)] + [(5000, text(1, "#"), "en", "calm")]
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(5000) and all(got.values())  # what is usual in one source is odd in another


KEY = b"test"
PII = 'mail a.b.27@mail6.example.com or x@sub.firm.org, call +1 (389) 555-5010. ip 56.187.231.175, 10.0.0.1; card 4539578763621486 and 4417744280351547 tok "04dbebab91ab85687d33eeaaf9ac699e1188f962" IBAN DE89370400440532013000.'


def test_surrogates_formats():
    new, counts, pairs = surrogates.pseudonymize(PII, KEY)
    assert counts == {"email": 2, "phone": 1, "ip": 2, "card": 2, "secret": 1, "iban": 1}
    for kind, old, sub in pairs:
        assert old not in new and sub in new and len(old) == len(sub) or kind == "ip"
        shape = lambda s: re.sub("[a-f]", "x", re.sub(r"\d", "0", s)) if kind == "secret" else re.sub(r"\d", "0", s)
        if kind in ("phone", "card", "iban"):
            assert re.sub(r"\d", "0", old) == re.sub(r"\d", "0", sub)
        if kind == "card":
            assert surrogates.luhn(old) == surrogates.luhn(sub) and old[0] == sub[0]
        if kind == "ip":
            assert surrogates.address_class(old) == surrogates.address_class(sub)
        if kind == "iban":
            assert surrogates._mod97(sub) == 1
        assert shape(old) is not None
    assert surrogates.pseudonymize(PII, KEY)[0] == new != surrogates.pseudonymize(PII, b"other")[0]


def test_surrogates_further_forms():
    token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    cases = {
        "secret": [token, token.lower(), "aB" + token[2:]],
        "phone": ["+33 1 23 45 67 89", "+49 30 1234567", "+33 (0)1 23 45 67 89", "01 23 45 67 89", "030 1234567", "(030) 1234567", "+4915112345678"],
        "national_id": ["123-45-6789", "AB 12 34 56 C", "12345678Z"],
        "ip": ["2001:db8:0:12:34ab:0:0:7f", "2001:DB8::7F3A", "fe80::1a2b:3c4d", "fd12:3456::1b"],
    }
    for kind, entities in cases.items():
        for e in entities:
            new, counts, pairs = surrogates.pseudonymize(f'it is "{e}", so', KEY)
            assert counts == {kind: 1} and pairs[0][:2] == (kind, e) and e not in new and new == f'it is "{pairs[0][2]}", so'
            sub = pairs[0][2]
            assert len(sub) == len(e) and re.sub("[0-9A-Za-z]", "x", sub) == re.sub("[0-9A-Za-z]", "x", e)
            if kind in ("secret", "ip"):
                assert surrogates.hex_case(sub) == surrogates.hex_case(e)
            if kind == "ip":
                assert surrogates.address6_class(sub) == surrogates.address6_class(e) != "invalid"
    assert surrogates._dni(surrogates.surrogate("national_id", "12345678Z", KEY))
    short = [f"{a}::{b}" for a in "12ab" for b in "0123456789abcdef"]
    assert len({surrogates.surrogate("ip", x, KEY) for x in short}) == len(short)
    for kept in ("at 12:30:45 on 2024-10-11", "std::vector a::b", "aa:bb:cc:dd:ee:ff", "version 1.2.3 of 12345678"):
        assert surrogates.pseudonymize(kept, KEY)[0] == kept


def test_surrogates_names_without_title():
    new, counts, pairs = surrogates.pseudonymize("Later Anna Schmidt came; Schmidt's car and Luc Moreau left. ANNA SCHMIDT", KEY)
    m = dict((a, b) for _, a, b in pairs)
    assert set(m) == {"Anna", "Schmidt", "Luc", "Moreau", "ANNA", "SCHMIDT"} and counts == {"name": 7}
    assert m["Anna"] in surrogates.FIRST_NAMES["female", "latin"] and m["Luc"] in surrogates.FIRST_NAMES["male", "latin"]
    assert new == f"Later {m['Anna']} {m['Schmidt']} came; {m['Schmidt']}'s car and {m['Luc']} {m['Moreau']} left. {m['Anna'].upper()} {m['Schmidt'].upper()}"


def test_surrogates_names():
    new, _, pairs = surrogates.pseudonymize("Dr. Anna Schmidt met Mr Петров. Later Schmidt left; Anna smiled.", KEY)
    m = dict((a, b) for _, a, b in pairs)
    assert m["Anna"] in surrogates.FIRST_NAMES["female", "latin"] and re.fullmatch("[А-Я][а-я]{4}в", m["Петров"]) and re.fullmatch("[A-Z][a-z]{5}t", m["Schmidt"])
    assert new == f"Dr. {m['Anna']} {m['Schmidt']} met Mr {m['Петров']}. Later {m['Schmidt']} left; {m['Anna']} smiled."
    for clean in ("MS Windows and DR Congo", "Annabel Lee", "the Road to 12 places", "born in 1980", "Drive 5 km"):
        assert surrogates.pseudonymize(clean, KEY)[0] == clean


def test_surrogates_take_their_time():
    """A title that contradicts a listed name, names of every length, digits alone as hex: nothing is searched for."""
    import time

    names = [n for group in surrogates.FIRST_NAMES.values() for n in group]
    began = time.time()
    for title in surrogates.TITLES:
        for name in names[::3]:
            surrogates.pseudonymize(f"{title} {name} Smith", KEY)
    for secret in ("1" * 32, "12345678" * 16, "0" * 40):
        assert surrogates.surrogate("secret", secret, KEY).isdigit()
    for ip in ("192.168.1.7", "172.20.3.4", "10.1.2.3", "127.0.0.1", "0.0.0.1", "fe80::1a2b:3c4d", "ff02::1"):
        surrogates.surrogate("ip", ip, KEY)
    assert time.time() - began < 10


def test_surrogates_same_person_in_all_documents():
    said = ["Mrs Robert Smith called.", "Then Robert Smith left.", "Ms Smith and Anna Smith", "all of them: " + " Mr ".join(("", *surrogates.FIRST_NAMES["male", "latin"])) + ", Robert Smith"]
    found = [{(e, s) for _, e, s in surrogates.pseudonymize(t, KEY)[2]} for t in said]
    both = [dict(f) for f in found]
    assert len({b["Smith"] for b in both}) == 1 and both[0]["Robert"] == both[1]["Robert"] == both[3]["Robert"] != "Robert"
    for names in surrogates.FIRST_NAMES.values():
        moved = [surrogates.surrogate("name", n, KEY) for n in names]
        assert sorted(moved) == sorted(names) and all(a != b for a, b in zip(names, moved, strict=True))
    assert len(set(both[3].values())) == len(both[3]) >= 50


def test_surrogates_by_words():
    cases = {"birth_date": ["born on {1980-03-12}", "Date of birth: {12.03.1980}", "né le {01/02/1999}", "geboren am {31.12.1900}"], "passport": ["passport no. {AB1234567}", "Reisepass Nr. {123456789}"], "address": ["at {12 Baker Street}, London", "in der {Gartenstraße 7}", "au {5, rue de Rivoli} ici", "en la {Calle Mayor 12}"]}
    for kind, texts in cases.items():
        for t in texts:
            entity, plain = re.search("{(.*)}", t)[1], t.replace("{", "").replace("}", "")
            new, counts, pairs = surrogates.pseudonymize(plain, KEY)
            assert counts == {kind: 1} and pairs[0][1] == entity != pairs[0][2] and new == plain.replace(entity, pairs[0][2])
            assert re.sub(r"\d", "0", pairs[0][2]) == re.sub(r"\d", "0", entity) if kind == "birth_date" else len(pairs[0][2]) == len(entity)


def test_every_mapping_is_one_to_one():
    """All entities of small classes, also those with wrong check digits."""
    for kind, entities in {
        "card": [f"4000-0000-000{k // 100}-{k % 100:02d}0{j}" for k in range(30) for j in range(10)],
        "iban": [f"DE{c:02d}370400440532{k:06d}" for c in (2, 50, 89, 98) for k in range(50)],
        "national_id": [f"{k:08d}{x}" for k in range(40) for x in "TRWAG"] + [f"AB 12 34 5{k} {c}" for k in range(10) for c in "ABCD"],
        "ip": [f"192.168.{a}.{b}" for a in range(4) for b in range(50)] + [f"172.16.{a}.9" for a in range(99)] + [f"8.8.{a}.8" for a in range(200)],
        "phone": [f"+49 30 12345{k:02d}" for k in range(100)] + [f"030 12345{k:02d}" for k in range(100)],
        "name": ["Li", "Lu", "Al", "O'Brien", "Anna-Maria", "Müller", "Muller", "SMITH", "Smith", "Smyth", "Ng", *surrogates.FIRST_NAMES["female", "latin"]],
        "birth_date": [f"19{y}-01-0{d}" for y in range(10, 90) for d in range(1, 10)],
        "address": [f"{k} Baker Street" for k in range(1, 300)],
    }.items():
        moved = [surrogates.surrogate(kind, e, KEY) for e in entities]
        assert len(set(moved)) == len(set(entities)) and not any(a == b for a, b in zip(entities, moved, strict=True)), kind


def test_permutation_is_one_to_one():
    for size in (1, 2, 10, 1000):
        assert sorted(surrogates.permute(x, size, KEY, "t") for x in range(size)) == list(range(size)) == sorted(surrogates.move(x, size, KEY, "t") for x in range(size))
        assert all(surrogates.permute(surrogates.permute(x, size, KEY, "t"), size, KEY, "t", back=True) == x and (size == 1 or surrogates.move(x, size, KEY, "t") != x) for x in range(size))
    ips = {surrogates.surrogate("ip", f"10.0.{i}.{j}", KEY) for i in range(8) for j in range(64)}
    assert len(ips) == 512


def test_surrogates_table(spark, docs, rows, empty):
    got = surrogates.replace_entities(docs)
    assert got.columns[: len(docs.columns)] == docs.columns and got.count() == len(rows)
    assert [r.text for r in got.where("text IS NULL").collect()] == [None, None]
    many = spark.createDataFrame([(i, f"write to user{i}@mail.example.com or 56.1.{i}.7") for i in range(200)] * 2, "doc_id long, text string")
    assert surrogates.collisions(many).count() == 0 and surrogates.replace_entities(empty).count() == 0
    assert surrogates.replace_entities(many).groupBy("doc_id").agg({"text": "count"}).count() == 200
    clash = spark.createDataFrame([(1, "a@b.org and 10.0.0.1", "kept")], "doc_id long, text string, n_email string")
    row = surrogates.replace_entities(clash).first()
    assert row.n_email == "kept" and row.n_ip == 1 and "a@b.org" not in row.text and surrogates.replace_entities(clash).columns.count("n_email") == 1


def brute_groups(rows):
    sets = []
    for r in rows:
        w = words(lower(r[1]))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for (r, a), (q, b) in itertools.combinations(zip(rows, sets, strict=True), 2):
        if a and b and None not in (r[0], q[0]) and 100 * len(a & b) >= 80 * len(a | b):
            x, y = root(r[0]), root(q[0])
            parent[max(x, y)] = min(x, y)
    return sorted((r[0] if r[0] is not None else -1, len(s), root(r[0]) if r[0] is not None else -1) for r, s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("block", [8000, 3])
def test_jaccard_join(spark, docs, rows, empty, block):
    rng = np.random.default_rng(5)
    near = []
    for k in range(60):  # near copies with edits of several sizes
        w = BASE.split() * 4
        for at in rng.integers(0, len(w), rng.integers(0, 6)):
            w[at] = f"e{rng.integers(0, 9)}"
        near.append((2000 + k, " ".join(w), "en", "a", 1, "k", 1))
    mine = [*rows, *near]
    got = overlap_join.join_groups(spark.createDataFrame(mine, SCHEMA), block=block).collect()
    fill = lambda x: -1 if x is None else x
    assert sorted((fill(r.doc_id), r.n_shingles, fill(r.component_id)) for r in got) == brute_groups(mine)
    if block == 8000:
        assert overlap_join.join_groups(empty).count() == 0
        kept = [r.doc_id for r in overlap_join.keep_representatives(docs).collect()]
        heads = {c for d, n, c in brute_groups(rows) if d == c}
        assert {k for k in kept if k is not None} == {d for d in heads if d >= 0} and None in kept


@pytest.mark.parametrize("block", [8000, 3])
def test_jaccard_links_are_counted(spark, rows, block):
    """Each document's number of links against brute force, also of classes that share several cells and blocks."""
    rng = np.random.default_rng(6)
    near = []
    for k in range(40):
        w = BASE.split() * 2
        for j in rng.choice(len(w), k % 4, replace=False):
            w[j] = f"z{rng.integers(0, 3)}"
        near.append((900 + k, " ".join(w), "en", "a", 1, "k", 2))
    mine = [*rows, *near, near[3]]
    sets = {(r[0], frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))) for r in mine if r[0] is not None and (w := words(lower(r[1])))}
    links = lambda d, s: sum(100 * len(s & t) >= 80 * len(s | t) for e, t in sets if (e, t) != (d, s))
    want = []
    for r in mine:
        w = words(lower(r[1]))
        s = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        want.append((-1 if r[0] is None else r[0], len(s), -1 if r[0] is None else links(r[0], s) if s else 0))
    got = overlap_join.join_groups(spark.createDataFrame(mine, SCHEMA), block=block).collect()
    fill = lambda x: -1 if x is None else x
    assert sorted((fill(r.doc_id), r.n_shingles, fill(r.n_links)) for r in got) == sorted(want)
    assert max(x for *_, x in want) > 20


def test_divide_skip_finds_all_links():
    rng = np.random.default_rng(2)
    for _ in range(20):
        base = np.arange(60, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(30, 60), replace=False), rng.integers(100, 140, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(25)]
        want = {(a, b) for a, b in itertools.combinations(range(25), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
        got = {tuple(sorted(p)) for p in overlap_join.links_of(np.array([len(s) for s in sets]), sets, 80)}
        assert got == want
        maps = overlap_join.Bitmaps([len(s) for s in sets], [overlap_join.parity(overlap_join._mix(s)) for s in sets], 80)
        for a, b in want:
            assert b in maps.possible(a, np.arange(25)) and a in maps.possible(b, np.arange(25))


def test_backoff_scores(spark, docs, rows, empty):
    got = backoff_lm.score_corpus(docs, block_rows=3).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts = Counter(w for r in rows if not held(r[0]) for w in [*words(lower(r[1])), ""])
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        t = [*words(lower(r[1])), ""]
        want.append((r[0] if r[0] is not None else -1, held(r[0]), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score <= 0 for r in got)
    assert backoff_lm.score_corpus(empty).count() == 0
    alone = backoff_lm.score_corpus(docs.where("doc_id = 2")).collect()[0]
    assert alone.train_tokens in (0, 1)


def learnt(texts, training):
    """The model by plain counting: counts by order, N, log10 probabilities of words, of unknown ones, strengths of the priors."""
    grams = {k: Counter() for k in (1, 2, 3)}
    for k, t in enumerate(texts):
        if training(k):
            w = ["", *words(lower(t)), ""]
            grams[1].update((x,) for x in w[1:])
            for m in (2, 3):
                grams[m].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    n, once, twice = sum(grams[1].values()), *(sum(c == x for c in grams[1].values()) for x in (1, 2))
    d = once / (once + 2 * twice) if once and twice else 0.5
    prior = {}
    for k in (2, 3):
        low, high, want = 0.01, 1000.0, sum(c == 1 for c in grams[k].values())
        while high / low > 1 + 1e-12:
            m = math.sqrt(low * high)
            low, high = (m, high) if sum(c * m / (c + m) for c in grams[k - 1].values()) < want else (low, m)
        prior[k] = low
    return grams, n, {w: math.log10((c - d) / n) for (w,), c in grams[1].items()}, math.log10(d * len(grams[1]) / n), prior


def test_backoff_scores_by_brute_force(spark, rows):
    """Scores are those of the automaton with all n-grams of the training documents, and of its formula, word by word."""
    rng = np.random.default_rng(5)
    common = [" ".join(f"c{w}" for w in rng.integers(0, 30, rng.integers(0, 60))) for _ in range(900)]
    rare = [f"c{k % 9} rare{k} Pair{k} tail{k} c{k % 7}" for k in range(40)]
    texts = [*common, *rare, *rare, "rare1 pair2 never pair3 tail3", *[r[1] for r in rows if r[1] is None or len(r[1]) < 5000]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams, n, logs, unknown, prior = learnt(texts, lambda k: zlib.crc32(str(k).encode()) % 7 != 2)
    ids = {w: i for i, w in enumerate(logs)}
    number = lambda g: tuple(ids[w] for w in g)
    machine = backoff_lm.Automaton(list(logs.values()), {number(g): c for m in (2, 3) for g, c in grams[m].items()}, {number(g): c for m in (1, 2) for g, c in grams[m].items()}, prior)
    got = {r.doc_id: r.score for r in backoff_lm.score_corpus(table, block_rows=100).collect()}
    for k, t in enumerate(texts):
        said = [*words(lower(t)), ""]
        way = [(ids.get(w, -1), logs.get(w, unknown)) for w in said]
        assert got[k] == pytest.approx(machine.score(way, machine.state[(ids[""],)]), abs=1e-6)
        total, past = 0.0, [""]
        for w in said:
            p = 10 ** logs.get(w, unknown)
            for m in (2, 3):
                h = tuple(past[-m + 1 :])
                if len(h) == m - 1 and grams[m - 1][h]:
                    p = (grams[m][(*h, w)] + prior[m] * p) / (grams[m - 1][h] + prior[m])
            total += math.log10(p)
            past.append(w)
        assert got[k] == pytest.approx(total, abs=1e-6)


def test_automaton_is_a_distribution():
    logs = [math.log10(p) for p in (0.4, 0.3, 0.2)]  # 0.1 for the rest
    counts = {(0, 1): 3, (0, 0): 1, (1, 2): 2, (0, 1, 2): 2, (0, 1, 0): 1}
    machine = backoff_lm.Automaton(logs, counts, {(0,): 4, (1,): 2, (0, 1): 3, (0, 0): 0, (1, 2): 0, (2,): 0}, {2: 1.5, 3: 0.5})
    for context in ((), (0,), (1,), (2,), (0, 1), (1, 2)):
        s, rest = machine.longest(context), 0.0
        total = sum(10 ** machine.log(s, w) for w in range(3))
        while s:
            rest, s = rest + machine.weight[s], machine.fail[s]
        assert total + 10**rest * 0.1 == pytest.approx(1)


def test_numbers_in_planes():
    rng = np.random.default_rng(4)
    for a in ([], [0], [2**64 - 1, 0, 5], rng.integers(0, 1 << 40, 999).tolist()):
        assert backoff_lm.numbers(backoff_lm.planes(np.array(a, np.uint64))).tolist() == a
    counts = rng.integers(0, 5000, 3000)
    low, n = backoff_lm._bins(counts)
    assert n.sum() == (counts > 0).sum() and all(n[low == x].sum() == (counts == x).sum() for x in (1, 2, 63))
    assert all(any(x <= c < x + max(1, c / 32) for x in low) for c in counts[counts > 0])


def write_tables(spark, folder, found, labels):
    spark.createDataFrame(found, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_by_plain_python(spark, tmp_path, rows):
    """Every stage against its meaning, on nulls, empty texts, repeats and ties; then the chain."""
    import corpus_pipeline as pipe

    good = [(600 + k, f"A plain sentence, number {k}, of no great interest.\nAnd one more by a@b{k}.org, for good measure {k * 7}.", "en", "ab"[k % 2], None) for k in range(40)]
    junk = [(700 + k, f"BUY!! {k}$$$ NOW!! " * 9, "en", "c", 3) for k in range(20)]
    found = [*[(*r[:4], r[4]) for r in rows], *good, good[3], *junk]
    folder = str(tmp_path)
    write_tables(spark, folder, found, [(600 + k, 1, 0) for k in range(0, 40, 2)] + [(700, 0, 0), (None, 1, 0), (601, None, 0)])
    step = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda t: tuple((v is not None, v) if not isinstance(v, str) else (True, v) for v in t)
    tuples = lambda df: [tuple(r) for r in df.collect()]
    kept = tuples(pipe.quality(spark, step, folder))
    assert not Counter(kept) - Counter(found) and set(good) <= set(kept) and not set(junk) & set(kept)
    step = spark.createDataFrame(kept, step.schema)
    one = tuples(pipe.near_copies(spark, step, folder))
    heads = {d: c for d, _, c in brute_groups(kept)}
    assert Counter(one) == Counter(r for r in kept if r[0] is None or heads[r[0]] == r[0])
    step = spark.createDataFrame(one, step.schema)
    clean = tuples(pipe.personal_data(spark, step, folder))
    want = [(r[0], surrogates.pseudonymize(r[1], b"unitweave-surrogates")[0], *r[2:4]) for r in one]
    assert sorted((key((*w, None if w[1] is None else len(w[1]))) for w in want)) == sorted(map(key, clean)) and not any("a@b" in (r[1] or "") for r in clean)
    step = spark.createDataFrame(clean, step.schema)
    mixed = tuples(pipe.mixture(spark, step, folder))
    taken = {(r.doc_id, r.source): 0 for r in mixing.mix(step).collect()}
    for r in mixing.mix(step).collect():
        taken[r.doc_id, r.source] += r.taken
    again = Counter()
    for r in mixed:
        again[r[0], r[3]] += len(words(r[1]))
        assert any((r[1] or "") == (t[1] or "")[: len(r[1] or "")] for t in clean if t[0] == r[0]) and r[4] == (None if r[1] is None else len(r[1]))
    assert {k: v for k, v in again.items() if v} == {k: v for k, v in taken.items() if v}
    assert sum(not words(r[1]) for r in mixed) == sum(not words(r[1]) for r in clean)
    pieces = pipe.packing(spark, spark.createDataFrame(mixed, step.schema), folder).collect()
    ids = [[*i, 0] for i in encode([r[1] for r in mixed])]
    by_row = defaultdict(list)
    for p in pieces:
        by_row[p.row_id].append(p)
    assert sorted((key((own[0].doc_id,)), own[0].doc_tokens) for own in by_row.values()) == sorted((key((r[0],)), len(i)) for r, i in zip(mixed, ids, strict=True))
    texts = Counter((r[0], tuple(i)) for r, i in zip(mixed, ids, strict=True))
    for own in by_row.values():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == list(itertools.accumulate((p.length for p in own), initial=0))[:-1]
        assert any(all(crc(i[p.start : p.start + p.length]) == p.ids_crc32 for p in own) for d, i in texts if d == own[0].doc_id and len(i) == own[0].doc_tokens)
    whole = pipe.run(spark, folder).collect()
    assert sorted((key((p.doc_id,)), p.start, p.length if p.length == 1024 else 0) for p in whole if p.start == 0) == sorted((key((p.doc_id,)), p.start, p.length if p.length == 1024 else 0) for p in pieces if p.start == 0)
    assert sum(p.length for p in whole) == sum(map(len, ids))


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as pipe

    write_tables(spark, str(tmp_path), [], [])
    step = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "1 AS score", "2 AS words", "3 AS h")
    for name, stage in pipe.STAGES[:-1]:
        assert stage(spark, step, str(tmp_path)).columns == pipe.COLUMNS, name
    assert pipe.run(spark, str(tmp_path)).count() == 0
