"""How far the sources of a language are from each other: a two-pass count of a kept vocabulary.

1. First pass. Documents are read in chunks of a bounded size. A chunk sends each of its
   terms with the number of its documents that have it, and its text, reduced to terms with
   one delimiter around each, by source. Sums over the chunks are exact document
   frequencies; a language keeps the terms in at least `least` documents.
2. Second pass. Each chunk gets those of its own terms that were kept, builds an
   Aho-Corasick automaton of them, padded with delimiters, and counts their occurrences in
   its text. A kept term that a chunk didn't send doesn't occur there, so no task ever
   holds the vocabulary of a language.
3. The counts are sparse postings (language, term, source, count). For a pair of sources
   the sum over all kept terms is taken over the terms that both have; what one or none
   has follows from sums over one source's postings and the number of terms. A task
   reads whole terms and sends sums, not pairs of postings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitweave.llm.common import cut, drop_cut, ship

#: ASCII letters in lower case; every other ASCII byte is a delimiter; the bytes of other characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
SCALE = 1_000_000_000
#: Below this, SCALE * (count + 1) is a 64-bit number.
_SAFE = 9_000_000_000
#: Rows of sums that a task holds at most before it sends them on, and pairs of postings that it compares at once.
_HELD, _SLAB = 1 << 20, 1 << 20
#: Groups whose facts may be broadcast; with more of them the facts come by a join before the postings are dealt.
FEW_GROUPS = 50_000


def _words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """docs (lang, source, text) -> (chunk, lang, source, term, df, body): a row per term of a chunk and language, and a row per source with its text, compressed.

    A chunk closes when its text has `chunk_bytes`; its number holds the task's, so a task
    that runs again names its chunks alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        names, pack = ["chunk", "lang", "source", "term", "df", "body"], zstandard.ZstdCompressor(level=1)
        chunk, held, found, bodies = TaskContext.get().partitionId() << 32, 0, {}, {}

        def close() -> Iterator[pa.RecordBatch]:
            for lang, df in found.items():
                if n := len(df):
                    own, times = pa.array(list(df), pa.binary()).cast(pa.string()), pa.array(list(df.values()), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.repeat(pa.scalar(lang, pa.string()), n), pa.nulls(n, pa.string()), own, times, pa.nulls(n, pa.binary())], names)
            for (lang, source), parts in bodies.items():
                body = pack.compress(b" " + b" ".join(parts) + b" ")
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([lang], pa.string()), pa.array([source], pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([body], pa.binary())], names)

        for batch in batches:
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = _words(text)
                if (df := found.get(lang)) is None:
                    df = found[lang] = Counter()
                df.update(set(words))
                parts = bodies.setdefault((lang, source), [])
                held += 16  # a text without terms costs a name at most
                if words:
                    parts.append(b" ".join(words))
                    held += len(parts[-1])
                if held >= chunk_bytes:
                    yield from close()
                    chunk, held, found, bodies = chunk + 1, 0, {}, {}
        yield from close()

    return docs.mapInArrow(run, "chunk long, lang string, source string, term string, df long, body binary")


def recount(rows: DataFrame) -> DataFrame:
    """rows (chunk, lang, source, term, df, first, body), terms before texts within a chunk and language -> (lang, source, term, n).

    Occurrences by chunk; for each text a row without a term; and for each language rows
    without a source, whose sum is the number of its kept terms (those marked `first`).
    An automaton takes its terms by falling frequency, as it looks for a node's children in the order they came.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        import zstandard

        names, unpack = ["lang", "source", "term", "n"], zstandard.ZstdDecompressor()
        at, vocabulary, often, automaton, kept = None, [], [], None, Counter()

        def count(lang: str, source: str, body: bytes) -> pa.RecordBatch:
            hits = np.zeros(0, np.int64)
            if len(vocabulary):
                hits = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(unpack.decompress(body).decode())), np.int64), minlength=len(vocabulary))
            own = np.flatnonzero(hits)
            terms = pa.concat_arrays([vocabulary.take(pa.array(own)) if len(own) else pa.nulls(0, pa.string()), pa.nulls(1, pa.string())])
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(terms)), pa.repeat(pa.scalar(source, pa.string()), len(terms)), terms, pa.array(np.append(hits[own], 0))], names)

        for batch in batches:
            chunk, lang, source, term, df, first, body = batch.columns
            is_text = body.is_valid().to_numpy(zero_copy_only=False)
            new = (pc.not_equal(chunk[1:], chunk[:-1]).to_numpy(zero_copy_only=False)) | (pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(new | is_text[1:] | is_text[:-1]) + 1  # each text, and each run of terms of a chunk and language, by itself
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunk)], strict=True):
                here = (chunk[a].as_py(), lang[a].as_py())
                if here != at:
                    at, vocabulary, often, automaton = here, [], [], None
                if is_text[a]:
                    if automaton is None:
                        if vocabulary:
                            order = np.argsort(-np.concatenate(often), kind="stable")
                            vocabulary = pa.concat_arrays(vocabulary).take(pa.array(order))
                            automaton = ahocorasick.Automaton()
                            for k, t in enumerate(vocabulary.to_pylist()):
                                automaton.add_word(f" {t} ", k)
                            automaton.make_automaton()
                        else:
                            automaton = ahocorasick.Automaton()
                    yield count(at[1], source[a].as_py(), body[a].as_py())
                else:
                    vocabulary.append(term[a:b])
                    often.append(df[a:b].to_numpy())
                    kept[at[1]] += pc.sum(first[a:b]).as_py()
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.nulls(len(kept), pa.string()), pa.nulls(len(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names)

    return rows.mapInArrow(run, "lang string, source string, term string, n long")


def parts_per_billion(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kept)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 1), wide(total + kept)) + 1


def shares(count: np.ndarray, total: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The same of arrays."""
    if len(count) and count.max() > _SAFE:
        return np.array([1 + SCALE * (c + 1) // (t + k) for c, t, k in zip(count.tolist(), total.tolist(), kept.tolist(), strict=True)], np.int64)
    return 1 + SCALE * (count + 1) // (total + kept)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


class Sums:
    """Exact sums by a 64-bit key, merged when they grow."""

    def __init__(self, width: int):
        self.parts, self.rows, self.width = [], 0, width

    def add(self, keys: np.ndarray, *values: np.ndarray) -> None:
        if len(keys):
            self.parts.append(self._merged([(keys, *values)]))
            self.rows += len(self.parts[-1][0])
            if self.rows > _HELD:
                self.settle()

    @staticmethod
    def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        keys, *values = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[new], *(np.add.reduceat(v[order], new) for v in values)

    def settle(self) -> tuple[np.ndarray, ...] | None:
        if self.parts:
            self.parts = [self._merged(self.parts)]
            self.rows = len(self.parts[0][0])
        return self.parts[0] if self.parts else None


PAIR, SHARE, TERM = 0, 1, 2


def measure(postings: DataFrame, top: int) -> DataFrame:
    """postings (lang, term, no, n, total, v, lang_total), whole terms in a task and in order -> (kind, lang, a, b, x, times, term).

    PAIR: of sources a and b, the sum over the terms that both have of what the pair's
    divergence is beyond what the sums against bases say, and how many those are. SHARE:
    how many terms have share b in source a. TERM: a task's first `top` terms of source a, with
    value x. Sums are sent at a language's end, or earlier where a task would hold too much.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, pairs, times, best, rest = None, Sums(2), Sums(1), [], None

        def rows(kind: int, a: np.ndarray, b: np.ndarray | None, x: np.ndarray | None, n: np.ndarray | None, terms: pa.Array | None = None) -> pa.RecordBatch:
            long = lambda v: pa.nulls(len(a), pa.int64()) if v is None else pa.array(v, pa.int64())
            columns = [pa.array(np.full(len(a), kind, np.int32)), pa.repeat(pa.scalar(lang, pa.string()), len(a)), long(a), long(b), long(x), long(n), pa.nulls(len(a), pa.string()) if terms is None else terms]
            return pa.RecordBatch.from_arrays(columns, ["kind", "lang", "a", "b", "x", "times", "term"])

        def first_of_each() -> pa.Table:
            table = pa.concat_tables(best).sort_by([("a", "ascending"), ("x", "descending"), ("term", "ascending")])
            a = table["a"].to_numpy()
            start = np.maximum.accumulate(np.where(np.concatenate([[True], a[1:] != a[:-1]]), np.arange(len(a)), 0))
            return table.filter(pa.array(np.arange(len(a)) - start < top))

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal pairs, times, best
            if found := pairs.settle():
                yield rows(PAIR, found[0] >> 32, found[0] & 0xFFFFFFFF, found[1], found[2])
            if found := times.settle():
                yield rows(SHARE, found[0] >> 31, found[0] & 0x7FFFFFFF, None, found[1])
            if best:
                found = first_of_each()
                yield rows(TERM, found["a"].to_numpy(), None, found["x"].to_numpy(), None, found["term"].combine_chunks())
            pairs, times, best = Sums(2), Sums(1), []

        def add(table: pa.Table) -> None:
            """Whole terms of one language."""
            nonlocal best
            term = table["term"]
            no, n, total, v, lang_total = (table[c].to_numpy() for c in ("no", "n", "total", "v", "lang_total"))
            starts = np.flatnonzero(np.concatenate([[True], pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)]))
            size = np.diff(np.concatenate([starts, [len(no)]]))
            p, base = shares(n, total, v), shares(np.zeros_like(n), total, v)
            q = np.repeat(shares(np.add.reduceat(n, starts), lang_total[starts], v[starts]), size)
            times.add((no << 31) | p, np.ones(len(p), np.int64))
            above = np.flatnonzero(p > q)
            best.append(pa.table({"a": no[above], "x": _f(p[above], q[above]), "term": term.take(pa.array(above))}))
            if sum(len(b) for b in best) > _HELD // 4:
                best = [first_of_each()]
            # Each posting against all postings of its term, some postings at a time.
            of, first = np.repeat(size, size), np.repeat(starts, size)
            ends = np.cumsum(of)
            at = 0
            while at < len(no):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLAB, "right")))
                k = of[at:to]
                left = np.repeat(np.arange(at, to), k)
                right = np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[at:to], k)
                other = left != right
                left, right = left[other], right[other]
                pa_, pb, ua, ub = p[left], p[right], base[left], base[right]
                pairs.add((no[left] << 32) | no[right], _f(pa_, pb) - _f(pa_, ub) - _f(ua, pb) + _f(ua, ub), np.ones(len(left), np.int64))
                at = to

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            if not len(table):
                continue
            here, term = table["lang"], table["term"]
            new_lang = pc.not_equal(here[1:], here[:-1]).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(new_lang | pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)) + 1
            last = int(new[-1]) if len(new) else 0  # the last term may go on
            rest = table.slice(last)
            for a, b in zip([0, *(x + 1 for x in np.flatnonzero(new_lang[: max(last - 1, 0)]).tolist())], [*(x + 1 for x in np.flatnonzero(new_lang[: max(last - 1, 0)]).tolist()), last], strict=True):
                if a < b:
                    if here[a].as_py() != lang:
                        yield from close()
                        lang = here[a].as_py()
                    add(table.slice(a, b - a))
            if pairs.rows + times.rows + sum(len(x) for x in best) > _HELD:
                yield from close()
        if rest is not None and len(rest):
            if rest["lang"][0].as_py() != lang:
                yield from close()
                lang = rest["lang"][0].as_py()
            add(rest)
        yield from close()

    return postings.mapInArrow(run, "kind int, lang string, a long, b long, x long, times long, term string")


def audit(docs: DataFrame, least: int = 3, top: int = 200, chunk_bytes: int = 32 << 20) -> DataFrame:
    """lang, source, part, item, value, rank: how each source differs from the others of its language, and in which terms.

    Null texts, languages and sources are empty ones. Each row is a document, repeated rows
    too. A (lang, source) without terms is a group like the others. Part `pair` has a row
    for each other source, 0 where the language keeps no terms; part `term` the first `top`
    of the group's kept terms that stand above the language's share. Ties rank by the
    item's UTF-8 bytes. A language of one source has no pairs. Other columns of docs,
    whatever their names, take no part. An empty table gives an empty result.

    The work for a term is the square of the sources that have it, as the result's is of a
    language's sources; what tasks send are sums by pair of sources.
    """
    spark = docs.sparkSession
    ship(spark)
    parallelism = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    read = cut(chunks(plain, chunk_bytes), "divergence-chunks")
    w = Window.partitionBy("lang", "term")  # a row a chunk at most
    own = read.where("term IS NOT NULL").select("chunk", "lang", "term", "df", F.sum("df").over(w).alias("docs"), (F.min("chunk").over(w) == F.col("chunk")).alias("first")).where(F.col("docs") >= least)
    none = lambda t: F.lit(None).cast(t)
    rows = own.select("chunk", "lang", none("string").alias("source"), "term", "df", "first", none("binary").alias("body")).union(read.where("body IS NOT NULL").select("chunk", "lang", "source", none("string"), none("long"), none("boolean"), "body"))
    rows = rows.repartition(parallelism, "chunk", "lang").sortWithinPartitions("chunk", "lang", F.col("term").isNull())
    counted = cut(recount(rows), "divergence-counts")
    drop_cut(read)

    # Groups: as many rows as there are languages and sources.
    groups = counted.where("source IS NOT NULL").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocabulary = counted.where("source IS NULL").groupBy(F.col("lang").alias("v_lang")).agg(F.sum("n").alias("v"))
    groups = groups.join(vocabulary, F.col("lang") == F.col("v_lang"), "left").drop("v_lang").na.fill(0, ["v"])
    of = Window.partitionBy("lang")
    groups = groups.withColumns({"no": (F.row_number().over(of.orderBy("source")) - 1).cast("long"), "lang_total": F.sum("total").over(of)})
    groups = cut(groups.withColumn("base", F.when(F.col("v") > 0, parts_per_billion(F.lit(0), F.col("total"), F.col("v")))), "divergence-groups")

    facts = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "no", "total", "v", "lang_total")
    few = groups.count() <= FEW_GROUPS
    postings = counted.where("term IS NOT NULL").select("lang", "source", "term", "n").repartition(parallelism, "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    postings = postings.join(F.broadcast(facts) if few else facts, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source"))).select("lang", "term", "no", "n", "total", "v", "lang_total")
    if not few:
        postings = postings.repartition(parallelism, "lang", "term")
    measured = cut(measure(postings.sortWithinPartitions("lang", "term"), top), "divergence-measured")

    names = groups.select(F.col("lang").alias("n_lang"), F.col("no").alias("n_no"), "source")
    compared = measured.where(F.col("kind") == TERM).select("lang", "a", F.col("term").alias("item"), F.col("x").alias("value"), F.pmod(F.xxhash64("term"), F.lit(64)).alias("salt"))
    best = [F.col("value").desc(), F.col("item")]
    for keys in (["lang", "a", "salt"], ["lang", "a"]):  # a group's terms may be a third of all: first the best of each 64th
        compared = compared.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= top)
    by_term = compared.join(names, (F.col("lang") == F.col("n_lang")) & (F.col("a") == F.col("n_no"))).select("lang", "source", F.lit("term").alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))

    # One source's postings against another's base, by distinct share.
    other = groups.select(F.col("lang").alias("o_lang"), F.col("source").alias("item"), F.col("no").alias("o_no"), F.col("base").alias("o_base"))
    held = measured.where(F.col("kind") == SHARE).groupBy(F.col("lang").alias("h_lang"), F.col("a").alias("h_no"), F.col("b").alias("p")).agg(F.sum("times").alias("times"))
    crossed = held.join(other, (F.col("h_lang") == F.col("o_lang")) & (F.col("h_no") != F.col("o_no")))
    crossed = crossed.groupBy("h_lang", "h_no", "o_no").agg(F.sum(F.col("times") * divergence(F.col("p"), F.col("o_base"))).alias("to"), F.sum(F.col("times") * divergence(F.col("o_base"), F.col("p"))).alias("back"), F.sum("times").alias("terms"))
    shared = measured.where(F.col("kind") == PAIR).groupBy(F.col("lang").alias("x_lang"), F.col("a").alias("x_a"), F.col("b").alias("x_b")).agg(F.sum("x").alias("x"))

    pairs = groups.join(other, (F.col("lang") == F.col("o_lang")) & (F.col("no") != F.col("o_no"))).select("lang", "source", "item", "no", "o_no", "v", "base", "o_base")
    pairs = pairs.join(shared, (F.col("lang") == F.col("x_lang")) & (F.col("no") == F.col("x_a")) & (F.col("o_no") == F.col("x_b")), "left")
    forth = crossed.select(F.col("h_lang").alias("f_lang"), F.col("h_no").alias("f_no"), F.col("o_no").alias("f_o"), "to", F.col("terms").alias("f_terms"))
    back = crossed.select(F.col("h_lang").alias("b_lang"), F.col("h_no").alias("b_no"), F.col("o_no").alias("b_o"), "back", F.col("terms").alias("b_terms"))
    pairs = pairs.join(forth, (F.col("lang") == F.col("f_lang")) & (F.col("no") == F.col("f_no")) & (F.col("o_no") == F.col("f_o")), "left")
    pairs = pairs.join(back, (F.col("lang") == F.col("b_lang")) & (F.col("o_no") == F.col("b_no")) & (F.col("no") == F.col("b_o")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    # Terms that either has were summed against the other's base, mended in x where both have them; all others count as both bases.
    rest = (F.col("v") - zero("f_terms") - zero("b_terms")) * divergence(F.col("base"), F.col("o_base"))
    value = F.when(F.col("v") > 0, zero("x") + zero("to") + zero("back") + rest).otherwise(F.lit(0)).cast("long")
    pairs = pairs.select("lang", "source", "item", value.alias("value"))
    by_pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best)).cast("int").alias("rank"))
    return by_pair.union(by_term)


#: DuckDB.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
 w AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
 k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
 v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
 g AS (SELECT DISTINCT d.lang, d.source, coalesce(v.v, 0) AS v FROM d LEFT JOIN v ON v.lang = d.lang),
 c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
 n AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
 m AS (SELECT lang, sum(total) AS total FROM n GROUP BY ALL),
 l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
 p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(n.total, 0) + g.v)::HUGEINT AS p
   FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
 q AS (SELECT l.lang, l.term, 1 + (1000000000::HUGEINT * (l.n + 1)) // (m.total + v.v)::HUGEINT AS q FROM l JOIN m ON m.lang = l.lang JOIN v ON v.lang = l.lang),
 s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 x AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
 y AS (SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM x
UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM y) WHERE rank <= 200
"""
