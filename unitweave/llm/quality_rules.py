"""Quality rules whose limits come from the data: a quantile sketch per language and source.

Measures are whole numbers (thousandths, hundredths). A sketch is a log-linear
histogram: values up to 64 are exact, larger ones keep six leading bits, so a quantile
is off by less than 1/32 of its value. Sketches merge by adding counts, in any order,
with the same result; as rows (group, measure, bin, count) a merge is a groupBy. To each
group's sketch, PRIOR documents are added that are spread like its language's, and to each
language's as many spread like all documents: a group of a few documents is judged mostly
by its language, one of many by itself, and nothing changes at a border.

From the quartiles of a group come its fences: q3 + 3 * spread and, for the length of
words, q1 - 3 * spread, where spread = max(q3 - q1, the least spread of the measure).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitweave.llm.common import BLANKS, WORD, cut, ship

WORDS, SYMBOLS = re.compile(WORD), "#*$%&|<>"
_NO_BLANKS, _NO_SYMBOLS = str.maketrans("", "", BLANKS), str.maketrans("", "", SYMBOLS)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Measure -> (numerator, denominator, factor, least spread, has a lower fence).
MEASURES = {
    "word_length": ("word_chars", "n_words", 100, 60, True),
    "symbols": ("n_symbols", "n_words", 1000, 80, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 80, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 80, False),
}
#: Documents added to a sketch from the one above it.
PRIOR = 50


def base_measures(text: str | None) -> tuple[int, ...]:
    """The six counts of BASE of a whole text; zeros for null.

    Words in a 3-word window that is found twice or more count once each, the first
    window's included.
    """
    if not text:
        return (0,) * 6
    words = WORDS.findall(text)
    lines = [s for s in text.split("\n") if WORDS.search(s)]
    repeated, n = 0, len(words)
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            end = 0  # words before it are counted
            for k, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += k + 3 - max(end, k)
                    end = k + 3
    return n, len(text.translate(_NO_BLANKS)), len(text) - len(text.translate(_NO_SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of BASE, for every row of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [base_measures(t.as_py()) for t in batch.column(3)]
            counts = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *counts], ["doc_id", "lang", "source", *BASE])

    kept = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), docs["text"].cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in BASE))


def bin_of(v: Column) -> Column:
    """Lowest value of the sketch bin of a whole number >= 0."""
    shift = F.greatest(F.lit(0), F.length(F.bin(v)) - 6)
    return F.when(v < 64, v).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)).cast("long")


def sketch(measures: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: one mergeable sketch for each language, source and measure."""
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.floor(F.col(a) * k / F.col(b)).alias("v")) for m, (a, b, k, _, _) in MEASURES.items()])
    rows = measures.select("lang", "source", F.explode(values).alias("m"))
    return rows.groupBy("lang", "source", F.col("m.measure").alias("measure"), bin_of(F.col("m.v")).alias("bin")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    """The merged sketches of all rows with the same keys."""
    return sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def fences(measures: DataFrame) -> DataFrame:
    """lang, source and for each measure m: low_m, high_m.

    measures: the rows that count. The weights of bins are whole numbers: a language's are
    counts times the number of all documents, a group's times both numbers.
    """
    big = lambda c: F.col(c).cast("decimal(38,0)")
    own = cut(sketch(measures), "rules-sketch")
    by_lang = cut(merge(own, "lang"), "rules-sketch-lang")
    of_all = merge(by_lang).withColumn("a_total", F.sum("n").over(Window.partitionBy("measure"))).select(F.col("measure").alias("m1"), F.col("bin").alias("b"), F.col("n").alias("a_n"), "a_total")
    lang = by_lang.groupBy("lang", "measure").agg(F.sum("n").alias("l_total")).join(of_all, F.col("measure") == F.col("m1")).drop("m1")
    l_own = by_lang.select(F.col("lang").alias("l2"), F.col("measure").alias("m2"), F.col("bin").alias("b2"), F.col("n").alias("l_n"))
    lang = lang.join(l_own, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("measure") == F.col("m2")) & (F.col("b") == F.col("b2")), "left").na.fill(0, ["l_n"])
    in_order = lambda *keys: Window.partitionBy(*keys, "measure").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    lang = lang.withColumn("l_upto", F.sum(big("l_n") * big("a_total") + F.lit(PRIOR) * big("a_n")).over(in_order("lang")))
    lang = lang.select(F.col("lang").alias("l3"), F.col("measure").alias("m3"), "b", "l_upto", ((big("l_total") + F.lit(PRIOR)) * big("a_total")).cast("decimal(38,0)").alias("unit"))
    group = own.groupBy("lang", "source", "measure").agg(F.sum("n").alias("total")).join(lang, F.col("lang").eqNullSafe(F.col("l3")) & (F.col("measure") == F.col("m3"))).drop("l3", "m3")
    g_own = own.select(F.col("lang").alias("l4"), F.col("source").alias("s4"), F.col("measure").alias("m4"), F.col("bin").alias("b4"), F.col("n").alias("g_n"))
    same = F.col("lang").eqNullSafe(F.col("l4")) & F.col("source").eqNullSafe(F.col("s4")) & (F.col("measure") == F.col("m4")) & (F.col("b") == F.col("b4"))
    group = group.join(g_own, same, "left").na.fill(0, ["g_n"]).withColumn("g_upto", F.sum("g_n").over(in_order("lang", "source")))
    upto, total = big("g_upto") * F.col("unit") + F.lit(PRIOR) * F.col("l_upto"), (big("total") + F.lit(PRIOR)) * F.col("unit")
    at = lambda q: F.min(F.when(upto * 4 >= total * q, F.col("b")))
    q = group.groupBy("lang", "source", "measure").agg(at(1).alias("q1"), at(3).alias("q3"))
    spread = F.element_at(F.create_map(*[x for m, s in MEASURES.items() for x in (F.lit(m), F.lit(s[3]))]), F.col("measure"))
    q = q.withColumn("least", spread)
    q = q.withColumn("spread", F.greatest(F.col("q3") - F.col("q1"), F.col("least")))
    of = lambda m, c: F.max(F.when(F.col("measure") == m, c))
    return q.groupBy("lang", "source").agg(*[x for m in MEASURES for x in (of(m, F.col("q1") - 3 * F.col("spread")).alias(f"low_{m}"), of(m, F.col("q3") + 3 * F.col("spread")).alias(f"high_{m}"))])


def apply_rules(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept.

    Base rule: fewer than 50 words, or more than half of them in repeated windows; such
    documents are not kept and don't enter the sketches. Null lang or source are groups
    like others. A null text has no words. Repeated rows count as often as they are
    there. An empty table gives an empty result.
    """
    m = cut(measured(docs), "rules-measures")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    m = m.withColumn("base_failed", failed)
    limits = fences(m.where(~F.col("base_failed")))
    limits = limits.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *[c for c in limits.columns if c not in ("lang", "source")])
    joined = m.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    good = ~F.col("base_failed")
    for name, (a, b, k, _, lower) in MEASURES.items():
        v = F.floor(F.col(a) * k / F.greatest(F.col(b), F.lit(1)))
        good = good & (v <= F.col(f"high_{name}"))
        if lower:
            good = good & (v >= F.col(f"low_{name}"))
    return joined.select("doc_id", *BASE[:5], "base_failed", F.coalesce(good, F.lit(False)).alias("kept"), "n_lines")


def _oracle() -> str:
    bins = "CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END"
    parts = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, ({a} * {k}) // {b} AS v FROM ok" for m, (a, b, k, _, _) in MEASURES.items())
    least = "CASE measure " + " ".join(f"WHEN '{m}' THEN {s[3]}" for m, s in MEASURES.items()) + " END"
    high = lambda m: f"max(CASE WHEN measure = '{m}' THEN q3 + 3 * spread END) AS high_{m}, max(CASE WHEN measure = '{m}' THEN q1 - 3 * spread END) AS low_{m}"
    tests = " AND ".join(f"({a} * {k}) // greatest({b}, 1) <= high_{m}" + (f" AND ({a} * {k}) // greatest({b}, 1) >= low_{m}" if low else "") for m, (a, b, k, _, low) in MEASURES.items())
    return rf"""
WITH t AS (SELECT doc_id, lang, source, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
 w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
 g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
 g3 AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM g),
 g4 AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g3) WHERE c > 1),
 rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g4) GROUP BY r),
 m AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM w LEFT JOIN rep USING (r)),
 b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
 ok AS (SELECT * FROM b WHERE NOT base_failed),
 v AS (SELECT lang, source, measure, {bins} AS bin FROM ({parts})),
 o AS (SELECT lang, source, measure, bin, count(*) AS n FROM v GROUP BY ALL), l AS (SELECT lang, measure, bin, count(*) AS n FROM v GROUP BY ALL),
 a AS (SELECT measure, bin, n, (sum(n) OVER (PARTITION BY measure))::HUGEINT AS total FROM (SELECT measure, bin, count(*) AS n FROM v GROUP BY ALL)),
 lt AS (SELECT lang, measure, sum(n)::HUGEINT AS total FROM l GROUP BY ALL),
 lw AS (SELECT lt.lang, lt.measure, a.bin, coalesce(l.n, 0)::HUGEINT * a.total + {PRIOR} * a.n::HUGEINT AS w, (lt.total + {PRIOR}) * a.total AS unit
    FROM lt JOIN a ON lt.measure = a.measure LEFT JOIN l ON l.lang IS NOT DISTINCT FROM lt.lang AND l.measure = lt.measure AND l.bin = a.bin),
 lc AS (SELECT *, (sum(w) OVER (PARTITION BY lang, measure ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::HUGEINT AS upto FROM lw),
 gt AS (SELECT lang, source, measure, sum(n)::HUGEINT AS total FROM o GROUP BY ALL),
 gc AS (SELECT gt.lang, gt.source, gt.measure, lc.bin, gt.total, lc.unit, lc.upto,
    (sum(coalesce(o.n, 0)) OVER (PARTITION BY gt.lang, gt.source, gt.measure ORDER BY lc.bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::HUGEINT AS own
    FROM gt JOIN lc ON gt.lang IS NOT DISTINCT FROM lc.lang AND gt.measure = lc.measure
    LEFT JOIN o ON o.lang IS NOT DISTINCT FROM gt.lang AND o.source IS NOT DISTINCT FROM gt.source AND o.measure = gt.measure AND o.bin = lc.bin),
 f AS (SELECT lang, source, measure, min(bin) FILTER (WHERE (own * unit + {PRIOR} * upto) * 4 >= (total + {PRIOR}) * unit) AS q1,
    min(bin) FILTER (WHERE (own * unit + {PRIOR} * upto) * 4 >= (total + {PRIOR}) * unit * 3) AS q3, {least} AS least FROM gc GROUP BY ALL),
 h AS (SELECT lang, source, {', '.join(map(high, MEASURES))} FROM (SELECT *, greatest(q3 - q1, least) AS spread FROM f) GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND {tests}, false) AS kept
FROM b LEFT JOIN h ON b.lang IS NOT DISTINCT FROM h.lang AND b.source IS NOT DISTINCT FROM h.source
"""


ORACLE = _oracle()
