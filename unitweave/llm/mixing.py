"""Mixing sources to target weights by capped water-filling.

Each source has a size (words), a weight and a cap of `max_epochs` times its size.
The budget is dealt by weight; sources above their cap are clamped to it and the
excess is dealt again to the others by weight, until none is above. As sources are
clamped in the order of cap / weight, the fixed point is found by prefix sums over
that order instead of rounds.

A source's target is then taken as whole epochs of every document, and a fractional
epoch: documents in the order of a seeded hash, up to the target; the document at
the border gives its first words only. The border is found by two histogram levels
over the hash and exact sums in the one bin that is left, so no source is ever
sorted as a whole. Rows of one hash (repeated or null ids) follow each other by a hash
of the text, found in the same way, and equal rows one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitweave.llm.common import cut, n_words

#: 15 hex digits of md5: 60 bits, cut into two levels of BITS and the rest.
HASH_BITS, BITS = 60, 10


def seeded_hash(doc_id: Column, seed: str) -> Column:
    text = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def text_hash(text: Column) -> Column:
    """60 bits of a text's hash: the order of rows that share a seeded hash."""
    return F.shiftrightunsigned(F.xxhash64(text.cast("string")), 64 - HASH_BITS)


def water_fill(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """sizes (source, source_size) -> with weight, cap and target (double).

    One row for each source, so the windows without keys see no more rows than
    there are sources. share = (numerator, denominator) of the sum of all sizes.
    """
    num, den = share
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    w = w.withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), F.col("rank"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({
        "all_words": F.sum("source_size").over(everything),
        "caps_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    left = (F.col("all_words") * num - F.col("caps_before") * den).cast("double")
    w = w.withColumn("clamped", F.col("cap").cast("double") * den * F.col("weight_left") <= left * F.col("weight"))
    w = w.withColumns({
        "caps": F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(everything),
        "open_weight": F.sum(F.when(F.col("clamped"), 0).otherwise(F.col("weight"))).over(everything),
    })
    share_left = (F.col("all_words") * num - F.col("caps") * den) * F.col("weight")
    return w.withColumn("target", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share_left.cast("double") / (F.col("open_weight") * den))).select("source", "source_size", "weight", "cap", "target")


def _border(bins: DataFrame, wanted: DataFrame, keys: list[str], bin_col: str) -> DataFrame:
    """The bin in which a source's fractional epoch ends, and how many of its words are taken."""
    w = Window.partitionBy("source").orderBy(bin_col)
    run = bins.withColumn("upto", F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hit = run.join(wanted, run["source"].eqNullSafe(wanted["w_source"]))
    hit = hit.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
    more = [F.col(c) for c in bins.columns if c not in ("source", bin_col, "words")]
    return hit.select(F.col("w_source"), *[F.col(k) for k in keys], F.col(bin_col), (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"), *more)


def _limits(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), max_epochs: int = 2, seed: str = "mix-1:") -> tuple[DataFrame, DataFrame]:
    """The sizes of all documents, and for each source its target, whole epochs and border."""
    h = F.col("h")
    sized = cut(docs.select(docs["doc_id"], docs["source"].cast("string").alias("source"), n_words(docs["text"]).alias("size"), seeded_hash(docs["doc_id"], seed).alias("h"), text_hash(docs["text"]).alias("t")), "mix-sizes")
    coarse = sized.groupBy("source", F.shiftright(h, HASH_BITS - BITS).alias("a")).agg(F.sum("size").alias("words"))
    sizes = coarse.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = water_fill(sizes, weights, share, max_epochs)
    # Epochs of the rounded target: what is left is less than an epoch, so its border is in the source.
    plan = plan.withColumn("rounded", F.round("target").cast("long"))
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("rounded div source_size")).otherwise(0).cast("long"))
    plan = cut(plan.withColumn("rest", F.col("rounded") - F.col("whole") * F.col("source_size")).drop("rounded").coalesce(1), "mix-plan")
    open_ = plan.where("rest > 0").select(F.col("source").alias("w_source"), "rest")
    at_h = cut(_find(sized, open_, "h", coarse).coalesce(1), "mix-border")
    ends = at_h.select("w_source", F.col("h").alias("border"), F.lit(None).cast("long").alias("tie"), F.col("rest").alias("part"), "equal").where("equal = 1")
    many = at_h.where("equal > 1")
    if not many.isEmpty():
        tied = sized.join(many.select(F.col("w_source").alias("s0"), F.col("h").alias("h0")), sized["source"].eqNullSafe(F.col("s0")) & (sized["h"] == F.col("h0"))).select("source", "size", "t")
        at_t = _find(tied, many.select("w_source", "rest"), "t")
        at_t = at_t.join(many.select(F.col("w_source").alias("s0"), F.col("h").alias("border")), at_t["w_source"].eqNullSafe(F.col("s0")))
        ends = ends.union(at_t.select("w_source", "border", F.col("t").alias("tie"), F.col("rest").alias("part"), "equal"))
    limits = cut(plan.join(ends, plan["source"].eqNullSafe(ends["w_source"]), "left").drop("w_source").withColumnRenamed("source", "p_source").coalesce(1), "mix-limits")
    return sized, limits


def _find(sized: DataFrame, open_: DataFrame, key: str, coarse: DataFrame | None = None) -> DataFrame:
    """(w_source, key, rest, words, equal): the value of a hash at which a source's fractional epoch ends, and the words taken of its rows."""
    k = F.col(key)
    if coarse is None:
        coarse = sized.groupBy("source", F.shiftright(k, HASH_BITS - BITS).alias("a")).agg(F.sum("size").alias("words"))
    at_a = _border(coarse, open_, [], "a")
    in_a = sized.join(at_a.select(F.col("w_source").alias("s1"), "a"), sized["source"].eqNullSafe(F.col("s1")) & (F.shiftright(k, HASH_BITS - BITS) == F.col("a")))
    fine = in_a.groupBy("source", F.shiftright(k, HASH_BITS - 2 * BITS).alias("b")).agg(F.sum("size").alias("words"))
    at_b = _border(fine, at_a.select("w_source", "rest"), [], "b")
    in_b = sized.join(at_b.select(F.col("w_source").alias("s1"), "b"), sized["source"].eqNullSafe(F.col("s1")) & (F.shiftright(k, HASH_BITS - 2 * BITS) == F.col("b")))
    last = in_b.groupBy("source", key).agg(F.sum("size").alias("words"), F.count("*").alias("equal"))
    return _border(last, at_b.select("w_source", "rest"), [], key)


def _fraction(d: DataFrame, limits: DataFrame, order: Column) -> DataFrame:
    """d (m_source, m_size, m_h, m_t, ...) with its source's limits and `extra`: the words taken in the fractional epoch."""
    d = d.join(limits, d["m_source"].eqNullSafe(limits["p_source"]))
    at = F.coalesce((F.col("m_h") == F.col("border")) & (F.col("m_t") == F.coalesce("tie", "m_t")), F.lit(False))
    before = F.lit(0).cast("long")
    if limits.where("equal > 1").isEmpty():
        d = d.withColumn("before", before)
    else:  # equal rows at a border, one after the other; only these are sorted
        upto = F.sum("m_size").over(Window.partitionBy("m_source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        d = d.where(~at).withColumn("before", before).unionByName(d.where(at).withColumn("before", F.coalesce(upto, before)))
    full = (F.col("m_h") < F.col("border")) | ((F.col("m_h") == F.col("border")) & (F.col("m_t") < F.col("tie")))
    extra = F.when(full, F.col("m_size")).when(at, F.greatest(F.lit(0), F.least("m_size", F.col("part") - F.col("before")))).otherwise(0)
    return d.withColumn("extra", extra.cast("long"))


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mix of `docs` (doc_id, text, source): each row with size, source_size, target, taken.

    Nulls: a null text has size 0; null sources are one source, last in order; a null
    id is hashed as an empty one. Rows of one hash follow each other by their texts'
    hash, equal ones in any order, so one document a source is partial. A source without words has target
    0. An empty table gives an empty table. Other columns of docs are ignored.
    """
    sized, limits = _limits(docs, **params)
    d = sized.select("doc_id", F.col("source").alias("m_source"), F.col("size").alias("m_size"), F.col("h").alias("m_h"), F.col("t").alias("m_t"))
    out = _fraction(d, limits, F.col("m_size"))
    taken = F.col("whole") * F.col("m_size") + F.col("extra")
    return out.select("doc_id", F.col("m_source").alias("source"), F.col("m_size").alias("size"), "source_size", "target", "whole", "extra", taken.cast("long").alias("taken"), "border", "part", F.col("m_h").alias("h"))


def repeat_documents(docs: DataFrame, **params) -> DataFrame:
    """docs as the mix has them: a row for each whole epoch, and one cut to its first words at the border.

    Columns and their order are those of docs. Documents that the mix does not take
    are not in the result; documents without words stay once, as they weigh nothing.
    """
    seed = params.get("seed", "mix-1:")
    _, limits = _limits(docs, **params)
    names = docs.columns
    d = docs.select(F.struct(*[docs[c] for c in names]).alias("d"), docs["source"].cast("string").alias("m_source"), n_words(docs["text"]).alias("m_size"), seeded_hash(docs["doc_id"], seed).alias("m_h"), text_hash(docs["text"]).alias("m_t"))
    d = _fraction(d, limits, F.xxhash64("d"))
    extra = F.col("extra")
    full = F.when(F.col("m_size") == 0, 1).otherwise(F.col("whole") + (extra == F.col("m_size")).cast("long")).cast("int")
    cuts = F.when((extra > 0) & (extra < F.col("m_size")), extra).otherwise(0)
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), full), F.when(cuts > 0, F.array(cuts.cast("long"))).otherwise(F.array().cast("array<bigint>")))
    d = d.select("d", F.explode(copies).alias("words"))
    text = F.when(F.col("words") < 0, F.col("d.text")).otherwise(first_words(F.col("d.text"), F.col("words")))
    return d.select(*[(text if c == "text" else F.col("d").getField(c)).alias(c) for c in names])


def first_words(text: Column, k: Column) -> Column:
    """The text up to the end of its k-th word."""
    words = F.slice(F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0)), 1, k.cast("int"))
    return F.array_join(words, "")


#: DuckDB, for documents with unique ids.
ORACLE = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
 src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
 r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM src),
 w AS (SELECT *, [5, 2, 1][1 + (rank - 1) % 3]::BIGINT AS weight, 2 * source_size AS cap FROM r),
 o AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS all_words,
    coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps_before,
    (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight_left FROM w),
 c AS (SELECT *, cap::DOUBLE * 2 * weight_left <= (all_words * 3 - caps_before * 2)::DOUBLE * weight AS clamped FROM o),
 s AS (SELECT *, (sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER ())::BIGINT AS caps, (sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER ())::BIGINT AS open_weight FROM c),
 t AS (SELECT source, source_size, CASE WHEN clamped THEN cap::DOUBLE ELSE ((all_words * 3 - caps * 2) * weight)::DOUBLE / (open_weight * 2) END AS target FROM s),
 p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
 q AS (SELECT *, greatest(0, round(target)::BIGINT - whole * source_size) AS rest FROM p),
 d AS (SELECT sized.*, q.source_size, q.target, q.whole, q.rest,
    coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM sized JOIN q ON sized.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM d
"""
