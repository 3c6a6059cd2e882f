"""Near copies by circulant MinHash: bands of signatures, exact Jaccard, groups by links.

1. A shingle's hash names one of D cells. The permutation sigma moves the cells, and the
   table pi, itself a permutation of D numbers, is read from there: coordinate k of a set's
   signature is the least pi[(sigma(x) + k) mod D] over its cells. One row of K consecutive
   entries of pi per shingle gives all K coordinates, so the work is reading and taking
   minima; no K hash functions are evaluated.
2. Texts with one set of shingles are one class. A class has a key for each band of
   `rows` coordinates, and classes with a key in common meet in a bucket. Buckets with the
   same members are one. Two sets of Jaccard J miss each other in all bands with
   probability (1 - J^rows)^bands: 7e-10 at J = 0.8 for the 40 bands of 4.
3. In each bucket every member is compared with one leader, the member that shares most
   buckets with others (a text from which others were made, where it is there), on the
   whole sets, by joins of pairs with sets: a bucket of n members costs n comparisons,
   none in one task. Links make components. What remains are buckets whose members are in
   several components; there other leaders are tried while buckets are large, and then
   each pair of members from different components that sizes and parity bitmaps allow is
   compared too. So no pair of a bucket is left out but those that links already join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.llm.common import cut, drop_cut, ship
from unitweave.llm.overlap_join import Bitmaps, components, parity, set_key, shingles

CELLS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLAB = 2048


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class Circulant:
    """The two permutations, and signatures of `k` coordinates made with them."""

    def __init__(self, k: int, seed: int = 0, cells: int = CELLS):
        self.k, self.cells = k, np.uint64(cells - 1)
        numbers = np.arange(cells, dtype=np.uint64)
        self.sigma, pi = (np.argsort(_mix(numbers + (np.uint64(2 * seed + i + 1) << np.uint64(32))), kind="stable").astype(np.uint32) for i in (0, 1))
        self.rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:k]]), k)

    def signature(self, s: np.ndarray) -> np.ndarray:
        """Of a set of hashes, not empty. Large sets are read in slabs."""
        at = self.sigma[(s & self.cells).astype(np.int64)]
        return np.min([self.rows[at[i : i + _SLAB]].min(axis=0) for i in range(0, len(at), _SLAB)], axis=0)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A signed 64-bit key for each band of each signature."""
    parts = signatures.reshape(len(signatures), -1, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2])
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = _mix(key * _BASE + parts[:, :, r])
    return key.view(np.int64)


def signed(docs: DataFrame, n: int, bands: int, rows: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, set key (k1, k2) of every row; parity bitmap and band keys where a task meets a set first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, seen = Circulant(bands * rows, seed), set()
        for batch in batches:
            sizes, keys, bits, at, signatures = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                s = shingles(text.as_py(), n)
                key = set_key(s)
                sizes.append(len(s))
                keys.append(key)
                if len(s) and key not in seen:
                    seen.add(key)
                    at.append(k)
                    bits.append(parity(s, 4))
                    signatures.append(maker.signature(s))
            if len(seen) > 100_000:
                seen.clear()
            columns: list[list] = [[None] * len(sizes), [None] * len(sizes)]
            if at:
                for k, b, key in zip(at, bits, band_keys(np.stack(signatures), rows).tolist(), strict=True):
                    columns[0][k], columns[1][k] = b, key
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)], pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.list_(pa.int64()))], ["doc_id", "n_shingles", "k1", "k2", "bits", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bits binary, bands array<long>")


def buckets(classes: DataFrame) -> DataFrame:
    """classes (cls, n_shingles, bands) -> (bucket, cls, n, weight): members of each bucket of two and more; buckets of the same members are one.

    weight: how many members the buckets of a class have together.
    """
    rows = classes.select(F.explode("bands").alias("key"), "cls", F.col("n_shingles").alias("n"))
    shared = rows.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select(F.col("key").alias("bucket"))
    found = cut(rows.join(shared, F.col("key") == F.col("bucket")).select("key", "cls", "n"), "circulant-shared")
    alike = found.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("cls")).alias("x1"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("x2"))
    one = alike.groupBy("size", "x1", "x2").agg(F.min("key").alias("bucket"))
    members = found.join(one.select("bucket", "size"), F.col("key") == F.col("bucket")).select("bucket", "cls", "n", "size")
    weights = members.groupBy(F.col("cls").alias("w_cls")).agg(F.sum("size").alias("weight"))
    return members.join(weights, F.col("cls") == F.col("w_cls")).select("bucket", "cls", "n", "weight")


def star_pairs(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """members (bucket, cls, comp, n, weight) -> (a, b): each member with its bucket's leader, where sizes allow a link and components differ.

    The leader of the first turn is the member of most weight, later ones are drawn.
    """
    first = F.col("weight") if turn == 0 else F.xxhash64("cls", F.lit(turn))
    lead = members.groupBy("bucket").agg(F.max(F.struct(first.alias("by"), "cls", "comp", "n")).alias("lead"))
    lead = lead.select(F.col("bucket").alias("l_bucket"), F.col("lead.cls").alias("l_cls"), F.col("lead.comp").alias("l_comp"), F.col("lead.n").alias("l_n"))
    pairs = members.join(lead, F.col("bucket") == F.col("l_bucket")).where((F.col("comp") != F.col("l_comp")) & (100 * F.least("n", "l_n") >= percent * F.greatest("n", "l_n")))
    return pairs.select(F.least("cls", "l_cls").alias("a"), F.greatest("cls", "l_cls").alias("b")).distinct()


def open_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """members with their components, of the buckets in which there are several."""
    placed = members.join(groups, F.col("cls") == F.col("node"), "left").select("bucket", "cls", F.coalesce("component", "cls").alias("comp"), "n", "weight")
    several = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low < high AND size > 2").select(F.col("bucket").alias("s_bucket"), "size")
    return placed.join(several, F.col("bucket") == F.col("s_bucket")).drop("s_bucket")


def remaining_pairs(members: DataFrame, classes: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): pairs of members of one bucket from different components that sizes and bitmaps allow.

    A bucket of more than `block` members is split, and each pair of its blocks is a task's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> pa.RecordBatch | None:
            ids, comps, sides = (np.array([h[k] for h in held]) for k in (1, 2, 0))
            maps, out = Bitmaps([h[3] for h in held], [h[4] for h in held], percent), []
            for k in range(len(held) - 1):
                others = comps[k + 1 :] != comps[k]
                if at[1] != at[2]:
                    others &= sides[k + 1 :] != sides[k]
                others = np.flatnonzero(others) + k + 1
                if len(others) and len(near := maps.possible(k, others)):
                    out.append(np.stack([np.minimum(ids[k], ids[near]), np.maximum(ids[k], ids[near])]))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(np.concatenate(out, axis=1), axis=1)], ["a", "b"]) if out else None

        for batch in batches:
            for bucket, i, j, *member in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (bucket, i, j) != at:
                    if len(held) > 1 and (done := close()) is not None:
                        yield done
                    at, held = (bucket, i, j), []
                held.append(member)
        if len(held) > 1 and (done := close()) is not None:
            yield done

    spark = members.sparkSession
    full = members.join(classes.select(F.col("cls").alias("c_cls"), "bits"), F.col("cls") == F.col("c_cls"))
    blocks = F.ceil(F.col("size") / block).cast("int")
    full = full.select("bucket", blocks.alias("blocks"), F.pmod(F.xxhash64("cls", F.lit(7)), blocks).cast("int").alias("own"), "cls", "comp", "n", "bits")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.struct(F.least(F.col("own"), y).alias("i"), F.greatest(F.col("own"), y).alias("j"), F.when(F.col("own") <= y, 0).otherwise(1).alias("side")))
    full = full.select("bucket", F.explode(others).alias("t"), "cls", "comp", "n", "bits").select("bucket", "t.i", "t.j", "t.side", "cls", "comp", "n", "bits")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return full.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a long, b long").distinct()


def whole_sets(members: DataFrame, classes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(cls, shingles): the sets of the classes that are in a bucket, made once from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(cls, s.astype("<u8").tobytes()) for text, cls, k1, k2 in zip(*[c.to_pylist() for c in batch.columns], strict=True) if set_key(s := shingles(text, n)) == (k1, k2)]
            if found:  # rows of one id with other texts are other classes
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["cls", "shingles"])

    wanted = members.select(F.col("cls").alias("w")).distinct().join(classes.select("cls", "class_id", "k1", "k2"), F.col("w") == F.col("cls"))
    texts = docs.join(wanted, docs["doc_id"] == wanted["class_id"]).select("text", "cls", "k1", "k2")
    return texts.mapInArrow(run, "cls long, shingles binary").groupBy("cls").agg(F.first("shingles").alias("shingles"))  # a row may be repeated


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose whole sets have 100 * |A and B| >= percent * |A or B|."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (left, right))
                merged = np.concatenate([x, y])
                merged.sort(kind="stable")  # two runs
                both = int((merged[1:] == merged[:-1]).sum())
                keep.append(100 * both >= percent * (len(merged) - both))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["a", "b"])

    joined = pairs.join(sets.select(F.col("cls").alias("c1"), F.col("shingles").alias("x")), F.col("a") == F.col("c1")).drop("c1")
    joined = joined.join(sets.select(F.col("cls").alias("c2"), F.col("shingles").alias("y")), F.col("b") == F.col("c2")).select("a", "b", "x", "y")
    return joined.mapInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, percent: int = 80, n: int = 2, bands: int = 40, rows: int = 4, seed: int = 0, large: int = 20_000, turns: int = 4, block: int = 4000) -> DataFrame:
    """Per row: doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable by links), kept (doc_id = component_id).

    Documents without words, and null texts, have an empty set, are linked with nothing and are
    kept. Repeated rows (one id, whatever the texts) are returned each; rows of one id are
    one node. A row with a null id is no node: its component is null and it is kept. Copies
    are one class and are never expanded into pairs; texts of any length are read whole.
    Other columns of docs, whatever their names, take no part. An empty table gives an
    empty result. `large` and `turns`: while a bucket with several components has more than
    `large` members, up to `turns` leaders are tried before its remaining pairs are.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    known = cut(signed(kept, n, bands, rows, seed), "circulant-signed")
    usable = known.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # A task's first row of a set has its bands, whatever its id; so bands come from all rows with words.
    classes = known.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n_shingles"), F.first("bits", ignorenulls=True).alias("bits"), F.first("bands", ignorenulls=True).alias("bands"))
    classes = cut(classes.where("class_id IS NOT NULL").withColumn("cls", F.monotonically_increasing_id()), "circulant-classes")
    members = cut(buckets(classes), "circulant-buckets")

    # One id with several texts ties their classes.
    several = usable.groupBy("doc_id").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low <> high").select(F.col("doc_id").alias("several"))
    tied = usable.join(several, F.col("doc_id") == F.col("several"), "left_semi").select("doc_id", "k1", "k2").distinct().join(classes.select("k1", "k2", "cls"), ["k1", "k2"])
    first = tied.groupBy("doc_id").agg(F.min("cls").alias("a")).withColumnRenamed("doc_id", "t_id")
    links = tied.join(first, F.col("doc_id") == F.col("t_id")).where("a < cls").select("a", F.col("cls").alias("b"))

    sets = cut(whole_sets(members, classes, kept, n), "circulant-sets")
    rest = members.withColumn("comp", F.col("cls"))
    for turn in range(turns):
        links = links.union(cut(confirmed(star_pairs(rest, turn, percent), sets, percent), f"circulant-links-{turn}"))
        groups = components(links)
        rest = cut(open_members(members, groups), f"circulant-open-{turn}")
        most = rest.agg(F.max("size")).first()[0] or 0
        if most <= large:
            break
    if most:
        pairs = cut(remaining_pairs(rest, classes, percent, block), "circulant-pairs")
        groups = components(links.union(cut(confirmed(pairs, sets, percent), "circulant-links-rest")))
    drop_cut(sets)
    placed = classes.select("cls", "k1", "k2", "class_id").join(groups, F.col("cls") == F.col("node"), "left").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "class_id", F.coalesce("component", "cls").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("class_id").alias("component_id")).withColumnRenamed("comp", "of")
    placed = cut(placed.join(least, F.col("comp") == F.col("of")).select("c1", "c2", "component_id"), "circulant-placed")
    out = known.join(placed, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


#: DuckDB.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS ss FROM w),
 c AS (SELECT min(doc_id) AS c, any_value(ss) AS ss, hash(list_sort(ss)) AS h, len(ss) AS n FROM s WHERE len(ss) > 0 GROUP BY hash(list_sort(ss)), len(ss)),
 f AS (SELECT g, count(*) AS f FROM (SELECT unnest(ss) AS g FROM c) GROUP BY g),
 e AS (SELECT x.c, x.n, x.g, row_number() OVER (PARTITION BY x.c ORDER BY f.f, x.g) AS k FROM (SELECT c, n, unnest(ss) AS g FROM c) x JOIN f ON f.g = x.g),
 p AS (SELECT DISTINCT a.c AS x, b.c AS y FROM e a JOIN e b ON a.g = b.g AND a.c < b.c AND a.k <= a.n - (80 * a.n + 99) // 100 + 1 AND b.k <= b.n - (80 * b.n + 99) // 100 + 1 AND 100 * b.n >= 80 * a.n AND 100 * a.n >= 80 * b.n),
 o AS (SELECT p.x, p.y, a.n AS nx, b.n AS ny, len(list_intersect(a.ss, b.ss)) AS k FROM p JOIN c a ON a.c = p.x JOIN c b ON b.c = p.y),
 l AS (SELECT x, y FROM o WHERE 100 * k >= 80 * (nx + ny - k) UNION SELECT y, x FROM o WHERE 100 * k >= 80 * (nx + ny - k)),
 r(n, m) AS (SELECT c, c FROM c UNION SELECT l.y, r.m FROM r JOIN l ON r.n = l.x AND r.m < l.y),
 k AS (SELECT n, min(m) AS m FROM r GROUP BY n)
SELECT s.doc_id, len(s.ss)::BIGINT AS n_shingles, coalesce(k.m, s.doc_id) AS component_id, s.doc_id = coalesce(k.m, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.h = hash(list_sort(s.ss)) AND c.n = len(s.ss) AND len(s.ss) > 0 LEFT JOIN k ON k.n = c.c
"""
