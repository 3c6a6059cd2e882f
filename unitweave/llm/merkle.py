"""Merkle manifest of a dataset: a binary hash tree per group, a proof per row, checked row by row.

1. A row's leaf is the sha-256 of its fields, written with their sizes. Leaves get their
   number within their group by one range sort and the sizes of what comes before.
2. Supersteps upward. A vertex is a run of 2^height consecutive nodes of a level. Children
   send it their number and digest; a vertex that has heard of all its children hashes
   them, level by level, to one digest and sends that to its own parent. The groups' roots
   are the leaves of one more tree, which gives the root of all.
3. Supersteps downward. The root sends its (empty) path to its vertex; each vertex puts the
   siblings inside its run before what it was sent and passes that to each child. Leaves
   end with the whole path, fold their digest along it and compare with the root.

With height 1 a superstep is one level; with the default of 7 it is seven, so 10^11 rows
need six each way. No vertex holds more than 2^height children, whatever the size of a
group, and each vertex's state goes through one shuffle that both directions read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitweave.llm.common import cut, ship

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
#: In a path: the sibling stands left or right of the node; the node is alone in its run.
LEFT, RIGHT, ALONE = "L", "R", "-"

Vertex = tuple[int, int]  # tree, number of the run; tree -1 is the one over the groups' roots


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(values: Iterable[Column]) -> Column:
    """sha-256 of all values: `-` for null, else the size in UTF-8 bytes, `:`, the value as text."""
    written = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in written]), 256)


def run_levels(digests: list[str], n: int, height: int) -> list[list[str]]:
    """The levels above a run of nodes, of which its whole level has n: each two become one, the last one of an odd level by itself; up to one node."""
    levels = [digests]
    while n > 1 and len(levels) <= height:
        low = levels[-1]
        levels.append([digest("".join(low[k : k + 2])) for k in range(0, len(low), 2)])
        n = -(-n // 2)
    return levels


def run_path(levels: list[list[str]], at: int) -> list[str]:
    """What stands beside node `at` of the lowest level on its way to the top of the run: a mark and a digest a level."""
    path = []
    for low in levels[:-1]:
        other = at ^ 1
        path.append((LEFT if at & 1 else RIGHT) + low[other] if other < len(low) else ALONE)
        at >>= 1
    return path


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its path lead to."""
    for step in path:
        leaf = digest(step[1:] + leaf if step[0] == LEFT else leaf + step[1:])
    return leaf


def steps_for(n: int, height: int) -> int:
    """Supersteps until n leaves are one node."""
    return max(1, -(-max(0, n - 1).bit_length() // height))


def _where(vertex: Vertex) -> int:
    x = ((vertex[0] + 2) * 0x9E3779B97F4A7C15 ^ vertex[1] * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return x >> 32


def numbered(leaves: DataFrame, parts: int) -> DataFrame:
    """leaves (grp, doc_id, leaf, shown, tie) with g (the group's number), at (the leaf's number in it) and n (the group's size).

    A group may hold all rows: it is sorted by ranges, and a leaf's number is its place in
    its range after the sizes of the ranges before.
    """
    spark = leaves.sparkSession
    by = ["grp", "doc_id", "leaf", "tie"]
    ordered = leaves.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("m", F.monotonically_increasing_id())
    ordered = cut(ordered.drop("tie").withColumn("part", F.shiftright("m", 33)), "manifest-ordered")
    runs = ordered.groupBy("grp", "part").agg(F.min("m").alias("low"), F.count("*").alias("size"))
    w = Window.partitionBy("grp")
    runs = runs.withColumns({"n": F.sum("size").over(w), "before": F.sum("size").over(w.orderBy("part")) - F.col("size")})
    named = runs.select("grp").distinct().orderBy("grp").rdd.zipWithIndex().map(lambda x: (x[0].grp, x[1]))
    names = spark.createDataFrame(named, "grp string, g long")
    runs = cut(runs.join(names, "grp").select(F.col("grp").alias("r_grp"), F.col("part").alias("r_part"), "low", "before", "n", "g"), "manifest-runs")
    joined = ordered.join(runs, (F.col("grp") == F.col("r_grp")) & (F.col("part") == F.col("r_part")))
    return joined.select("g", (F.col("m") - F.col("low") + F.col("before")).alias("at"), "n", "doc_id", "leaf", "shown")


def _complete(item: tuple[Vertex, Iterable[tuple]], height: int) -> tuple[Vertex, tuple]:
    """A vertex that has heard of its children: (nodes of the children's level, the children in order)."""
    vertex, children = item
    held = sorted(children, key=lambda c: c[0])
    n, first = held[0][2], vertex[1] << height
    if [c[0] for c in held] != list(range(first, min(first + (1 << height), n))):
        raise RuntimeError(f"vertex {vertex} has {len(held)} children of {n} from {first}: not each exactly once")
    return vertex, (n, held)


class Climb:
    """One tree's, or many trees', supersteps: up() and then down()."""

    def __init__(self, height: int, parallelism: int):
        self.height, self.parallelism, self.states = height, parallelism, []

    def _parts(self, nodes: int) -> int:
        """Partitions for a level's messages: about 2^18 a task, and enough tasks for small levels."""
        return max(1, min(self.parallelism, nodes // 1024), nodes >> 18)

    def up(self, messages: RDD, nodes: int, steps: int) -> RDD:
        """messages (vertex, (number, digest, n, ...)) of the lowest level -> (tree, root of the tree)."""
        height = self.height
        for _ in range(steps):
            parts = self._parts(nodes)
            state = messages.groupByKey(parts, _where).map(lambda x: _complete(x, height), preservesPartitioning=True)
            self.states.append((state, parts))

            def forward(item: tuple[Vertex, tuple]) -> tuple[Vertex, tuple]:
                (tree, k), (n, held) = item
                top = run_levels([c[1] for c in held], n, height)[-1][0]
                return (tree, k >> height), (k, top, -(-n >> height))

            messages = state.map(forward)
            nodes = max(1, nodes >> height)
        return messages.map(lambda x: (x[0][0], x[1][1]))

    def down(self, told: RDD) -> Iterator[RDD]:
        """told (vertex, (given, path)) for the top vertices -> the same for the children of each superstep, highest first: (tree, child, given, path)."""
        height = self.height
        for state, parts in reversed(self.states):
            both = state.mapValues(lambda v: (0, v)).union(told.partitionBy(parts, _where).mapValues(lambda v: (1, v))).groupByKey(parts, _where)

            def tell(item: tuple[Vertex, Iterable[tuple]]) -> Iterator[tuple]:
                (tree, _), got = item
                (_, (n, held)), (_, (given, path)) = sorted(got, key=lambda x: x[0])
                levels = run_levels([c[1] for c in held], n, height)
                for k, child in enumerate(held):
                    yield tree, child, given, run_path(levels, k) + path

            out = both.flatMap(tell)
            yield out
            told = out.map(lambda x: ((x[0], x[1][0]), (x[2], x[3])))


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = 7) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    One tree per lang (null is one, before all others, and apart from an empty one), leaves
    by rising doc_id (null first), rows of one id by their leaf; equal rows are leaves of
    their own, whose proofs differ by their places. `tampered` marks rows of which a
    verifier sees n_chars + 1 (null stays null); null counts as false. Empty and long
    texts are hashed whole. A lone row is the root itself, with the digest of nothing as
    proof. Other columns of docs, whatever their names, take no part. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    values = {c: docs[c] for c in FIELDS}
    seen = values | {"n_chars": values["n_chars"].cast("decimal(38,0)") + 1}
    leaf = leaf_digest(values.values())
    changed = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    # '' for null and '=' before the rest keeps null first and apart; Spark orders strings by their UTF-8 bytes.
    grp = F.coalesce(F.concat(F.lit("="), docs["lang"]), F.lit(""))
    leaves = docs.select(grp.alias("grp"), docs["doc_id"].cast("long").alias("doc_id"), leaf.alias("leaf"), F.when(changed, leaf_digest(seen.values())).alias("shown"), F.monotonically_increasing_id().alias("tie"))
    leaves = cut(leaves, "manifest-leaves")
    rows = leaves.count()
    if not rows:
        return spark.createDataFrame([], SCHEMA)
    parallelism = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = cut(numbered(leaves, max(min(parallelism, rows // 1024), rows >> 18, 1)), "manifest-numbered")
    most, trees = known.agg(F.max("n"), F.max("g") + 1).first()
    lower, upper = Climb(height, parallelism), Climb(height, parallelism)
    sent = known.rdd.map(lambda r: ((r[0], r[1] >> height), (r[1], r[4], r[2], r[3], r[5])))
    subroots = lower.up(sent, rows, steps_for(most, height))
    roots = upper.up(subroots.map(lambda x: ((-1, x[0] >> height), (x[0], x[1], trees))), trees, steps_for(trees, height))
    told = roots.map(lambda x: ((x[0], 0), (x[1], [])))
    for out in upper.down(told):  # the last are the groups' roots
        told = out.map(lambda x: ((x[0], x[1][0]), (x[2], x[3])))
        last = out
    told = last.map(lambda x: ((x[1][0], 0), ((x[2], x[1][1]), x[3])))
    for last in lower.down(told):
        pass

    def row(x: tuple) -> tuple:
        _, (_, own, _, doc_id, shown), (root, subroot), path = x
        folded = fold(shown or own, path)
        return doc_id, own, subroot, root, digest("".join(p[1:] for p in path)), folded, folded == root

    return spark.createDataFrame(last.map(row), SCHEMA, verifySchema=False)


#: DuckDB. crc32 of the id as text, bit by bit.
ORACLE = r"""
WITH RECURSIVE f AS (SELECT doc_id, lang, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS c, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1) END AS c1,
   CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
   CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
   xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]), lambda x, k: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 7 = 0 AS bad FROM documents),
 a AS (SELECT doc_id, lang, sha256(head || c || tail) AS leaf, sha256(head || CASE WHEN bad THEN c1 ELSE c END || tail) AS shown FROM f),
 b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM a),
 t(lang, lev, i, n, h) AS (SELECT lang, 0, i, n, leaf FROM b
   UNION ALL SELECT lang, lev + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lang, lev, i // 2),
 s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
 u(lev, i, n, h) AS (SELECT 0, i, n, h FROM s
   UNION ALL SELECT lev + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lev, i // 2),
 up(doc_id, leaf, lang, lev, i, n, h, proof) AS (SELECT doc_id, leaf, lang, 0, i, n, shown, '' FROM b
   UNION ALL SELECT p.doc_id, p.leaf, p.lang, p.lev + 1, p.i // 2, (p.n + 1) // 2, sha256(CASE WHEN p.i % 2 = 1 THEN coalesce(t.h, '') || p.h ELSE p.h || coalesce(t.h, '') END), p.proof || coalesce(t.h, '')
   FROM up p LEFT JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND t.lev = p.lev AND t.i = xor(p.i, 1) WHERE p.n > 1),
 top(doc_id, leaf, subroot, lev, i, n, h, proof) AS (SELECT p.doc_id, p.leaf, s.h, 0, s.i, s.n, p.h, p.proof FROM up p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang WHERE p.n = 1
   UNION ALL SELECT p.doc_id, p.leaf, p.subroot, p.lev + 1, p.i // 2, (p.n + 1) // 2, sha256(CASE WHEN p.i % 2 = 1 THEN coalesce(u.h, '') || p.h ELSE p.h || coalesce(u.h, '') END), p.proof || coalesce(u.h, '')
   FROM top p LEFT JOIN u ON u.lev = p.lev AND u.i = xor(p.i, 1) WHERE p.n > 1),
 r AS (SELECT h AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM top, r WHERE top.n = 1
"""
