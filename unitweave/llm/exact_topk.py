"""Exact top-k by inner product: tiled products of query blocks and vector shards.

Vectors are packed into tiles, queries into blocks of the same form. Every tile meets
every block (blobs, not rows), one matrix product a pair. A product's k best per query
are selected at once and merged with the task's list of that query; the tasks' lists
are merged per query by a rank, which Spark applies before and after its shuffle.
No list is ever longer than k.

Components are integers, floor(scale * x). A product is exact in float32 where
dim * max^2 < 2^24, in float64 below 2^53, and in int64 below 2^63; the tile pair
picks the cheapest that is exact. Beyond, the score would not fit a long: an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitweave.llm.common import cut, ship

TILE = "tile long, dim int, n int, ids binary, data binary, largest double"


def _usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and its integer components, without vectors that are null, empty or hold what isn't a finite number."""
    v = vectors["embedding"]
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    part = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(odd, F.lit(True)) & vectors["vec_id"].isNotNull()).select(vectors["vec_id"].cast("long").alias("vec_id"), part.alias("v"))


def _tiles(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Packs vectors of one dimension into blobs of up to `rows` rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list] = {}
        made = TaskContext.get().partitionId() << 32

        def tile(dim: int, part: list) -> pa.RecordBatch:
            nonlocal made
            made += 1
            ids, data = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            top = float(np.abs(data).max())
            kind = "<f4" if top < 1 << 24 else "<f8"
            return pa.RecordBatch.from_pydict({"tile": [made], "dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": [ids.tobytes()], "data": [kind.encode() + data.astype(kind).tobytes()], "largest": [top]})

        for batch in batches:
            ids, v = batch.column(0).to_numpy(), batch.column(1)
            dims = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                data = flat[(ends[at][:, None] + np.arange(dim)).reshape(-1)].reshape(-1, dim)
                for k in range(0, len(at), rows):
                    part = held.setdefault(dim, [])
                    part.append((ids[at[k : k + rows]], data[k : k + rows]))
                    if sum(len(p[0]) for p in part) >= rows:
                        yield tile(dim, held.pop(dim))
        for dim, part in held.items():
            yield tile(dim, part)

    return cut(vectors.mapInArrow(pack, TILE), name)


def _matrix(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, blob[:3].decode(), offset=3).reshape(-1, dim)


def _product(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Exact q @ x.T; most bounds every partial sum."""
    if most >= 1 << 63:
        raise ValueError("an inner product of these integers does not fit 64 bits")
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (q.astype(kind, copy=False) @ x.astype(kind, copy=False).T).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: score descending, id ascending; partial selection first."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, tile_rows: int = 4096, block_rows: int = 1024) -> DataFrame:
    """For each row of queries its k best rows of vectors: query_id, rank, vec_id, score.

    Both have vec_id and embedding. A candidate with the query's own vec_id is left
    out. Vectors that are null, empty, hold nulls or non-finite numbers, or have a null
    vec_id take no part; vectors of another dimension than the query's are no candidates
    of it. Ties go to the smaller vec_id; repeated candidate rows each count; a repeated
    query row is answered once a row. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    tiles = _tiles(_usable(vectors, scale), tile_rows, "topk-tiles")
    blocks = _tiles(_usable(queries, scale), block_rows, "topk-blocks").select(*[F.col(c).alias(f"q_{c}") for c in ("tile", "dim", "n", "ids", "data", "largest")])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Blobs against blobs. As a difference, the condition is no hash key, so tiles of one dimension don't
    # meet in one task: Spark broadcasts the blocks only under its size threshold, and beyond it deals out
    # pairs of partitions.
    pairs = tiles.repartition(n, "tile").join(blocks, F.col("dim") - F.col("q_dim") == 0)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, list] = {}  # block -> query ids, and per query (ids, scores) of its best so far
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(i)[row].as_py() for i, c in enumerate(batch.schema.names)}
                dim = r["dim"]
                q, x = _matrix(r["q_data"], dim), _matrix(r["data"], dim)
                q_ids, ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                scores = _product(q, x, dim * max(1.0, r["largest"]) * max(1.0, r["q_largest"]))
                best = lists.setdefault(r["q_tile"], (q_ids, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q_ids)))[1]
                for j, own in enumerate(q_ids.tolist()):
                    at = _best(ids, scores[j], k + int((ids == own).sum()))
                    at = at[ids[at] != own]
                    c_ids, c_scores = np.concatenate([best[j][0], ids[at]]), np.concatenate([best[j][1], scores[j][at]])
                    at = _best(c_ids, c_scores, k)
                    best[j] = (c_ids[at], c_scores[at])
                if len(lists) > 64:
                    yield from _rows(lists)
                    lists = {}
        yield from _rows(lists)

    found = pairs.mapInArrow(multiply, "q_tile long, q_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_tile", "q_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _rows(lists: dict) -> Iterator[pa.RecordBatch]:
    for tile, (q_ids, best) in lists.items():
        n = [len(b[0]) for b in best]
        if sum(n):
            at = np.repeat(np.arange(len(n)), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tile)), pa.array(at), pa.array(q_ids[at]), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], ["q_tile", "q_row", "query_id", "vec_id", "score"])


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
