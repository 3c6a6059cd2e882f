"""N-gram Jaccard join by T-occurrence search, and the groups that its links make.

1. Texts with the same set of shingles are one class; its smallest doc_id stands for it.
2. Two sets of Jaccard >= t share a shingle in their prefixes, the first
   |A| - ceil(t |A|) + 1 shingles in one global order. The order is by rising frequency
   (from a sketch of counts that covers all documents and has a fixed size) and then by
   hash, so frequent passages stay out of the prefixes. Each task sends a class's
   prefix once.
3. All classes with one prefix shingle meet in the cell of the smallest key of them, first
   with a parity bitmap each, one bit a shingle. The bits in which two bitmaps differ are
   at most the shingles in which the sets differ, so most pairs end here, and none that is
   a link. What hangs together in a cell is a group, named by its members, and cells that
   lead to the same group are one. Only members of groups are read again.
4. A group is an inverted index. For each set A, smallest first, T = ceil(t |A|) of its
   shingles must occur in a smaller partner: the L longest lists are set aside
   (DivideSkip), the short ones are merged with counts, whoever has T - L occurrences is
   probed in the long ones by binary search, and whoever reaches T is held against the
   exact bound. Cells with more than `block` sets, or `block_bytes` bytes of them, are split
   before: each pair of blocks is a task of its own, so none needs more than one executor's memory.
5. Links are joined to components by repeated star contraction, all in DataFrames.

Hashes of shingles have 64 bits; those of sets 128.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.llm.common import WORD, cut, drop_cut, ship

WORDS = re.compile(WORD.encode())
_CASE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
SLOTS = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16), _BASE)]), dtype=np.uint64)
    return _POWERS[:n]


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of the whole sequence if it is shorter."""
    if not text:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_CASE), np.uint8)
    inside = ~(((b >= 9) & (b <= 13)) | (b == 32))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    if not len(edge):
        return np.zeros(0, np.uint64)
    sizes = edge[1::2] - edge[0::2]
    first = np.cumsum(sizes) - sizes  # where each word starts among the bytes of words
    with np.errstate(over="ignore"):
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        terms = (b[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(sizes.max()))[place]
        words = _mix(np.add.reduceat(terms, first) + sizes.astype(np.uint64))
        m = min(n, len(words))
        out = np.full(len(words) - m + 1, np.uint64(m))
        for k in range(m):
            out = _mix(out * _BASE + words[k : len(words) - m + 1 + k])
    return np.unique(out)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set of hashes, as two signed longs."""
    import xxhash

    return struct.unpack("<qq", xxhash.xxh3_128_digest(np.ascontiguousarray(s).tobytes()))


def parity(s: np.ndarray, times: int = 1) -> bytes:
    """Bitmap of `times` the least power of two >= |s| bits (64 at least): is the number of shingles of each bit odd?"""
    bits = times * max(64, 1 << max(0, len(s) - 1).bit_length())
    place = (s >> np.uint64(24)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and set key (k1, k2) of every row; and, in rows of their own, the tasks' frequency sketches as blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        names, counts, seen = ["doc_id", "n_shingles", "k1", "k2", "bits", "counts"], np.zeros(SLOTS, np.int64), set()
        for batch in batches:
            sizes, keys, bits, new = [], [], [], [np.zeros(0, np.uint64)]
            for text in batch.column(1):
                s = shingles(text.as_py(), n)
                sizes.append(len(s))
                keys.append(set_key(s))
                bits.append(parity(s))
                if keys[-1] not in seen:
                    seen.add(keys[-1])
                    new.append(s)
            counts += np.bincount((np.concatenate(new) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
            if len(seen) > 100_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)], pa.array(bits, pa.binary()), pa.nulls(len(keys), pa.binary())], names)
        blob = zstandard.ZstdCompressor(level=3).compress(counts.astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.binary()), pa.array([blob], pa.binary())], names)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bits binary, counts binary")


def frequencies(blobs: DataFrame) -> np.ndarray:
    """The merged sketch: log2 of the counts by slot, one byte a slot. Merged in executors, a fixed size each."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        total = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for blob in batch.column(0):
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), "<u4")
        yield pa.RecordBatch.from_pydict({"counts": [zstandard.ZstdCompressor(level=3).compress(total.tobytes())]})

    import zstandard

    n = int(blobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = blobs.select("counts").coalesce(max(1, min(8, n))).mapInArrow(merge, "counts binary").repartition(1).mapInArrow(merge, "counts binary")
    total = np.zeros(SLOTS, np.float64)
    for row in parts.collect():  # one
        total += np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row.counts)), "<u4")
    return (4 * np.log2(1 + total)).astype(np.uint8)


def memberships(docs: DataFrame, order: np.ndarray, percent: int, n: int) -> DataFrame:
    """(k1, cell): the cells in which each class has a possible partner; a cell is named by its smallest k1."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(order)  # SLOTS bytes

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = shared.value, set()
        for batch in batches:
            held, keys, lengths = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), n)
                key = set_key(s)[0]
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                p = prefix_size(len(s), percent)
                r = rank[(s & np.uint64(SLOTS - 1)).astype(np.int64)]
                by = np.lexsort((s, r))[:p]
                held.append(s[by].view(np.int64))
                keys.append(key)
                lengths.append(p)
            if len(seen) > 100_000:
                seen.clear()
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(np.repeat(np.array(keys, np.int64), lengths))], ["shingle", "k1"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shingle and key; of most shingles there is one class, and those end here."""
        shingle = cell = None
        for batch in batches:
            s, k = (batch.column(c).to_numpy() for c in (0, 1))
            if not len(s):
                continue
            new = np.concatenate([[s[0] != shingle if shingle is not None else True], s[1:] != s[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
            own = np.where(start >= 0, k[np.maximum(start, 0)], 0 if cell is None else cell)
            shingle, cell = s[-1], own[-1]
            other = own != k
            pairs = np.unique(np.stack([np.concatenate([k[other], own[other]]), np.concatenate([own[other], own[other]])], 1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["k1", "cell"])

    rows = docs.mapInArrow(prefixes, "shingle long, k1 long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "shingle").sortWithinPartitions("shingle", "k1").mapInArrow(runs, "k1 long, cell long").distinct()


class Bitmaps:
    """Parity bitmaps of a cell's members; which could be links of a given one."""

    def __init__(self, sizes: list[int], bits: list[bytes], percent: int):
        self.sizes, self.percent, self.bits = np.array(sizes), percent, np.array([8 * len(b) for b in bits])
        self.rows, self.maps = {}, {}
        for width in np.unique(self.bits).tolist():
            at = np.flatnonzero(self.bits == width)
            self.rows[width] = at
            self.maps[width] = np.frombuffer(b"".join([bits[k] for k in at.tolist()]), "<u8").reshape(len(at), -1)

    @staticmethod
    def _fold(maps: np.ndarray) -> np.ndarray:
        """To half the bits: the parity of a union of places is the exclusive or."""
        half = maps.shape[-1] // 2
        return maps[..., :half] ^ maps[..., half:]

    def possible(self, k: int, others: np.ndarray) -> np.ndarray:
        """Those of `others` whose sizes and bitmaps allow a link with k."""
        width, found = int(self.bits[k]), []
        mine = self.maps[width][np.searchsorted(self.rows[width], k)]
        for w in (width // 2, width, width * 2):
            if w in self.rows:
                at = np.flatnonzero(np.isin(self.rows[w], others, assume_unique=True)) if len(others) < len(self.sizes) else np.arange(len(self.rows[w]))
                rows = self.rows[w][at]
                n, m = int(self.sizes[k]), self.sizes[rows]
                near = (100 * m >= self.percent * n) & (100 * n >= self.percent * m)
                at, rows, m = at[near], rows[near], m[near]
                maps, own = self.maps[w][at], mine
                if w < width:
                    own = self._fold(own)
                elif w > width:
                    maps = self._fold(maps)
                differ = np.bitwise_count(maps ^ own).sum(axis=1).astype(np.int64)
                # |A and B| <= (|A| + |B| - differ) / 2, and a link needs (100 + percent) * |A and B| >= percent * (|A| + |B|).
                found.append(rows[(100 + self.percent) * (n + m - differ) >= 2 * self.percent * (n + m)])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def sieve(cells: DataFrame, percent: int) -> DataFrame:
    """cells (cell, i, j, side, class_id, n_shingles, bits) sorted by task -> (class_id, grp): groups of two and more that may hold links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        task, held = None, []

        def close() -> pa.RecordBatch | None:
            ids = np.array([h[1] for h in held])
            maps = Bitmaps([h[2] for h in held], [h[3] for h in held], percent)
            rest, out = np.arange(len(held)), []
            while len(rest):
                group, todo, rest = [], [int(rest[0])], rest[1:]
                while todo:
                    k = todo.pop()
                    group.append(k)
                    if len(rest):
                        near = maps.possible(k, rest)
                        if len(near):
                            todo += near.tolist()
                            rest = np.setdiff1d(rest, near, assume_unique=True)
                if len(group) > 1:
                    own = np.sort(ids[group])
                    out.append((own, np.full(len(own), xxhash.xxh3_64_intdigest(own.tobytes()), np.uint64).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in (0, 1)], ["class_id", "grp"]) if out else None

        for batch in batches:
            for cell, i, j, side, class_id, n, bits in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (cell, i, j) != task:
                    if len(held) > 1 and (done := close()) is not None:
                        yield done
                    task, held = (cell, i, j), []
                held.append((side, class_id, n, bits))
        if len(held) > 1 and (done := close()) is not None:
            yield done

    return cells.mapInArrow(run, "class_id long, grp long")


def links_of(sizes: np.ndarray, members: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """All pairs of sets with 100 * |A and B| >= percent * |A or B|, by T-occurrence search with DivideSkip."""
    by_size = np.argsort(sizes, kind="stable")
    rank_size = sizes[by_size]
    terms = np.concatenate([members[k] for k in by_size.tolist()])
    owners = np.repeat(np.arange(len(by_size)), rank_size)
    vocabulary, term = np.unique(terms, return_inverse=True)
    order = np.argsort(term, kind="stable")  # lists of owners, rising
    lists, bounds = owners[order], np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
    starts = np.concatenate([[0], np.cumsum(rank_size)])
    for q in range(1, len(by_size)):
        n = int(rank_size[q])
        need = -(-percent * n // 100)
        first = int(np.searchsorted(rank_size, need))
        if first >= q:
            continue
        mine = term[starts[q] : starts[q + 1]]
        a, b = bounds[mine], bounds[mine + 1]
        size = b - a
        longest_first = np.argsort(-size, kind="stable")
        most = int(size[longest_first[0]])
        n_long = min(need - 1, int(need / (0.0085 * math.log2(most + 2) + 1)))
        while n_long and size[longest_first[n_long - 1]] <= 2:  # lists as short as that are cheaper to merge
            n_long -= 1
        short, long_ = longest_first[n_long:], longest_first[:n_long]
        # The short lists are runs in order: a stable sort merges them from a stack of runs, as a heap would, and equal owners are counted.
        merged = np.concatenate([lists[a[k] : b[k]] for k in short.tolist()]) if len(short) else np.zeros(0, np.int64)
        merged = merged[(merged >= first) & (merged < q)]
        if not len(merged):
            continue
        merged.sort(kind="stable")
        new = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        found, counts = merged[new], np.diff(np.concatenate([new, [len(merged)]]))
        keep = counts >= need - n_long
        found, counts = found[keep], counts[keep]
        for done, k in enumerate(long_.tolist()):
            if not len(found):
                break
            own = lists[a[k] : b[k]]
            at = np.searchsorted(own, found)
            counts = counts + (own[np.minimum(at, len(own) - 1)] == found)
            keep = counts >= need - (n_long - done - 1)
            found, counts = found[keep], counts[keep]
        ok = 100 * counts >= percent * (n + rank_size[found] - counts)
        for f in found[ok].tolist():
            yield int(by_size[f]), int(by_size[q])


def search(groups: DataFrame, percent: int) -> DataFrame:
    """groups (grp, doc_id, shingles, groups, k1, k2, copies) sorted by group -> (a, b, n, k1, k2).

    Rows with a and b are a spanning set of links of each group's link graph; rows with
    n say how many documents of other classes are linked with the class k1, k2. A
    link of two classes that share several groups is counted in the smallest of them.
    A group's links are contracted to a forest and summed at once: what leaves it grows
    with its documents, not with its links.
    """
    names = ["a", "b", "n", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, seen = None, [], set()

        def close() -> pa.RecordBatch | None:
            members = [np.frombuffer(h[1], "<u8") for h in held]
            parent, out, linked = list(range(len(held))), [], [0] * len(held)

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for x, y in links_of(np.array([len(m) for m in members]), members, percent):
                gx, gy = held[x][2], held[y][2]
                if len(gx) == 1 or len(gy) == 1 or min(gx & gy) == group:
                    linked[x] += held[y][4]
                    linked[y] += held[x][4]
                rx, ry = root(x), root(y)
                if rx != ry:
                    parent[rx] = ry
                    out.append((held[x][0], held[y][0], None, None, None))
            out += [(None, None, c, *h[3]) for c, h in zip(linked, held, strict=True) if c]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names) if out else None

        for batch in batches:
            for grp, doc_id, blob, groups_, k1, k2, copies in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if grp != group:
                    if len(held) > 1 and (done := close()) is not None:
                        yield done
                    group, held, seen = grp, [], set()
                if (k1, k2) not in seen:  # a row may be repeated
                    seen.add((k1, k2))
                    held.append((doc_id, blob, frozenset(groups_), (k1, k2), copies))
        if len(held) > 1 and (done := close()) is not None:
            yield done

    return groups.mapInArrow(run, "a long, b long, n long, k1 long, k2 long")


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node of each connected component.

    Alternates large-star and small-star: each node points its larger neighbours, then
    its smaller ones, at the smallest. The edges of a round are a cut table; a fixed
    point is reached in about the log of the longest path, whatever the size.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links-0")
    for k in range(1, max_rounds + 1):
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(low, both["u"] == low["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        low = low.withColumnRenamed("u", "n")
        small = large.join(low, large["u"] == low["n"])
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = cut(small, f"links-{k}")
        same = new.count() == edges.count() and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        drop_cut(edges)
        edges = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def join_groups(docs: DataFrame, percent: int = 80, n: int = 5, block: int = 8000, block_bytes: int = 64 << 20) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), class_id, n_links.

    n_links is the number of other documents of Jaccard >= percent / 100, copies among
    them, without expanding pairs; repeated rows of one id and set count once, an id with
    several sets once for each. It is 0 for an empty set and null for a null id.

    Documents without words, and null texts, have an empty set and are linked with
    nothing. Repeated rows (one id, whatever the texts) are returned each; rows of one
    id are one node. A row with a null id is no node: its component is null. Copies are
    one class and are never expanded into pairs. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    known = cut(sets(kept, n), "join-sets")
    mine = known.where("counts IS NULL")
    order = frequencies(known.where("counts IS NOT NULL"))
    usable = mine.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits")), "join-classes")
    cells = cut(memberships(kept, order, percent, n), "join-cells")
    joined = cells.withColumnRenamed("k1", "p1").join(classes, F.col("p1") == F.col("k1")).select("cell", "k1", "class_id", "n_shingles", "bits")
    joined = cut(joined, "join-placed")
    # Only large cells are named, so this table is small and needs no shuffle by cell where Spark can broadcast it.
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") * 8 / block_bytes)).cast("int")
    large = cut(joined.groupBy("cell").agg(blocks.alias("blocks")).where("blocks > 1").select(F.col("cell").alias("of"), "blocks"), "join-large")
    placed = joined.join(large, F.col("cell") == F.col("of"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int")
    placed = placed.select("cell", own.alias("own"), "blocks", "class_id", "n_shingles", "bits")
    # In a cell of one block, one task (0, 0). Else block x meets every block: as the left side from x on, as the right up to x.
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.struct(F.least(F.col("own"), y).alias("i"), F.greatest(F.col("own"), y).alias("j"), F.when(F.col("own") <= y, 0).otherwise(1).alias("side")))
    placed = placed.select("cell", F.explode(others).alias("t"), "class_id", "n_shingles", "bits").select("cell", "t.i", "t.j", "t.side", "class_id", "n_shingles", "bits")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = sieve(placed.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j"), percent)
    grouped = cut(grouped.distinct().groupBy("class_id").agg(F.collect_list("grp").alias("groups")), "join-groups")
    sizes = usable.select("k1", "k2", "doc_id").distinct().groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    sizes = cut(sizes, "join-sizes")
    wanted = grouped.withColumnRenamed("class_id", "w").join(classes, F.col("w") == F.col("class_id")).join(sizes, ["k1", "k2"]).select("class_id", "k1", "k2", "groups", "copies")

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups_at, copies_at = batch.column(4), batch.column(5)
            for k, (doc_id, text, k1, k2) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:4]], strict=True)):
                s = shingles(text, n)
                if set_key(s) == (k1, k2):  # rows of one id with other texts are other classes
                    columns = [pa.array([doc_id]), groups_at.slice(k, 1), pa.array([s.astype("<u8").tobytes()]), pa.array([k1]), pa.array([k2]), copies_at.slice(k, 1)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "groups", "shingles", "k1", "k2", "copies"])

    texts = kept.join(wanted, kept["doc_id"] == wanted["class_id"]).select("doc_id", "text", "k1", "k2", "groups", "copies")
    full = texts.mapInArrow(whole_sets, "doc_id long, groups array<long>, shingles binary, k1 long, k2 long, copies long")
    full = full.select(F.explode("groups").alias("grp"), "doc_id", "shingles", "groups", "k1", "k2", "copies")
    found = cut(search(full.repartition(parts, "grp").sortWithinPartitions("grp", "doc_id"), percent), "join-links")
    # One id with several texts ties their classes.
    several = usable.groupBy("doc_id").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low <> high").select(F.col("doc_id").alias("several"))
    ties = usable.join(several, F.col("doc_id") == F.col("several"), "left_semi").join(classes, ["k1", "k2"]).where("doc_id <> class_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    groups = components(found.where("n IS NULL").select("a", "b").union(ties))
    linked = found.where("n IS NOT NULL").groupBy("k1", "k2").agg(F.sum("n").alias("linked"))
    c = classes.select("k1", "k2", "class_id").join(sizes, ["k1", "k2"]).join(linked, ["k1", "k2"], "left")
    c = c.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "class_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = mine.join(c, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links")
    out = out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), n_links)
    out = out.join(groups, F.col("class_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"), "class_id", "n_links")


def keep_representatives(docs: DataFrame, **params) -> DataFrame:
    """docs with one document of each group: the one whose id names it. Documents without words stay.

    Rows with a null id are no part of any group and stay.
    """
    groups = join_groups(docs, **params).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti").select(*[docs[c] for c in docs.columns])


#: DuckDB.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS ss FROM w),
 c AS (SELECT min(doc_id) AS c, any_value(ss) AS ss, hash(list_sort(ss)) AS h, len(ss) AS n FROM s WHERE len(ss) > 0 GROUP BY hash(list_sort(ss)), len(ss)),
 e AS (SELECT c, n, unnest(ss) AS g FROM c),
 o AS (SELECT a.c AS x, b.c AS y, a.n AS nx, b.n AS ny, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.c < b.c AND 100 * b.n >= 80 * a.n AND 100 * a.n >= 80 * b.n GROUP BY ALL),
 l AS (SELECT x, y FROM o WHERE 100 * k >= 80 * (nx + ny - k) UNION SELECT y, x FROM o WHERE 100 * k >= 80 * (nx + ny - k)),
 r(n, m) AS (SELECT c, c FROM c UNION SELECT l.y, r.m FROM r JOIN l ON r.n = l.x AND r.m < l.y),
 k AS (SELECT n, min(m) AS m FROM r GROUP BY n)
SELECT s.doc_id, len(s.ss)::BIGINT AS n_shingles, coalesce(k.m, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.h = hash(list_sort(s.ss)) AND c.n = len(s.ss) AND len(s.ss) > 0 LEFT JOIN k ON k.n = c.c
"""
