"""Packing by lexical retrieval: windows filled with a seed and its BM25 neighbours.

Documents are tokenized once. Full windows of long documents need no partner and are done
there; only what is left of each document (its tail, shorter than a window) is kept as
ids. The tails are the collection: terms are token ids, so their document frequencies,
counted over all tails, are an array of vocabulary size whatever the corpus.

Tails are dealt to shards by what they are made of. The place of a tail is a simhash of
its tokens (language and style) and then the least hash of its four-token shingles, which
near copies share; shards of about `shard_docs` tails are consecutive places, so many tails
of one place are cut like any others. Each shard has an inverted index of BM25 weights. The
first unused tail is the seed; its unused neighbours, best first, fill its window. The
neighbour that does not fit is cut, and what is left of it seeds the next window. The last
window of a shard is cut into powers of two, which need no padding.

Retrieval: the postings of the seed's `terms` rarest terms nominate `nominated` unused
tails, which are ranked by their whole BM25 scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.llm.common import cut, ship
from unitweave.llm.tokens import encoder, release

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row_id long, shard long"
TOKENS = "row_id long, doc_id long, n long, first_seq long, crcs array<long>, tail binary, place long, df binary"
_NAMES = {schema: [c.split()[0] for c in schema.split(", ")] for schema in (PIECE, TOKENS)}
K1, B = 1.2, 0.75
SHINGLE, STYLE_BITS = 4, 6
#: Sequences of full windows are numbered from here on.
FULL = 1 << 62


def narrowed(tails: list[np.ndarray], flat: np.ndarray) -> list[bytes]:
    """Each tail's ids, two bytes an id where all of them (flat) fit, behind a byte that says so."""
    mark, kind = (b"\x02", "<u2") if flat.max() < 1 << 16 else (b"\x04", "<u4")
    raw, size, at, out = flat.astype(kind).tobytes(), int(kind[2]), 0, []
    for t in tails:
        end = at + size * len(t)
        out.append(mark + raw[at:end])
        at = end
    return out


def widen(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if blob[0] == 2 else "<u4", offset=1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


_HASHES = np.zeros((2, 0), np.uint64)


def _hashes(most: int) -> np.ndarray:
    """Of token ids up to `most`: a hash, and STYLE_BITS of it as 0 or 1 in fields of 10 bits each."""
    global _HASHES
    if _HASHES.shape[1] <= most:
        h = _mix(np.arange(1, max(most, 1 << 16) + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        fields = np.zeros(len(h), np.uint64)
        for k in range(STYLE_BITS):
            fields |= ((h >> np.uint64(20 + k)) & np.uint64(1)) << np.uint64(10 * k)
        _HASHES = np.stack([h, fields])
    return _HASHES


def places(tails: list[np.ndarray]) -> np.ndarray:
    """Of tails of 1 to 1023 tokens: a number whose high bits are a simhash of the tokens, the others the least hash of a shingle.

    Of a longer tail, the simhash is of its first 1023 tokens (windows above 1024 only).
    """
    sizes = np.array([len(t) for t in tails])
    starts = np.cumsum(sizes) - sizes
    ids = np.concatenate(tails)
    hashed, fields = _hashes(int(ids.max()))
    own = fields[ids]
    if sizes.max() > 1023:
        own[np.arange(len(ids)) - np.repeat(starts, sizes) >= 1023] = 0
    counts, short = np.add.reduceat(own, starts), np.minimum(sizes, 1023).astype(np.uint64)
    style = np.zeros(len(tails), np.uint64)
    for k in range(STYLE_BITS):
        ones = counts >> np.uint64(10 * k) & np.uint64(1023)
        style = style << np.uint64(1) | (ones * np.uint64(2) > short).astype(np.uint64)
    h = hashed[ids]
    least = np.full(len(ids), np.uint64(2**64 - 1))
    if len(ids) >= SHINGLE:
        n = len(ids) - SHINGLE + 1
        mixed = h[:n].copy()
        for k in range(1, SHINGLE):
            mixed += h[k : n + k] * np.uint64(2 * k + 1)
        least[:n] = _mix(mixed)
        over = (starts + sizes)[:, None] - np.arange(1, SHINGLE)  # shingles that begin here end beyond the tail
        least[over[over >= starts[:, None]]] = np.uint64(2**64 - 1)
    least = np.minimum.reduceat(least, starts)
    return (style << np.uint64(63 - STYLE_BITS) | least >> np.uint64(STYLE_BITS + 1)).astype(np.int64)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """A row (TOKENS) for each document: tokens of its whole text and the end id, a crc32 for each full window, its tail.

    And for each task one row that has only `df`: in how many tails each token id is.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, at, seq, df = encoder(tokenizer), TaskContext.get().partitionId() << 32, 0, np.zeros(0, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                n, crcs, tails, firsts = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = memoryview(enc.encode(text) + end)
                    full = len(ids) // (4 * window)
                    n.append(len(ids) // 4)
                    crcs.append([zlib.crc32(ids[4 * window * j : 4 * window * (j + 1)]) for j in range(full)])
                    firsts.append(FULL + (at >> 32 << 32) + seq)
                    seq += full
                    tails.append(np.frombuffer(ids, "<u4", offset=4 * window * full) if len(ids) > 4 * window * full else np.zeros(0, "<u4"))
                has = np.array([len(t) > 0 for t in tails])
                place, blobs = np.zeros(len(tails), np.int64), [b"\x02"] * len(tails)
                own = [t for t in tails if len(t)]
                if own:
                    place[has] = places(own)
                    flat = np.concatenate(own)
                    blobs = narrowed(tails, flat)
                    kind, shift = (np.uint32, 24) if flat.max() < 1 << 24 else (np.uint64, 32)
                    seen = np.sort(np.repeat(np.arange(len(own), dtype=kind) << kind(shift), [len(t) for t in own]) | flat.astype(kind, copy=False))
                    seen = seen[np.concatenate([[True], seen[1:] != seen[:-1]])] & kind((1 << shift) - 1)
                    more = np.bincount(seen)
                    if len(more) > len(df):
                        df = np.concatenate([df, np.zeros(len(more) - len(df), np.int64)])
                    df[: len(more)] += more
                rows = len(tails)
                columns = [np.arange(at, at + rows), part.column(0), np.array(n), np.array(firsts), pa.array(crcs, pa.list_(pa.int64())), pa.array(blobs, pa.binary()), place, pa.nulls(rows, pa.binary())]
                at += rows
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], _NAMES[TOKENS])
        blob = zstandard.ZstdCompressor(level=3).compress(df.astype("<i8").tobytes())
        columns = [pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([blob], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, _NAMES[TOKENS])

    kept = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return kept.mapInArrow(run, TOKENS)


def document_frequencies(blobs: DataFrame) -> np.ndarray:
    """Tails with each token id, over all tasks. Merged in executors; each array has no more than the vocabulary."""
    import zstandard

    def add(found: Iterator[bytes]) -> np.ndarray:
        total = np.zeros(1, np.int64)
        for blob in found:
            own = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8")
            if len(own) > len(total):
                total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
            total[: len(own)] += own
        return total

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = add(x for batch in batches for x in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_pydict({"df": [zstandard.ZstdCompressor(level=3).compress(total.astype("<i8").tobytes())]})

    return add(bytes(r.df) for r in blobs.select("df").coalesce(8).mapInArrow(merge, "df binary").collect())


def inverse_frequencies(n_docs: int, df: np.ndarray) -> np.ndarray:
    """BM25's weight of each token id; a term in more than half of all tails is no evidence."""
    return np.maximum(0.0, np.log((n_docs - df + 0.5) / (df + 0.5)))


class ShardIndex:
    """Inverted index of BM25 weights over one shard's tails, and the same by tail."""

    def __init__(self, tails: list[np.ndarray], mean: float, idf: np.ndarray, terms: int = 64, nominated: int = 48):
        self.n, self.most, self.nominated = len(tails), terms, nominated
        lengths = np.array([len(t) for t in tails], np.int64)
        ids = np.concatenate([np.zeros(0, "<u2"), *tails])
        shift = max(1, int(ids.max(initial=0)).bit_length())
        kind = np.uint32 if shift + self.n.bit_length() <= 32 else np.uint64
        keys = np.sort(np.repeat(np.arange(self.n).astype(kind), lengths) << kind(shift) | ids.astype(kind))
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        tf, keys = np.diff(np.concatenate([at, [len(keys)]])), keys[at]
        owner, term = (keys >> kind(shift)).astype(np.int64), (keys & kind((1 << shift) - 1)).astype(np.int64)
        keep = idf[term] > 0
        owner, term, tf = owner[keep], term[keep], tf[keep]
        self.term, self.weight = term, idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / mean))
        self.bounds = np.searchsorted(owner, np.arange(self.n + 1))
        by_term = np.argsort(term.astype(np.uint16) if shift <= 16 else term, kind="stable")  # small numbers are sorted by radix
        self.p_term, self.p_owner, self.p_weight = term[by_term], owner[by_term], self.weight[by_term]
        self.asked = np.zeros(1 << shift)
        self._count()

    def _count(self) -> None:
        self.sizes = np.bincount(self.p_term, minlength=len(self.asked))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def forget(self, used: np.ndarray) -> None:
        """Takes the postings of used tails out of the inverted lists."""
        keep = ~used[self.p_owner]
        self.p_term, self.p_owner, self.p_weight = self.p_term[keep], self.p_owner[keep], self.p_weight[keep]
        self._count()

    def neighbours(self, k: int, used: np.ndarray) -> Iterator[int]:
        """The unused tails, nominated ones first by falling BM25 score to tail k; ties in order."""
        mine = self.term[self.bounds[k] : self.bounds[k + 1]]
        listed = mine[np.argpartition(self.sizes[mine], self.most)[: self.most]] if len(mine) > self.most else mine
        spans = list(zip(self.starts[listed].tolist(), (self.starts[listed] + self.sizes[listed]).tolist(), strict=True))
        if spans:
            partial = np.bincount(np.concatenate([self.p_owner[a:b] for a, b in spans]), np.concatenate([self.p_weight[a:b] for a, b in spans]), minlength=self.n)
        else:
            partial = np.zeros(self.n)
        partial[used] = -1.0
        first = self._largest(partial, used)
        yield from first[np.argsort(-self.scores(mine, first), kind="stable")].tolist()
        partial[first] = -1.0
        rest = np.flatnonzero(partial >= 0)
        yield from rest[np.argsort(-partial[rest], kind="stable")].tolist()

    def _largest(self, partial: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Unused tails with the `nominated` largest values, in order of their numbers; all where there are no more."""
        most = float(partial.max())
        for part in (0.5, 0.25, 0.125):  # most values are small: above one of these limits there are usually enough, and few
            above = np.flatnonzero(partial >= part * most) if most > 0 else []
            if len(above) >= self.nominated:
                break
        else:
            above = np.flatnonzero(~used)
        if len(above) <= self.nominated:
            return above
        own = partial[above]
        return np.sort(above[np.argpartition(own, len(own) - self.nominated)[len(own) - self.nominated :]])

    def scores(self, terms: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """BM25 of tails for a query of terms."""
        sizes = self.bounds[tails + 1] - self.bounds[tails]
        at = _ranges(self.bounds[tails], sizes)
        self.asked[terms] = 1.0
        found = self.asked.take(self.term.take(at))
        self.asked[terms] = 0.0
        found *= self.weight.take(at)
        out, full = np.zeros(len(tails)), np.flatnonzero(sizes)
        if len(full):
            out[full] = np.add.reduceat(found, (np.cumsum(sizes) - sizes)[full])
        return out.round(9)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0] + sizes[0] - 1, starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def pack_shard(sizes: list[int], window: int, index: ShardIndex) -> Iterator[tuple[list[tuple], int]]:
    """Windows over one shard's tails: ([(tail number, from, to)], tokens in it)."""
    used, order, alive, listed = np.zeros(len(sizes), bool), 0, len(sizes), len(sizes)
    seed, at, row, room = -1, 0, [], window
    while True:
        if seed < 0:
            while order < len(sizes) and used[order]:
                order += 1
            if order == len(sizes):
                break
            seed, at = order, 0
            used[seed] = True
            alive -= 1
        if alive < 0.8 * listed:
            index.forget(used)
            listed = alive
        ranked, piece, seed = index.neighbours(seed, used), seed, -1
        while piece is not None:
            if not used[piece]:
                used[piece] = True
                alive -= 1
            take = min(room, sizes[piece] - at)
            row.append((piece, at, at + take))
            room, at = room - take, at + take
            if room == 0:
                yield row, window
                row, room = [], window
                seed, at = (piece, at) if at < sizes[piece] else (-1, 0)
                break
            at, piece = 0, next(ranked, None)
    if row:
        yield row, window - room


def powers_of_two(row: list[tuple], size: int) -> Iterator[list[tuple]]:
    """Cuts a window of `size` tokens into windows whose sizes are powers of two, largest first."""
    for bit in range(size.bit_length() - 1, -1, -1):
        if size >> bit & 1:
            room, part = 1 << bit, []
            while room:
                piece, a, b = row[0]
                take = min(room, b - a)
                part.append((piece, a, a + take))
                room -= take
                row = [(piece, a + take, b), *row[1:]] if a + take < b else row[1:]
            yield part


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024, shard_docs: int = 10_000, terms: int = 64, nominated: int = 48) -> DataFrame:
    """Packs docs (doc_id, text) into sequences of at most `window` tokens (a power of two); a row for each piece.

    doc_id, start (the document's tokens before the piece), length, ids_crc32,
    doc_tokens, sequence_id, offset, row_id (a number for each row of docs, so that rows
    that repeat an id can be told apart) and shard (null for full windows of one
    document). A null text is an empty one: its end id alone. Rows that repeat an id are
    packed like others; null ids stay null. Texts of any length are cut into windows. An
    empty table gives an empty result. Other columns are ignored. `shard_docs` bounds
    the memory of a task and is how far a seed looks; a larger one looks farther.
    """
    spark = docs.sparkSession
    ship(spark)
    known = cut(tokenize(docs, tokenizer, end_id, window), "pack-tokens")
    rows = known.where("row_id IS NOT NULL")
    tails = rows.where(F.col("n") % window > 0)
    n_docs, mean = tails.agg(F.count("*"), F.avg(F.col("n") % window)).first()
    df = document_frequencies(known.where("df IS NOT NULL"))
    shared = spark.sparkContext.broadcast((mean or 1.0, inverse_frequencies(n_docs, df)))  # bounded by the vocabulary
    most = shard_docs + shard_docs // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # memory that this stage has better use for
        base, seq, held = TaskContext.get().partitionId() << 32, 0, []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            ids = [widen(h[3]) for h in held]
            index, sizes, made, shard = ShardIndex(ids, *shared.value, terms, nominated), list(map(len, ids)), [], base + seq
            for row, size in pack_shard(sizes, window, index):
                for part in [row] if size == window else powers_of_two(row, size):
                    offset = 0
                    for p, a, b in part:
                        row_id, doc_id, n, _ = held[p]
                        made.append((doc_id, n - sizes[p] + a, b - a, zlib.crc32(ids[p][a:b].astype("<u4").tobytes()), n, base + seq, offset, row_id, shard))
                        offset += b - a
                    seq += 1
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], _NAMES[PIECE])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(row)
                if len(held) == most:
                    yield from close()
        if held:
            yield from close()

    parts = max(1, math.ceil(n_docs / shard_docs))
    dealt = tails.select("row_id", "doc_id", "n", "tail", "place").repartitionByRange(parts, "place", "row_id").sortWithinPartitions("place", "row_id")
    packed = dealt.select("row_id", "doc_id", "n", "tail").mapInArrow(run, PIECE)
    full = rows.where(F.col("n") >= window).select("doc_id", "n", "first_seq", "row_id", F.posexplode("crcs").alias("k", "crc"))
    long = lambda c: c.cast("long")
    full = full.select("doc_id", long(F.col("k") * window).alias("start"), long(F.lit(window)).alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("first_seq") + F.col("k")).alias("sequence_id"), long(F.lit(0)).alias("offset"), "row_id", long(F.lit(None)).alias("shard"))
    return full.union(packed)
