"""A language model as a weighted backoff automaton, learnt and applied without a table of all words in one place.

Learning: documents are tokenized once, into parts of about a million tokens that are kept
in a cut table. Every n-gram, from words up to the highest order, has a key made of the
hashes of its words. Each part sends its different keys with their counts, sorted, to
buckets of keys; a bucket adds up the counts over all training documents and answers each
part in the order of its keys. So every n-gram of the training documents is counted,
however rare, and none is broadcast or sent to the driver. What the driver gets are
histograms of the counts.

Smoothing: a word has (c - d) / N, and d * V / N is left for unknown ones, with the
absolute discount d = n1 / (n1 + 2 n2). In a context h that occurs c(h) times, a word has
(c(h, w) + m p(w in the shorter context)) / (c(h) + m): a Dirichlet prior, whose strength m
is estimated for each order so that the chance of a new follower, m / (c(h) + m), comes to
the share of n-grams that occur once (Good and Turing).

Automaton: a state is an n-gram that training has seen, an arc (h, w) has the weight
above, and the failure arc of h leads to the state without its first word, with the weight
m / (c(h) + m). Scoring runs over the words once, left to right; the state is the longest
known end of what has been read, so it depends on the last words alone, and a part's words
are taken together: from state 0 on, each order adds the arc or the failure arc of every
word. Automaton is the same model as explicit states and arcs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitweave.llm.common import WORD, crc_mod, cut, ship

WORDS = re.compile(WORD)
END = ""  # no word is empty: the key of the end token
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(text: str | None) -> list[str]:
    """Words, A-Z in lower case; without the end token."""
    if not text:
        return []
    # On bytes, lower() changes A-Z alone; UTF-8 has no such byte inside another character.
    return WORDS.findall(text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


class Automaton:
    """States over ids of words. State 0 is the empty context."""

    def __init__(self, logs: list[float], counts: dict[tuple[int, ...], int], totals: dict[tuple[int, ...], int], prior: dict[int, float]):
        """logs: log10 probability of each word alone; counts: of n-grams from two words on; totals: of their contexts; prior: strength by order."""
        self.logs, self.prior, self.state = logs, prior, {(): 0}
        for gram in sorted({*totals, *counts, *((w,) for w in range(len(logs)))}, key=lambda g: (len(g), g)):
            self.state.setdefault(gram, len(self.state))
        n = len(self.state)
        self.fail, self.weight, self.arcs = [0] * n, [0.0] * n, {}
        for h, s in self.state.items():
            if h:
                self.fail[s] = self.state[h[1:]] if h[1:] in self.state else self.longest(h[1:])
                m = prior.get(len(h) + 1)
                self.weight[s] = math.log10(m / (totals[h] + m)) if m and totals.get(h) else 0.0
        for gram, c in sorted(counts.items(), key=lambda x: len(x[0])):
            h, w, m = gram[:-1], gram[-1], prior[len(gram)]
            s = self.state[h]
            p = (c + m * 10 ** self.log(self.fail[s], w)) / (totals[h] + m)
            self.arcs[s, w] = (self.longest(gram if len(gram) < max(prior) else gram[1:]), math.log10(p))

    def longest(self, gram: tuple[int, ...]) -> int:
        while gram not in self.state:
            gram = gram[1:]
        return self.state[gram]

    def log(self, s: int, w: int) -> float:
        """log10 probability of a known word after state s."""
        found = 0.0
        while s:
            arc = self.arcs.get((s, w))
            if arc:
                return found + arc[1]
            found += self.weight[s]
            s = self.fail[s]
        return found + self.logs[w]

    def score(self, words: list[tuple[int, float]], start: int = 0) -> float:
        """log10 probability of (id of a word or -1, its log10 probability alone), ..., in one traversal."""
        s, total = start, 0.0
        for w, alone in words:
            while s:
                arc = self.arcs.get((s, w))
                if arc:
                    s, p = arc
                    total += p
                    break
                total += self.weight[s]
                s = self.fail[s]
            else:
                total += alone
                s = self.state[(w,)] if w >= 0 else 0
        return total


def _mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The key of an n-gram from that of its first n - 1 words and its last word's."""
    x = h * np.uint64(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def planes(a: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed, behind their number; planes that are zero at the top are left out."""
    import zstandard

    a = np.ascontiguousarray(a).astype("<u8", copy=False)
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T))


def numbers(blob: bytes) -> np.ndarray:
    import zstandard

    own = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(blob)[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((own.shape[1], 8), np.uint8)
    out[:, : blob[0]] = own.T
    return out.view("<u8").ravel()


PART = "part long, kind int, n int, bucket long, m long, a binary, b binary, c binary, d binary, e binary"
SENT = "bucket long, n int, part long, keys binary, counts binary"
_NAMES = {schema: [c.split()[0] for c in schema.split(", ")] for schema in (PART, SENT, RESULT)}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(columns, schema.split(", "), strict=True)], _NAMES[schema])


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow each other with the same first `width` columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:width] != key:
                if held:
                    yield key, held
                key, held = row[:width], []
            held.append(row)
    if held:
        yield key, held


def _parts(docs: DataFrame, block_rows: int) -> DataFrame:
    """(part, n, a, b, c, d, e): n tokens; word numbers, the words' hashes, and of each document tokens, id, flags (1 training, 2 null id).

    Each document has an end token at its beginning and at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        ids: dict[str, int] = defaultdict()
        ids.default_factory = ids.__len__
        flat, sizes, names, flags = [], [], [], []

        def out() -> pa.RecordBatch:
            hashes = np.array([int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in ids], np.uint64)
            row = (base | seq, 0, len(flat), 0, None, planes(np.array(flat, np.uint64)), planes(hashes), planes(np.array(sizes, np.uint64)), planes(np.array(names, np.int64).view(np.uint64)), bytes(flags))
            return _batch(PART, [row])

        for batch in batches:
            for doc_id, train, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = [END, *tokens(text), END]
                flat += map(ids.__getitem__, own)
                sizes.append(len(own))
                names.append(0 if doc_id is None else doc_id)
                flags.append(train + (2 if doc_id is None else 0))
                if len(sizes) >= block_rows or len(flat) >= 1 << 20:
                    yield out()
                    seq += 1
                    ids.clear()
                    flat, sizes, names, flags = [], [], [], []
        if sizes:
            yield out()

    return docs.mapInArrow(run, PART)


class Part:
    """The n-grams of a part: of each order its different keys in order (uniq), and each position's place in them (at)."""

    def __init__(self, row: tuple, order: int, bits: int):
        """bits: of the keys of n-grams of two words and more. Words have 64."""
        self.number, flat, hashes, sizes = row[0], numbers(row[5]).astype(np.int64), numbers(row[6]), numbers(row[7]).astype(np.int64)
        self.ids, self.flags = numbers(row[8]).view(np.int64), np.frombuffer(row[9], np.uint8)
        self.sizes, self.first = sizes, np.cumsum(sizes) - sizes
        self.depth = np.arange(len(flat)) - np.repeat(self.first, sizes)
        self.train = np.repeat(self.flags & 1, sizes).astype(bool)
        by_hash, back = np.unique(hashes, return_inverse=True)
        self.uniq, self.at = {1: by_hash}, {1: back[flat]}
        words = hashes[flat]
        keys = words
        for k in range(2, order + 1):
            keys = np.concatenate([keys[:1], _mix(keys[:-1], words[1:])])
            here = self.here(k)
            self.uniq[k], found = np.unique(keys[here] >> np.uint64(64 - bits), return_inverse=True)
            self.at[k] = np.full(len(flat), -1)
            self.at[k][here] = found

    def here(self, k: int) -> np.ndarray:
        """Positions at which an n-gram of order k ends; the first end token of a document is only a context."""
        return np.flatnonzero(self.depth >= max(1, k - 1))

    def counts(self, k: int) -> np.ndarray:
        here = self.here(k)
        return np.bincount(self.at[k][here[self.train[here]]], minlength=len(self.uniq[k]))


def _send(part: int, k: int, bits: int, buckets: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Rows of SENT: the keys (sorted, of `bits` bits) by bucket, as differences."""
    bucket = (((keys << np.uint64(64 - bits)) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    out = []
    for a, z in zip(starts, [*starts[1:], len(keys)], strict=True):
        own = keys[a:z]
        out.append((int(bucket[a]), k, part, planes(np.concatenate([own[:1], own[1:] - own[:-1]])), planes(counts[a:z])))
    return out


def _bins(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A histogram of counts above zero: the lowest value of each bin and how many are in it. Exact up to 64, then 6 leading bits."""
    counts = counts[counts > 0].astype(np.uint64)
    shift = np.maximum(0, np.frexp(counts.astype(np.float64))[1] - 6).astype(np.uint64)
    low, n = np.unique(np.where(counts < 64, counts, counts >> shift << shift), return_counts=True)
    return low.astype(np.int64), n


def strength(contexts: dict[int, int], once: int) -> float:
    """m such that the sum of c m / (c + m) over contexts {c: how many} is `once`; between 1/100 and 1000."""
    low, high = 0.01, 1000.0
    c, n = np.array(list(contexts), np.float64), np.array(list(contexts.values()), np.float64)
    for _ in range(60):
        m = (low * high) ** 0.5
        low, high = (m, high) if float((n * c * m / (c + m)).sum()) < once else (low, m)
    return low


def score_corpus(docs: DataFrame, order: int = 3, block_rows: int = 4096, folds: int = 7, held: int = 2) -> DataFrame:
    """Per document: RESULT. Learns from documents whose crc32(doc_id as text) mod folds is not `held`.

    Scores are log10 probabilities of the words and one end token. A null text is an
    empty one: its end token alone. A null id counts as an empty text in the fold rule.
    Repeated rows are learnt as often as they are there, and scored each. Without any
    training document every token is unknown and has probability 1. Texts are read
    whole; other columns are ignored; an empty table gives an empty result.

    Keys of n-grams have 20 bits more than their number needs, so about one n-gram in a
    million shares its count with another; keys of words have 64 bits.
    """
    spark = docs.sparkSession
    ship(spark)
    train = (crc_mod(F.col("doc_id"), folds) != held).cast("int").alias("train")
    rows = cut(_parts(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).select("doc_id", train, "text"), block_rows), "lm-parts")
    size, tasks = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.shiftright("part", 32)), F.lit(0)) + 1).first()
    of_bucket, of_part = F.col("bucket"), F.shiftright("part", 32) + F.col("part").bitwiseAND(0xFFFFFFFF) * tasks  # dealt evenly
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(order * size / 2**23))
    bits = min(64, max(1, order * size).bit_length() + 20)
    width = lambda k: 64 if k == 1 else bits

    def send_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, [row] in _runs(batches, 1):
            part = Part(row, order, bits)
            for k in part.uniq:
                if len(part.uniq[k]):  # texts without words have no higher orders
                    yield _batch(SENT, _send(part.number, k, width(k), buckets, part.uniq[k], part.counts(k)))

    def add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, k), own in _runs(batches, 2):
            keys = [np.cumsum(numbers(r[3]), dtype=np.uint64) for r in own]
            different, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, np.concatenate([numbers(r[4]) for r in own]), minlength=len(different)).astype(np.int64)
            answer, bounds = total[at], np.cumsum([0, *map(len, keys)]).tolist()
            out = [(r[2], 1, k, bucket, None, planes(answer[a:z]), b"", b"", b"", b"") for r, a, z in zip(own, bounds, bounds[1:], strict=False)]
            out += [(-1, 9, k, low, n, b"", b"", b"", b"", b"") for low, n in zip(*map(np.ndarray.tolist, _bins(total)), strict=True)]
            if k == 1:
                out.append((-1, 9, 0, 0, int(total.sum()), b"", b"", b"", b"", b""))
            yield _batch(PART, out)

    answers = cut(_arranged(rows.mapInArrow(send_counts, SENT), buckets, of_bucket, "bucket", "n", "part").mapInArrow(add_counts, PART), "lm-counts")
    counts: dict[int, dict[int, int]] = defaultdict(dict)  # order -> value (a few hundred bins) -> n-grams
    for r in answers.where("kind = 9").groupBy("n", "bucket").agg(F.sum("m").alias("m")).collect():
        counts[r.n][r.bucket] = r.m
    n, v, n1, n2 = counts[0].get(0, 0), sum(counts[1].values()), counts[1].get(1, 0), counts[1].get(2, 0)
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    unknown, base_unit = d * v / n if v else 1.0, math.log10(n + v + 1)
    prior = {k: strength(counts[k - 1], counts[k].get(1, 0)) for k in range(2, order + 1)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _runs(batches, 1):
            part = Part(own[0], order, bits)
            total = {k: np.concatenate([numbers(r[5]) for r in own if r[1] == 1 and r[2] == k] or [np.zeros(0, np.uint64)]).astype(np.float64) for k in part.uniq}
            scored = part.depth > 0
            c = total[1][part.at[1]]
            p = np.where(c > 0, np.maximum(c - d, 1e-300) / max(1, n), unknown)
            known, base = (c > 0) & scored, np.where(scored, np.log10(c + 1) - base_unit, 0.0)
            for k in range(2, order + 1):
                here = part.here(k)
                h, c = total[k - 1][part.at[k - 1][here - 1]], total[k][part.at[k][here]]
                p[here] = (c + prior[k] * p[here]) / (np.maximum(h, c) + prior[k])
            logs = np.where(scored, np.log10(p), 0.0)
            base, logs, known = (np.add.reduceat(x, part.first, dtype=t) for x, t in ((base, np.float64), (logs, np.float64), (known, np.int64)))
            ids = pa.array(part.ids, mask=part.flags & 2 > 0)
            columns = [ids, part.flags & 1 == 0, part.sizes - 1, known, np.full(len(base), n, np.int64), base, logs]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], _NAMES[RESULT])

    return _arranged(rows.union(answers.where("kind = 1")), buckets, of_part, "part", "kind", "n", "bucket").mapInArrow(score, RESULT)


def _arranged(sent: DataFrame, parts: int, place: Column, *by: str) -> DataFrame:
    """Rows dealt to partition `place` modulo parts, and sorted there."""
    return sent.repartitionById(parts, F.pmod(place, F.lit(parts)).cast("int")).sortWithinPartitions(*by)
