"""A quality classifier from positives and unlabelled text (non-negative PU risk).

Trusted positives are labelled rows; the other set is plain web text, all documents, with no
label read. With the class prior pi, the risk of a score g is

    pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])

(logistic l) and a small square penalty, minimised for a linear model: features are
computed once and kept in a cut table, and each step adds up loss and gradient over
all rows in the executors; the driver gets sums of the model's size and takes a
quasi-Newton step. So all positives and all text count, at any size.

The prior is estimated from positives and text alone (best bin estimation): a first model
tells positives from text on one half of the rows; on the other half, the share of text
above a score, divided by the share of positives above it, bounds the prior from above,
and is taken at the score at which the bound with its sampling error is lowest.

Features say how a text is written, not what it is about: shapes of words, short
words, letters, lines and their repeats.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from unitweave.llm.common import WORD, crc_mod, cut, ship

WORDS = re.compile(WORD)
N_HASHED, N_DENSE = 1024, 18
SIZE = N_HASHED + N_DENSE
BINS, BIN_WIDTH, LOWEST = 2048, 1 / 64, -16.0
#: How round the corner of max(0, risk of the negatives) is.
SOFT = 0.01
_RUN = re.compile(r"(.)\1+", re.S)
_CLASSES = str.maketrans({**{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}})


class _Kept(dict):
    """Word -> its three buckets, two bytes each: its shape (runs of one class as one), its last three characters, itself if short (else N_HASHED)."""

    def __missing__(self, word: str) -> bytes:
        shape = word.translate(_CLASSES)
        if not word.isascii():
            shape = "".join(["x" if c.islower() else "X" if c.isupper() else "x" if c.isalpha() else c for c in shape])
        bucket = lambda name: zlib.crc32(name.encode("utf-8", "surrogatepass")) % N_HASHED
        out = struct.pack("<HHH", bucket("s" + _RUN.sub(r"\1+", shape)), bucket("e" + word[-3:]), bucket("w" + word) if len(word) <= 4 else N_HASHED)
        if len(word) <= 100:
            self[word] = out
        return out


_KEPT, MAX_KEPT = _Kept(), 600_000


def features(text: str | None) -> np.ndarray:
    """Of a whole text: shares of hashed word features, then measures between about 0 and 2."""
    text = text or ""
    x = np.zeros(SIZE, np.float32)
    words = WORDS.findall(text)
    n, chars = len(words), max(1, len(text))
    counts = Counter(words)
    longest = repeated = 0
    if n:
        if len(_KEPT) > MAX_KEPT:
            _KEPT.clear()
        times = np.fromiter(counts.values(), np.float64, len(counts))
        at = np.frombuffer(b"".join(map(_KEPT.__getitem__, counts)), "<u2")
        x[:N_HASHED] = np.sqrt(np.bincount(at, np.repeat(times, 3), N_HASHED + 1)[:N_HASHED] / n)
        longest = max(map(len, counts))
    if n > 2:
        number = {w: k for k, w in enumerate(counts)}
        ids = np.fromiter(map(number.__getitem__, words), np.uint64, n)
        m = np.uint64(len(counts))
        triples = np.unique((ids[:-2] * m + ids[1:-1]) * m + ids[2:], return_counts=True)[1]
        repeated = int(triples[triples > 1].sum())
    lines = [s for s in text.split("\n") if s and not s.isspace()]
    kinds = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    upper, lower, digit = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum()
    symbols = kinds[[35, 42, 36, 37, 38, 124, 60, 62, 61, 123, 125, 95, 126, 94, 64]].sum()
    x[N_HASHED:] = [
        np.log1p(n) / 8, n == 0, len(counts) / max(1, n), (len(text) / max(1, n)) / 10,
        upper / chars, lower / chars, digit / chars * 4, symbols / chars * 4,
        kinds[33] / max(1, n), kinds[46] / max(1, n), kinds[44] / max(1, n), kinds[63] / max(1, n),
        np.log1p(len(lines)) / 5, 1 - len(set(lines)) / max(1, len(lines)),
        max(counts.values(), default=0) / max(1, n), repeated / max(1, n),
        longest / 50, (kinds[128:].sum()) / chars,
    ]
    return np.clip(x, 0, 4)


def featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """d (a struct of the columns to keep), doc_id, at, x: each text's features that aren't zero, as binary columns. A cut table."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                at, x = [], []
                for text in part.column(2):
                    f = features(text.as_py())
                    own = np.flatnonzero(f)
                    at.append(own.astype("<u2").tobytes())
                    x.append(f[own].astype("<f2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at, pa.binary()), pa.array(x, pa.binary())], ["d", "doc_id", "at", "x"])

    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("d"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    schema = StructType([rows.schema["d"], StructField("doc_id", LongType()), StructField("at", BinaryType()), StructField("x", BinaryType())])
    return cut(rows.mapInArrow(run, schema), "pu-features")


class Rows:
    """The features of a batch: all indices and values one after the other, and where each row begins."""

    def __init__(self, at: pa.Array, x: pa.Array):
        self.n = len(at)
        self.sizes = np.diff(_offsets(at)) // 2
        self.at, self.x = _flat(at, "<u2").astype(np.int64), _flat(x, "<f2").astype(np.float64)
        self.full = np.flatnonzero(self.sizes)
        self.starts = (np.cumsum(self.sizes) - self.sizes)[self.full]

    def scores(self, w: np.ndarray) -> np.ndarray:
        """w has a weight for each feature, and a constant."""
        g = np.full(self.n, w[SIZE])
        if len(self.full):
            g[self.full] += np.add.reduceat(w.take(self.at) * self.x, self.starts)
        return g

    def sums(self, of: np.ndarray) -> np.ndarray:
        """Sum of the rows' features, and of one, each row times a number."""
        return np.concatenate([np.bincount(self.at, self.x * np.repeat(of, self.sizes), SIZE), [of.sum()]])


def _offsets(a: pa.Array) -> np.ndarray:
    return np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)


def _flat(a: pa.Array, kind: str) -> np.ndarray:
    ends = _offsets(a)
    return np.frombuffer(a.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind) if ends[-1] > ends[0] else np.zeros(0, kind)


def _total(rows: DataFrame, tasks: int, size: int, of: Callable[[Rows, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of of(features, role, half), an array of `size` numbers, over all batches of rows (role, half, at, x), which `tasks` tasks read.

    Merged in about as many tasks as the square root of their number before it reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _KEPT.clear()  # of the stage before, in this worker process
        total = np.zeros(size)
        for batch in batches:
            role, half = (batch.column(c).to_numpy() for c in (0, 1))
            total += of(Rows(batch.column(2), batch.column(3)), role, half)
        yield pa.RecordBatch.from_pydict({"total": [total.astype("<f8").tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total += np.frombuffer(blob, "<f8")
        yield pa.RecordBatch.from_pydict({"total": [total.astype("<f8").tobytes()]})

    parts = rows.mapInArrow(run, "total binary")
    if tasks > 64:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(merge, "total binary")
    return np.sum([np.frombuffer(bytes(r.total), "<f8") for r in parts.collect()] or [np.zeros(size)], axis=0)


def _softplus(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, g)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, curvature: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Quasi-Newton steps (limited memory) from w with a diagonal first guess; each call of f is a pass over the data."""
    value, grad = f(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, kept = grad.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        q /= curvature
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ (y / curvature))
        for (s, y), a in zip(past, reversed(kept), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        slope, step = -(grad @ q), 1.0
        if slope >= 0:
            past.clear()
            q = grad / curvature
            slope = -(grad @ q)
        for _ in range(6):
            new = w - step * q
            found, g = f(new)
            if found <= value + 1e-4 * step * slope:
                break
            step /= 3
        else:
            return w
        s, y = new - w, g - grad
        if s @ y > 1e-12 * (y @ y):
            past = [*past, (s, y)][-memory:]
        small = value - found < 1e-5 * abs(value)
        w, value, grad = new, found, g
        if small:
            break
    return w


def prior_of(positive: np.ndarray, text: np.ndarray, share: float = 0.1) -> float:
    """Best bin estimation from histograms of scores: of positives and of text."""
    n_p, n_u = positive.sum(), text.sum()
    if not n_p or not n_u:
        return 0.5
    above_p, above_u = np.cumsum(positive[::-1]) / n_p, np.cumsum(text[::-1]) / n_u
    error = sum(math.sqrt(math.log(4 / share) / (2 * n)) for n in (n_p, n_u))
    some = above_p > 0
    bound = (above_u[some] + 1.01 * error) / above_p[some]
    best = int(np.argmin(bound))
    return float(min(0.98, max(0.02, above_u[some][best] / above_p[some][best])))


def train(known: DataFrame, labels: DataFrame, decay: float = 1e-4, steps: int = 30) -> np.ndarray:
    """Weights and a constant from featured rows and labels (doc_id, quality).

    Positives are the rows whose id has a label 1 outside the held-out fold; all rows are
    the unlabelled text. Without a positive or a text, the model is constant at 1/2.
    """
    fold = labels.select(labels["doc_id"].cast("long").alias("p_id"), labels["quality"].cast("int").alias("quality"))
    fold = fold.where(F.col("p_id").isNotNull() & (F.col("quality") == 1) & (crc_mod(F.col("p_id"), 3) != 1)).select("p_id").distinct()
    positive = cut(known.join(fold, known["doc_id"] == fold["p_id"], "left_semi").select("doc_id", "at", "x"), "pu-positive")
    half = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(2)).cast("int").alias("half")
    of = lambda df, role: df.select(F.lit(role).alias("role"), half, "at", "x")
    rows = of(known, 0).unionByName(of(positive, 1))
    tasks = rows.rdd.getNumPartitions()

    def moments(r: Rows, role: np.ndarray, half: np.ndarray) -> np.ndarray:
        squares = np.bincount(r.at, r.x**2 * np.repeat(role == 0, r.sizes), SIZE)
        sums = [r.sums(((role == 1) & (half <= h)).astype(float)) for h in (0, 1)]
        return np.concatenate([squares, *sums, [((role == a) & (half <= h)).sum() for a, h in ((0, 0), (0, 1), (1, 0), (1, 1))]])

    m = _total(rows, tasks, SIZE + 2 * (SIZE + 1) + 4, moments)
    squares, sums, counts = m[:SIZE], (m[SIZE : 2 * SIZE + 1], m[2 * SIZE + 1 : 3 * SIZE + 2]), m[-4:]
    if not counts[2] or not counts[0]:  # too few for two halves
        return np.zeros(SIZE + 1)
    curvature = np.concatenate([squares / counts[1] / 4 + decay + 1e-3, [0.25]])
    penalty = np.concatenate([np.full(SIZE, decay), [0.0]])

    def risk(prior: float | None, last: int) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
        """Of halves up to `last`: the non-negative PU risk; without a prior, of telling positives from text."""
        n_u, n_p = counts[last], counts[2 + last]

        def f(w: np.ndarray) -> tuple[float, np.ndarray]:
            def losses(r: Rows, role: np.ndarray, half: np.ndarray) -> np.ndarray:
                g = r.scores(w)
                s, loss, p, u = _sigmoid(g), _softplus(g), (role == 1) & (half <= last), (role == 0) & (half <= last)
                return np.concatenate([r.sums(s * p), r.sums(s * u), [loss[p].sum(), (loss - g)[p].sum(), loss[u].sum()]])

            t = _total(rows, tasks, 2 * (SIZE + 1) + 3, losses)
            as_one, as_zero, text = t[-2] / n_p, t[-3] / n_p, t[-1] / n_u  # l(g) and l(-g) of positives, l(-g) of text
            up, up_text = t[: SIZE + 1] / n_p, t[SIZE + 1 : 2 * SIZE + 2] / n_u
            down = up - sums[last] / n_p  # gradient of l(g)
            extra, pull = 0.5 * float(penalty @ w**2), penalty * w
            if prior is None:
                return as_one + text + extra, down + up_text + pull
            negative = text - prior * as_zero
            root = math.hypot(negative, SOFT)  # max(0, x) as (x + root) / 2, which has no kink
            return prior * as_one + (negative + root) / 2 + extra, prior * down + (1 + negative / root) / 2 * (up_text - prior * up) + pull

        return f

    w = minimise(risk(None, 0), np.zeros(SIZE + 1), curvature, steps // 3)

    def bins(r: Rows, role: np.ndarray, half: np.ndarray) -> np.ndarray:
        at = np.clip((r.scores(w) - LOWEST) / BIN_WIDTH, 0, BINS - 1).astype(np.int64)
        return np.concatenate([np.bincount(at[(role == a) & (half == 1)], minlength=BINS) for a in (1, 0)])

    found = _total(rows, tasks, 2 * BINS, bins)
    prior = prior_of(found[:BINS], found[BINS:])
    return minimise(risk(prior, 1), w, curvature, steps)


def score(known: DataFrame, model: np.ndarray) -> DataFrame:
    """d, doc_id and `score` (the probability of quality 1) of featured rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = Rows(batch.column(2), batch.column(3)).scores(model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_sigmoid(g))], ["d", "doc_id", "score"])

    schema = StructType([known.schema["d"], StructField("doc_id", LongType()), StructField("score", DoubleType())])
    return known.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    A null or empty text is scored as a text without words; texts are read whole. A null id
    counts as an empty text in the fold rule and is never a positive. Repeated rows
    count as often as they are there and are scored alike. Labels without a document,
    or with nulls, are left out; an id with labels 0 and 1 counts as a positive. Other
    columns are ignored. Without a usable positive every score is 1/2; an empty table
    gives an empty result.
    """
    known = featured(docs, ["doc_id"])
    scored = score(known, train(known, labels, **params))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of docs that classify() predicts to be of quality 1, with all their columns."""
    known = featured(docs, docs.columns)
    return score(known, train(known, labels, **params)).where("score >= 0.5").select(*[F.col("d").getField(c).alias(c) for c in docs.columns])
