"""Structure of texts: units, segments, parts, reading, searching.

All operators take contexts (ctx_id, text) and work on any number of them at once. What
needs a text's layout is one Arrow stage without a shuffle; the rest are column
expressions.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from unitweave.functions import text as layout
from unitweave.operators.intervals import holding

MIN_CHARS, TARGET_CHARS, MAX_CHARS = 400, 4_000, 12_000
MAX_HITS, BEFORE, AFTER = 40, 80, 160


def contexts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(df[id_col].alias("ctx_id"), df[text_col].cast("string").alias("text"))


def _each(ctx: DataFrame, columns: str, make: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """Rows of make(text) behind their ctx_id, for every text that isn't null. Texts reach Python once, in batches."""
    kept = ctx.select("ctx_id", "text")
    own = StructType.fromDDL(columns)
    schema = StructType([kept.schema["ctx_id"], *own.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in own.fields]
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                at, rows = [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    if text is not None:
                        made = list(make(text))
                        rows += made
                        at += [k] * len(made)
                if rows:
                    values = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *values], schema.names)

    return kept.mapInArrow(run, schema)


def _check_band(low: int, target: int, high: int) -> None:
    if not 0 < low <= target <= high:
        raise ValueError(f"a band needs 0 < min <= target <= max, not {low}, {target}, {high}")


def _spans(text: str, low: int, target: int, high: int) -> tuple[str, list[int], list[tuple[int, int, int]]]:
    kind = layout.structure(text)
    ends = layout.unit_ends(text, kind)
    return kind, ends, layout.segment_spans(ends, low, target, high)


def kinds(ctx: DataFrame) -> DataFrame:
    """ctx_id, structure. Null texts have no row."""
    return _each(ctx, "structure string", lambda t: [(layout.structure(t),)])


def units(ctx: DataFrame, source: bool = True) -> DataFrame:
    """ctx_id, item, start, end, source: non-blank spans that tile each text.

    A blank piece joins the unit before it, leading blanks the first one. Null, empty
    and blank texts have no unit. Without `source`, only the spans.
    """

    def make(text: str) -> Iterator[tuple]:
        start = 0
        for k, end in enumerate(layout.unit_ends(text, layout.structure(text))):
            yield (k, start, end, text[start:end]) if source else (k, start, end)
            start = end

    return _each(ctx, "item long, start long, end long" + (", source string" if source else ""), make)


def segments(ctx: DataFrame, target: int = TARGET_CHARS, low: int = MIN_CHARS, high: int = MAX_CHARS, prefix: str = "s", text: bool = False) -> DataFrame:
    """ctx_id, seg_no, ref, start, end, kind, units (and text, if asked for): units packed in order until `target` characters."""
    _check_band(low, target, high)

    def make(t: str) -> Iterator[tuple]:
        kind, _, spans = _spans(t, low, target, high)
        for k, (a, b, n) in enumerate(spans):
            yield (k, f"{prefix}{k:04d}", a, b, kind, n, *([t[a:b]] if text else []))

    return _each(ctx, "seg_no int, ref string, start long, end long, kind string, units long" + (", text string" if text else ""), make)


def partition(ctx: DataFrame, target_chars: int | None = None) -> DataFrame:
    """ctx_id, part, text: whole units packed to a target size, none above three times that but single units."""
    target = target_chars or TARGET_CHARS
    made = segments(ctx, target, min(MIN_CHARS, target), 3 * target, text=True)
    return made.select("ctx_id", F.col("seg_no").alias("part"), "text")


def tiles(segs: DataFrame, ctx: DataFrame, empty: bool = True) -> DataFrame:
    """ctx_id, tiles: do the segments cover the text exactly, in order? An empty text without segments counts as `empty`."""
    w = Window.partitionBy("ctx_id").orderBy("seg_no")
    s = segs.withColumn("joined", F.coalesce(F.lead("start").over(w) == F.col("end"), F.lit(True)))
    s = s.groupBy("ctx_id").agg(F.min("start").alias("first"), F.max("end").alias("last"), F.bool_and("joined").alias("joined"))
    all_ = ctx.select("ctx_id", F.length("text").alias("chars")).join(s, "ctx_id", "left")
    return all_.select("ctx_id", F.when(F.col("chars") == 0, F.col("first").isNull() & F.lit(empty)).otherwise(F.coalesce((F.col("first") == 0) & (F.col("last") == F.col("chars")) & F.col("joined"), F.lit(False))).alias("tiles"))


def parts(ctx: DataFrame, slots: int, target: int = TARGET_CHARS, low: int = MIN_CHARS, high: int = MAX_CHARS, text: bool = False) -> DataFrame:
    """ctx_id, part, start, end (and text): at most `slots` parts, cut at the segment end nearest each proportional bound."""
    _check_band(low, target, high)

    def make(t: str) -> Iterator[tuple]:
        start = 0
        for k, end in enumerate(layout.part_cuts([s[1] for s in _spans(t, low, target, high)[2]], len(t), max(1, slots))):
            yield (k, start, end, *([t[start:end]] if text else []))
            start = end

    return _each(ctx, "part int, start long, end long" + (", text string" if text else ""), make)


def manifest(ctx: DataFrame, target: int = TARGET_CHARS, low: int = MIN_CHARS, high: int = MAX_CHARS) -> DataFrame:
    """One row for each text: sizes, structure, digest and segments in short. A null text counts as an empty one."""
    _check_band(low, target, high)

    def make(t: str) -> Iterator[tuple]:
        kind, _, spans = _spans(t, low, target, high)
        sizes, refs = [b - a for a, b, _ in spans] or [0], [f"s{k:04d}" for k in range(len(spans))]
        yield (len(t), t.count("\n") + 1 if t else 0, hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()[:16], kind if t else "empty", len(spans), min(sizes), max(sizes), round(sum(sizes) / len(sizes)), refs[:5], refs[-1] if refs else None, t[:400])

    filled = ctx.select("ctx_id", F.coalesce("text", F.lit("")).alias("text"))
    return _each(filled, "chars long, lines long, sha256 string, structure string, segments long, seg_min long, seg_max long, seg_mean long, first_refs array<string>, last_ref string, head string", make)


class ContextStore:
    """Contexts with a band of segment sizes. Segments are written once for each content and band, and read from then on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.ctx, self.band = spark, folder.rstrip("/"), None, {}

    def bind(self, ctx: DataFrame, **band: int | None) -> DataFrame:
        """Keeps the contexts and their band (target, low, high; what is empty or 0 is left out); their manifest."""
        self.ctx, self.band = ctx, {k: v for k, v in band.items() if v}
        return manifest(ctx, **self.band)

    def identity(self) -> str:
        """Of the contents, in any order, and the band."""
        row = F.struct(F.col("ctx_id").cast("string"), "text")
        sums = self.ctx.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(k), row).cast("decimal(38,0)")) for k in (1, 2)]).first()
        return hashlib.sha256(json.dumps([*map(str, sums), sorted(self.band.items())]).encode()).hexdigest()[:32]

    def segments(self) -> DataFrame:
        path = f"{self.folder}/segments-{self.identity()}"
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            segments(self.ctx, **self.band).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def by_ref(self, ref: str) -> DataFrame:
        """The segments of that name: none or one for each context."""
        return self.segments().where(F.col("ref") == ref)

    def read(self, ref_or_start: str | int, end: int | None = None) -> DataFrame:
        return read_ref(self.ctx, ref_or_start, **self.band) if isinstance(ref_or_start, str) else read(self.ctx, ref_or_start, end)


def read(ctx: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """ctx_id, text of [start, end), with both ends inside the text."""
    a = max(0, start)
    stop = F.length("text") if end is None else F.least(F.length("text"), F.lit(end))
    return ctx.select("ctx_id", F.substring(F.col("text"), F.lit(a + 1), F.greatest(F.lit(0), stop - a)).alias("text"))


def read_ref(ctx: DataFrame, ref: str, target: int = TARGET_CHARS, low: int = MIN_CHARS, high: int = MAX_CHARS) -> DataFrame:
    """ctx_id, text, problem: the segment of that name; where a text has none, the problem names the refs it has."""
    _check_band(low, target, high)

    def make(t: str) -> Iterator[tuple]:
        spans = _spans(t, low, target, high)[2]
        found = next(((t[a:b], None) for k, (a, b, _) in enumerate(spans) if f"s{k:04d}" == ref), None)
        yield found or (None, f"no segment {ref!r}; there are s0000 to s{len(spans) - 1:04d}" if spans else f"no segment {ref!r}; there is none")

    return _each(ctx, "text string, problem string", make)


def to_segments(spans: DataFrame, segs: DataFrame) -> DataFrame:
    """spans (ctx_id, start, ...) with `ref`: the segment that holds their start."""
    s = segs.select("ctx_id", "ref", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    return holding(spans, s, "ctx_id", "start", "s_start", "s_end").drop("s_start", "s_end")


def empty_alternative(pattern: str) -> bool:
    """Has a regular expression an unescaped `||` outside a class, an alternative that matches nothing?"""
    plain = re.sub(r"\\.", "..", pattern, flags=re.S)
    return "||" in re.sub(r"\[[^\]]*\]?", lambda m: "." * len(m[0]), plain)


def search(ctx: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = True, max_hits: int = MAX_HITS) -> DataFrame:
    """ctx_id, hit, start, line, ref, excerpt, matches: matches that don't overlap, the first max_hits of each text.

    `matches` counts all; `ref` is the segment that holds the hit. A pattern that isn't
    valid, that matches an empty text or has an empty alternative is refused by name.
    """
    try:
        compiled = re.compile(pattern if regex else re.escape(pattern), re.I if ignore_case else 0)
    except re.error as e:
        raise ValueError(f"{pattern!r} is no regular expression: {e}") from e
    if compiled.search("") or regex and empty_alternative(pattern):
        raise ValueError(f"{pattern!r} matches an empty text")

    def make(t: str) -> Iterator[tuple]:
        found = list(compiled.finditer(t))
        if not found:
            return
        starts = [a for a, _, _ in _spans(t, MIN_CHARS, TARGET_CHARS, MAX_CHARS)[2]]
        line = at = 0
        for k, m in enumerate(found[:max_hits]):
            line, at = line + t.count("\n", at, m.start()), m.start()
            ref = f"s{bisect_right(starts, at) - 1:04d}" if starts else None
            yield k, at, line + 1, ref, t[max(0, at - BEFORE) : at + AFTER].replace("\n", " ⏎ "), len(found)

    return _each(ctx, "hit long, start long, line long, ref string, excerpt string, matches long", make)


def search_refs(hits: DataFrame) -> DataFrame:
    """ctx_id, matches, returned, refs: what a search found in each text, with the names of its hits' segments in order."""
    return hits.groupBy("ctx_id").agg(F.max("matches").alias("matches"), F.count("*").alias("returned"), F.array_sort(F.collect_set("ref")).alias("refs"))
