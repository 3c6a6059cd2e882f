"""Units and segments of texts that are too large for a row: chunks with carries.

A text comes as chunks (ctx_id, chunk, text), in order from 0, of any sizes but that all
but the last have LOOK characters at least. What a chunk means depends on what is before it in few ways only.

Units. Whether the chunk begins a line, and the mark that its last line may begin, are seen
in a few characters of its neighbours. A blank line that goes over a border is a machine
of two states, so a chunk is a function of them: keep, swap, or one of two constants; the
state a chunk begins in is the last constant before it, turned once for each swap
since. Whether a piece is blank is seen in the chunks behind it up to the next mark.

Segments. A segment is closed by the first piece that brings it to a size, so where cuts
fall depends on the last one before. A text is cut into ranges; a range is a function from
the first cut in it, of which there are as many as pieces in `target` characters, to that of the
next range. Those that the first cut leads to are found by pointer doubling, and then each
range knows its own.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from unitweave.functions import text as layout
from unitweave.operators import scan, trees
from unitweave.operators.text import MAX_CHARS, MIN_CHARS, TARGET_CHARS, _check_band, kinds
from unitweave.sources.work import settle

#: Characters of the next chunk that can decide what a line is, by the longest mark; and of a range of segments.
LOOK, RANGE = 16, 1 << 20
KEEP, SWAP, ZERO, ONE = "keep", "swap", "zero", "one"
_EDGE = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def _blank_machine(text: str, state: int) -> tuple[list[int], int]:
    """Ends of blank lines and the state behind the text: 1 after a line break and blanks only."""
    ends, at = [], 0
    if state:
        lead = len(text) - len(text.lstrip(" \t"))
        if lead == len(text):
            return [], 1
        if text[lead] == "\n":
            ends.append(lead + 1)
            at = lead + 1
    for m in layout._BLANK.finditer(text, at):
        ends.append(m.end())
    last = ends[-1] if ends else at
    tail = text.rfind("\n", last)
    return ends, int(tail >= 0 and not text[tail + 1 :].strip(" \t"))


def _function(text: str) -> tuple[str]:
    """What a chunk makes of either state."""
    return ({(0, 0): ZERO, (1, 1): ONE, (0, 1): KEEP, (1, 0): SWAP}[_blank_machine(text, 0)[1], _blank_machine(text, 1)[1]],)


def _marks(text: str, before: str, after: str, kind: str, state: int) -> list[int]:
    """Where units may begin behind a chunk's first character, up to its end: `before` is the character in front of it (or none), `after` the next ones."""
    found, whole = set(), before + text + after
    patterns = {"code": [layout._DEFINITION], "sections": [layout._HEADING]}.get(kind, [])
    for p in (layout._DOC, *patterns):
        found.update(m.start() - len(before) for m in p.finditer(whole))
    if kind in ("rows", "lines"):
        found.update(m.end() for m in _EDGE.finditer(text + after[:1]))
    else:
        found.update(_blank_machine(text, state)[0])
    return sorted(k for k in found if 0 < k <= len(text))


def placed_chunks(chunks: DataFrame) -> DataFrame:
    """ctx_id, chunk, text, start, before, after, chars (of the whole text) and structure of each chunk."""
    c = chunks.where("text <> ''").select("ctx_id", F.col("chunk").cast("long").alias("chunk"), "text").withColumn("size", F.length("text").cast("long"))
    w, whole = Window.partitionBy("ctx_id").orderBy("chunk"), Window.partitionBy("ctx_id")
    edges = c.select("ctx_id", "chunk", "size", F.left("text", F.lit(LOOK)).alias("head"), F.right("text", F.lit(1)).alias("tail"))  # a short row a chunk
    edges = edges.select(F.col("ctx_id").alias("e_ctx"), F.col("chunk").alias("e_chunk"), (F.sum("size").over(w) - F.col("size")).alias("start"), F.coalesce(F.lag("tail").over(w), F.lit("")).alias("before"), F.coalesce(F.lead("head").over(w), F.lit("")).alias("after"), F.sum("size").over(whole).alias("chars"))
    small = edges.where((F.length("after") < LOOK) & (F.length("after") > 0)).join(c.groupBy("ctx_id").agg(F.max("chunk").alias("last")), F.col("e_ctx") == F.col("ctx_id")).where("e_chunk < last - 1")
    if not small.isEmpty():
        raise ValueError(f"chunks have at least {LOOK} characters, but the last of a text")
    c = c.join(edges, (F.col("ctx_id") == F.col("e_ctx")) & (F.col("chunk") == F.col("e_chunk"))).drop("e_ctx", "e_chunk", "size")
    head = c.where(F.col("start") < layout.SAMPLE).groupBy("ctx_id").agg(F.array_sort(F.collect_list(F.struct("chunk", F.left("text", F.lit(layout.SAMPLE)).alias("text")))).alias("t"))  # SAMPLE characters and a chunk
    head = kinds(head.select("ctx_id", F.left(F.array_join(F.transform("t", lambda x: x["text"]), ""), F.lit(layout.SAMPLE)).alias("text")))
    return c.join(head.withColumnsRenamed({"ctx_id": "h_ctx"}), F.col("ctx_id") == F.col("h_ctx")).drop("h_ctx")


def _each_chunk(rows: DataFrame, columns: list[str], out: str, make) -> DataFrame:
    """ctx_id, chunk and the values of make(*columns) of each chunk."""
    kept = rows.select("ctx_id", "chunk", *columns)
    kind = kept.schema["ctx_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for k in range(batch.num_rows):  # a chunk at a time
                values = make(*[c[k].as_py() for c in batch.columns[2:]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), *[pa.array([v], to_arrow_type(f.dataType)) for v, f in zip(values, fields, strict=True)]], names)

    fields = StructType.fromDDL(out).fields
    names = ["ctx_id", "chunk", *[f.name for f in fields]]
    return kept.mapInArrow(run, f"ctx_id {kind}, chunk long, {out}")


def units(chunks: DataFrame) -> DataFrame:
    """ctx_id, item, start, end of the units of chunked texts: those that the whole text has."""
    c = settle(placed_chunks(chunks), "chunks")
    w = Window.partitionBy("ctx_id").orderBy("chunk")
    before, behind = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    f = _each_chunk(c, ["text"], "does string", _function)
    swaps = F.coalesce(F.sum((F.col("does") == SWAP).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    f = f.withColumn("swaps", swaps)
    fixed = F.when(F.col("does").isin(ZERO, ONE), F.struct((F.col("does") == ONE).cast("int").alias("to"), "swaps"))
    f = f.withColumns({"base": F.last(fixed, ignorenulls=True).over(before), "so_far": F.coalesce(F.last("swaps").over(before), F.lit(0))})
    state = (F.coalesce("base.to", F.lit(0)) + F.col("so_far") - F.coalesce("base.swaps", F.lit(0))) % 2
    f = f.select(F.col("ctx_id").alias("f_ctx"), F.col("chunk").alias("f_chunk"), state.cast("int").alias("state"))

    def look(text: str, start: int, chars: int, prior: str, after: str, kind: str, carry: int) -> tuple:
        here = ([] if start else [0]) + _marks(text, prior, after, kind, carry)
        edges = [*here, len(text)]
        solid = [bool(text[a:b].strip()) for a, b in zip(edges, edges[1:], strict=False)]
        lead = bool(text[: here[0] if here else len(text)].strip())
        sure = [start + k for k, s in zip(here, solid, strict=True) if s]
        return sure, start + here[-1] if here and not solid[-1] else None, lead, bool(here)

    j = c.join(f, (F.col("ctx_id") == F.col("f_ctx")) & (F.col("chunk") == F.col("f_chunk")))
    m = settle(_each_chunk(j, ["text", "start", "chars", "before", "after", "structure", "state"], "sure array<long>, open long, lead boolean, marked boolean", look), "marks")
    # The last mark of a chunk may have only blanks behind it there: it counts if the chunks behind have more before their first mark.
    filled = F.first(F.when(F.col("marked") | F.col("lead"), F.col("lead")), ignorenulls=True).over(behind)
    m = m.withColumn("starts", F.when(F.col("open").isNotNull() & F.coalesce(filled, F.lit(False)), F.array_append("sure", F.col("open"))).otherwise(F.col("sure")))
    m = m.withColumns({"n": F.size("starts"), "next": F.first(F.get("starts", F.lit(0)), ignorenulls=True).over(behind)})
    m = m.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    chars = c.groupBy("ctx_id").agg(F.first("chars").alias("chars")).withColumnRenamed("ctx_id", "t_ctx")
    u = m.select("ctx_id", "earlier", "next", "starts", F.posexplode("starts").alias("k", "from")).join(chars, F.col("ctx_id") == F.col("t_ctx"))
    item = F.col("earlier") + F.col("k")
    end = F.coalesce(F.get("starts", F.col("k") + 1), F.col("next"), F.col("chars"))
    return u.select("ctx_id", item.cast("long").alias("item"), F.when(item == 0, 0).otherwise(F.col("from")).cast("long").alias("start"), end.cast("long").alias("end"))


def _walk(pieces: list[int], forced: list[int], at: int, need: int, target: int) -> Iterator[int]:
    """Cuts from a range's first piece to close a segment on: each at the next forced place, or at the first piece `target` behind the cut before."""
    while True:
        k, f = bisect_left(pieces, need), bisect_right(forced, at)
        if f < len(forced) and (k == len(pieces) or forced[f] <= pieces[k]):
            at = forced[f]
        elif k < len(pieces):
            at = pieces[k]
        else:
            return
        need = at + target
        yield at


def segments(chunks: DataFrame, target: int = TARGET_CHARS, low: int = MIN_CHARS, high: int = MAX_CHARS, width: int = RANGE) -> DataFrame:
    """ctx_id, seg_no, ref, start, end, units of the segments of chunked texts: those that the whole text has. `width`: characters of a range, above target."""
    _check_band(low, target, high)
    if width <= target:
        raise ValueError("a range is wider than a segment")
    u = settle(units(chunks), "units")
    forced = u.where(F.col("end") - F.col("start") > high).select("ctx_id", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(high).cast("long"))).alias("at"), F.lit(True).alias("forced")).where("at > 0")
    pieces = u.select("ctx_id", F.col("end").alias("at"), F.lit(False).alias("forced")).unionByName(forced)
    pieces = pieces.groupBy("ctx_id", "at").agg(F.bool_or("forced").alias("forced")).withColumn("chunk", F.call_function("div", F.col("at"), F.lit(width)))
    inside = F.array_sort(F.collect_list(F.struct("at", "forced")))  # `width` places at most
    r = pieces.groupBy("ctx_id", "chunk").agg(inside.alias("p"))
    r = r.select("ctx_id", "chunk", F.transform("p", lambda x: x["at"]).alias("pieces"), F.transform(F.filter("p", lambda x: x["forced"]), lambda x: x["at"]).alias("forced"))
    w = Window.partitionBy("ctx_id").orderBy("chunk")
    ahead = F.struct("chunk", F.filter("pieces", lambda x: x < (F.col("chunk") * width + target)).alias("pieces"))
    r = settle(r.withColumns({"first": F.row_number().over(w) == 1, "ahead": F.lead(ahead).over(w), "earlier": F.coalesce(F.sum(F.size("pieces")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}), "ranges")

    def entries(chunk: int, own: list[int], stops: list[int], ahead: dict | None) -> tuple:
        """For each place in `own` at which a first segment may close: the like in the next range."""
        if ahead is None:
            return ([],)
        begin, go_on = chunk * width, []
        top = bisect_left(own, begin + target)
        for k in range(top + 1):
            cuts = list(_walk(own, stops, begin - 1, own[k] if k < len(own) else begin + width, target))
            need = cuts[-1] + target if cuts else begin
            go_on.append(bisect_left(ahead["pieces"], max(need, ahead["chunk"] * width)))
        return (go_on,)

    r = r.withColumn("number", F.col("chunk"))
    f = _each_chunk(r, ["number", "pieces", "forced", "ahead"], "go_on array<long>", entries)
    f = f.join(r.select(F.col("ctx_id").alias("o_ctx"), F.col("chunk").alias("o_chunk"), F.col("ahead.chunk").alias("to")), (F.col("ctx_id") == F.col("o_ctx")) & (F.col("chunk") == F.col("o_chunk")))
    name = lambda chunk, k: F.concat_ws("/", F.col("ctx_id").cast("string"), chunk.cast("string"), k.cast("string"))
    nodes = f.select("ctx_id", "chunk", "to", F.posexplode("go_on").alias("k", "next")).select(name(F.col("chunk"), F.col("k")).alias("node_id"), name(F.col("to"), F.col("next")).alias("parent_id"), F.lit(0).alias("by"))
    begins = F.size(F.filter("pieces", lambda x: x < target))
    start = r.where("first").select(name(F.col("chunk"), F.when(F.col("chunk") == 0, begins).otherwise(F.lit(0))).alias("node_id"))
    reached = trees.climb(nodes, start, lambda known, jumps: known.unionByName(known.join(jumps, F.col("node_id") == F.col("node")).select(F.col("above").alias("node_id"))))
    parts = F.split(F.col("node_id"), "/")
    entry = reached.select(F.array_join(F.slice(parts, 1, F.size(parts) - 2), "/").alias("n_ctx"), F.get(parts, F.size(parts) - 2).cast("long").alias("n_chunk"), F.get(parts, F.size(parts) - 1).cast("int").alias("k"))
    own = r.join(entry, (F.col("ctx_id").cast("string") == F.col("n_ctx")) & (F.col("chunk") == F.col("n_chunk")))

    def cuts(chunk: int, own: list[int], stops: list[int], k: int) -> tuple:
        begin = chunk * width
        found = list(_walk(own, stops, begin - 1 if chunk else 0, own[k] if k < len(own) else begin + width, target))
        return found, [bisect_right(own, c) for c in found]

    made = _each_chunk(own, ["number", "pieces", "forced", "k"], "cuts array<long>, counts array<long>", cuts)
    made = made.join(r.select(F.col("ctx_id").alias("r_ctx"), F.col("chunk").alias("r_chunk"), "earlier"), (F.col("ctx_id") == F.col("r_ctx")) & (F.col("chunk") == F.col("r_chunk")))
    c = made.select("ctx_id", "chunk", F.explode(F.arrays_zip("cuts", "counts")).alias("z"), "earlier").select("ctx_id", F.col("z.cuts").alias("end"), (F.col("z.counts") + F.col("earlier")).alias("count"))
    last = u.groupBy("ctx_id").agg(F.max("end").alias("chars"), F.count("*").alias("n")).withColumnRenamed("ctx_id", "l_ctx")
    n_pieces = pieces.groupBy("ctx_id").agg(F.count("*").alias("pieces")).withColumnRenamed("ctx_id", "p_ctx")
    rest = u.select("ctx_id").distinct().join(last, F.col("ctx_id") == F.col("l_ctx")).join(n_pieces, F.col("ctx_id") == F.col("p_ctx")).select("ctx_id", F.col("chars").alias("end"), F.col("pieces").alias("count"))
    c = settle(c.unionByName(rest).distinct(), "cuts")  # the end of the text closes the last segment
    c = scan.stretches(c, "end")
    c = scan.carried(c, "ctx_id", prior=(F.max(F.struct("end", "count")), F.max), so_far=(F.count("*"), F.sum))
    ws = scan.inside("ctx_id", "end")
    c = c.withColumns({"begin": F.coalesce(F.lag(F.struct("end", "count")).over(ws), "prior"), "k": F.row_number().over(ws) - 1 + F.coalesce("so_far", F.lit(0))})
    c = c.select("ctx_id", "k", F.coalesce("begin.end", F.lit(0)).cast("long").alias("start"), "end", (F.col("count") - F.coalesce("begin.count", F.lit(0))).cast("long").alias("units"))
    # A last segment below `low` joins the one before.
    tail = c.groupBy("ctx_id").agg(F.max(F.struct("k", "start", "end", "units")).alias("tail")).withColumnRenamed("ctx_id", "t_ctx")
    c = c.join(tail, F.col("ctx_id") == F.col("t_ctx"))
    short = (F.col("tail.k") > 0) & (F.col("tail.end") - F.col("tail.start") < low)
    c = c.where(~(short & (F.col("k") == F.col("tail.k"))))
    grown = short & (F.col("k") == F.col("tail.k") - 1)
    return c.select("ctx_id", F.col("k").cast("long").alias("seg_no"), F.format_string("s%04d", "k").alias("ref"), "start", F.when(grown, F.col("tail.end")).otherwise(F.col("end")).alias("end"), F.when(grown, F.col("units") + F.col("tail.units")).otherwise(F.col("units")).alias("units"))
