"""Interval algebra over spans (ctx_id, start, end): unions, gaps, fractions."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitweave.operators import scan, trees
from unitweave.sources.work import settle


def union(spans: DataFrame) -> DataFrame:
    """ctx_id, start, end: the union as disjoint spans; touching spans are one. Empty and null spans are left out.

    Spans are joined inside stretches of their text first; what reaches over from the
    stretches before decides which of the joined ones begin a span of the whole.
    """
    longest = scan.stretches(spans.where("end > start"), "start").groupBy("ctx_id", "stretch", "start").agg(F.max("end").alias("end"))
    w = scan.inside("ctx_id", "start")
    s = longest.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("island", F.sum((F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int")).over(scan.up_to_here(w)))
    s = s.groupBy("ctx_id", "stretch", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    s = scan.carried(s, "ctx_id", before=(F.max("end"), F.max))
    s = s.withColumn("first", F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), F.col("start"))).drop("before")
    s = scan.carried(s, "ctx_id", open=(F.max("first"), F.max))
    own = F.greatest(F.max("first").over(scan.up_to_here(w)), F.col("open"))
    return s.withColumn("own", own).groupBy("ctx_id", "own").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("own")


def union_written(spans: DataFrame) -> DataFrame:
    """union() of spans of a written table that are few a text, as a rule: one window a text, dealt once.

    Texts of more than scan.WIDTH spans, which are counted first, go through stretches. Null texts are left out.
    """
    spans = spans.where("ctx_id IS NOT NULL AND end > start").select("ctx_id", "start", "end")
    many = settle(spans.groupBy("ctx_id").agg(F.count("*").alias("n")).where(F.col("n") > scan.WIDTH).select("ctx_id"), "many")
    rest = None if many.isEmpty() else union(spans.join(many, "ctx_id", "left_semi"))
    few = spans if rest is None else spans.join(many, "ctx_id", "left_anti")
    w = Window.partitionBy("ctx_id").orderBy("start")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = few.withColumn("first", F.when(reach.isNull() | (F.col("start") > reach), F.col("start")))
    own = first.withColumn("own", F.max("first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = own.groupBy("ctx_id", "own").agg(F.max("end").alias("end")).select("ctx_id", F.col("own").alias("start"), "end")
    return joined if rest is None else joined.unionByName(rest.select("ctx_id", "start", "end"))


def gaps(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """ctx_id, start, end: what the spans leave of each text of `sizes` (ctx_id, chars)."""
    edge = sizes.select("ctx_id", F.col("chars").cast("long").alias("start"), F.col("chars").cast("long").alias("end"))
    u = union(spans).select("ctx_id", "start", "end").join(sizes.select("ctx_id"), "ctx_id", "left_semi").unionByName(edge)
    u = scan.carried(scan.stretches(u, "start"), "ctx_id", before=(F.max("end"), F.max))
    a = F.coalesce(F.lag("end").over(scan.inside("ctx_id", "start", "end")), "before", F.lit(0))
    g = u.select("ctx_id", a.alias("a"), F.col("start").alias("b"))
    return g.where("b > a").select("ctx_id", F.col("a").cast("long").alias("start"), F.col("b").cast("long").alias("end"))


def fraction(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """ctx_id, covered (characters), chars, share; an empty text has share 0."""
    return _shares(union(spans), sizes)


def _shares(disjoint: DataFrame, sizes: DataFrame) -> DataFrame:
    c = disjoint.groupBy("ctx_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    j = sizes.join(c, "ctx_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))
    return j.select("ctx_id", "covered", F.col("chars").cast("long").alias("chars"), F.when(F.col("chars") > 0, F.col("covered") / F.col("chars")).otherwise(0.0).alias("share"))


def certificate(fractions: DataFrame, failed: DataFrame, threshold: float = 0.98) -> DataFrame:
    """ctx_id, covers: enough characters, and no failed unit (failed: ctx_id)."""
    bad = failed.select("ctx_id").distinct().withColumn("bad", F.lit(True))
    return fractions.join(bad, "ctx_id", "left").select("ctx_id", (F.col("bad").isNull() & (F.col("chars") > 0) & (F.col("share") >= threshold)).alias("covers"))


def runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, run, value, n: run-length encoding of value in order."""
    r = rows.select(F.col(key), F.col(order), F.struct(F.col(value).alias("is")).alias("held"))
    r = scan.carried(scan.stretches(r, order), key, before=(F.max_by("held", order), scan.last))
    w = scan.inside(key, order)
    r = r.withColumn("new", (~F.col("held").eqNullSafe(F.coalesce(F.lag("held").over(w), "before")) | F.coalesce(F.lag("held").over(w), "before").isNull()).cast("int")).drop("before")
    r = scan.carried(r, key, earlier=(F.sum("new"), F.sum))
    r = r.withColumn("run", F.sum("new").over(scan.up_to_here(w)) + F.coalesce("earlier", F.lit(0)))
    return r.groupBy(key, "run").agg(F.first("held").alias("held"), F.count("*").alias("n")).select(key, F.col("run").cast("long").alias("run"), F.col("held.is").alias(value), "n")


def last_before(rows: DataFrame, key: str, order: str, mark: str, value: str) -> DataFrame:
    """As-of: each row that isn't a mark with the value of the last mark before it."""
    marked = F.when(F.col(mark), F.col(value))
    r = scan.carried(scan.stretches(rows, order), key, carry=(F.max_by(F.struct(marked.alias("is")), F.when(marked.isNotNull(), F.col(order))), scan.last))
    here = F.last(marked, ignorenulls=True).over(scan.up_to_here(scan.inside(key, order)))
    return r.withColumn("as_of", F.coalesce(here, F.col("carry.is"))).where(~F.col(mark)).drop("stretch", "carry")


def place(parts: DataFrame, ctx: DataFrame) -> DataFrame:
    """parts (part_id, ctx_id, part) with placed_at: where the text has the part, if it has it once.

    Occurrences that overlap count; an absent, repeated, empty or null part is not placed.
    """
    j = parts.join(ctx.select("ctx_id", "text"), "ctx_id", "left")
    j = j.withColumn("p1", F.expr("locate(part, text)")).withColumn("p2", F.expr("locate(part, text, p1 + 1)"))
    at = F.when((F.col("part") != "") & (F.col("p1") > 0) & (F.col("p2") == 0), F.col("p1") - 1)
    return j.select("part_id", "ctx_id", at.cast("long").alias("placed_at"))


def verify_spans(claims: DataFrame, ctx: DataFrame) -> DataFrame:
    """claims (part_id, ctx_id, part, start, end) with placed_at: start, if the text has the part exactly there."""
    j = claims.join(ctx.select("ctx_id", "text"), "ctx_id", "left")
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text"))
    same = F.expr("substring(text, CAST(start + 1 AS INT), CAST(end - start AS INT)) = part")
    return j.select("part_id", "ctx_id", F.when(inside & same, F.col("start")).cast("long").alias("placed_at"))


def lifted(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """ctx_id, start, end: spans (node_id, start, end) of a tree, in the text of every node above and of their own.

    nodes (node_id, parent_id, placed_at), a tree of any depth; what is below an unplaced
    node counts for nothing above it. A ring of nodes is an error.
    """
    own = spans.select(F.col("node_id").alias("ctx_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    return trees.climb(_placed(nodes), own, _shifted)


def _placed(nodes: DataFrame) -> DataFrame:
    return nodes.where("placed_at IS NOT NULL").select("node_id", "parent_id", F.col("placed_at").alias("by"))


def _shifted(known: DataFrame, jumps: DataFrame) -> DataFrame:
    higher = known.join(jumps, F.col("ctx_id") == F.col("node")).select(F.col("above").alias("ctx_id"), (F.col("start") + F.col("by")).alias("start"), (F.col("end") + F.col("by")).alias("end"))
    return known.unionByName(higher)


def tree_certificate(spans: DataFrame, nodes: DataFrame, failed: DataFrame, threshold: float = 0.98) -> DataFrame:
    """node_id, covers: enough of the node's text, no failed unit, no unplaced child, and every child covers.

    nodes (node_id, parent_id, placed_at, chars), failed (node_id). On their way up, a
    node's spans are kept as their union, so a root doesn't hold all spans of its tree.
    Spans and what is bad go up one ladder, whose jumps over an unplaced node have no `by`.
    """
    sizes = nodes.select(F.col("node_id").alias("ctx_id"), "chars")
    own = spans.select(F.col("node_id").alias("ctx_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    steps = trees.ladder(nodes.select("node_id", "parent_id", F.col("placed_at").alias("by")))
    placed = itertools.takewhile(lambda jumps: not jumps.isEmpty(), (jumps.where("by IS NOT NULL") for jumps in steps))

    def read_below(known: DataFrame, jumps: DataFrame) -> DataFrame:
        return union_written(settle(_shifted(known, jumps), "read"))

    own = settle(union_written(settle(own, "own")), "own-joined")
    read = trees.ascend(placed, own, read_below)
    each = settle(certificate(_shares(read, sizes), failed.select(F.col("node_id").alias("ctx_id")), threshold), "each")
    unplaced = nodes.where("parent_id IS NOT NULL AND placed_at IS NULL").select(F.col("parent_id").alias("ctx_id"))
    bad = settle(each.where("NOT covers").select("ctx_id").unionByName(unplaced).distinct(), "bad")

    def spread(known: DataFrame, jumps: DataFrame) -> DataFrame:
        return known.unionByName(known.join(jumps, F.col("ctx_id") == F.col("node")).select(F.col("above").alias("ctx_id"))).distinct()

    bad = trees.ascend(steps, bad, spread).withColumn("bad", F.lit(True))
    return each.join(bad, "ctx_id", "left").select(F.col("ctx_id").alias("node_id"), F.col("bad").isNull().alias("covers"))
