"""Recursion as a frontier: questions over texts that are split level by level, with lineage, limits and a certificate.

A level is a table of nodes. Those that `expand` splits make the next level; all others are
answered by one sweep for each question of the level. A child whose question and
text are already being answered above it is refused, a text that was answered is not
sent again, and the nodes of the whole tree are counted against one ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitweave.operators import coverage, scan, text, trees
from unitweave.operators.identity import hashed
from unitweave.operators.provenance import is_cycle
from unitweave.operators.sweep import Judge, Sweeps
from unitweave.plans.budget import Budget
from unitweave.sources.work import settle

#: nodes (node_id, question, text) -> their children (node_id, child, question, text, placed_at); none for those to be answered.
Expand = Callable[[DataFrame], DataFrame]
NODE = ["node_id", "parent_id", "depth", "question", "mark", "placed_at", "chars", "status", "same_as"]


def by_segments(slots: int, above: int) -> Expand:
    """Texts of more than `above` characters in at most `slots` parts on ends of segments, with the same question."""

    def expand(nodes: DataFrame) -> DataFrame:
        large = nodes.where(F.length("text") > above)
        parts = text.parts(large.select(F.col("node_id").alias("ctx_id"), "text"), slots, text=True)
        parts = parts.select(F.col("ctx_id").alias("of"), F.col("part").cast("string").alias("child"), F.col("start").alias("placed_at"), F.col("text").alias("own"))
        return parts.join(nodes.select("node_id", "question"), F.col("of") == F.col("node_id")).select("node_id", "child", "question", F.col("own").alias("text"), "placed_at")

    return expand


@dataclass
class Exploration:
    nodes: DataFrame  # NODE; status: expanded, answered, reused, empty, or refused: cycle, max_nodes
    rows: DataFrame  # node_id, item, value, start, end: of the nodes that were answered or reused
    totals: DataFrame  # node_id, examined, positive: of each node and all below it
    certificate: DataFrame  # node_id, covers
    budget: Budget


def _children(level: DataFrame, expand: Expand) -> DataFrame:
    """Children of a level, with their lineage; one whose mark is in it is a cycle. A part that isn't placed is looked for in its parent."""
    found = expand(level.select("node_id", "question", "text"))
    above = level.select(F.col("node_id").alias("parent_id"), F.col("lineage").alias("above"), "depth", F.col("text").alias("whole"))
    c = found.withColumnRenamed("node_id", "of").join(above, F.col("of") == F.col("parent_id"))
    once = (F.expr("locate(text, whole)") > 0) & (F.expr("locate(text, whole, locate(text, whole) + 1)") == 0) & (F.col("text") != "")
    placed = F.coalesce(F.col("placed_at").cast("long"), F.when(once, F.expr("locate(text, whole)") - 1).cast("long"))
    mark = hashed(F.col("question"), F.col("text"))
    return c.select(
        F.concat_ws("/", "parent_id", "child").alias("node_id"), "parent_id", (F.col("depth") + 1).alias("depth"), "question", mark.alias("mark"), placed.alias("placed_at"), F.length("text").cast("long").alias("chars"), "text",
        F.concat("above", F.array(mark)).alias("lineage"), is_cycle(mark, F.col("above")).alias("cycle"),
    )


def explore(spark: SparkSession, ctx: DataFrame, question: str, judge: Judge, folder: str, budget: Budget, expand: Expand) -> Exploration:
    """The question over contexts (ctx_id, text), whose roots are not counted as nodes.

    Children of a level are admitted in order of their ids as far as nodes are left; at the
    greatest depth texts are answered whole. Null and blank texts are empty. Ids of
    children are their parents' with a slash.
    """
    mark = hashed(F.col("question"), F.col("text"))
    level = ctx.select(F.col("ctx_id").cast("string").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.lit(question).alias("question"), F.coalesce("text", F.lit("")).alias("text"))
    level = level.select("node_id", "parent_id", "depth", "question", mark.alias("mark"), F.lit(None).cast("long").alias("placed_at"), F.length("text").cast("long").alias("chars"), "text", F.array(mark).alias("lineage"))
    level, done, rows, failed, answered = settle(level, "frontier"), [], [], [], None
    own = budget
    while True:
        blank = F.length(F.trim(F.regexp_replace("text", r"(?U)\s", ""))) == 0
        real = level.where(~blank)
        done.append(level.where(blank).select(*NODE[:7], F.lit("empty").alias("status"), F.lit(None).cast("string").alias("same_as")))
        asked, below = real, None
        if own.depth < own.max_depth:
            below = settle(_children(real, expand), "children")
            left = max(0, budget.max_nodes - budget.ledger.nodes)
            below = settle(scan.numbered(below.withColumn("cycle", F.coalesce("cycle", F.lit(False))), "cycle", "node_id").withColumn("admitted", ~F.col("cycle") & (F.col("position") < left)), "admitted")
            parents = below.select(F.col("parent_id").alias("p")).distinct()
            split = real.join(parents, F.col("node_id") == F.col("p"), "left_semi")
            asked = real.join(parents, F.col("node_id") == F.col("p"), "left_anti")
            done.append(split.select(*NODE[:7], F.lit("expanded").alias("status"), F.lit(None).cast("string").alias("same_as")))
            done.append(below.where("NOT admitted").select(*NODE[:7], F.when(F.col("cycle"), "cycle").otherwise("max_nodes").alias("status"), F.lit(None).cast("string").alias("same_as")))
        # One node of each mark is asked, and none whose mark has an answer.
        first = asked.groupBy("mark").agg(F.min("node_id").alias("first"))
        if answered is not None:
            known = answered.select(F.col("mark").alias("k_mark"), F.col("node_id").alias("known"))
            first = first.join(known, F.col("mark") == F.col("k_mark"), "left").select("mark", F.coalesce("known", "first").alias("first"))
        asked = settle(asked.join(first.withColumnRenamed("mark", "f_mark"), F.col("mark") == F.col("f_mark")).drop("f_mark"), "asked")
        new = asked.where("node_id = first")
        done.append(asked.select(*NODE[:7], F.when(F.col("node_id") == F.col("first"), "answered").otherwise("reused").alias("status"), F.when(F.col("node_id") != F.col("first"), F.col("first")).alias("same_as")))
        for r in new.select("question").distinct().collect():  # as many questions as nodes at most
            sweep = Sweeps(spark, folder, judge, own, r.question).semantic_search(new.where(F.col("question") == r.question).select(F.col("node_id").alias("ctx_id"), "text"))
            rows.append(sweep.rows.select(F.col("ctx_id").alias("node_id"), "item", "value", "start", "end"))
            failed.append(sweep.failed.select(F.col("ctx_id").alias("node_id")))
        marks = new.select("mark", "node_id")
        answered = marks if answered is None else answered.unionByName(marks)
        admitted = below.where("admitted") if below is not None else None
        n = admitted.count() if admitted is not None else 0
        if not n:
            break
        own = own.child()  # one level down: its own turns, the same ledger, and one node
        budget.ledger.nodes += n - 1
        level = admitted.select("node_id", "parent_id", "depth", "question", "mark", "placed_at", "chars", "text", "lineage")
    nodes = settle(reduce(DataFrame.unionByName, done), "nodes")
    none = "node_id string, item long, value string, start long, end long"
    found = reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], none)
    again = nodes.where("same_as IS NOT NULL").select(F.col("node_id").alias("again"), "same_as")
    found = settle(found.unionByName(found.join(again, F.col("node_id") == F.col("same_as")).select(F.col("again").alias("node_id"), "item", "value", "start", "end")), "rows")
    lost = reduce(DataFrame.unionByName, failed) if failed else nodes.select("node_id").limit(0)
    lost = lost.unionByName(lost.join(again, F.col("node_id") == F.col("same_as")).select(F.col("again").alias("node_id")))
    lost = lost.unionByName(nodes.where("status IN ('cycle', 'max_nodes')").select("node_id"))
    own_totals = nodes.select("node_id").join(found.groupBy("node_id").agg(F.count("*").alias("examined"), F.count_if(F.col("value") == "true").alias("positive")), "node_id", "left").na.fill(0)

    def lift(known: DataFrame, jumps: DataFrame) -> DataFrame:
        higher = known.join(jumps, F.col("node_id") == F.col("node")).select(F.col("above").alias("node_id"), "examined", "positive")
        return known.unionByName(higher).groupBy("node_id").agg(F.sum("examined").alias("examined"), F.sum("positive").alias("positive"))

    totals = trees.climb(trees.edges_of(nodes), own_totals, lift)
    spans = found.select("node_id", "start", "end").unionByName(nodes.where("status = 'empty' AND chars > 0").select("node_id", F.lit(0).cast("long").alias("start"), F.col("chars").alias("end")))
    certificate = coverage.tree_certificate(spans, nodes.where("chars > 0").select("node_id", "parent_id", "placed_at", "chars"), lost)
    return Exploration(nodes, found, totals, certificate, budget)
