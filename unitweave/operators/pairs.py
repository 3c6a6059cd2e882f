"""Pairs of users by the labels of their rows, all specs in one aggregate; scores against a gold set.

entries: (user long, label string, date date). Qualifying users are aggregated first,
so what is joined has one row for each user and task; the result is as large as the
number of pairs. Counts and floors are arithmetic and never make pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitweave.operators import tiles


@dataclass(frozen=True)
class Sym:
    """Both users have a row of one of `any`; every row of the date rule's label is strictly after/before its limit."""

    any: tuple[str, ...]
    date_rule: tuple[str, str, str] | None = None


@dataclass(frozen=True)
class Asym:
    """One user meets `a`, the other `b`: (label, '>=' or '==', n) each."""

    a: tuple[tuple[str, str, int], ...]
    b: tuple[tuple[str, str, int], ...]


def entries(labelled: DataFrame, text: str = "text") -> DataFrame:
    """Labelled lines `Date: Feb 02, 2023 || User: 10 || Instance: q || Label: entity` as rows; other lines are skipped."""
    pattern = r"^Date: (\w{3} \d{1,2}, \d{4}) \|\| User: (\d+) \|\| Instance: (?:.*) \|\| Label: (.*)$"
    line = labelled.select(F.explode(F.split(text, "\n")).alias("line"))
    get = lambda k: F.regexp_extract("line", pattern, k)
    rows = line.where(F.col("line").rlike(pattern))
    return rows.select(get(2).cast("long").alias("user"), F.trim(get(3)).alias("label"), F.to_date(get(1), "MMM d, yyyy").alias("date"))


def _sym_test(spec: Sym) -> Column:
    test = F.bool_or(F.col("label").isin(*spec.any))
    if spec.date_rule:
        label, op, limit = spec.date_rule
        late = F.col("date") > F.lit(limit).cast("date") if op == "after" else F.col("date") < F.lit(limit).cast("date")
        test = test & F.coalesce(F.bool_and(F.when(F.col("label") == label, late)), F.lit(True))
    return test


def _side_test(conditions: tuple[tuple[str, str, int], ...]) -> Column:
    tests = [F.count_if(F.col("label") == label) >= n if op == ">=" else F.count_if(F.col("label") == label) == n for label, op, n in conditions]
    return reduce(lambda x, y: x & y, tests)


def qualified(rows: DataFrame, specs: dict[int, Sym | Asym]) -> DataFrame:
    """task, user, sides: who meets a task's spec: 1 its first side, 2 its second, 3 both; 3 for a symmetric one.

    All specs are tests of one aggregate by user, so rows are read and dealt once.
    """
    sides = []
    for task, s in specs.items():
        if isinstance(s, Sym):
            code = F.when(_sym_test(s), 3)
        else:
            code = F.nullif(F.when(_side_test(s.a), 1).otherwise(0) + F.when(_side_test(s.b), 2).otherwise(0), F.lit(0))
        sides.append(F.struct(F.lit(task).alias("task"), code.cast("int").alias("sides")))
    met = rows.groupBy("user").agg(F.array(*sides).alias("met"))
    return met.select("user", F.explode("met").alias("m")).where("m.sides IS NOT NULL").select("m.task", "user", "m.sides")


def task_counts(rows: DataFrame, specs: dict[int, Sym | Asym]) -> DataFrame:
    """task, n_pairs, floor: pairs of each task by arithmetic, and the F1 of answering every pair."""
    sym = F.col("task").isin(*[k for k, s in specs.items() if isinstance(s, Sym)]) if any(isinstance(s, Sym) for s in specs.values()) else F.lit(False)
    n = qualified(rows, specs).groupBy("task").agg(*[F.count_if(F.col("sides") == k).alias(f"n{k}") for k in (1, 2, 3)])
    within = F.col("n3") * (F.col("n3") - 1) / 2
    across = F.col("n1") * F.col("n2") + F.col("n3") * (F.col("n1") + F.col("n2"))
    counts = n.select("task", F.when(sym, within).otherwise(across + within).cast("long").alias("n_pairs"))
    tasks = rows.sparkSession.createDataFrame([(k,) for k in specs], "task int")
    users = rows.agg(F.countDistinct("user").alias("users"))
    c = tasks.join(counts, "task", "left").select("task", F.coalesce("n_pairs", F.lit(0).cast("long")).alias("n_pairs")).crossJoin(users)  # one row for each task
    every = F.col("users") * (F.col("users") - 1) / 2
    return c.select("task", "n_pairs", F.when(F.col("n_pairs") + every == 0, 1.0).otherwise(2 * F.col("n_pairs") / (F.col("n_pairs") + every)).alias("floor"))


def pairs(rows: DataFrame, spec: Sym | Asym) -> DataFrame:
    """(a, b), a < b, each once. As large as the number of pairs, which tiles spread over all tasks."""
    return _joined(qualified(rows, {0: spec}).select("user", "sides"))


def every_pair(rows: DataFrame) -> DataFrame:
    return _joined(rows.select("user").distinct().withColumn("sides", F.lit(3)))


def _joined(q: DataFrame) -> DataFrame:
    """(a, b), a < b, of users (user, sides) of which one meets the first side and the other the second.

    Users of the same sides are blocks in order of number, so whether a user goes with a block
    is asked once for the block; only the block that a user's own number falls in has rows on the wrong side of the diagonal.
    """
    blocks = tiles.blocks(q, ["sides"], "user")
    a = blocks.select("block", F.col("sides").alias("sa"), F.col("values").alias("a"))
    b = blocks.select("block", F.col("sides").alias("sb"), F.array_max("values").alias("last"), F.col("values").alias("b"))
    # Not both the same single side.
    met = tiles.squared(a, b, "a", (F.col("a") < F.col("last")) & (F.col("sa").bitwiseOR(F.col("sb")) == 3))
    return met.select("a", F.explode("b").alias("b")).where("a < b")


def pair_count(rows: DataFrame, spec: Sym | Asym) -> DataFrame:
    """n_pairs, by arithmetic: n (n - 1) / 2; for two sides |A| |B| less the diagonal and what both orders give."""
    return task_counts(rows, {0: spec}).select("n_pairs")


def rates(counts: DataFrame) -> DataFrame:
    """counts (..., hits, predicted, truth) with precision, recall and f1, to four digits (halves to even); two empty sets score 1."""
    none = (F.col("predicted") == 0) & (F.col("truth") == 0)
    rate = lambda d: F.when(none, 1.0).when(F.col(d) == 0, 0.0).otherwise(F.col("hits") / F.col(d))
    f = F.when(none, 1.0).otherwise(2 * F.col("hits") / (F.col("predicted") + F.col("truth")))
    return counts.select("*", *[F.bround(x, 4).alias(n) for x, n in ((rate("predicted"), "precision"), (rate("truth"), "recall"), (f, "f1"))])


def f1(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """hits, predicted, truth, precision, recall, f1 of two sets of (a, b)."""
    both = predicted.select("a", "b").distinct().withColumn("p", F.lit(1)).join(truth.select("a", "b").distinct().withColumn("t", F.lit(1)), ["a", "b"], "full")
    return rates(both.agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("hits"), F.count("p").alias("predicted"), F.count("t").alias("truth")))


def spec_f1(rows: DataFrame, predicted: Sym | Asym, truth: Sym | Asym) -> DataFrame:
    """f1() of the pairs of two specs, without making a pair: users are counted by what they meet of both."""
    q = qualified(rows, {1: predicted, 2: truth}).groupBy("user").agg(*[F.coalesce(F.max(F.when(F.col("task") == k, F.col("sides"))), F.lit(0)).alias(f"s{k}") for k in (1, 2)])
    n = q.groupBy("s1", "s2").agg(F.count("*").alias("n"))  # 16 kinds of users at most
    a, b = (n.select(*[F.col(c).alias(f"{c}{x}") for c in ("s1", "s2", "n")]) for x in "ab")
    j = a.crossJoin(b).where("s1a < s1b OR (s1a = s1b AND s2a <= s2b)")
    pairs_ = F.when((F.col("s1a") == F.col("s1b")) & (F.col("s2a") == F.col("s2b")), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    meets = lambda k: (F.least(f"s{k}a", f"s{k}b") > 0) & (F.col(f"s{k}a").bitwiseOR(F.col(f"s{k}b")) == 3)
    total = lambda t: F.coalesce(F.sum(F.when(t, pairs_)), F.lit(0)).cast("long")
    return rates(j.agg(total(meets(1) & meets(2)).alias("hits"), total(meets(1)).alias("predicted"), total(meets(2)).alias("truth")))


def macro(scores: DataFrame) -> DataFrame:
    """macro_f1, above_floor, tasks of scores (task, f1, floor)."""
    return scores.agg(F.avg("f1").alias("macro_f1"), F.count_if(F.col("f1") > F.col("floor")).alias("above_floor"), F.count("*").alias("tasks"))


def overlaid(records: DataFrame, predictions: DataFrame, only_complete_users: bool = False) -> DataFrame:
    """Entries of records (index, user, label, date) with predicted labels (index, label) in place of theirs.

    With only_complete_users, those of users all of whose records have a prediction.
    """
    p = predictions.select(F.col("index").alias("p_index"), F.col("label").alias("said"))
    j = records.join(p, F.col("index") == F.col("p_index"), "left").select("index", "user", F.coalesce("said", "label").alias("label"), "date", "said")
    if only_complete_users:
        whole = j.groupBy("user").agg(F.bool_and(F.col("said").isNotNull()).alias("whole")).where("whole").select("user")
        j = j.join(whole, "user", "left_semi")
    return j.select("user", "label", "date")


def pair_set_sha256(answers: DataFrame) -> DataFrame:
    """answer_id, sha256 of each answer's pairs (answer_id, a, b) as lines `(a, b)` in order of number."""
    grouped = answers.select("answer_id", "a", "b").distinct().groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("x"))
    text = F.array_join(F.transform("x", lambda x: F.format_string("(%d, %d)", x["a"], x["b"])), "\n")
    return grouped.select("answer_id", F.sha2(text, 256).alias("sha256"))


#: The pair grammars of answers, strict and as a list.
STRICT = r"\(\s*(\d+)\s*,\s*(\d+)\s*\)"
LISTED = r"[\(\[]\s*[\"']?(\d+)[\"']?\s*,\s*[\"']?(\d+)[\"']?\s*[\)\]]"


BARE = r"(?md)^[ \t]*(\d+)(?:[ \t]*,[ \t]*|[ \t]+)(\d+)[ \t]*$"


def _ordered(z: DataFrame, key: list[str]) -> DataFrame:
    z = z.select(*key, F.col("x").try_cast("long").alias("x"), F.col("y").try_cast("long").alias("y"))
    return z.select(*key, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def parse_answer(answers: DataFrame, pattern: str = STRICT, text: str = "text", key: str | None = None) -> DataFrame:
    """(key, a, b) anywhere in the answers, in order of number, each once."""
    get = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    own = [key] if key else []
    z = answers.select(*own, F.explode(F.arrays_zip(get(1).alias("x"), get(2).alias("y"))).alias("z"))
    return _ordered(z.select(*own, "z.x", "z.y"), own)


def parse_answer_loose(answers: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """Listed pairs, lines of two ids and nothing else, and answers that are a JSON list of such lines."""
    own = [key] if key else []
    listed = F.when(_is_list(F.col(text)), F.from_json(text, "array<string>"))
    items = answers.select(*own, F.explode(listed).alias("line")).where(F.col("line").rlike("^" + BARE.removeprefix("(?md)^").removesuffix("$") + "$"))
    found = [parse_answer(answers, LISTED, text, key), parse_answer(answers, BARE, text, key), parse_answer(items, BARE, "line", key)]
    return reduce(DataFrame.unionByName, found).distinct()


def _is_list(text: Column) -> Column:
    """Is a text, in whole, a JSON list? The parser itself would ignore what follows one."""
    return F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("[") & F.regexp_replace(text, r"\s+\z", "").endswith("]")


def pairs_from_value(value: Column) -> Column:
    """array<struct<a, b>> of a JSON value that is a list of pairs of different whole numbers (or their digits); null for any other."""
    rows = F.from_json(value, "array<array<string>>")
    digits = lambda x: F.coalesce(x.rlike(r"^\d+$"), F.lit(False))
    pair = lambda r: (F.size(r) == 2) & digits(F.get(r, F.lit(0))) & digits(F.get(r, F.lit(1))) & (F.get(r, F.lit(0)).try_cast("long") != F.get(r, F.lit(1)).try_cast("long"))
    n = lambda r, k: F.get(r, F.lit(k)).try_cast("long")
    made = F.transform(rows, lambda r: F.struct(F.least(n(r, 0), n(r, 1)).alias("a"), F.greatest(n(r, 0), n(r, 1)).alias("b")))
    ok = _is_list(value) & F.forall(rows, lambda r: F.coalesce(r.isNotNull() & pair(r), F.lit(False)))
    return F.when(ok, F.array_sort(F.array_distinct(made)))
