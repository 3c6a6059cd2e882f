"""Validation of judged values as column expressions, and parsing of replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitweave.functions.text import bare
from unitweave.plans.schema import MAX_TEXT, Leaf

#: Words of answers, and the line of a reply.
TRUE_WORDS, FALSE_WORDS, NULL_WORDS = ("yes", "true", "si", "sí"), ("no", "false"), ("null", "none", "n/a")
LINE = r"(?md)^\s*item\s*(\d+)\s*[:\-]\s*(.*?)\s*$"


def _quoted(x: Column) -> Column:
    return F.concat(F.lit("'"), F.left(x, F.lit(40)), F.lit("'"))


def validate(raw: Column, leaf: Leaf) -> Column:
    """struct(ok, value, problem): the canonical value as text (of objects as JSON), null where it is not valid or a valid null; and why it is not valid.

    Null words come before everything else, so a label spelt like one never validates. Of an
    object all problems are told, in the order of its fields, then those not asked for.
    """
    x = bare(F.coalesce(raw.cast("string"), F.lit("")))
    low = F.lower(x)
    if leaf.base == "boolean":
        value = F.when(low.isin(*TRUE_WORDS), "true").when(low.isin(*FALSE_WORDS), "false")
        wrong = F.concat(_quoted(x), F.lit(" is not yes or no"))
    elif leaf.base == "enum":
        value = F.try_element_at(F.create_map(*[F.lit(y) for v in leaf.values for y in (v.lower(), v)]), low)
        wrong = F.concat(_quoted(x), F.lit(" is none of the labels"))
    elif leaf.base == "text":
        value = F.when((F.length(x) <= MAX_TEXT) & ~F.contains(x, F.lit("\n")), x)
        wrong = F.when(F.contains(x, F.lit("\n")), "has more than one line").otherwise(F.lit(f"has more than {MAX_TEXT} characters"))
    else:
        return _object(raw, leaf)
    empty, null_word = x == "", low.isin(*NULL_WORDS)
    ok = F.when(empty, False).when(null_word, leaf.nullable).otherwise(value.isNotNull())
    problem = F.when(ok, None).when(empty, "is empty").when(null_word, "may not be null").otherwise(wrong)
    return F.struct(ok.alias("ok"), F.when(ok & ~null_word, value).alias("value"), problem.alias("problem"))


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), with x made once however often it is used."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _object(raw: Column, leaf: Leaf) -> Column:
    def checked(x: Column) -> Column:
        braces = x.startswith("{") & x.endswith("}")
        m = F.when(braces & F.try_parse_json(x).isNotNull(), F.from_json(x, "map<string,string>"))
        return _let(m, lambda m: _let(F.array(*[field(m, name, f) for name, f in leaf.fields]), lambda v: _let(told(x, braces, m, v), lambda p: result(v, p))))

    def field(m: Column, name: str, f: Leaf) -> Column:
        """A JSON null is the word."""
        said = F.coalesce(F.try_element_at(m, F.lit(name)), F.when(F.array_contains(F.map_keys(m), name), "null"))
        return _let(said, lambda y: validate(y, f))

    def told(x: Column, braces: Column, m: Column, v: Column) -> Column:
        keys = F.map_keys(m)
        names = F.array(*[F.lit(name) for name, _ in leaf.fields])
        wrong = [F.when(~F.array_contains(keys, name), F.lit(f"{name} is missing")).when(~v[k]["ok"], F.concat(F.lit(f"{name} "), v[k]["problem"])) for k, (name, _) in enumerate(leaf.fields)]
        other = F.transform(F.array_sort(F.array_except(keys, names)), lambda k: F.concat(k, F.lit(" is not asked for")))
        every = F.nullif(F.array_join(F.concat(F.array_compact(F.array(*wrong)), other), "; "), F.lit(""))
        # A key that comes twice is neither missing nor another one.
        every = F.coalesce(every, F.when(F.size(m) != len(leaf.fields), "a field comes twice"))
        return F.when(x == "", "is empty").when(~braces, "is no JSON object").when(m.isNull(), "is no valid JSON").otherwise(every)

    def result(v: Column, problem: Column) -> Column:
        value = F.to_json(F.struct(*[v[k]["value"].alias(name) for k, (name, _) in enumerate(leaf.fields)]), {"ignoreNullFields": "false"})
        return F.struct(problem.isNull().alias("ok"), F.when(problem.isNull(), value).alias("value"), problem.alias("problem"))

    return _let(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", ""), checked)


def parse_replies(replies: DataFrame, wanted: DataFrame, leaf: Leaf, key: str = "fragment") -> DataFrame:
    """key, item, problem, value, why: a row for each wanted item of each reply, and for each foreign one.

    problem: null, missing, repeated (also with the same value), foreign or invalid; `why` says of an invalid one what is wrong.
    replies (key, reply), wanted (key, item).
    """
    get = lambda k: F.regexp_extract_all("reply", F.lit(LINE), F.lit(k))
    said = replies.select(key, F.explode(F.arrays_zip(get(1).alias("i"), get(2).alias("v"))).alias("z"))
    said = said.select(F.col(key).alias("r_key"), F.col("z.i").try_cast("long").alias("r_item"), F.col("z.v").alias("v")).where("r_item IS NOT NULL")
    said = said.groupBy("r_key", "r_item").agg(F.count("*").alias("times"), F.max("v").alias("v")).withColumn("check", validate(F.col("v"), leaf))
    j = wanted.select(key, "item").join(said, (F.col(key) == F.col("r_key")) & (F.col("item") == F.col("r_item")), "full")
    problem = F.when(F.col("item").isNull(), "foreign").when(F.col("times").isNull(), "missing").when(F.col("times") > 1, "repeated").when(~F.col("check.ok"), "invalid")
    return j.select(F.coalesce(key, "r_key").alias(key), F.coalesce("item", "r_item").alias("item"), problem.alias("problem"), F.when(problem.isNull(), F.col("check.value")).alias("value"), F.when(problem == "invalid", F.col("check.problem")).alias("why"))
