"""Delivery of answers: line grammars, lint, rendering, comparison with committed values, verdicts.

answers (answer_id, text). Issues are rows (answer_id, code, n, lines): how many lines
break a rule and the numbers of the first three; a valid answer has none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A line with a pair, and one that only lacks its parentheses.
PAIR_LINE = r"^\(\s*(\d+)\s*,\s*(\d+)\s*\)$"
BARE_PAIR_LINE = r"^\s*(\d+)\s*,\s*(\d+)\s*$"
#: How numbers are written.
INTEGER = r"^\s*[+-]?\d+(?:_\d+)*\s*$"
NUMBER = r"(?i)^\s*[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+)?|inf(?:inity)?|nan)\s*$"
TYPES = ("integer", "number", "string")
#: How an answer's text is treated.
MODES = ("raw", "validate_only", "validate_repair", "constrained")


@dataclass(frozen=True)
class Records:
    """Records by line: prefix, fields with a separator between them, suffix."""

    fields: tuple[str, ...]
    separator: str
    prefix: str = ""
    suffix: str = ""
    ascending: bool = False
    duplicates: bool = False
    allow_empty: bool = True

    def __post_init__(self):
        if not 1 <= len(self.fields) <= 8 or any(f not in TYPES for f in self.fields):
            raise ValueError(f"records have 1 to 8 fields, each one of {', '.join(TYPES)}")
        if not self.separator or max(map(len, (self.separator, self.prefix, self.suffix))) > 8:
            raise ValueError("delimiters have at most 8 characters, a separator at least one")
        if self.ascending and (len(self.fields) != 2 or "string" in self.fields):
            raise ValueError("ascending order needs two fields of numbers")


def matches(value: Column, kind: str) -> Column:
    if kind == "string":
        return value.isNotNull()
    return value.rlike(INTEGER) if kind == "integer" else value.rlike(INTEGER) | value.rlike(NUMBER)


def _lines(answers: DataFrame) -> DataFrame:
    """answer_id, no (from 1), line: without what a last line end leaves; an empty or null answer has no line."""
    body = F.regexp_replace("text", r"\n\z", "")
    return answers.where("text <> ''").select("answer_id", F.posexplode(F.split(body, "\n", -1)).alias("k", "line")).select("answer_id", (F.col("k") + 1).alias("no"), "line")


def _issues(flagged: DataFrame) -> DataFrame:
    """From rows (answer_id, no, codes) to (answer_id, code, n, lines). Line numbers of a code: as the first three are all that is kept, ranks come before the groups."""
    e = flagged.select("answer_id", "no", F.explode("codes").alias("code"))
    rank = F.row_number().over(Window.partitionBy("answer_id", "code").orderBy("no"))
    e = e.withColumn("rank", rank)
    first = F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.col("no"))))
    return e.groupBy("answer_id", "code").agg(F.count("*").alias("n"), first.alias("lines"))


def _codes(**tests: Column) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in tests.items()]))


def check_pairs(answers: DataFrame) -> DataFrame:
    """Issues of answers that list pairs `(low, high)`, one on each line; an empty answer is valid.

    An answer with an empty line has the one issue pair_line_required (n = 1, no lines).
    """
    text = F.col("text")
    blank = (text != "") & ((F.regexp_replace(text, r"\n\z", "") == "") | F.contains(F.regexp_replace(text, r"\n\z", ""), F.lit("\n\n")))
    empty = answers.where(blank).select("answer_id", F.lit("pair_line_required").alias("code"), F.lit(1).cast("long").alias("n"), F.array().cast("array<int>").alias("lines"))
    a = _lines(answers.where(~blank))
    form = F.when(F.col("line").rlike(PAIR_LINE), 2).when(F.col("line").rlike(BARE_PAIR_LINE), 1).otherwise(0)
    number = lambda k: F.regexp_extract("line", r"(\d+)\s*,\s*(\d+)", k)
    a = a.select("answer_id", "no", form.alias("form"), number(1).alias("a"), number(2).alias("b"))
    again = F.row_number().over(Window.partitionBy("answer_id", "form_ok", "a", "b").orderBy("no")) > 1
    a = a.withColumn("form_ok", F.col("form") > 0).withColumn("again", again)
    # Numbers of any length: without leading zeros, the longer one is larger.
    bare = lambda c: F.regexp_replace(c, "^0+(?=.)", "")
    x, y = bare(F.col("a")), bare(F.col("b"))
    low = (F.length(x) < F.length(y)) | ((F.length(x) == F.length(y)) & (x < y))
    codes = _codes(pair_parentheses_required=F.col("form") == 1, invalid_pair_line=F.col("form") == 0, pair_order=F.col("form_ok") & ~low, duplicate_pair=F.col("form_ok") & F.col("again"))
    return _issues(a.select("answer_id", "no", codes.alias("codes"))).unionByName(empty)


def check_records(answers: DataFrame, spec: Records) -> DataFrame:
    """Issues of answers in a declared record format. A null answer counts as an empty one."""
    a = _lines(answers)
    line, inner = F.col("line"), F.col("line")
    framed = line.startswith(spec.prefix) & line.endswith(spec.suffix)
    if spec.prefix:
        inner = F.when(inner.startswith(spec.prefix), F.substring(inner, len(spec.prefix) + 1, 2**31 - 1)).otherwise(inner)
    if spec.suffix:
        inner = F.when(inner.endswith(spec.suffix), F.left(inner, F.length(inner) - len(spec.suffix))).otherwise(inner)
    quoted = "\\Q" + spec.separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    values = F.transform(F.split(inner, quoted, -1), lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", ""))
    a = a.select("answer_id", "no", framed.alias("framed"), values.alias("v"))
    n = len(spec.fields)
    counted = F.size("v") == n
    typed = F.lit(True)
    for k, kind in enumerate(spec.fields):
        typed = typed & F.coalesce(matches(F.try_element_at("v", F.lit(k + 1)), kind), F.lit(False))
    a = a.withColumn("counted", counted).withColumn("good", counted & typed)
    again = F.row_number().over(Window.partitionBy("answer_id", "good", "v").orderBy("no")) > 1
    a = a.withColumn("again", again)
    codes = {"record_delimiters": ~F.col("framed"), "field_count": ~F.col("counted"), "field_type": F.col("counted") & ~F.col("good")}
    if spec.ascending:
        x, y = (F.regexp_replace(F.try_element_at("v", F.lit(k)), "_", "").try_cast("decimal(38,12)") for k in (1, 2))
        finite = x.isNotNull() & y.isNotNull()
        codes |= {"numeric_order_type": F.col("good") & ~finite, "record_order": F.col("good") & finite & (x >= y)}
    if not spec.duplicates:
        codes["duplicate_record"] = F.col("good") & F.col("again")
    found = _issues(a.select("answer_id", "no", _codes(**codes).alias("codes")))
    if not spec.allow_empty:
        none = answers.where("text IS NULL OR text = ''")
        found = found.unionByName(none.select("answer_id", F.lit("records_required").alias("code"), F.lit(1).cast("long").alias("n"), F.array().cast("array<int>").alias("lines")))
    return found


def check_json(answers: DataFrame, root: str) -> DataFrame:
    """answer_id, code: invalid_json, or json_root where the root is no object, array or scalar as declared."""
    if root not in ("object", "array", "scalar"):
        raise ValueError("a JSON root is object, array or scalar")
    t = F.ltrim(F.col("text"))
    kind = F.when(t.startswith("{"), "object").when(t.startswith("["), "array").otherwise("scalar")
    code = F.when(F.try_parse_json("text").isNull(), "invalid_json").when(kind != root, "json_root")
    return answers.select("answer_id", code.alias("code")).where("code IS NOT NULL")


def render_records(rows: DataFrame, spec: Records) -> DataFrame:
    """answer_id, text of rows (answer_id, pos, fields: array<string>): a line each, in order of pos.

    Where ascending, the two fields of a row change places if needed; where duplicates
    are not wanted, the first of equal rows stays. The lines of one answer form one
    text, so an answer must fit a task.
    """
    f = F.col("fields")
    if spec.ascending:
        f = F.when(f[0].cast("decimal(38,12)") > f[1].cast("decimal(38,12)"), F.reverse(f)).otherwise(f)
    line = F.concat(F.lit(spec.prefix), F.array_join(f, spec.separator), F.lit(spec.suffix))
    made = rows.select("answer_id", "pos", line.alias("line"))
    if not spec.duplicates:
        made = made.groupBy("answer_id", "line").agg(F.min("pos").alias("pos"))
    in_order = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return made.groupBy("answer_id").agg(F.array_join(F.transform(in_order, lambda x: x["line"]), "\n").alias("text"))


def check_scalar(answers: DataFrame, kind: str) -> DataFrame:
    """answer_id, code: scalar_type where the text is no single value of the declared type."""
    if kind not in TYPES:
        raise ValueError(f"a scalar is one of {', '.join(TYPES)}")
    one = matches(F.coalesce("text", F.lit("")), kind) & ~F.contains(F.coalesce("text", F.lit("")), F.lit("\n"))
    return answers.where(~one if kind != "string" else F.col("text").isNull()).select("answer_id", F.lit("scalar_type").alias("code"))


def check_mode(mode: str, contract: bool) -> None:
    """raw goes without a contract, all others need one."""
    if mode not in MODES:
        raise ValueError(f"an output mode is one of {', '.join(MODES)}, not {mode!r}")
    if contract == (mode == "raw"):
        raise ValueError("raw output has no contract" if contract else f"{mode} needs a contract")


def verdicts(answers: DataFrame, issues: DataFrame, differing: DataFrame | None = None) -> DataFrame:
    """answer_id, valid: no issue, and the text says what was committed (no row of differences())."""
    bad = issues.select("answer_id").distinct()
    if differing is not None:
        bad = bad.union(differing.select("answer_id")).distinct()
    return answers.select("answer_id").join(bad.withColumn("bad", F.lit(True)), "answer_id", "left").select("answer_id", F.col("bad").isNull().alias("valid"))


def feedback(issues: DataFrame, classes: int = 8) -> DataFrame:
    """answer_id, text: the most frequent codes of each answer with how often and on which lines, `classes` at most."""
    rank = F.row_number().over(Window.partitionBy("answer_id").orderBy(F.col("n").desc(), "code"))
    line = F.concat(F.col("code"), F.lit(" x"), F.col("n").cast("string"), F.when(F.size("lines") > 0, F.concat(F.lit(" (lines "), F.array_join(F.col("lines").cast("array<string>"), ", "), F.lit(")"))).otherwise(""))
    top = issues.withColumn("rank", rank).where(F.col("rank") <= classes).select("answer_id", F.struct("rank", line.alias("line")).alias("r"))
    return top.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]), "; ").alias("text"))


def differences(committed: DataFrame, presented: DataFrame) -> DataFrame:
    """answer_id, missing, extra: pairs (answer_id, a, b) that only one side has; equal answers give no row."""
    key = ["answer_id", "a", "b"]
    both = committed.select(*key).distinct().withColumn("c", F.lit(1)).join(presented.select(*key).distinct().withColumn("p", F.lit(1)), key, "full")
    d = both.groupBy("answer_id").agg(F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("c").isNull()).alias("extra"))
    return d.where("missing + extra > 0")


def task_status(answer: Column, predicted: Column, strict_f1: Column, loose_f1: Column, floor_f1: Column) -> Column:
    """failed (no answer, or nothing parsed), above_floor, invalid_format (only the loose reading is above) or at_or_below_floor."""
    none = answer.isNull() | (answer == "") | predicted.isNull() | (predicted == 0)
    return F.when(none, "failed").when(strict_f1 > floor_f1, "above_floor").when(loose_f1 > floor_f1, "invalid_format").otherwise("at_or_below_floor")
