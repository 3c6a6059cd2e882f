"""Small functions of one value: excerpts, signatures, canonical values, readings of answers."""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter
from collections.abc import Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREVIEW, EDGE, INLINE = 600, 240, 20_000


def preview(text: Column, limit: int = PREVIEW) -> Column:
    """The beginning, and how many characters are left out."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.left(t, F.lit(limit)), F.lit("\n...["), (F.length(t) - limit).cast("string"), F.lit(" more chars]")))


def truncated(text: Column, limit: int) -> Column:
    """The beginning and the end, half the limit each, around how many characters are left out."""
    half = F.lit(limit // 2)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, half), F.lit("\n...["), (F.length(text) - limit).cast("string"), F.lit(" chars omitted]...\n"), F.right(text, half)))


def signature(question: Column, text: Column) -> Column:
    """Identity of a question over a text, by content."""
    q = F.regexp_replace(F.coalesce(question, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return F.substring(F.sha2(F.concat(q, F.lit("\0"), F.sha2(F.coalesce(text, F.lit("")), 256)), 256), 1, 16)


def answer_tag(text: Column) -> Column:
    """What the first <answer> ... </answer> holds, stripped; null without one."""
    inside = F.regexp_extract(text, r"(?is)<answer>(.*?)</answer>", 1)
    return F.when(text.rlike(r"(?is)<answer>.*?</answer>"), F.regexp_replace(inside, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def has_number(text: Column, value: Column | int) -> Column:
    """Is a whole number among the digit runs of a text, thousands marks left out?"""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d[\d,.]*"), F.lit(0)), lambda x: F.translate(x, ",.", "").try_cast("decimal(38,0)"))
    return F.exists(found, lambda x: F.coalesce(x == (F.lit(value) if isinstance(value, int) else value), F.lit(False)))


def is_identifier(text: Column, value: Column | int) -> Column:
    """Is a number among the whole digit tokens of a text? 008 is 8, and not in 1008."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b\d+\b"), F.lit(0)), lambda x: x.try_cast("decimal(38,0)"))
    return F.exists(found, lambda x: F.coalesce(x == (F.lit(value) if isinstance(value, int) else value), F.lit(False)))


def has_text(text: Column, needle: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(needle.lower()))


def lexical_tell(answer: Column, truth: int, keyword_count: int) -> Column:
    """lexical_answer where the answer is what a search for words would count, else answered or other_wrong_answer."""
    return F.when(has_number(answer, keyword_count), "lexical_answer").when(has_number(answer, truth), "answered").otherwise("other_wrong_answer")


def label_of(response: Column, labels: Iterable[str]) -> Column:
    """The declared label that a reply names, if it names exactly one."""
    said = F.lower(F.coalesce(response, F.lit("")))
    found = F.array_compact(F.array(*[F.when(F.contains(said, F.lit(x)), F.lit(x)) for x in labels]))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def without(text: Column, *strings: str) -> Column:
    """text with each of the strings (paths of this machine, say) replaced by <host>, longest first."""
    for s in sorted({x for x in strings if x}, key=len, reverse=True):
        text = F.replace(text, F.lit(s), F.lit("<host>"))
    return text


def as_text(value: Any, what: str = "text") -> str:
    """A text, or a group of texts joined by blank lines; anything else is refused by name."""
    if isinstance(value, str):
        return value
    if isinstance(value, (list, tuple)):
        if not value:
            raise ValueError(f"{what} is an empty list")
        wrong = [k for k, x in enumerate(value) if not isinstance(x, str)]
        if wrong:
            hint = "; take the text out of each record first" if isinstance(value[wrong[0]], dict) else ""
            raise ValueError(f"{what}[{wrong[0]}] is {type(value[wrong[0]]).__name__}, not a text{hint}")
        return "\n\n".join(value)
    raise ValueError(f"{what} is {type(value).__name__}, not a text or a list of texts")


def canonical_value(value: Any, path: str = "value") -> Any:
    """A value of the JSON model: tuples are arrays, keys are strings, numbers are finite; the path of what isn't is named."""
    if isinstance(value, float) and not math.isfinite(value):
        raise TypeError(f"{path} is a number that JSON does not have")
    if value is None or isinstance(value, (str, bool, int, float)):
        return value
    if isinstance(value, (list, tuple)):
        return [canonical_value(x, f"{path}[{k}]") for k, x in enumerate(value)]
    if isinstance(value, dict):
        odd = [k for k in value if not isinstance(k, str)]
        if odd:
            raise TypeError(f"{path} has a key that is no string: {odd[0]!r}")
        return {k: canonical_value(x, f"{path}.{k}") for k, x in value.items()}
    raise TypeError(f"{path} is {type(value).__name__}, which JSON does not have")


def canonical_json(value: Any) -> str:
    return json.dumps(canonical_value(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def json_type(value: Any) -> str:
    kinds = ((bool, "boolean"), (int, "integer"), (float, "number"), (str, "string"), ((list, tuple), "array"), (dict, "object"))
    return "null" if value is None else next(n for k, n in kinds if isinstance(value, k))


def shape(value: Any, depth: int = 0) -> str:
    """What a value is made of, without what it says: at most 32 members are looked at, three levels deep."""
    if value is None or isinstance(value, (bool, int, float)):
        return "null" if value is None else type(value).__name__
    if isinstance(value, str):
        return f"str[{len(value):,} chars]"
    if not isinstance(value, (list, tuple, dict)) or depth >= 3:
        return type(value).__name__
    inner = sorted({shape(x, depth + 1) for x in list(value.values() if isinstance(value, dict) else value)[:32]})
    said = " | ".join(inner[:4]) + (" | ..." if len(inner) > 4 else "")
    return f"{type(value).__name__}[{len(value):,}]" + (f" of {said}" if inner else "")


def frame_shape(df: DataFrame) -> str:
    """The same of a table: columns and types, without a row."""
    return df.schema.simpleString()


def plan_key(df: DataFrame) -> int:
    """The same for plans that mean the same: what tells a repeated query."""
    return df.semanticHash()


def repeated_tail(text: Column, window: int = 24, least: int = 20, tail: int = 3000) -> Column:
    """The phrase of `window` characters that a text's end repeats most, if at least `least` times; the first of equals."""

    @F.pandas_udf("string")
    def phrase(texts: pd.Series) -> pd.Series:
        def most(t: str | None) -> str | None:
            counts = Counter((t or "")[k : k + window] for k in range(len(t or "") - window))
            best = max(counts, key=counts.get, default="")  # the first of those counted most
            return best if counts and counts[best] >= least else None

        return texts.map(most, na_action=None)

    return phrase(F.right(text, F.lit(tail)))
