"""How an answer is to be written: free text, JSON, a scalar or records, declared once and checked."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitweave.functions.scalars import canonical_json, canonical_value
from unitweave.operators import delivery
from unitweave.operators.sweep import Judge

#: Kinds of presentation, and what each declares.
KINDS = {"free_text": (), "json": ("root",), "scalar": ("value_type",), "records": ("fields", "separator", "prefix", "suffix", "ascending", "duplicates", "allow_empty")}


def normalise(spec: Any) -> dict[str, Any]:
    """A declaration with its defaults; anything not declared is refused by name."""
    if not isinstance(spec, dict) or spec.get("kind") not in KINDS:
        raise ValueError(f"a presentation has a kind: {', '.join(KINDS)}")
    odd = set(spec) - {"kind", *KINDS[spec["kind"]]}
    if odd:
        raise ValueError(f"{spec['kind']} declares no {', '.join(sorted(odd))}")
    if spec["kind"] == "json" and spec.get("root", "object") not in ("object", "array", "scalar"):
        raise ValueError("a JSON root is object, array or scalar")
    if spec["kind"] == "scalar" and spec.get("value_type") not in delivery.TYPES:
        raise ValueError(f"a scalar is one of {', '.join(delivery.TYPES)}")
    if spec["kind"] == "records":
        r = delivery.Records(**{k: tuple(v) if k == "fields" else v for k, v in spec.items() if k != "kind"})
        return {"kind": "records", **{k: list(v) if k == "fields" else v for k, v in vars(r).items()}}
    return {"kind": spec["kind"]} | ({"root": spec.get("root", "object")} if spec["kind"] == "json" else {}) | ({"value_type": spec["value_type"]} if spec["kind"] == "scalar" else {})


def records_of(spec: dict[str, Any]) -> delivery.Records:
    return delivery.Records(**{k: tuple(v) if k == "fields" else v for k, v in spec.items() if k != "kind"})


def check(answers: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """answer_id, code: what is wrong with each text under a declaration."""
    spec = normalise(spec)
    if spec["kind"] == "records":
        return delivery.check_records(answers, records_of(spec)).select("answer_id", "code")
    if spec["kind"] == "json":
        return delivery.check_json(answers, spec["root"])
    if spec["kind"] == "scalar":
        return delivery.check_scalar(answers, spec["value_type"])
    return answers.where("text IS NULL").select("answer_id", F.lit("text_required").alias("code"))


def render(spark: SparkSession, value: Any, spec: dict[str, Any]) -> str:
    """The text of a committed value; what is rendered is checked again before it is given back."""
    spec, value = normalise(spec), canonical_value(value)
    if spec["kind"] == "records":
        if not isinstance(value, list) or any(not isinstance(r, list) or len(r) != len(spec["fields"]) for r in value):
            raise ValueError("records are rendered from a list of lists of that many fields")
        rows = spark.createDataFrame([(0, k, [str(x) for x in r]) for k, r in enumerate(value)], "answer_id int, pos int, fields array<string>")
        made = delivery.render_records(rows, records_of(spec)).collect()
        text = made[0].text if made else ""
    elif spec["kind"] == "json":
        text = canonical_json(value)
    else:
        if isinstance(value, (list, dict)):
            raise ValueError(f"{spec['kind']} is rendered from one value")
        text = value if isinstance(value, str) else json.dumps(value)
    issues = check(spark.createDataFrame([(0, text)], "answer_id int, text string"), spec).collect()
    if issues:
        raise ValueError(f"what was rendered has {', '.join(sorted({r.code for r in issues}))}")
    return text


def infer(spark: SparkSession, judge: Judge, question: str) -> dict[str, Any]:
    """The presentation that a question asks for, by one call of a judge; free text where the reply declares none or a wrong one.

    {"spec", "declared", "problem"}: a problem is recorded, not raised.
    """
    job = spark.createDataFrame([("presentation", "Declare, as one JSON object with a kind of " + ", ".join(KINDS) + ", how the answer is to be written.", question)], "request string, instruction string, source string")
    reply = judge(job.withColumn("items", F.array(F.struct(F.lit(0).cast("long").alias("item"), F.col("source").alias("source"))))).first()
    try:
        declared = json.loads((reply.reply if reply else "") or "")
        return {"spec": normalise(declared), "declared": declared, "problem": None}
    except (ValueError, TypeError) as e:
        return {"spec": {"kind": "free_text"}, "declared": reply.reply if reply else None, "problem": str(e)}
