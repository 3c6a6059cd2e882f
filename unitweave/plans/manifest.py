"""What a run was made of, how two runs differ, and results that may be put together."""

from __future__ import annotations

import hashlib
import json
import platform
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitweave.functions.scalars import canonical_json, sha256
from unitweave.operators.sweep import contract_fingerprint

#: Settings that results may depend on.
SETTINGS = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")


def code_sha256() -> str:
    """Of this package's source files."""
    root, found = Path(__file__).resolve().parents[1], hashlib.sha256()
    for f in sorted(root.rglob("*.py")):
        found.update(str(f.relative_to(root)).encode() + b"\0" + f.read_bytes())
    return found.hexdigest()


def build(spark: SparkSession, **facts: Any) -> dict[str, Any]:
    """A manifest: code, contract wording, versions, settings, and facts of the run's own."""
    return {"code_sha256": code_sha256(), "contract_sha256": contract_fingerprint(), "environment": {"python": platform.python_version(), "spark": spark.version}, "settings": {k: spark.conf.get(k, None) for k in SETTINGS}, "facts": facts}


def differences(a: Any, b: Any, path: str = "") -> list[str]:
    """The paths at which two manifests differ."""
    if isinstance(a, dict) and isinstance(b, dict):
        return [p for k in sorted({*a, *b}) for p in differences(a.get(k), b.get(k), f"{path}.{k}" if path else k)]
    return [] if a == b else [path]


def signature(manifest: dict[str, Any]) -> str:
    return sha256(canonical_json(manifest))


def write(spark: SparkSession, manifest: dict[str, Any], path: str) -> None:
    """As one line of JSON with sorted keys; a path is written once."""
    spark.range(1).select(F.lit(json.dumps(manifest, sort_keys=True)).alias("value")).write.mode("errorifexists").text(path)


def read(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path).first()[0])


def consolidation_problems(results: DataFrame, tasks: list[int]) -> DataFrame:
    """problem, detail of results (task, signature, clean, answer, answer_sha256, f1, recomputed_f1) that keep them from one table; none where all is well.

    Mixed manifests, code that was changed, tasks twice, absent or unknown, digests and scores that don't hold.
    """
    wanted = results.sparkSession.createDataFrame([(t,) for t in tasks], "wanted int")
    say = lambda problem, detail, df: df.select(F.lit(problem).alias("problem"), detail.cast("string").alias("detail"))
    found = [
        say("mixed manifests", F.col("n"), results.agg(F.countDistinct("signature").alias("n")).where("n > 1")),
        say("changed code", F.col("task"), results.where("NOT clean")),
        say("duplicate task", F.col("task"), results.groupBy("task").count().where("count > 1")),
        say("missing task", F.col("wanted"), wanted.join(results, F.col("wanted") == F.col("task"), "left_anti")),
        say("unknown task", F.col("task"), results.join(wanted, F.col("wanted") == F.col("task"), "left_anti")),
        say("answer digest", F.col("task"), results.where(~F.sha2("answer", 256).eqNullSafe(F.col("answer_sha256")))),
        say("score", F.col("task"), results.where(~F.round("f1", 4).eqNullSafe(F.round("recomputed_f1", 4)))),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
