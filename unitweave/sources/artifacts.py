"""Named results of a run, kept as tables with what verifies them."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitweave.functions.scalars import INLINE, canonical_json, canonical_value, json_type, sha256
from unitweave.sources.work import exists

#: Names of artifacts and references to them.
NAME = re.compile(r"[A-Za-z0-9_.-]{1,120}")
REF = re.compile(r"artifact://([A-Za-z0-9_.-]{1,120})")


class Artifacts:
    """A folder with a table for each name. A name is written once; a missing one raises."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name_or_ref: str) -> str:
        ref = REF.fullmatch((name_or_ref or "").strip())
        name = ref.group(1) if ref else name_or_ref
        if not NAME.fullmatch(name or "") or name in (".", ".."):
            raise ValueError(f"{name!r} is no name of an artifact: 1 to 120 letters, digits, '_', '.' or '-'")
        return f"{self.root}/{name}"

    def save(self, name: str, value: DataFrame) -> str:
        """Writes a table and gives its reference."""
        value.write.mode("errorifexists").parquet(self.path(name))
        return f"artifact://{name}"

    def save_text(self, name: str, text: str) -> str:
        made = self.spark.range(1).select(F.lit(text).alias("text"))
        return self.save(name, made.withColumns({"chars": F.length("text"), "sha256": F.sha2("text", 256)}))

    def load(self, name_or_ref: str) -> DataFrame:
        path = self.path(name_or_ref)
        if not exists(self.spark, path):
            raise KeyError(f"no artifact {name_or_ref!r}")
        return self.spark.read.parquet(path)

    def load_text(self, name_or_ref: str) -> str:
        """A saved text; its length and digest are verified."""
        row = self.load(name_or_ref).select("text", ((F.length("text") == F.col("chars")) & (F.sha2("text", 256) == F.col("sha256"))).alias("intact")).first()
        if not row.intact:
            raise ValueError(f"artifact {name_or_ref!r} has changed since it was saved")
        return row.text

    def load_value(self, name_or_ref: str) -> Any:
        """A saved text, or the JSON value that save_value() wrote under that name."""
        kind = "value" if "json" in self.load(name_or_ref).columns else "text"
        text = self.load_text(name_or_ref)
        return json.loads(text) if kind == "value" else text

    def save_value(self, name: str, value: Any) -> str:
        made = self.spark.range(1).select(F.lit(canonical_json(value)).alias("text"))
        return self.save(name, made.withColumns({"chars": F.length("text"), "sha256": F.sha2("text", 256), "json": F.lit(True)}))

    def resolve(self, value: Any) -> Any:
        """What a reference stands for; any other value is itself. A missing artifact raises."""
        return self.load_value(value) if isinstance(value, str) and REF.fullmatch(value.strip()) else value

    def undelivered(self, answers: DataFrame, known: DataFrame) -> DataFrame:
        """Answers (answer_id, text) that are references to no known artifact (ref)."""
        refs = answers.where(F.trim("text").rlike("^artifact://")).withColumn("r", F.trim("text"))
        return refs.join(known.select(F.col("ref").alias("k")), F.col("r") == F.col("k"), "left_anti").select("answer_id", "text")

    def record(self, value: Any, label: str = "answer-value", limit: int = INLINE) -> dict[str, Any]:
        """A record of a value: inline up to `limit` characters of canonical JSON, else an artifact; with its length and digest."""
        text = canonical_json(value)
        base = {"json_type": json_type(value), "chars": len(text), "sha256": sha256(text)}
        if len(text) <= limit:
            return base | {"storage": "inline", "value": canonical_value(value)}
        name = f"{label}-{base['sha256'][:16]}"
        return base | {"storage": "artifact", "ref": f"artifact://{name}" if exists(self.spark, self.path(name)) else self.save_value(name, value)}

    def read_record(self, record: dict[str, Any]) -> Any:
        """The value of a record; its length and digest are verified."""
        if record.get("storage") not in ("inline", "artifact"):
            raise ValueError(f"no storage {record.get('storage')!r}")
        value = record["value"] if record["storage"] == "inline" else self.load_value(record["ref"])
        text = canonical_json(value)
        if (len(text), sha256(text)) != (record.get("chars"), record.get("sha256")):
            raise ValueError("a record has changed since it was made")
        return value


class Submission:
    """An answer that is committed once: a table under a staging name, then a marker. What has no marker was never submitted."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def committed(self) -> bool:
        return exists(self.spark, f"{self.root}/committed/_SUCCESS")

    def submit(self, value: Any) -> None:
        """value: a DataFrame, or a value of the JSON model (also an empty one, 0 or None)."""
        if self.committed():
            raise RuntimeError("an answer is submitted once")
        table = value if isinstance(value, DataFrame) else self.spark.range(1).select(F.lit(canonical_json(value)).alias("json"))
        table.write.mode("overwrite").parquet(f"{self.root}/staged")
        kind = "table" if isinstance(value, DataFrame) else "value"
        self.spark.range(1).select(F.lit(kind).alias("kind")).write.mode("errorifexists").parquet(f"{self.root}/committed")

    def answer(self) -> Any:
        if not self.committed():
            raise KeyError("nothing has been submitted")
        table = self.spark.read.parquet(f"{self.root}/staged")
        return table if self.spark.read.parquet(f"{self.root}/committed").first().kind == "table" else json.loads(table.first().json)
