"""A session of SQL over the tables of sweeps: statements with structured observations, and repeats named."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from unitweave.functions.scalars import frame_shape, plan_key


@dataclass
class Workbench:
    spark: SparkSession
    sample: int = 5
    seen: dict[int, int] = field(default_factory=dict)
    turns: list[dict[str, Any]] = field(default_factory=list)

    def execute(self, statement: str) -> dict[str, Any]:
        """ok, schema, sample (the first rows), repeated (the turn of an equal statement before), or the error. Never raises for a statement."""
        turn = len(self.turns)
        try:
            df = self.spark.sql(statement)
            key = plan_key(df)
            out = {"ok": True, "schema": frame_shape(df), "sample": [r.asDict(recursive=True) for r in df.limit(self.sample).collect()], "repeated": self.seen.get(key)}
            self.seen.setdefault(key, turn)
        except Exception as e:  # noqa: BLE001
            first = str(e).strip().split("\n")[0]
            out = {"ok": False, "error": f"{type(e).__name__}: {first[:300]}", "tables": sorted(t.name for t in self.spark.catalog.listTables())}
        self.turns.append({"statement": statement, **out})
        return out

    def isolate(self) -> None:
        """Nothing cached stays: for runs that must not warm each other up."""
        self.spark.catalog.clearCache()
        left = self.spark.sparkContext._jsc.sc().getPersistentRDDs().size()
        if left:
            raise RuntimeError(f"{left} cached tables are left")
