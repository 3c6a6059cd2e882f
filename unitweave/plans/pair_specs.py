"""The twenty frozen pair tasks as data, reading of task files, and the check of specs against questions."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import SparkSession

from unitweave.operators.pairs import Asym, Sym

#: The labels.
DESC, ENTITY, HUMAN, NUMERIC, LOCATION, ABBR = LABELS = ("description and abstract concept", "entity", "human being", "numeric value", "location", "abbreviation")
#: Task -> who is paired.
TASKS: dict[int, Sym | Asym] = {
    1: Sym((NUMERIC, LOCATION)),
    2: Sym((ENTITY, HUMAN)),
    3: Sym((DESC, ABBR)),
    4: Sym((HUMAN, LOCATION), (HUMAN, "after", "2023-01-06")),
    5: Sym((ENTITY, NUMERIC), (ENTITY, "before", "2023-03-15")),
    6: Sym((LOCATION, ABBR)),
    7: Sym((DESC, NUMERIC), (NUMERIC, "after", "2023-02-01")),
    8: Sym((HUMAN, DESC)),
    9: Sym((ENTITY, LOCATION), (LOCATION, "after", "2023-04-10")),
    10: Sym((NUMERIC, ABBR), (ABBR, "before", "2023-05-20")),
    11: Asym(((ENTITY, ">=", 1), (ABBR, ">=", 1)), ((ENTITY, "==", 1),)),
    12: Asym(((NUMERIC, ">=", 2),), ((LOCATION, ">=", 1), (HUMAN, ">=", 1))),
    13: Asym(((DESC, "==", 1),), ((ABBR, ">=", 1), (ENTITY, ">=", 1))),
    14: Asym(((HUMAN, ">=", 1), (NUMERIC, ">=", 1)), ((LOCATION, "==", 2),)),
    15: Asym(((ENTITY, ">=", 1), (LOCATION, ">=", 1), (ABBR, ">=", 1)), ((NUMERIC, "==", 1),)),
    16: Asym(((DESC, ">=", 1), (HUMAN, ">=", 1)), ((ENTITY, ">=", 2), (ABBR, "==", 1))),
    17: Asym(((NUMERIC, "==", 1),), ((LOCATION, ">=", 1), (DESC, ">=", 1))),
    18: Asym(((ABBR, ">=", 1), (HUMAN, "==", 1)), ((ENTITY, ">=", 1), (NUMERIC, ">=", 1))),
    19: Asym(((LOCATION, ">=", 2), (ENTITY, ">=", 1)), ((DESC, "==", 1), (ABBR, "==", 1))),
    20: Asym(((NUMERIC, ">=", 1), (HUMAN, ">=", 1)), ((LOCATION, ">=", 1), (ENTITY, ">=", 1), (ABBR, "==", 1))),
}


def spec(value: dict) -> Sym | Asym:
    """A spec of a task file: {"kind": "sym", "any", "date_rule"} or {"kind": "asym", "a", "b"}."""
    if value["kind"] == "sym":
        return Sym(tuple(value["any"]), tuple(value["date_rule"]) if value.get("date_rule") else None)
    if value["kind"] == "asym":
        return Asym(*(tuple(tuple(c) for c in value[side]) for side in ("a", "b")))
    raise ValueError(f"no kind of spec: {value['kind']!r}")


def load(spark: SparkSession, path: str) -> list[dict]:
    """The tasks of a JSON file {"tasks": [{"task", "query", "spec"}]}, from any of Spark's file systems."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])["tasks"]


def check(tasks: list[dict]) -> list[tuple[int, str]]:
    """(task, problem): labels, kinds and date rules of specs that the task's question doesn't state, and date rules it states without one."""
    found = []
    for t in tasks:
        question, s = t["query"].lower(), spec(t["spec"])
        labels = s.any if isinstance(s, Sym) else [c[0] for c in (*s.a, *s.b)]
        found += [(t["task"], f"label {x!r} is not in the question") for x in labels if x not in question]
        shape = "both users have at least one" if isinstance(s, Sym) else "the other user"
        if shape not in question:
            found.append((t["task"], f"the question does not say {shape!r}"))
        if isinstance(s, Sym):
            if s.date_rule:
                day = datetime.date.fromisoformat(s.date_rule[2])
                if s.date_rule[1] not in question or f"{day:%B} {day.day}, {day.year}".lower() not in question:
                    found.append((t["task"], f"the date rule {s.date_rule} is not in the question"))
            elif " must be after " in question or " must be before " in question:
                found.append((t["task"], "the question has a date rule, the spec none"))
    return found
