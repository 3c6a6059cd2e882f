"""Budgets of a run: counters that a tree of nodes shares, allowances of each node, and the relational cut that spends them."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.operators import scan


@dataclass
class Ledger:
    """What a whole tree has spent."""

    turns: int = 0
    tokens: int = 0
    calls: int = 0
    nodes: int = 1
    started: float = field(default_factory=time.monotonic)

    def seconds(self) -> float:
        return time.monotonic() - self.started

    def reserve(self, n: int, limit: int) -> int:
        """Claims up to n calls; how many are granted."""
        granted = max(0, min(n, limit - self.calls))
        self.calls += granted
        return granted

    def release(self, n: int) -> None:
        """Gives back claims whose requests were never sent."""
        self.calls = max(0, self.calls - n)

    def snapshot(self) -> dict[str, float]:
        return {"turns": self.turns, "tokens": self.tokens, "calls": self.calls, "nodes": self.nodes, "seconds": round(self.seconds(), 2)}


@dataclass
class Budget:
    max_turns: int = 12
    max_seconds: float = 900.0
    max_tokens: int = 120_000
    max_calls: int = 600
    max_nodes: int = 8
    max_depth: int = 2
    max_in_flight: int = 4
    depth: int = 0
    turns_here: int = 0
    ledger: Ledger = field(default_factory=Ledger)

    def fresh(self) -> Budget:
        """The same allowances for a new run."""
        return replace(self, depth=0, turns_here=0, ledger=Ledger())

    def child(self) -> Budget:
        """Half the turns (two at least) of its own, one level deeper, the same ledger."""
        refused = self.may_recurse()
        if refused:
            raise RuntimeError(refused)
        self.ledger.nodes += 1
        return replace(self, max_turns=max(2, self.max_turns // 2), depth=self.depth + 1, turns_here=0)

    def spend_turn(self) -> None:
        self.turns_here += 1
        self.ledger.turns += 1

    def calls_exhausted(self) -> str | None:
        """Why no more calls may start inside a turn: the first of time, tokens, calls, nodes."""
        spent = (("max_seconds", self.ledger.seconds() >= self.max_seconds), ("max_tokens", self.ledger.tokens >= self.max_tokens), ("max_calls", self.ledger.calls >= self.max_calls), ("max_nodes", self.ledger.nodes > self.max_nodes))
        return next((why for why, over in spent if over), None)

    def exhausted(self) -> str | None:
        """Why this node stops: its own turns first, then what the tree has spent."""
        return "max_turns" if self.turns_here >= self.max_turns else self.calls_exhausted()

    def may_recurse(self) -> str | None:
        """Why no child may start, or None."""
        return "max_depth" if self.depth >= self.max_depth else "max_nodes" if self.ledger.nodes >= self.max_nodes else None

    def admit(self, jobs: DataFrame, order: str = "job_seq") -> DataFrame:
        """jobs with `sent`: the first ones by order, as many as calls are left, by their positions. Claims are not booked here."""
        left = max(0, self.max_calls - self.ledger.calls)
        return scan.numbered(jobs, order).withColumn("sent", F.col("position") < left).drop("position")
