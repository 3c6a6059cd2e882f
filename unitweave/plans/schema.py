"""Leaf schemas: what a judge may answer for an item. Pure functions on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Fixed values.
IMPLEMENTED = ("boolean", "enum", "object")
MAX_FIELDS, MAX_TEXT, REPLY_CHARS, REPLY_RESERVE, LINE_CHARS = 5, 60, 4096, 400, 10


@dataclass(frozen=True)
class Leaf:
    base: str
    values: tuple[str, ...] = ()
    nullable: bool = False
    fields: tuple[tuple[str, Leaf], ...] = field(default=())

    def widest(self) -> int:
        """Characters of the longest valid answer."""
        n = {"boolean": 3, "text": MAX_TEXT}.get(self.base, 0)
        if self.base == "enum":
            n = max(map(len, self.values))
        if self.base == "object":
            n = 2 + sum(len(name) + 6 + leaf.widest() for name, leaf in self.fields)
        return max(n, 4) if self.nullable else n

    def items_per_request(self) -> int:
        """How many answers fit one reply."""
        return max(1, (REPLY_CHARS - REPLY_RESERVE) // (LINE_CHARS + self.widest()))


def parse(schema: dict, inside: bool = False) -> Leaf:
    """A JSON-Schema fragment as a Leaf; what isn't supported is refused by name."""
    if not isinstance(schema, dict):
        raise TypeError("a schema is a dict such as {'type': 'boolean'}")
    types = schema.get("type")
    types = [types] if isinstance(types, str) else list(types or [])
    values = schema.get("enum")
    nullable = "null" in types and (values is None or None in values)
    types = [t for t in types if t != "null"]
    if values is not None:
        labels = tuple(v for v in values if v is not None)
        if not labels or not all(isinstance(v, str) and v.strip() for v in labels):
            raise ValueError("an enum lists labels that are not empty")
        if len({v.lower() for v in labels}) < len(labels):
            raise ValueError("labels of an enum must differ by more than case")
        return Leaf("enum", labels, nullable)
    if types == ["boolean"]:
        return Leaf("boolean", nullable=nullable)
    if types == ["object"] and not inside:
        fields = schema.get("properties") or {}
        if not 1 <= len(fields) <= MAX_FIELDS:
            raise ValueError(f"an object has 1 to {MAX_FIELDS} fields")
        if set(schema.get("required", fields)) != set(fields):
            raise ValueError("all fields of an object are required")
        leaves = tuple((name, parse(f, inside=True)) for name, f in fields.items())
        if all(leaf.base == "text" for _, leaf in leaves):
            raise ValueError("an object needs a field that is judged, not only text")
        return Leaf("object", nullable=nullable, fields=leaves)
    if types == ["string"] and inside:
        return Leaf("text", nullable=nullable)
    raise NotImplementedError(f"{types or 'no type'}: only {', '.join(IMPLEMENTED)} are implemented")
