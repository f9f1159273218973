"""Index configuration: which fields are indexed how, and which attributes a document has."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

PREFIX_TYPES = {"INT": T.LongType(), "STR": T.StringType(), "LIST_INT": T.ArrayType(T.LongType()), "LIST_STR": T.ArrayType(T.StringType())}
_COMMENT = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', re.S)


def loads_with_comments(text: str) -> dict:
    """JSON with // and /* */ comments."""
    return json.loads(_COMMENT.sub(lambda m: m[1] or "", text))


@dataclass(frozen=True)
class FieldRule:
    """One indexed field: op NLP (tokens), PREFIX (token in front of values) or DOC_ID."""

    name: str
    op: str
    optional: bool = False
    position: bool = False
    hit_field: str | None = None
    hit_weight: int = 0
    type: str | None = None
    token: str = ""
    source: str | None = None

    @property
    def column(self) -> str:
        return self.source or self.name


@dataclass(frozen=True)
class IndexSpec:
    """Validated configuration.  ``cell`` and ``attributes`` give each field's width in bits (1 to 32)."""

    rules: tuple[FieldRule, ...]
    cell: dict[str, int] = field(default_factory=dict)
    attributes: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        names = [r.name for r in self.rules]
        if len(set(names)) < len(names):
            raise ValueError("a field is configured twice")
        if [r.op for r in self.rules].count("DOC_ID") != 1:
            raise ValueError("exactly one DOC_ID field is needed")
        if sum(r.position for r in self.rules) > 1:
            raise ValueError("at most one field may keep positions")
        if "weight" not in self.cell:
            raise ValueError("the posting cell needs a weight")
        for r in self.rules:
            if r.op not in ("DOC_ID", "NLP", "PREFIX"):
                raise ValueError(f"unknown operation {r.op!r} of field {r.name!r}")
            if r.op == "PREFIX" and r.type not in PREFIX_TYPES:
                raise ValueError(f"unknown type {r.type!r} of field {r.name!r}")
            if r.hit_field and (r.hit_weight <= 0 or r.hit_field not in self.cell):
                raise ValueError(f"field {r.name!r}: a hit field needs a place in the cell and a positive weight")
            if r.position and not {"offset1", "offset2"} <= self.cell.keys():
                raise ValueError("positions need offset1 and offset2 in the cell")
        for name, bits in (self.cell | self.attributes).items():
            if not 1 <= bits <= 32:
                raise ValueError(f"field {name!r} has {bits} bits")

    @property
    def doc_id(self) -> FieldRule:
        return next(r for r in self.rules if r.op == "DOC_ID")

    def largest(self, name: str) -> int:
        """Largest value that a cell field or attribute holds."""
        return (1 << {**self.attributes, **self.cell}[name]) - 1

    @classmethod
    def from_config(cls, text: str) -> IndexSpec:
        config = loads_with_comments(text)
        rules = []
        for entry in config["FLEXINDEX"]:
            for name, rule in entry.items():
                rules.append(FieldRule(name=name, op=rule["op"], optional=bool(rule.get("optional", 0)), position=bool(rule.get("position", 0)), hit_field=rule.get("hit_field"), hit_weight=int(rule.get("hit_weight", 0)), type=rule.get("type"), token=rule.get("token", "")))
        masks = config["STRUCTMASK"]
        widths = [{k: v for e in masks.get(part, []) for k, v in e.items()} for part in ("posting_list_cell", "document_attribute")]
        return cls(tuple(rules), *widths)

    def message_schema(self) -> T.StructType:
        """Schema of the messages that this configuration accepts."""
        kinds = {"DOC_ID": T.LongType(), "NLP": T.StringType()}
        fields = {r.name: kinds.get(r.op) or PREFIX_TYPES[r.type] for r in self.rules}
        fields |= {a: T.LongType() for a in self.attributes if a not in fields}
        return T.StructType([T.StructField("OPERATION", T.StringType()), *(T.StructField(n, k) for n, k in fields.items()), T.StructField("id_list", T.ArrayType(T.LongType()))])
