"""Attribute filters: equal, at least, at most, zone, set, and their conjunction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Methods by number and by name.  BIGGER and SMALLER include the bound; a zone is closed.
METHODS = ("EQUAL", "BIGGER", "SMALLER", "ZONE", "SET")


def predicate(column: Column, method: int | str, value=None, low=None, high=None) -> Column:
    name = METHODS[method] if isinstance(method, int) and not isinstance(method, bool) and 0 <= method < len(METHODS) else method
    if name not in METHODS:
        raise ValueError(f"unknown filter method {method!r}")
    if name == "ZONE":
        if low is None or high is None:
            raise ValueError("a zone needs min and max")
        return column.between(low, high)
    if value is None:
        raise ValueError(f"{name} needs a value")
    if name == "SET":
        if not isinstance(value, (list, tuple, set)):
            raise ValueError("a set needs a list of values")
        return column.isin(*value)
    return {"EQUAL": column == value, "BIGGER": column >= value, "SMALLER": column <= value}[name]


def build_predicate(filters: list[dict], columns: list[str]) -> Column:
    """All filters of a query ({field, method, value | min, max}) ANDed.  An unknown field or method fails."""
    parts = []
    for f in filters:
        if f.get("field") not in columns:
            raise ValueError(f"unknown filter field {f.get('field')!r}")
        parts.append(predicate(F.col(f["field"]), f.get("method"), f.get("value"), f.get("min"), f.get("max")))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def apply_filters(rows: DataFrame, filters: list[dict]) -> DataFrame:
    return rows.where(build_predicate(filters, rows.columns)) if filters else rows


def filter_postings(postings: DataFrame, attributes: DataFrame, filters: list[dict]) -> DataFrame:
    """Postings of the documents whose attributes pass."""
    return postings.join(apply_filters(attributes, filters).select("doc_id"), "doc_id", "left_semi")
