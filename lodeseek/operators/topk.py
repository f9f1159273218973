"""Sorting, top-k and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 2000


def topk_field(rows: DataFrame, key: str, k: int, tie: str = "doc_id") -> DataFrame:
    """The ``k`` rows with the largest ``key``, descending, ties to the larger ``tie``."""
    return rows.orderBy(F.desc(key), F.desc(tie)).limit(k)


def topk_nested(rows: DataFrame, first: str, k: int, then: str, tie: str) -> DataFrame:
    """The top ``k`` by one key, ranked by another: adds ``rank`` (1: largest).  The second order is over k rows."""
    order = Window.orderBy(F.desc(then), F.desc(tie))
    return topk_field(rows, first, k, tie).withColumn("rank", F.row_number().over(order))


def page_bounds(offset: int = 0, size: int = MOST) -> tuple[int, int]:
    """Offsets outside 0 .. 2000 act as 0, sizes outside 1 .. 2000 as 2000, and a page that ends beyond 2000 is the
    whole list."""
    offset = offset if 0 <= offset <= MOST else 0
    size = size if 1 <= size <= MOST else MOST
    return (0, MOST) if offset + size > MOST else (offset, size)


def page(rows: DataFrame, offset: int = 0, size: int = MOST, key: str | None = None, tie: str = "doc_id") -> DataFrame:
    """A page of the rows by ``key`` descending (default: weight), ties to the larger ``tie``."""
    offset, size = page_bounds(offset, size)
    return rows.orderBy(F.desc(key or "weight"), F.desc(tie)).offset(offset).limit(size)
