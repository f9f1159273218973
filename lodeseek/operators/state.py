"""Document state from an ordered message log: versions, attributes, deletion, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_version(messages: DataFrame, key: str, position: str, keep: list[str]) -> DataFrame:
    """The last message of each key: key, position and the columns of ``keep``.  Combined before the shuffle."""
    last = messages.groupBy(key).agg(F.max_by(F.struct(position, *keep), position).alias("_m"))
    return last.select(key, F.col(f"_m.{position}").alias(position), *(F.col(f"_m.{c}").alias(c) for c in keep))


def attr_carry_forward(messages: DataFrame, key: str, position: str, fields: dict[str, Column]) -> DataFrame:
    """The last value that each field was given, on its own: a message leaves out the fields it does not change."""
    return messages.groupBy(key).agg(*(F.max_by(value, F.when(value.isNotNull(), F.col(position))).alias(name) for name, value in fields.items()))


def delete_restore_state(messages: DataFrame, key: str, position: str, operation: str = "operation") -> DataFrame:
    """(key, last_operation, has_insert, visible): visible if an indexing insert exists and the last of insert,
    delete and restore is not a delete.  Other operations do not count."""
    acts = messages.where(F.col(operation).isin("INSERT", "UPDATE", "DELETE", "RESTORE"))
    found = acts.groupBy(key).agg(F.max_by(operation, position).alias("last_operation"), F.max(F.col(operation).isin("INSERT", "UPDATE")).alias("has_insert"))
    return found.withColumn("visible", F.col("has_insert") & (F.col("last_operation") != "DELETE"))


def filter_live(rows: DataFrame, state: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """Rows whose key is visible; with ``version``, a column of both, only those that the state's version has not
    superseded."""
    live = state.where("visible")
    if version is None:
        return rows.join(live.select(key), key, "left_semi")
    return rows.join(live.select(key, version), [key, version], "left_semi")


def drop_superseded(versions: DataFrame, newest: DataFrame, key: str, position: str) -> DataFrame:
    """Versions that no newer one of the same key supersedes."""
    later = newest.select(F.col(key).alias("_k"), F.col(position).alias("_p"))
    return versions.join(later, (F.col(key) == F.col("_k")) & (F.col(position) < F.col("_p")), "left_anti")


def dedup_messages(messages: DataFrame, position: list[str]) -> DataFrame:
    """One row per position: at-least-once delivery made idempotent."""
    return messages.dropDuplicates(position)


def queue_seek(messages: DataFrame, position: list[str], after: tuple) -> DataFrame:
    """Messages behind a position; the comparison reaches the scan."""
    if len(position) == 1:
        return messages.where(F.col(position[0]) > after[0])
    file_no, block = position
    return messages.where((F.col(file_no) >= after[0]) & ((F.col(file_no) > after[0]) | (F.col(block) > after[1])))


def replay_sequence(messages: DataFrame, position: str, width: int = 1 << 16) -> DataFrame:
    """The log with ``seq``, its order from 0.  Numbers are made per range of ``width`` positions; only the ranges'
    counts, one row each, are summed up in one place."""
    ranged = messages.withColumn("_r", F.floor(F.col(position) / width))
    counts = ranged.groupBy("_r").agg(F.count("*").alias("_n"))
    before = counts.select("_r", (F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))).alias("_b"))
    within = F.row_number().over(Window.partitionBy("_r").orderBy(position))
    return ranged.withColumn("_i", within).join(before, "_r").withColumn("seq", F.coalesce("_b", F.lit(0)) + F.col("_i") - 1).drop("_r", "_i", "_b")
