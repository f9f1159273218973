"""The message queue as tables: envelopes, subscriptions, log files, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = T.StructType([T.StructField("__QUEUE_NAME__", T.StringType()), T.StructField("__OPERATION__", T.StringType()), T.StructField("__OPERATION_BODY__", T.StringType())])
POSITION = ["file_no", "block_id"]


def envelope_validate(messages: DataFrame, raw: str, body: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): envelopes with a queue name, an operation and an object as body, the body parsed by its
    schema into ``body``; the others with what was sent."""
    parsed = messages.withColumn("_e", F.from_json(raw, ENVELOPE, {"allowComments": "true"}))
    parsed = parsed.withColumn("_b", F.col("_e.__OPERATION_BODY__"))
    valid = F.col("_e.__QUEUE_NAME__").isNotNull() & F.col("_e.__OPERATION__").isNotNull() & F.coalesce(F.trim("_b").startswith("{"), F.lit(False))
    good = parsed.where(valid).withColumn("queue", F.col("_e.__QUEUE_NAME__")).withColumn("operation", F.col("_e.__OPERATION__")).withColumn("body", F.from_json("_b", body, {"allowComments": "true"}))
    return good.drop("_e", "_b", raw), parsed.where(~valid | valid.isNull()).drop("_e", "_b")


def project_body(valid: DataFrame, drop_keys: list[str] | None = None) -> DataFrame:
    """What a follower is sent: position and body, without the keys that are configured away."""
    body = F.col("body").dropFields(*drop_keys) if drop_keys else F.col("body")
    return valid.select(*[c for c in POSITION if c in valid.columns], body.alias("body")).select("*", "body.*").drop("body")


def event_subscribe(messages: DataFrame, subscriptions: list[tuple[str, str]], queue: str = "queue", operation: str = "operation") -> DataFrame:
    """Messages of the subscribed (queue, operation) pairs; ("all", "all") takes everything."""
    if ("all", "all") in subscriptions:
        return messages
    return messages.where(F.concat_ws(" # ", F.col(queue), F.col(operation)).isin([" # ".join(s) for s in subscriptions]))


def append_log(messages: DataFrame, path: str) -> None:
    """Append messages to the log: a file appears whole or not at all."""
    messages.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def tail_log(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 16) -> DataFrame:
    """The log as a stream; where it stands is in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def lag_monitor(polls: DataFrame, channel: str, at: str, queue_position: str, follower_position: str) -> DataFrame:
    """A status for each poll of each channel: STOP if the queue has grown since the poll before and the follower has
    not, OK if the follower has moved, else what it was (OK at first)."""
    order = Window.partitionBy(channel).orderBy(at)
    grown = F.col(queue_position) != F.lag(queue_position).over(order)
    moved = F.col(follower_position) != F.lag(follower_position).over(order)
    seen = polls.withColumn("_change", F.when(grown & moved, "OK").when(grown & ~moved, "STOP"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return seen.withColumn("status", F.coalesce(F.last("_change", ignorenulls=True).over(upto), F.lit("OK"))).drop("_change")
