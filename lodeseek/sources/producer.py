"""The sending side of the queue: typed messages, envelopes, and what ingress answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.sources.queue import ENVELOPE

#: What the queue answers to a message.
CODES = {"OK": 0, "EMPTY_MESSAGE": 1, "IP_INVALID": 2, "JSON_FORMAT_INVALID": 3}
LONGEST_ID_LIST = 100


def envelopes(bodies: DataFrame, queue: str, operation: str) -> DataFrame:
    """One message per row: the columns of ``bodies`` as the envelope's body, in ``raw``."""
    body = F.struct(*map(F.col, bodies.columns))
    return bodies.select(F.to_json(F.struct(F.lit(queue).alias("__QUEUE_NAME__"), F.lit(operation).alias("__OPERATION__"), body.alias("__OPERATION_BODY__"))).alias("raw"))


def insert_messages(docs: DataFrame) -> DataFrame:
    """INSERT bodies of documents."""
    return docs.select(F.lit("INSERT").alias("OPERATION"), *docs.columns)


def id_messages(ids: DataFrame, operation: str, key: str = "doc_id") -> DataFrame:
    """DELETE or RESTORE bodies, at most ``LONGEST_ID_LIST`` ids in each; lists are filled by hash of the id."""
    if operation not in ("DELETE", "RESTORE"):
        raise ValueError(f"{operation!r} takes no id list")
    spread = F.pmod(F.xxhash64(key), F.lit(ids.sparkSession.sparkContext.defaultParallelism * 8))
    gathered = ids.where(F.col(key).isNotNull()).groupBy(spread.alias("_s")).agg(F.collect_list(key).alias("_ids"))
    starts = F.sequence(F.lit(1), F.size("_ids"), F.lit(LONGEST_ID_LIST))
    return gathered.select(F.explode(F.transform(starts, lambda i: F.slice("_ids", i, F.lit(LONGEST_ID_LIST)))).alias("id_list")).select(F.lit(operation).alias("OPERATION"), "id_list")


def ingress(messages: DataFrame, raw: str = "raw", sender: str | None = None, allowed: list[str] | None = None) -> DataFrame:
    """``messages`` with ``status``, the code that the queue answers: checks go in order, the first that fails names
    the code.  With ``allowed``, only those senders are let in."""
    body = F.from_json(raw, ENVELOPE, {"allowComments": "true"})
    valid = body["__QUEUE_NAME__"].isNotNull() & body["__OPERATION__"].isNotNull() & F.coalesce(F.trim(body["__OPERATION_BODY__"]).startswith("{"), F.lit(False))
    checks: list[tuple[Column, str]] = [(F.coalesce(F.length(raw), F.lit(0)) == 0, "EMPTY_MESSAGE")]
    if allowed is not None:
        checks.append((~F.coalesce(F.col(sender).isin(allowed), F.lit(False)), "IP_INVALID"))
    checks.append((~F.coalesce(valid, F.lit(False)), "JSON_FORMAT_INVALID"))
    status = reduce(lambda rest, c: F.when(c[0], CODES[c[1]]).otherwise(rest), reversed(checks), F.lit(CODES["OK"]))
    return messages.withColumn("status", status)
