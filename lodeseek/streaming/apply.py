"""Keeping documents current from a message stream.

Each micro-batch is folded into a state table, one row per document, in buckets; the buckets that it touches are
written anew beside the old ones, and a manifest names the files in force and the last position applied.  A batch that comes again after a failure
finds its batch id in the manifest, or only positions that are applied already, and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.operators.state import dedup_messages
from lodeseek.sources.manifest import Manifests

STATE = "doc_id long, last_operation string, has_insert boolean, file_no long, block_id long, values map<string,long>"
#: Columns of a message: its position, operation, document, and the attribute values that it sets.
MESSAGE = "file_no long, block_id long, operation string, doc_id long, id_list array<long>, indexed boolean, values map<string,long>"


def named(messages: DataFrame) -> DataFrame:
    """One row per message and document that it names."""
    documents = F.when(F.col("operation").isin("DELETE", "RESTORE"), F.col("id_list")).otherwise(F.array("doc_id"))
    return messages.withColumn("doc_id", F.explode(documents))


def fold(state: DataFrame, messages: DataFrame) -> DataFrame:
    """State after messages: the last act, whether there was an insert, the last value of each attribute.

    DELETE and RESTORE name their documents in id_list.  An insert or update that indexes no term sets attributes
    only.  Deletes of documents that were never inserted leave no trace.
    """
    rows = named(dedup_messages(messages, ["file_no", "block_id"]))
    acts = F.when(F.col("operation").isin("DELETE", "RESTORE") | F.coalesce("indexed", F.lit(True)), F.col("operation"))
    new = rows.select("doc_id", acts.alias("last_operation"), (F.col("operation").isin("INSERT", "UPDATE") & F.coalesce("indexed", F.lit(True))).alias("has_insert"), "file_no", "block_id", "values")
    both = state.unionByName(new)
    at = F.struct("file_no", "block_id")
    acted = both.groupBy("doc_id").agg(
        F.max_by("last_operation", F.when(F.col("last_operation").isNotNull(), at)).alias("last_operation"),
        F.max("has_insert").alias("has_insert"),
        F.max(at).alias("at"),
        F.array_sort(F.collect_list(F.when(F.size("values") > 0, F.struct("file_no", "block_id", F.map_entries("values").alias("entries"))))).alias("sets"),
    )
    # Later values win: entries are merged in position order, and of equal keys the last is kept.
    entries = F.flatten(F.transform("sets", lambda s: s["entries"]))
    merged = F.aggregate(entries, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<long>")), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))
    kept = acted.where("has_insert or size(sets) > 0")
    return kept.select("doc_id", "last_operation", "has_insert", F.col("at.file_no").alias("file_no"), F.col("at.block_id").alias("block_id"), merged.alias("values"))


def visible(state: DataFrame) -> DataFrame:
    return state.withColumn("visible", F.col("has_insert") & (F.coalesce("last_operation", F.lit("")) != "DELETE"))


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


class StateStore:
    """The state table in a shared folder, in buckets by document: a batch rewrites the buckets that it touches."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.manifests = spark, path.rstrip("/"), Manifests(spark, path)
        #: A store keeps the number of buckets that it began with.
        self.buckets = (self.manifests.newest() or {}).get("buckets", buckets)

    def manifest(self) -> dict:
        """``held`` names, by bucket, the version of its files in force."""
        return self.manifests.newest() or {"version": -1, "batch": -1, "file_no": -1, "block_id": -1, "buckets": self.buckets, "held": {}}

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The state, or that of some buckets."""
        held = self.manifest()["held"]
        paths = [f"{self.path}/v{v}/bucket={k}" for k, v in sorted(held.items()) if only is None or int(k) in only]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def commit(self, state: DataFrame, touched: list[int], batch: int, file_no: int, block_id: int) -> None:
        """``state`` is the new content of the ``touched`` buckets."""
        before = self.manifest()
        version = before["version"] + 1
        kept = {k: v for k, v in before["held"].items() if int(k) not in touched}
        dealt = state.withColumn("bucket", bucket_of(self.buckets)).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{version}")
        # A touched bucket may have come out empty: then it has no files.
        written = {str(r.bucket) for r in self.spark.read.parquet(f"{self.path}/v{version}").select("bucket").distinct().collect()} if touched else set()
        held = kept | {k: version for k in written}
        replaced = [f"v{v}/bucket={k}" for k, v in before["held"].items() if held.get(k) != v]
        self.manifests.write({"version": version, "batch": batch, "file_no": file_no, "block_id": block_id, "buckets": self.buckets, "held": held, "replaced": replaced})
        for old in before.get("replaced", []):  # readers of the version before last are done
            self.manifests.drop(old)


def apply_batch(store: StateStore, messages: DataFrame, batch: int) -> None:
    """Fold a micro-batch in, once.  Messages at or before the last applied position are refused."""
    done = store.manifest()
    if batch <= done["batch"]:
        return
    new = messages.where((F.col("file_no") > done["file_no"]) | ((F.col("file_no") == done["file_no"]) & (F.col("block_id") > done["block_id"])))
    last = new.agg(F.max(F.struct("file_no", "block_id")).alias("m")).first().m
    if last is None:
        return
    touched = [r[0] for r in named(new).select(bucket_of(store.buckets)).distinct().collect()]
    store.commit(fold(store.read(touched), new), touched, batch, last.file_no, last.block_id)


def follow(messages: DataFrame, store: StateStore, checkpoint: str, once: bool = False):
    """Start applying a message stream; ``once`` stops when the log is read."""
    writer = messages.writeStream.foreachBatch(lambda df, batch: apply_batch(store, df, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def dispatch(messages: DataFrame, callback, checkpoint: str, once: bool = False):
    """One follower: ``callback(batch, batch_id)`` gets each micro-batch, again until it returns without an error;
    its progress is its own checkpoint."""
    writer = messages.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
