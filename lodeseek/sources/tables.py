"""Stored tables: postings, attributes, document details, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_postings(postings: DataFrame, path: str, parts: int | None = None, mode: str = "overwrite") -> None:
    """Postings dealt and sorted by term, newest document first, so that a term's rows lie together and row-group
    statistics skip the rest.  A frequent term's rows may fill several tasks: dealing is by term and document range."""
    dealt = postings.repartitionByRange(*([parts] if parts else []), "term", F.desc("doc_id"))
    dealt.sortWithinPartitions("term", F.desc("doc_id")).write.mode(mode).option("compression", "zstd").parquet(path)


def bucket_postings(postings: DataFrame, table: str, buckets: int = 64) -> None:
    """Postings as a bucketed table: merges and compactions by term need no shuffle."""
    postings.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term", "doc_id").saveAsTable(table)


def read_postings(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """Stored postings; with ``terms``, the filter is pushed into the scan."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("term").isin(terms)) if terms else rows


def attribute_table(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_chars, siteno, quality, toxic): the source's number, and labels where there are any, else 0."""
    base = docs.select("doc_id", "n_chars", F.regexp_extract("source", r"(\d+)$", 1).cast("long").alias("siteno"))
    if labels is None:
        return base.withColumns({"quality": F.lit(0).cast("long"), "toxic": F.lit(0).cast("long")})
    rated = labels.select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
    return base.join(rated, "doc_id", "left").na.fill(0, ["quality", "toxic"])


def attr_lookup(rows: DataFrame, attributes: DataFrame) -> DataFrame:
    """Rows with their document's attributes; a document without any has zeros."""
    names = [c for c in attributes.columns if c != "doc_id"]
    return rows.join(attributes, "doc_id", "left").na.fill(0, names)


def detail_lookup(details: DataFrame, key: str, keys: list[int]) -> DataFrame:
    """Details by key; the list goes into the scan as a filter."""
    return details.where(F.col(key).isin(keys))


def result_json(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, json): each result row as a JSON object, keys in column order."""
    return rows.select(key, F.to_json(F.struct(*map(F.col, rows.columns))).alias("json"))


def result_envelope(page: DataFrame, matched: DataFrame, columns: list[str], sortby: str = "weight", tie: str = "doc_id") -> DataFrame:
    """One row, json: ``all_num`` (all that matched) and ``doc_list``, the page in its order.  A page is small."""
    order = F.struct(F.col(sortby), F.col(tie), F.struct(*columns).alias("row"))
    listed = page.agg(F.transform(F.sort_array(F.collect_list(order), asc=False), lambda x: x["row"]).alias("doc_list"))
    counted = matched.agg(F.count("*").alias("all_num"))
    return counted.crossJoin(F.broadcast(listed)).select(F.to_json(F.struct("all_num", "doc_list")).alias("json"))  # one row each


def sharded(rows: DataFrame, sign: Column, shards: int = 4) -> DataFrame:
    """Rows dealt to shards by signature, one partition each."""
    return rows.withColumn("shard", F.pmod(sign, F.lit(shards))).repartition(shards, "shard")


def show_postings(postings: DataFrame, term: str, n: int = 20) -> None:
    postings.where(F.col("term") == term).orderBy(F.desc("doc_id")).show(n, truncate=False)


def show_attributes(attributes: DataFrame, ids: list[int], n: int = 20) -> None:
    attributes.where(F.col("doc_id").isin(ids)).orderBy("doc_id").show(n, truncate=False)


def show_log(messages: DataFrame, file_no: int, first: int = 0, n: int = 20) -> None:
    """Blocks of one log file, in order."""
    messages.where((F.col("file_no") == file_no) & (F.col("block_id") >= first)).orderBy("block_id").show(n, truncate=False)
