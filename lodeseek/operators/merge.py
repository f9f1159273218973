"""Merging posting lists: first-wins union, weighted disjunctive merge, conjunctive match, group counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SYNONYMS = 3
CANDIDATES = 2000


def or_merge(lists: list[DataFrame]) -> DataFrame:
    """Union of posting lists; a document in several keeps the cell of the earliest: list_no and the other columns."""
    rows = reduce(DataFrame.unionByName, [x.withColumn("list_no", F.lit(i)) for i, x in enumerate(lists)])
    rest = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(*rest), "list_no").alias("_c")).select("doc_id", *(F.col(f"_c.{c}").alias(c) for c in rest))


def expand_terms(terms: list[dict]) -> list[tuple[str, int, int, int]]:
    """(term, term_no, list_no, weight) of a query's terms and their first synonyms; weight 0 acts as 1."""
    out = []
    for no, t in enumerate(terms):
        term, weight = t.get("term"), t.get("weight")
        if not isinstance(term, str) or not isinstance(weight, int) or isinstance(weight, bool):
            raise ValueError("each term needs a string term and an integer weight")
        if weight < 0:
            raise ValueError("weights are not negative")
        out += [(x, no, k, max(weight, 1)) for k, x in enumerate([term, *(t.get("synonyms") or [])[:MAX_SYNONYMS]])]
    return out


def term_scores(postings: DataFrame, terms: list[dict]) -> DataFrame:
    """(doc_id, term_no, score): a query term hits a document once, through the earliest of its synonyms.

    The query's terms are a handful of literals, so they are broadcast; posting weight 0 (or none) acts as 1.
    """
    spark = postings.sparkSession
    wanted = spark.createDataFrame(expand_terms(terms), "term string, term_no int, list_no int, term_weight long")
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0)), F.lit(1)) if "weight" in postings.columns else F.lit(1)
    hits = postings.where(F.col("term").isin([t for t, *_ in expand_terms(terms)])).select("doc_id", "term", weight.cast("long").alias("_w")).join(F.broadcast(wanted), "term")
    if not any(t.get("synonyms") for t in terms):
        return hits.select("doc_id", "term_no", (F.col("term_weight") * F.col("_w")).alias("score"))
    return hits.groupBy("doc_id", "term_no").agg(F.min_by(F.col("term_weight") * F.col("_w"), "list_no").alias("score"))


def weight_merge(postings: DataFrame, terms: list[dict], most: int | None = CANDIDATES) -> DataFrame:
    """(doc_id, weight): sum over hit terms of term weight times posting weight; the ``most`` best, ties to the newer
    document.  A document need not hold every term."""
    merged = term_scores(postings, terms).groupBy("doc_id").agg(F.sum("score").alias("weight"))
    return merged if most is None else merged.orderBy(F.desc("weight"), F.desc("doc_id")).limit(most)


def must_hit_all(postings: DataFrame, terms: list[dict]) -> DataFrame:
    """(doc_id, weight) of the documents that every query term hits."""
    merged = term_scores(postings, terms).groupBy("doc_id").agg(F.sum("score").alias("weight"), F.count_distinct("term_no").alias("_n"))
    return merged.where(F.col("_n") == len(terms)).drop("_n")


def group_count(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): rows per value."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def doc_bitmaps(rows: DataFrame, key: str, id_col: str = "doc_id") -> DataFrame:
    """(key, bucket, bitmap): the documents of each key as bitmaps of 32,768 bits; tasks combine theirs before the shuffle."""
    return rows.groupBy(key, F.bitmap_bucket_number(F.col(id_col)).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(id_col))).alias("bitmap"))
