"""Score adjustment and term proximity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.operators.predicates import predicate

OPERATIONS = ("ADD", "MUL")


def ranking(rows: DataFrame, logics: list[dict], weight: str = "weight", bits: int | None = None) -> DataFrame:
    """Adjust ``weight`` by each logic ({field, method, value | min, max, operation, weight}) that holds, in order."""
    score: Column = F.col(weight)
    for x in logics:
        if x.get("field") not in rows.columns:
            raise ValueError(f"unknown ranking field {x.get('field')!r}")
        operation = OPERATIONS[x["operation"]] if isinstance(x.get("operation"), int) else x.get("operation")
        if operation not in OPERATIONS:
            raise ValueError(f"unknown ranking operation {x.get('operation')!r}")
        holds = predicate(F.col(x["field"]), x.get("method"), x.get("value"), x.get("min"), x.get("max"))
        changed = score + F.lit(x["weight"]) if operation == "ADD" else score * F.lit(x["weight"])
        score = F.when(holds, changed).otherwise(score)
    if bits:
        score = F.least(score, F.lit((1 << bits) - 1))
    return rows.withColumn(weight, score.cast(rows.schema[weight].dataType))


def proximity(lists: Column) -> Column:
    """Least sum of distances between consecutive terms, one position chosen per term, over an array of ascending
    position arrays; null if a term has no position.  For short lists: the cost is the product of neighbouring lists'
    lengths; ``proximity_scores`` sweeps.

    ``best[j]``, the least sum that ends at position j of the current list, is carried from list to list.
    """
    first = F.transform(lists[0], lambda p: F.struct(p.cast("long").alias("p"), F.lit(0).cast("long").alias("s")))

    def step(best: Column, positions: Column) -> Column:
        return F.transform(positions, lambda p: F.struct(p.cast("long").alias("p"), F.array_min(F.transform(best, lambda b: b["s"] + F.abs(b["p"] - p.cast("long")))).alias("s")))

    swept = F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))), first, step)
    return F.when(F.exists(lists, lambda x: F.size(x) == 0), None).otherwise(F.array_min(F.transform(swept, lambda b: b["s"])))


def proximity_scores(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, spread) of the documents that hold all ``terms``: the least sum of distances between consecutive terms,
    one position chosen per term.  ``postings`` has doc_id, term and positions.

    From term to term, the least sum that ends at each position follows from two sweeps in position order: over the
    positions before it (sum minus position) and behind it (sum plus position).  A document's positions are sorted, not
    paired, and all sweeps share one partitioning.
    """
    places = F.filter(F.sequence(F.lit(0), F.lit(len(terms) - 1)), lambda k: F.get(F.array(*map(F.lit, terms)), k) == F.col("term"))
    rows = postings.where(F.col("term").isin(terms)).select("doc_id", F.explode(places).alias("k"), "positions")
    rows = rows.select("doc_id", "k", F.explode(F.col("positions").cast("array<long>")).alias("p")).withColumn("s", F.when(F.col("k") == 0, F.lit(0).cast("long")))
    before = Window.partitionBy("doc_id").orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("doc_id").orderBy(F.desc("p")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    for k in range(1, len(terms)):
        last = F.when(F.col("k") == k - 1, F.col("s"))
        rows = rows.withColumns({"_l": F.min(last - F.col("p")).over(before), "_r": F.min(last + F.col("p")).over(behind)})
        rows = rows.withColumn("s", F.when(F.col("k") == k, F.least(F.col("_l") + F.col("p"), F.col("_r") - F.col("p"))).otherwise(F.col("s"))).drop("_l", "_r")
    return rows.where(F.col("k") == len(terms) - 1).groupBy("doc_id").agg(F.min("s").alias("spread")).where("spread is not null")
