"""A stored index: segments of postings, the oldest and largest first, and the documents that each segment indexes.

New and changed documents come in as small segments; ``compact`` merges segments into one.  A document's postings count
in the newest segment that indexes it only, so a changed document loses the terms that it has no more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.operators.postings import LARGE_CAP, MOST_POSTINGS, cap_postings
from lodeseek.sources.manifest import Manifests
from lodeseek.sources.tables import read_postings, write_postings


#: So many ids of documents (16 bytes a row) are broadcast at most, so that postings, which are far more, stay in place.
MOST_IDS = 4_000_000


def _ids(docs: DataFrame) -> DataFrame:
    return F.broadcast(docs) if docs.count() <= MOST_IDS else docs


class SegmentedIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, self.path)

    def segments(self) -> list[int]:
        return (self.manifests.newest() or {"segments": []})["segments"]

    def exists(self) -> bool:
        return bool(self.segments())

    def _next(self) -> int:
        return (self.manifests.newest() or {"next": 0})["next"]

    def _write(self, postings: DataFrame, docs: DataFrame, parts: int | None) -> int:
        number = self._next()
        # Postings are made once: dealing by ranges takes a sample first, which reads the written rows.
        postings.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/s{number}/made")
        write_postings(self.spark.read.schema(postings.schema).parquet(f"{self.path}/s{number}/made"), f"{self.path}/s{number}/postings", parts)
        self.manifests.drop(f"s{number}/made")
        docs.select(F.col("doc_id").cast("long")).write.mode("overwrite").parquet(f"{self.path}/s{number}/docs")
        return number

    def add(self, postings: DataFrame, docs: DataFrame, parts: int | None = None) -> int:
        """A new segment of all postings of ``docs`` (doc_id); it is in force when its manifest is."""
        number = self._write(postings, docs, parts)
        self.manifests.write({"segments": [*self.segments(), number], "next": number + 1})
        return number

    def _docs(self, numbers: list[int]) -> DataFrame:
        """(doc_id, _newest): the newest of these segments that indexes the document."""
        rows = [self.spark.read.schema("doc_id long").parquet(f"{self.path}/s{n}/docs").withColumn("_newest", F.lit(n)) for n in numbers]
        return reduce(DataFrame.unionByName, rows).groupBy("doc_id").agg(F.max("_newest").alias("_newest"))

    def _stored(self, number: int, terms: list[str] | None = None) -> DataFrame:
        return read_postings(self.spark, f"{self.path}/s{number}/postings", terms)

    def _merged(self, numbers: list[int], terms: list[str] | None) -> DataFrame:
        rows = [self._stored(n, terms).withColumn("_segment", F.lit(n)) for n in numbers]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
        if len(numbers) > 1:
            # Only documents of the later segments supersede anything; the first and largest list of documents is not read.
            rows = rows.join(_ids(self._docs(numbers[1:])), "doc_id", "left").where("_newest is null or _segment = _newest").drop("_newest")
        return rows.drop("_segment")

    def read(self, terms: list[str] | None = None) -> DataFrame:
        """Postings in force; ``terms`` goes into the scans as a filter, which skips all other row groups."""
        return self._merged(self.segments(), terms)

    def documents(self) -> DataFrame:
        return self._docs(self.segments()).select("doc_id")

    def compact(self, last: int | None = None, most: int = MOST_POSTINGS, deleted: DataFrame | None = None, parts: int | None = None) -> None:
        """Merge the ``last`` newest segments (default: all) into one: superseded postings go, so do documents of
        ``deleted`` (doc_id), and a term keeps its ``most`` newest postings.

        Readers keep what they have; the merged segments' files go with the compaction after this one.
        """
        before = self.manifests.newest()
        if before is None:
            return
        segments = before["segments"]
        chosen = segments[-last:] if last else segments
        docs = self._docs(chosen)

        def rows(terms: list[str] | None = None) -> DataFrame:
            found = self._merged(chosen, terms)
            return found if deleted is None else found.join(gone, "doc_id", "left_anti")

        if deleted is not None:
            gone = _ids(deleted.select("doc_id").distinct())
            # A deleted document stays in the list while older segments may hold postings of it.
            docs = docs.join(gone, "doc_id", "left_anti") if chosen == segments else docs
        if most < LARGE_CAP:
            capped = cap_postings(rows(), most)
        else:
            # Stored rows, superseded ones among them, bound a term's postings: only terms beyond the cap are ranked.
            held = reduce(DataFrame.unionByName, [self._stored(n).select("term") for n in chosen])
            crowded = [r.term for r in held.groupBy("term").count().where(F.col("count") > most).select("term").collect()]
            capped = rows()
            if crowded:
                capped = capped.where(~F.col("term").isin(crowded)).unionByName(cap_postings(rows(crowded), most))
        number = self._write(capped, docs, parts)
        self.manifests.write({"segments": [*segments[: len(segments) - len(chosen)], number], "next": number + 1, "replaced": chosen})
        for old in before.get("replaced", []):
            self.manifests.drop(f"s{old}")
