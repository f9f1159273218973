"""The engine as one object: add, delete and restore documents, and query them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.operators.postings import build_postings
from lodeseek.plans.query import SearchQuery
from lodeseek.plans.spec import IndexSpec
from lodeseek.sources.segments import SegmentedIndex
from lodeseek.streaming.apply import STATE, fold, visible


class SearchEngine:
    """Documents (columns of the spec's fields and attributes) and a message log, both as DataFrames.

    The methods return new engines; nothing runs until a result is read.  With ``index``, postings are stored: the
    constructor's documents are those it indexes already (or ``store`` writes them), and ``add`` writes the new
    documents' postings as a segment.  Without, each query makes the postings of its terms' documents anew.

    A document is visible if it was given or inserted and the last of insert, delete and restore is not a delete.
    Attribute values of messages count before those that the document came with.
    """

    def __init__(self, spec: IndexSpec, docs: DataFrame, state: DataFrame | None = None, tokenizer=None, index: SegmentedIndex | None = None):
        self.spec, self.docs, self.state, self.tokenizer, self.index = spec, docs, state, tokenizer, index

    def store(self, index: SegmentedIndex) -> SearchEngine:
        """The same engine with its postings stored in ``index``, as one segment."""
        index.add(build_postings(self.docs, self.spec, self.tokenizer), self.docs.select(self._key().alias("doc_id")))
        return SearchEngine(self.spec, self.docs, self.state, self.tokenizer, index)

    def _key(self) -> Column:
        return F.col(self.spec.doc_id.column).cast("long")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        if self.index is not None:
            return self.index.read(terms)
        return build_postings(self.docs, self.spec, self.tokenizer)

    @property
    def current(self) -> DataFrame:
        """The folded state: every document that was given counts as inserted before any message."""
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<long>"))
        given = self.docs.select(self._key().alias("doc_id"), F.lit("INSERT").alias("last_operation"), F.lit(True).alias("has_insert"), F.lit(-1).cast("long").alias("file_no"), F.lit(-1).cast("long").alias("block_id"), none.alias("values"))
        return given if self.state is None else given.unionByName(self.state)

    @property
    def attributes(self) -> DataFrame:
        """Attributes, those of messages before those of documents, clamped to their widths, missing ones 0."""
        names = list(self.spec.attributes)
        rows = self.docs.select(self._key().alias("doc_id"), *(F.col(a).cast("long").alias(a) for a in names))
        if self.state is not None:
            rows = rows.join(self.state.select("doc_id", "values"), "doc_id", "left")
            rows = rows.select("doc_id", *(F.coalesce(F.col("values")[a], F.col(a)).alias(a) for a in names))
        clamp = [F.least(F.greatest(F.coalesce(F.col(a), F.lit(0)), F.lit(0)), F.lit(self.spec.largest(a))).alias(a) for a in names]
        return rows.select("doc_id", *clamp)

    def _applied(self, docs: DataFrame, messages: DataFrame) -> SearchEngine:
        state = fold(self.current if self.state is not None else SearchEngine(self.spec, self.docs).current, messages)
        return SearchEngine(self.spec, docs, state, self.tokenizer, self.index)

    def add(self, docs: DataFrame, messages: DataFrame) -> SearchEngine:
        """New versions of documents replace old ones; ``messages`` are their INSERTs or UPDATEs.  Attributes that a
        new version has count like values of its message, and those that it lacks carry on from before."""
        key = self.spec.doc_id.column
        names = [a for a in self.spec.attributes if a in docs.columns]
        own = docs.select(self._key().alias("doc_id"), F.map_from_arrays(F.array(*map(F.lit, names)).cast("array<string>"), F.array(*(F.col(a).cast("long") for a in names)).cast("array<long>")).alias("_own")).dropDuplicates(["doc_id"])
        said = F.coalesce("values", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<long>")))
        lacking = F.map_filter(F.coalesce("_own", said), lambda k, v: v.isNotNull() & ~F.coalesce(F.map_contains_key(said, k), F.lit(False)))
        messages = messages.join(own, "doc_id", "left").withColumn("values", F.map_concat(said, lacking)).drop("_own")
        kept = self.docs.join(docs.select(key), key, "left_anti")
        older = SearchEngine(self.spec, self.docs, self.state, self.tokenizer, self.index)
        if self.index is not None:
            self.index.add(build_postings(docs, self.spec, self.tokenizer), docs.select(self._key().alias("doc_id")))
        # What an old version came with carries on as a value before all messages.
        before = self._values_of(self.docs.join(docs.select(key), key, "left_semi"))
        older.state = before if self.state is None else before.unionByName(self.state)
        return older._applied(kept.unionByName(docs, allowMissingColumns=True), messages)

    def _values_of(self, docs: DataFrame) -> DataFrame:
        names = [a for a in self.spec.attributes if a in docs.columns]
        values = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)).cast("array<string>"), F.array(*(F.col(a).cast("long") for a in names)).cast("array<long>")), lambda _, v: v.isNotNull())
        return docs.select(self._key().alias("doc_id"), F.lit(None).cast("string").alias("last_operation"), F.lit(False).alias("has_insert"), F.lit(-2).cast("long").alias("file_no"), F.lit(-2).cast("long").alias("block_id"), values.alias("values")).select(*(c.split()[0] for c in STATE.split(", ")))

    def apply(self, messages: DataFrame) -> SearchEngine:
        """DELETE, RESTORE and attribute messages."""
        return self._applied(self.docs, messages)

    def query(self, query: SearchQuery | str) -> DataFrame:
        query = SearchQuery.from_json(query) if isinstance(query, str) else query
        return query.page(self.matches(query))

    def matches(self, query: SearchQuery) -> DataFrame:
        """All candidates that pass, in no order."""
        return query.matches(self.postings(query.words()), self.attributes, None if self.state is None else visible(self.state))
