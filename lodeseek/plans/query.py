"""Search queries: from JSON to a DataFrame plan.

The order of steps is part of the meaning: postings per term, synonyms, weighted merge cut to the best 2000,
live documents, filters, score adjustment, attributes, order, page.  The cut comes before the filters, so a filter
never lets a document in that the merge has left out; Spark keeps a filter above a limit.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.operators.merge import CANDIDATES, expand_terms, group_count, weight_merge
from lodeseek.operators.predicates import apply_filters
from lodeseek.operators.rank import ranking
from lodeseek.operators.topk import MOST, page
from lodeseek.sources.tables import attr_lookup

#: Names that a query may use in place of others.
ALIASES = {"orderby": "sortby", "filterlist": "filtlist", "rankinglist": "ranklist"}


@dataclass(frozen=True)
class SearchQuery:
    terms: list[dict]
    filters: list[dict] = field(default_factory=list)
    ranking: list[dict] = field(default_factory=list)
    sortby: str | None = None
    groupcount: str | None = None
    offset: int = 0
    size: int = MOST
    candidates: int = CANDIDATES

    def __post_init__(self):
        expand_terms(self.terms)

    @classmethod
    def from_json(cls, text: str) -> SearchQuery:
        raw = json.loads(text)
        raw = {ALIASES.get(k, k): v for k, v in raw.items()}
        if not isinstance(raw.get("termlist"), list):
            raise ValueError("a query needs a termlist")
        return cls(raw["termlist"], raw.get("filtlist") or [], raw.get("ranklist") or [], raw.get("sortby"), raw.get("groupcount"), raw.get("offset", 0), raw.get("size", MOST))

    def words(self) -> list[str]:
        """All terms and synonyms: what a stored index is asked for."""
        return [t for t, *_ in expand_terms(self.terms)]

    def matches(self, postings: DataFrame, attributes: DataFrame, live: DataFrame | None = None) -> DataFrame:
        """All candidates that pass, with weight and attributes: what is counted, grouped and paged."""
        rows = weight_merge(postings, self.terms, self.candidates)
        if live is not None:
            rows = rows.join(live.where("visible").select("doc_id"), "doc_id", "left_semi")
        if self.candidates <= CANDIDATES:
            # At most that many documents are left: they are sent to the attributes, and the few found come back, so
            # the attribute table is scanned but never shuffled.
            attributes = F.broadcast(attributes.join(F.broadcast(rows.select("doc_id")), "doc_id", "left_semi"))
        rows = attr_lookup(rows, attributes)
        return ranking(apply_filters(rows, self.filters), self.ranking)

    def page(self, matched: DataFrame) -> DataFrame:
        key = self.sortby
        if key and key not in matched.columns:
            warnings.warn(f"unknown sort field {key!r} is ignored", stacklevel=2)
            key = None
        return page(matched, self.offset, self.size, key)

    def run(self, postings: DataFrame, attributes: DataFrame, live: DataFrame | None = None) -> DataFrame:
        """The page of results; all_num is ``matches(...).count()``."""
        return self.page(self.matches(postings, attributes, live))

    def counts(self, matched: DataFrame) -> DataFrame | None:
        """Rows per value of the group key, if the query has one."""
        return group_count(matched, self.groupcount) if self.groupcount else None
