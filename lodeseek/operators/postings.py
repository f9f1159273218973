"""The inverted index as DataFrames: one row per (term, document)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions.scalars import bound, distinct_tokens, prefixed, prefixed_list, saturate, title, token_positions
from lodeseek.operators.folding import folded
from lodeseek.plans.spec import FieldRule, IndexSpec
from lodeseek.session import ship

#: A term keeps at most so many postings.
MOST_POSTINGS = 1_000_000
#: Caps up to this one are worth applying to single batches (10,000 rows) first.
SMALL_CAP = 2000
#: From this cap on, the terms that exceed it are few enough to be named.
LARGE_CAP = 100_000
SUBS = "array<struct<pos:int,term:string>>"


def simple_postings(docs: DataFrame, terms: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term) for each distinct token.  With ``terms``, only those leave the scan: tokens are cut down to
    them before they become rows."""
    found = distinct_tokens(F.col(text_col))
    if terms is not None:
        found = F.array_intersect(found, F.array(*map(F.lit, terms)))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("term"))


def posting_scan(postings: DataFrame, term: str) -> DataFrame:
    """Postings of one term, newest document first."""
    return postings.where(F.col("term") == term).orderBy(F.desc("doc_id"))


def term_dictionary(postings: DataFrame) -> DataFrame:
    """(term, df), in term order."""
    return postings.groupBy("term").agg(F.count("*").alias("df")).orderBy("term")


def newest_of_batches(postings: DataFrame, most: int) -> DataFrame:
    """At least the ``most`` newest postings of each term: what is not among those of its own batch goes, unsorted and
    unshuffled.  Stored postings lie in order of terms, so most of a frequent term's rows go here."""
    ship(postings.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if batch.num_rows > most:
                term = batch.column(names.index("term")).dictionary_encode(null_encoding="encode").indices
                order = np.asarray(pc.sort_indices(pa.table({"t": term, "d": batch.column(names.index("doc_id"))}), sort_keys=[("t", "ascending"), ("d", "descending")]))
                sorted_ = np.asarray(term)[order]
                starts = np.flatnonzero(np.concatenate(([True], np.diff(sorted_) != 0)))
                place = np.arange(len(order)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(order)]))))
                kept = np.empty(len(order), bool)
                kept[order] = place < most
                batch = batch.filter(pa.array(kept))
            yield batch

    names = postings.columns
    return postings.mapInArrow(run, postings.schema)


def cap_postings(postings: DataFrame, most: int = MOST_POSTINGS) -> DataFrame:
    """The ``most`` newest postings of each term.  With a small ``most``, each task cuts its own part of a term's list
    before anything is sorted or shuffled.  With a large one all rows are ranked: give those of frequent terms only."""
    return _ranked(newest_of_batches(postings, most) if most <= SMALL_CAP else postings, most)


def _ranked(postings: DataFrame, most: int) -> DataFrame:
    newest = Window.partitionBy("term").orderBy(F.desc("doc_id"))
    return postings.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= most).drop("_rn")


def posting_cap(postings: DataFrame, most: int, least_df: int = 0) -> DataFrame:
    """The ``most`` newest postings of each term that has more than ``least_df``: (term, doc_id).

    Counts are combined before their shuffle; each task cuts its part of a term's list before it meets them."""
    rows = postings.select("term", "doc_id")
    if least_df:
        frequent = postings.groupBy("term").count().where(F.col("count") > least_df).select("term")
        cut = newest_of_batches(rows, most) if most <= SMALL_CAP else rows
        return _ranked(cut.join(frequent, "term", "left_semi"), most)
    return cap_postings(rows, most)


def index_nlp(docs: DataFrame, count_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, hit_count, offset1, offset2): occurrences (saturating), the first token position, and the
    distance from the first to the last."""
    found = folded(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text")), ["doc_id", "term", "n", "first", "last"])
    return found.select("doc_id", "term", saturate(F.col("n"), count_bits).alias("hit_count"), F.col("first").alias("offset1"), (F.col("last") - F.col("first")).alias("offset2"))


def term_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, positions): where each term of a text stands."""
    return folded(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text")), ["doc_id", "term", "positions"], placed=0)


def field_cells(rule: FieldRule, number: int, tokenizer=None, column: Column | None = None) -> Column:
    """Array of (term, field, pos) of one configured field.

    ``tokenizer`` maps a text column to an array of (pos, term), or of (pos, term, subs: array of (pos, term)) from a
    segmenter that cuts tokens into sub-tokens; positions are whatever the tokenizer counts in, tokens or characters.
    By default tokens are split at spaces.  Sub-tokens count where their parent first occurs only."""
    column = F.col(rule.column) if column is None else column
    if rule.op == "NLP":
        if tokenizer is None:
            cells = F.transform(token_positions(column), lambda t: F.struct(t["term"].alias("term"), F.lit(number).alias("field"), t["pos"].cast("int").alias("pos")))
        else:
            cells = _with_subs(tokenizer(column), number)
    else:
        terms = prefixed_list(rule.token, column) if rule.type.startswith("LIST") else F.array(prefixed(rule.token, column))
        cells = F.transform(F.filter(terms, lambda x: x.isNotNull()), lambda x: F.struct(x.alias("term"), F.lit(number).alias("field"), F.lit(0).alias("pos")))
    return F.coalesce(cells, F.array().cast("array<struct<term:string,field:int,pos:int>>"))


def _with_subs(tokens: Column, number: int) -> Column:
    """Cells of a tokenizer's tokens and, at each token's first occurrence, of its sub-tokens; empty ones are left out."""

    def cell(t: Column) -> Column:
        return F.struct(t["term"].cast("string").alias("term"), F.lit(number).alias("field"), t["pos"].cast("int").alias("pos"))

    said = F.filter(tokens, lambda t: t["term"] != "")
    whole = F.transform(said, cell)
    # In order of terms, a token that differs from the one before it is its term's first: n log n, whatever the text.
    sorted_ = F.array_sort(F.transform(said, lambda t, i: F.struct(t["term"].cast("string").alias("term"), i.alias("i"), F.coalesce(t["subs"], F.array().cast(SUBS)).alias("subs"))))
    first = bound(sorted_, lambda x: F.filter(x, lambda t, i: (i == 0) | (F.get(x, i - 1)["term"] != t["term"])))
    subs = F.flatten(F.transform(first, lambda t: F.transform(F.filter(t["subs"], lambda x: x["term"] != ""), cell)))
    return F.concat(whole, subs)


def build_postings(docs: DataFrame, spec: IndexSpec, tokenizer=None, subs: bool = False) -> DataFrame:
    """Postings of all configured fields: one row per (doc_id, term) with the cell's fields, each a saturating sum
    over the fields that hold the term; offset1 and offset2 come from the field that keeps positions.

    The cells of all fields of a document are made in one pass over its row and folded in one step.
    ``tokenizer`` as in ``field_cells``; ``subs`` says that its tokens have sub-tokens."""
    if tokenizer is not None and not subs:
        plain = tokenizer
        tokenizer = lambda c: F.transform(plain(c), lambda t: F.struct(t["pos"].alias("pos"), t["term"].alias("term"), F.array().cast(SUBS).alias("subs")))
    rules = [r for r in spec.rules if r.op != "DOC_ID"]
    texts = [k for k, r in enumerate(rules) if r.op == "NLP"]
    placed = next((k for k, r in enumerate(rules) if r.position), None)
    fields = docs.select(F.col(spec.doc_id.column).cast("long").alias("doc_id"), *(F.col(r.column).alias(f"_f{k}") for k, r in enumerate(rules)))
    # Plain texts are cut where they are folded; all else becomes cells here, after it has been dealt.
    cells = [F.col(f"_f{k}").cast("string") if tokenizer is None and r.op == "NLP" else field_cells(r, k, tokenizer, F.col(f"_f{k}")) for k, r in enumerate(rules)]
    names = ["doc_id", "term", "n", *(f"f{k}" for k in range(len(rules))), *([] if placed is None else ["positions"])]
    found = folded(fields, names, len(rules), placed, tuple(texts), [c.alias(f"_c{k}") for k, c in enumerate(cells)])
    zero = F.lit(0).cast("long")
    holds = [F.col(f"f{k}") for k in range(len(rules))]
    weight = reduce(lambda a, b: a + b, [holds[k] * rules[k].hit_weight for k in texts if rules[k].hit_weight], zero)
    hits = {h: reduce(lambda a, b: a + b, [holds[k] for k in texts if rules[k].hit_field == h], zero) for h in sorted({r.hit_field for r in rules if r.hit_field})}
    positions = F.array().cast("array<int>") if placed is None else F.col("positions")
    found = found.select("doc_id", "term", F.col("n").alias("hit_count"), weight.alias("weight"), *(x.alias(h) for h, x in hits.items()), positions.alias("positions"))
    out = [saturate(F.col(n), spec.cell.get(c, 32)).alias(n) for n, c in (("weight", "weight"), ("hit_count", "hit_count" if "hit_count" in spec.cell else "count"), *((h, h) for h in hits))]
    first, last = F.coalesce(F.array_min("positions"), F.lit(0)), F.coalesce(F.array_max("positions"), F.lit(0))
    offsets = [saturate(first, spec.cell["offset1"]).alias("offset1"), saturate(last - first, spec.cell["offset2"]).alias("offset2")] if "offset1" in spec.cell else []
    return found.select("doc_id", "term", *out, *offsets, "positions")


def index_multifield(docs: DataFrame, title_weight: int = 5, content_weight: int = 1) -> DataFrame:
    """Title (first line) and whole text as two weighted fields: (doc_id, term, weight, title_hit, hit_count)."""
    rules = (
        FieldRule("doc_id", "DOC_ID"),
        FieldRule("title", "NLP", hit_field="title_hit", hit_weight=title_weight),
        FieldRule("content", "NLP", hit_field="content_hit", hit_weight=content_weight),
    )
    spec = IndexSpec(rules, {"weight": 8, "title_hit": 1, "content_hit": 1, "hit_count": 3})
    fields = docs.select("doc_id", title(F.col("text")).alias("title"), F.col("text").alias("content"))
    return build_postings(fields, spec).select("doc_id", "term", "weight", "title_hit", "hit_count")


def merge_segments(older: DataFrame, newer: DataFrame, most: int = MOST_POSTINGS) -> DataFrame:
    """Two index segments as one: the postings of both, a document's newer cell first, at most ``most`` newest per term."""
    both = older.withColumn("_age", F.lit(1)).unionByName(newer.withColumn("_age", F.lit(0)))
    cell = F.struct("_age", *[c for c in older.columns if c not in ("term", "doc_id")])
    one = both.groupBy("term", "doc_id").agg(F.min_by(cell, "_age").alias("_cell"))
    rest = one.select("term", "doc_id", *(F.col(f"_cell.{c}").alias(c) for c in older.columns if c not in ("term", "doc_id")))
    return cap_postings(rest, most)
