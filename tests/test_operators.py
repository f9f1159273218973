"""The operator fixtures, scaled down, with the counts that they must give."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodeseek.engine import SearchEngine
from lodeseek.operators import merge as M
from lodeseek.operators import postings as P
from lodeseek.operators import state as D
from lodeseek.operators import topk as K
from lodeseek.operators.predicates import apply_filters, build_predicate, filter_postings
from lodeseek.operators.rank import proximity, proximity_scores, ranking
from lodeseek.plans import catalog
from lodeseek.plans.query import SearchQuery
from lodeseek.plans.spec import FieldRule, IndexSpec
from lodeseek.sources.segments import SegmentedIndex
from lodeseek.streaming.apply import MESSAGE

N = 8000


@pytest.fixture(scope="module")
def attrs(spark):
    i = F.col("id")
    return spark.range(N).select(i.alias("doc_id"), i.bitwiseAND(F.lit(3)).alias("clarity"), i.bitwiseAND(F.lit(7)).alias("duration"), i.bitwiseAND(F.lit(1)).alias("deleted"), i.bitwiseAND(F.lit(15)).alias("type"))


@pytest.mark.parametrize(
    ("filters", "count"),
    [
        ([{"field": "clarity", "method": "BIGGER", "value": 2}], N // 2),
        ([{"field": "clarity", "method": 2, "value": 1}], N // 2),
        ([{"field": "duration", "method": "ZONE", "min": 3, "max": 6}], N // 2),
        ([{"field": "clarity", "method": 0, "value": 2}], N // 4),
        ([{"field": "duration", "method": "SET", "value": [0, 1, 2, 3]}], N // 2),
        ([{"field": "clarity", "method": 1, "value": 3}, {"field": "clarity", "method": 2, "value": 3}, {"field": "duration", "method": 3, "min": 3, "max": 6}, {"field": "deleted", "method": 0, "value": 1}, {"field": "duration", "method": 4, "value": [0, 1, 2, 3]}], N // 8),
        ([], N),
    ],
)
def test_filters(attrs, filters, count):
    assert apply_filters(attrs, filters).count() == count


def test_filter_errors():
    for bad in ({"field": "nope", "method": 0, "value": 1}, {"field": "a", "method": 9, "value": 1}, {"field": "a", "method": True, "value": 1}, {"field": "a", "method": "ZONE", "min": 1}, {"field": "a", "method": "SET", "value": 3}):
        with pytest.raises(ValueError):
            build_predicate([bad], ["a"])


def test_filter_reaches_the_scan(spark, sf, capsys):
    rows = apply_filters(spark.read.parquet(f"{sf}/documents.parquet"), [{"field": "n_chars", "method": "ZONE", "min": 500, "max": 3000}]).select("doc_id")
    rows.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(n_chars,500)" in plan
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan


def test_group_count(attrs):
    assert {r.n for r in M.group_count(attrs, "type").collect()} == {N // 16}


def test_or_merge_first_list_wins(spark):
    one = spark.range(1, 1001).select(F.col("id").alias("doc_id"), F.lit(555).alias("cell"))
    two = spark.range(1, 2001).select(F.col("id").alias("doc_id"), F.lit(666).alias("cell"))
    rows = {r.doc_id: r.cell for r in M.or_merge([one, two]).collect()}
    assert len(rows) == 2000
    assert all(c == (555 if i <= 1000 else 666) for i, c in rows.items())
    assert M.or_merge([one, one]).count() == 1000


def test_weight_merge_counts(spark):
    rows = spark.range(3000).where("id % 2 = 0").select(F.col("id").alias("doc_id"), F.lit("a").alias("term")).unionByName(spark.range(3000).where("id % 3 = 0").select(F.col("id").alias("doc_id"), F.lit("b").alias("term")))
    got = M.weight_merge(rows, [{"term": "a", "weight": 1}, {"term": "b", "weight": 0}, {"term": "none", "weight": 9}], None).collect()
    assert len(got) == 2000
    assert sum(r.weight == 2 for r in got) == 500
    best = M.weight_merge(rows, [{"term": "a", "weight": 1}, {"term": "b", "weight": 1}], 10).collect()
    assert [r.doc_id for r in best] == list(range(2994, 2934, -6))


def test_term_errors_and_synonym_limit(spark):
    rows = spark.createDataFrame([(1, "d"), (2, "e")], "doc_id long, term string")
    terms = [{"term": "a", "weight": 5, "synonyms": ["b", "c", "d", "e"]}]
    assert [r.doc_id for r in M.weight_merge(rows, terms).collect()] == [1]  # the fourth synonym is left out
    for bad in ({"term": "a"}, {"weight": 1}, {"term": "a", "weight": 1.5}, {"term": "a", "weight": -1}):
        with pytest.raises(ValueError):
            M.expand_terms([bad])


def test_top_and_pages(spark):
    rows = spark.range(N).select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(N - F.col("id")).alias("doc_id"))
    assert [r.doc_id for r in K.topk_field(rows, "doc_id", 5).collect()] == [N - 1, N - 2, N - 3, N - 4, N - 5]
    assert K.page_bounds(-1, 10) == (0, 10)
    assert K.page_bounds(0, 0) == K.page_bounds(0, 2001) == K.page_bounds(1500, 600) == (0, 2000)
    small = spark.range(25).select(F.col("id").alias("doc_id"), (F.col("id") % 5).alias("weight"))
    pages = [r.doc_id for k in range(3) for r in K.page(small, 10 * k, 10).collect()]
    assert pages == [r.doc_id for r in K.page(small).collect()]


def test_cap_comes_before_filters(spark):
    posts = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a").alias("term"))
    attrs = spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").alias("n"))
    q = SearchQuery([{"term": "a", "weight": 1}], [{"field": "n", "method": "SMALLER", "value": 92}], candidates=10)
    assert sorted(r.doc_id for r in q.matches(posts, attrs).collect()) == [90, 91, 92]


def test_query_json_names_and_order(spark):
    q = SearchQuery.from_json('{"termlist": [{"term": "a", "weight": 1}], "orderby": "n", "filterlist": [], "offset": 1, "size": 2}')
    assert (q.sortby, q.offset, q.size) == ("n", 1, 2)
    posts = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("a").alias("term"))
    attrs = spark.range(5).select(F.col("id").alias("doc_id"), (-F.col("id")).alias("n"))
    assert [r.doc_id for r in q.run(posts, attrs).collect()] == [1, 2]
    with pytest.warns(UserWarning):
        SearchQuery([{"term": "a", "weight": 1}], sortby="nope").run(posts, attrs)


def test_ranking_order_and_clamp(spark):
    rows = spark.createDataFrame([(1, 10, 1), (2, 10, 0)], "doc_id long, weight long, q int")
    add = {"field": "q", "method": "EQUAL", "value": 1, "operation": "ADD", "weight": 5}
    mul = {"field": "q", "method": "BIGGER", "value": 0, "operation": 1, "weight": 3}
    assert [r.weight for r in ranking(rows, [add, mul]).orderBy("doc_id").collect()] == [45, 30]
    assert [r.weight for r in ranking(rows, [mul, add]).orderBy("doc_id").collect()] == [35, 30]
    assert [r.weight for r in ranking(rows, [mul, mul], bits=5).orderBy("doc_id").collect()] == [31, 31]


def test_proximity(spark):
    rows = spark.createDataFrame([([[1, 9], [4, 10], [12]],), ([[5], []],), ([[3]],)], "x array<array<int>>")
    assert [r[0] for r in rows.select(proximity(F.col("x"))).collect()] == [3, None, 0]


def test_proximity_of_postings(spark):
    """The sweep against all choices of one position per term."""
    rng = random.Random(2)
    data, want = [], {}
    for d in range(40):
        lists = {t: sorted(rng.sample(range(60), rng.randint(0, 6))) for t in "abc"}
        data += [(d, t, p) for t, p in lists.items() if p]
        if all(lists.values()):
            want[d] = min(sum(abs(x - y) for x, y in zip(c, c[1:])) for c in itertools.product(*lists.values()))
    rows = spark.createDataFrame(data, "doc_id long, term string, positions array<int>")
    assert {r.doc_id: r.spread for r in proximity_scores(rows, ["a", "b", "c"]).collect()} == want
    assert {r.spread for r in proximity_scores(rows, ["a"]).collect()} == {0}
    assert proximity_scores(rows, ["a", "none"]).collect() == []


CONFIG = """{
  "FLEXINDEX": [ {"vid": {"op": "DOC_ID"}}, {"title": {"op": "NLP", "hit_field": "title_hit", "hit_weight": 5, "position": 1}},
    {"content": {"op": "NLP", "optional": 1}}, {"tags": {"op": "PREFIX", "type": "LIST_STR", "token": "TAG^", "optional": 1}} ], // rules
  "STRUCTMASK": { "posting_list_cell": [ {"id": 26}, {"title_hit": 1}, {"hit_count": 3}, {"weight": 8}, {"offset1": 8}, {"offset2": 8} ],
    "document_attribute": [ {"plays": 32}, {"kind": 3} ] } /* widths */ }"""


def test_spec_and_index(spark):
    spec = IndexSpec.from_config(CONFIG)
    docs = spark.createDataFrame([(1, "a b a", "a c", ["x", "x"], 5, 9), (2, "c", None, None, None, None)], "vid long, title string, content string, tags array<string>, plays long, kind long")
    rows = {(r.doc_id, r.term): r for r in P.build_postings(docs, spec).collect()}
    assert set(rows) == {(1, "a"), (1, "b"), (1, "c"), (1, "TAG^x"), (2, "c")}
    a = rows[1, "a"]
    assert (a.weight, a.title_hit, a.hit_count, a.offset1, a.offset2, a.positions) == (5, 1, 3, 0, 2, [0, 2])
    assert (rows[1, "c"].weight, rows[1, "c"].title_hit) == (0, 0)
    engine = SearchEngine(spec, docs)
    assert {r.doc_id: (r.plays, r.kind) for r in engine.attributes.collect()} == {1: (5, 7), 2: (0, 0)}
    found = engine.query('{"termlist": [{"term": "a", "weight": 2}, {"term": "c", "weight": 3}]}').collect()
    assert [(r.doc_id, r.weight) for r in found] == [(2, 15), (1, 13)]


def test_tokenizer_with_sub_tokens(spark):
    """A segmenter that counts in characters and cuts compounds: sub-tokens count at their parent's first occurrence."""
    spec = IndexSpec((FieldRule("id", "DOC_ID"), FieldRule("t", "NLP", position=True)), {"weight": 8, "hit_count": 3, "offset1": 8, "offset2": 8})
    docs = spark.createDataFrame([(1, "sunflower oil sunflower sun"), (2, None)], "id long, t string")
    starts = lambda c: F.transform(F.split(c, " "), lambda w, i: F.struct(F.length(F.array_join(F.slice(F.split(c, " "), 1, i), " ")).alias("pos"), w.alias("term"), F.when(w == "sunflower", F.array(F.struct(F.lit(0).alias("pos"), F.lit("sun").alias("term")), F.struct(F.lit(3).alias("pos"), F.lit("flower").alias("term")), F.struct(F.lit(9).alias("pos"), F.lit("").alias("term")))).alias("subs")))
    got = {r.term: (r.hit_count, r.offset1, r.offset2) for r in P.build_postings(docs, spec, starts, subs=True).collect()}
    assert got == {"sunflower": (2, 0, 13), "oil": (1, 9, 0), "sun": (2, 0, 23), "flower": (1, 3, 0)}
    plain = lambda c: F.transform(F.split(F.upper(c), " "), lambda w, i: F.struct(i.alias("pos"), w.alias("term")))
    assert {r.term: r.hit_count for r in P.build_postings(docs, spec, plain).collect()} == {"SUNFLOWER": 2, "OIL": 1, "SUN": 1}


def test_tokens_stay_with_their_document(spark, sf):
    """Texts are dealt once; tokens are never shuffled.  The stored index is asked for its terms only."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for rows in (P.index_nlp(docs), P.index_multifield(docs)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
        assert plan.count("FileScan") == 1
    plan = catalog.stored(spark, sf).read(["from"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [from])]" in plan or "EqualTo(term,from)" in plan


def test_spec_errors():
    key, cell = FieldRule("id", "DOC_ID"), {"weight": 8}
    for rules, c in (
        ((key, key), cell),
        ((FieldRule("t", "NLP"),), cell),
        ((key, FieldRule("t", "NLP", position=True), FieldRule("u", "NLP", position=True)), cell | {"offset1": 8, "offset2": 8}),
        ((key, FieldRule("t", "NLP", position=True)), cell),
        ((key, FieldRule("t", "NLP", hit_field="t_hit")), cell | {"t_hit": 1}),
        ((key, FieldRule("t", "WHAT")), cell),
        ((key, FieldRule("t", "PREFIX", type="FLOAT")), cell),
        ((key,), {}),
        ((key,), {"weight": 33}),
    ):
        with pytest.raises(ValueError):
            IndexSpec(rules, c)


def test_postings_filter_and_compaction(spark, attrs):
    posts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, term string")
    assert [r.doc_id for r in filter_postings(posts, attrs, [{"field": "clarity", "method": 0, "value": 1}]).collect()] == [1]
    old = spark.createDataFrame([(1, "a", 1), (2, "a", 1)], "doc_id long, term string, weight long")
    new = spark.createDataFrame([(2, "a", 7), (3, "a", 7)], "doc_id long, term string, weight long")
    assert sorted((r.doc_id, r.weight) for r in P.merge_segments(old, new, 2).collect()) == [(2, 7), (3, 7)]


def segment(spark, rows):
    postings = spark.createDataFrame([(d, t, w) for d, terms in rows for t, w in terms.items()], "doc_id long, term string, weight long")
    return postings, spark.createDataFrame([(d,) for d, _ in rows], "doc_id long")


def contents(index, terms=None):
    return sorted((r.doc_id, r.term, r.weight) for r in index.read(terms).collect())


def test_segments_and_compaction(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    assert not index.exists()
    index.add(*segment(spark, [(1, {"a": 1, "b": 1, "c": 1}), (2, {"a": 2}), (3, {"a": 3})]))
    index.add(*segment(spark, [(1, {"a": 7, "d": 7, "e": 7}), (4, {"a": 4})]))
    index.add(*segment(spark, [(4, {"z": 5}), (5, {"a": 5}), (2, {})]))
    want = [(1, "a", 7), (1, "d", 7), (1, "e", 7), (3, "a", 3), (4, "z", 5), (5, "a", 5)]
    assert contents(index) == want
    assert contents(index, ["b"]) == []  # the newest version has it no more
    assert contents(index, ["a"]) == [w for w in want if w[1] == "a"]
    index.compact(last=2)
    assert len(index.segments()) == 2
    assert contents(index) == want
    gone = spark.createDataFrame([(3,)], "doc_id long")
    index.compact(most=1, deleted=gone)
    assert len(index.segments()) == 1
    assert contents(index) == [(1, "d", 7), (1, "e", 7), (4, "z", 5), (5, "a", 5)]
    assert sorted(r.doc_id for r in index.documents().collect()) == [1, 2, 4, 5]
    assert sorted(p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("s")) == ["s0", "s3", "s4"]


def engine_messages(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], MESSAGE)


@pytest.mark.parametrize("is_stored", [False, True])
def test_engine_follows_its_log(spark, tmp_path, is_stored):
    spec = IndexSpec((FieldRule("vid", "DOC_ID"), FieldRule("title", "NLP")), {"weight": 8, "hit_count": 3}, {"plays": 7, "kind": 8})
    columns = "vid long, title string, plays long, kind long"
    engine = SearchEngine(spec, spark.createDataFrame([(1, "a b", 6, 3), (2, "a c", 7, None)], columns))
    if is_stored:
        engine = engine.store(SegmentedIndex(spark, str(tmp_path / "index")))
    found = lambda e, term="a": {r.doc_id: (r.plays, r.kind) for r in e.query(f'{{"termlist": [{{"term": "{term}", "weight": 2}}]}}').collect()}
    assert found(engine) == {1: (6, 3), 2: (7, 0)}
    engine = engine.apply(engine_messages(spark, (1, "DELETE", None, [1, 9], True, {})))
    assert found(engine) == {2: (7, 0)}
    engine = engine.apply(engine_messages(spark, (2, "UPDATE", 2, None, False, {"plays": 99}), (3, "UPDATE", 1, None, False, {"plays": 500})))
    assert found(engine) == {2: (99, 0)}
    engine = engine.apply(engine_messages(spark, (4, "RESTORE", None, [1], True, {})))
    assert found(engine) == {1: (127, 3), 2: (99, 0)}
    new = spark.createDataFrame([(2, "b b", None, 5), (3, "a", 5, None)], columns)
    engine = engine.add(new, engine_messages(spark, (5, "UPDATE", 2, None, True, None), (6, "INSERT", 3, None, True, {"plays": 8})))
    assert found(engine) == {1: (127, 3), 3: (8, 0)}
    assert found(engine, "b") == {1: (127, 3), 2: (99, 5)}
    assert found(engine, "c") == {}
    engine = engine.apply(engine_messages(spark, (7, "DELETE", None, [2], True, {})))
    assert found(engine, "b") == {1: (127, 3)}


def test_live_rows_of_the_newest_version(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "doc long, at long")
    state = spark.createDataFrame([(1, 2, True), (2, 3, False)], "doc long, at long, visible boolean")
    assert [tuple(r) for r in D.filter_live(rows, state, "doc", "at").collect()] == [(1, 2)]
    assert D.filter_live(rows, state, "doc").count() == 2


def test_versions(spark):
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 3, "z")], "doc long, at long, v string")
    last = D.latest_version(rows, "doc", "at", ["v"])
    assert sorted(map(tuple, last.collect())) == [(1, 2, "y"), (2, 3, "z")]
    assert sorted(r.at for r in D.drop_superseded(rows, last, "doc", "at").collect()) == [2, 3]


def test_seek_on_two_part_positions(spark):
    rows = spark.createDataFrame([(1, 5), (1, 9), (2, 1)], "file_no long, block_id long")
    assert sorted(map(tuple, D.queue_seek(rows, ["file_no", "block_id"], (1, 5)).collect())) == [(1, 9), (2, 1)]


def test_replay_numbers_across_ranges(spark):
    rows = spark.createDataFrame([(i * 7,) for i in range(50)], "p long")
    assert [r.seq for r in D.replay_sequence(rows, "p", 32).orderBy("p").collect()] == list(range(50))
