"""Postings folded document by document, against brute force and against plans that gather all cells of a task."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from lodeseek.operators import folding
from lodeseek.operators import postings as P
from lodeseek.plans.spec import FieldRule, IndexSpec
from lodeseek.sources import segments


def _brute(rows):
    want = {}
    for d, t in rows:
        for i, x in enumerate([x for x in (t or "").split(" ") if x]):
            want.setdefault((d, x), []).append(i)
    return {k: sorted(v) for k, v in want.items()}


def _rows(seed):
    rng = random.Random(seed)
    words = ["a", "b", "é", "\U0001f600", "zz", "x\ny", ""]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, "", " ", *(" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(5))])) for _ in range(200)]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_slices_part_no_document():
    """Ids of several rows, nulls and empty texts, in slices and batches of any size."""
    rows = _rows(1)
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows])})
    for size, most in ((1, 1), (7, 40), (50, 100), (200, 1 << 20)):
        got = {}
        for piece in folding._pieces(iter(table.to_batches(size)), most):
            out = folding._fold(piece, 1, 0, [0])
            if out is not None:
                keys = list(zip(out["doc_id"].to_pylist(), out["term"].to_pylist()))
                assert not got.keys() & set(keys) and len(set(keys)) == len(keys)
                got |= dict(zip(keys, out["positions"].to_pylist()))
                assert [len(p) for p in out["positions"].to_pylist()] == list(out["n"])
        assert got == _brute(rows)


def test_no_task_gathers_its_cells(spark):
    """Cells were hashed or sorted by the task: at 0.5 GB that spilled 18 GB."""
    rows = _rows(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, nlp = P.term_positions(docs), P.index_nlp(docs)
    for df in (got, nlp, P.index_multifield(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and plan.count("Exchange") == 1
    assert {(r.doc_id, r.term): r.positions for r in got.collect()} == _brute(rows)
    assert {(r.doc_id, r.term): (r.hit_count, r.offset1, r.offset2) for r in nlp.collect()} == {k: (min(len(v), 7), v[0], v[-1] - v[0]) for k, v in _brute(rows).items()}


def test_fields_of_all_kinds_in_one_fold(spark):
    """Positions come from their field only, and in order where the tokenizer goes back."""
    key, tags = FieldRule("id", "DOC_ID"), FieldRule("tags", "PREFIX", type="LIST_STR", token="T^")
    spec = IndexSpec((key, FieldRule("t", "NLP", position=True, hit_field="t_hit", hit_weight=5), FieldRule("u", "NLP"), tags), {"weight": 8, "hit_count": 3, "t_hit": 1, "offset1": 8, "offset2": 8})
    docs = spark.createDataFrame([(1, "a b a", "a c", ["x", None]), (1, "a", None, None), (None, "b", "", [])], "id long, t string, u string, tags array<string>")
    got = {(r.doc_id, r.term): (r.weight, r.t_hit, r.hit_count, r.positions) for r in P.build_postings(docs, spec).collect()}
    assert got == {(1, "a"): (5, 1, 4, [0, 0, 2]), (1, "b"): (5, 1, 1, [1]), (1, "c"): (0, 0, 1, []), (1, "T^x"): (0, 0, 0, []), (None, "b"): (5, 1, 1, [0])}
    back = lambda c: F.transform(F.split(c, " "), lambda w, i: F.struct((9 - i).alias("pos"), w.alias("term")))
    assert {r.term: r.positions for r in P.build_postings(docs.limit(1), spec, back).collect()} == {"a": [7, 9], "b": [8], "c": [], "T^x": []}


def test_caps_cut_batches_before_they_are_sorted(spark):
    """A task sorted all its postings of frequent terms to keep a few: at 0.1 GB 344 MB of memory."""
    rng = random.Random(3)
    data = [(t, d) for t in ("often", "twice", "é") for d in rng.sample([None, *range(9000)], {"often": 9000, "twice": 2, "é": 300}[t])]
    rows = spark.createDataFrame(data, "term string, doc_id long").repartition(2).sortWithinPartitions("term")
    assert P.newest_of_batches(rows, 20).count() <= 2 * 3 * 20

    def newest(least):
        lists = {t: sorted((d for u, d in data if u == t), key=lambda d: (d is None, -(d or 0))) for t in ("often", "twice", "é")}
        return {(t, d) for t, ds in lists.items() if len(ds) > least for d in ds[:20]}

    assert {tuple(r) for r in P.posting_cap(rows, 20).collect()} == newest(0)
    assert {tuple(r) for r in P.posting_cap(rows, 20, 100).collect()} == newest(100)
    assert {tuple(r) for r in P.posting_cap(rows, 2500, 100).collect()} == {(t, d) for t, d in data if t == "é"} | {("often", d) for d in sorted((d for t, d in data if t == "often" and d is not None), reverse=True)[:2500]}


def test_compaction_ranks_the_terms_beyond_its_cap_only(spark, tmp_path, monkeypatch):
    """Under a cap that hardly any term exceeds, all postings were shuffled by term and ranked."""
    ranked = []
    monkeypatch.setattr(segments, "LARGE_CAP", 3)
    monkeypatch.setattr(segments, "cap_postings", lambda rows, most: ranked.append({r.term for r in rows.collect()}) or P.cap_postings(rows, most))
    index = segments.SegmentedIndex(spark, str(tmp_path / "i"))
    for texts in ({d: "a b c" if d % 2 else "a" for d in range(6)}, {5: "a z", 6: "z"}):
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        index.add(P.term_positions(docs), docs.select("doc_id"))
    index.compact(most=3, deleted=spark.createDataFrame([(4,)], "doc_id long"))
    assert ranked == [{"a"}]
    assert {(r.term, r.doc_id) for r in index.read().collect()} == {("a", 5), ("a", 3), ("a", 2), ("b", 1), ("b", 3), ("c", 1), ("c", 3), ("z", 5), ("z", 6)}


def test_superseding_and_deleting_leave_postings_in_place(spark, tmp_path):
    """Beyond the session's limit of broadcasts, all postings were shuffled by document."""
    index = segments.SegmentedIndex(spark, str(tmp_path / "i"))
    for ids in (range(6), range(3)):
        docs = spark.createDataFrame([(d, "a b") for d in ids], "doc_id long, text string")
        index.add(P.term_positions(docs), docs.select("doc_id"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.read()._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert index.read().count() == 12
