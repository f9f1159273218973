import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.sources import queue as Q
from lodeseek.sources import tables as A
from lodeseek.streaming.apply import MESSAGE, STATE, StateStore, apply_batch, dispatch, fold, follow, visible


def message(block, operation, doc=None, ids=None, indexed=True, **values):
    return (1, block, operation, doc, ids, indexed, values)


def frame(spark, rows):
    return spark.createDataFrame(rows, MESSAGE)


def state_of(spark, rows):
    empty = spark.createDataFrame([], STATE)
    return {r.doc_id: (r.visible, r["values"]) for r in visible(fold(empty, frame(spark, rows))).collect()}


def test_state_rules(spark):
    assert state_of(spark, [message(1, "DELETE", ids=[9])]) == {}  # never inserted: no trace... of the document itself
    assert state_of(spark, [message(1, "INSERT", 1, a=3), message(2, "UPDATE", 1, indexed=False, b=4), message(3, "INSERT", 1, a=5)])[1] == (True, {"a": 5, "b": 4})
    deleted = [message(1, "INSERT", 1, a=3), message(2, "DELETE", ids=[1, 7])]
    assert state_of(spark, deleted)[1][0] is False
    assert state_of(spark, [*deleted, message(3, "UPDATE", 1, indexed=False, a=9)])[1] == (False, {"a": 9})
    assert state_of(spark, [*deleted, message(3, "RESTORE", ids=[1])])[1] == (True, {"a": 3})
    assert state_of(spark, [*deleted, message(3, "INSERT", 1)])[1] == (True, {"a": 3})


def test_batches_give_what_one_batch_gives(spark, tmp_path):
    rows = [message(1, "INSERT", 1, a=3), message(2, "INSERT", 2, a=1), message(3, "DELETE", ids=[1]), message(4, "UPDATE", 2, indexed=False, b=2), message(5, "RESTORE", ids=[1]), message(6, "DELETE", ids=[2])]
    store = StateStore(spark, str(tmp_path / "state"))
    for k, part in enumerate((rows[:2], rows[2:5], rows[2:5], rows[4:])):
        apply_batch(store, frame(spark, part), min(k, 2) if k < 3 else 3)
    got = {r.doc_id: (r.visible, r["values"]) for r in visible(store.read()).collect()}
    assert got == state_of(spark, rows)
    before = store.manifest()
    apply_batch(store, frame(spark, rows), 3)  # the same batch again
    apply_batch(store, frame(spark, rows), 4)  # old positions under a new batch
    assert store.manifest() == before


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"), buckets=8)
    apply_batch(store, frame(spark, [message(k, "INSERT", k, a=k) for k in range(1, 60)]), 0)
    first = store.manifest()["held"]
    assert len(first) == 8
    apply_batch(store, frame(spark, [message(60, "UPDATE", 7, indexed=False, a=0)]), 1)
    second = StateStore(spark, str(tmp_path / "state")).manifest()
    assert sum(second["held"][k] != v for k, v in first.items()) == 1
    assert {r.doc_id: r["values"]["a"] for r in store.read().collect()} == {k: k if k != 7 else 0 for k in range(1, 60)}


def test_stream_restarts_where_it_stood(spark, tmp_path):
    log, schema = str(tmp_path / "log"), frame(spark, []).schema
    store = StateStore(spark, str(tmp_path / "state"))
    Q.append_log(frame(spark, [message(1, "INSERT", 1, a=1)]).coalesce(1), log)
    follow(Q.tail_log(spark, log, schema), store, str(tmp_path / "cp"), once=True).awaitTermination()
    assert {r.doc_id for r in store.read().collect()} == {1}
    Q.append_log(frame(spark, [message(2, "INSERT", 2, a=2), message(3, "DELETE", ids=[1])]).coalesce(1), log)
    seen = []
    follow(Q.tail_log(spark, log, schema), store, str(tmp_path / "cp"), once=True).awaitTermination()
    dispatch(Q.tail_log(spark, log, schema), lambda df, k: seen.append(df.count()), str(tmp_path / "cp2"), once=True).awaitTermination()
    assert {r.doc_id: r.visible for r in visible(store.read()).collect()} == {1: False, 2: True}
    assert sum(seen) == 3
    assert Q.read_log(spark, log, schema).count() == 3


def test_envelopes(spark):
    body = T.StructType([T.StructField("vid", T.LongType()), T.StructField("title", T.StringType()), T.StructField("secret", T.StringType())])
    good = {"__QUEUE_NAME__": "test", "__OPERATION__": "op", "__OPERATION_BODY__": {"vid": 3, "title": "t", "secret": "x"}}
    raws = [json.dumps(good), json.dumps(good | {"__OPERATION_BODY__": "text"}), json.dumps({k: v for k, v in good.items() if k != "__QUEUE_NAME__"}), "not json", None, json.dumps(good)[:-1] + "/* note */}"]
    valid, bad = Q.envelope_validate(spark.createDataFrame([(1, i, r) for i, r in enumerate(raws)], "file_no long, block_id long, raw string"), "raw", body)
    assert sorted(r.block_id for r in valid.collect()) == [0, 5]
    assert sorted(r.block_id for r in bad.collect()) == [1, 2, 3, 4]
    sent = Q.project_body(valid, ["secret"])
    assert sent.columns == ["file_no", "block_id", "vid", "title"]
    assert Q.event_subscribe(valid, [("test", "other")]).count() == 0
    assert Q.event_subscribe(valid, [("test", "op")]).count() == Q.event_subscribe(valid, [("all", "all")]).count() == 2


def test_lag(spark):
    polls = spark.createDataFrame([("c", t, q, f) for t, q, f in ((1, 5, 5), (2, 8, 5), (3, 8, 5), (4, 9, 7), (5, 9, 7), (6, 12, 7))], "c string, t long, q long, f long")
    assert [r.status for r in Q.lag_monitor(polls, "c", "t", "q", "f").orderBy("t").collect()] == ["OK", "STOP", "STOP", "OK", "OK", "STOP"]


def test_stored_postings(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 3).alias("term"))
    A.write_postings(rows, str(tmp_path / "p"), 2)
    assert A.read_postings(spark, str(tmp_path / "p"), ["t1"]).count() == 33
    assert A.sharded(rows, F.col("doc_id"), 4).select("shard").distinct().count() == 4
