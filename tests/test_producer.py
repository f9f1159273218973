import json

import pytest

from lodeseek.sources import producer as P


def test_envelopes_pass_ingress(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "vid long, title string")
    sent = P.envelopes(P.insert_messages(docs), "test", "op")
    assert [json.loads(r.raw)["__OPERATION_BODY__"] for r in sent.collect()] == [{"OPERATION": "INSERT", "vid": 1, "title": "a b"}, {"OPERATION": "INSERT", "vid": 2, "title": "c"}]
    assert {r.status for r in P.ingress(sent).collect()} == {0}


def test_codes(spark):
    good = json.dumps({"__QUEUE_NAME__": "q", "__OPERATION__": "o", "__OPERATION_BODY__": {}})
    rows = spark.createDataFrame([(0, good, "10.0.0.1"), (1, "", "10.0.0.1"), (1, None, "9.9.9.9"), (2, good, "9.9.9.9"), (2, good, None), (3, "{", "10.0.0.1")], "want int, raw string, ip string")
    assert all(r.want == r.status for r in P.ingress(rows, sender="ip", allowed=["10.0.0.1"]).collect())


def test_id_lists(spark):
    bodies = P.id_messages(spark.range(3000).withColumnRenamed("id", "doc_id"), "DELETE").collect()
    assert all(len(r.id_list) <= P.LONGEST_ID_LIST for r in bodies)
    assert sorted(i for r in bodies for i in r.id_list) == list(range(3000))
    with pytest.raises(ValueError):
        P.id_messages(spark.range(1), "INSERT")
