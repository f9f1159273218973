"""More queries of the catalog: logs and followers, state that a stream keeps, segments and merges, parsers and helpers.

Importing this module adds them to ``catalog.QUERIES`` and ``catalog.SQL``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.functions import scalars as S
from lodeseek.operators import merge as M
from lodeseek.operators import postings as P
from lodeseek.operators.predicates import filter_postings
from lodeseek.operators.rank import ranking
from lodeseek.plans.catalog import _A, _FOUND, _P, _TOP, TERMS, WIDTHS, WORDS, ZONE, attributes, bitfield_pack, messages, postings, query, search_filtered, table
from lodeseek.plans.query import SearchQuery
from lodeseek.plans.spec import FieldRule, IndexSpec
from lodeseek.session import shared_folder
from lodeseek.sources import producer as W
from lodeseek.sources import queue as Q
from lodeseek.sources.segments import SegmentedIndex
from lodeseek.streaming.apply import MESSAGE, StateStore, dispatch, follow, visible

#: A micro-batch takes an append as a whole, of however many files.
WHOLE = 1_000_000


def home(spark: SparkSession, name: str) -> str:
    """A new folder of the application's."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query(f"WITH {_P}, {_A} SELECT p.doc_id, p.term FROM p JOIN a ON a.doc_id = p.doc_id WHERE p.term IN ('from', 'this', 'than') AND n_chars BETWEEN 500 AND 3000 AND quality >= 1", "filter_postings")
def filter_postings_query(spark, sf_dir):
    filters = [ZONE, {"field": "quality", "method": "BIGGER", "value": 1}]
    return filter_postings(postings(spark, sf_dir, WORDS), attributes(spark, sf_dir), filters)


@query(f"SELECT doc_id, least(CAST((weight + CASE WHEN toxic = 0 THEN 40 ELSE 0 END) * CASE WHEN quality = 1 THEN 2 ELSE 1 END AS BIGINT), 127) AS weight FROM ({_FOUND.format(top=_TOP.format(2000))} WHERE n_chars BETWEEN 500 AND 3000)")
def rank_saturated(spark, sf_dir):
    """Two adjustments, one upon the other, in a weight field of 7 bits."""
    logics = [{"field": "toxic", "method": 0, "value": 0, "operation": 0, "weight": 40}, {"field": "quality", "method": "EQUAL", "value": 1, "operation": "MUL", "weight": 2}]
    return ranking(search_filtered(spark, sf_dir), logics, bits=7).select("doc_id", "weight")


@query(f"""WITH r AS (SELECT doc_id, n_chars, CAST(weight + CASE WHEN siteno IN (1, 3, 5) THEN 7 ELSE 0 END AS BIGINT) AS weight FROM ({_FOUND.format(top=_TOP.format(2000))} WHERE quality <= 1 AND n_chars >= 300))
SELECT doc_id, weight, n_chars FROM r ORDER BY n_chars DESC, doc_id DESC LIMIT 25 OFFSET 5""")
def search_json(spark, sf_dir):
    """A query as a client sends it: methods by number, alternative names of keys, a page."""
    sent = {
        "termlist": TERMS,
        "filterlist": [{"field": "quality", "method": 2, "value": 1}, {"field": "n_chars", "method": 1, "value": 300}],
        "rankinglist": [{"field": "siteno", "method": 4, "value": [1, 3, 5], "operation": 0, "weight": 7}],
        "orderby": "n_chars",
        "offset": 5,
        "size": 25,
    }
    q = SearchQuery.from_json(json.dumps(sent))
    return q.run(postings(spark, sf_dir, q.words()), attributes(spark, sf_dir)).select("doc_id", "weight", "n_chars")


@query(f"WITH {_A} SELECT doc_id, unnest(['siteno', 'quality', 'toxic']) AS field, unnest([siteno, quality, toxic]) AS value FROM a")
def bitfield_iterate(spark, sf_dir):
    packed = bitfield_pack(spark, sf_dir)
    return packed.select("doc_id", F.inline(S.bitfield_entries(F.col("packed"), WIDTHS)))


_CELLS = "SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(string_split({}, ' ')) AS term FROM documents{}) WHERE term <> '' GROUP BY ALL"


@query(f"""WITH o AS ({_CELLS.format("text", " WHERE lang <> 'de'")}), n AS ({_CELLS.format("split_part(text, chr(10), 1)", " WHERE lang <> 'fr'")}),
b AS (SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.term, o.term) AS term, least(coalesce(n.n, o.n), 7) AS hit_count FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.term = n.term)
SELECT term, doc_id, hit_count FROM b QUALIFY row_number() OVER (PARTITION BY term ORDER BY doc_id DESC) <= 30""")
def merge_indexes(spark, sf_dir):
    """Two overlapping indexes as one: where both hold a document under a term, the newer cell; 30 postings a term."""
    docs = table(spark, sf_dir, "documents")
    older = P.index_nlp(docs.where("lang <> 'de'"))
    newer = P.index_nlp(docs.where("lang <> 'fr'").withColumn("text", S.title(F.col("text"))))
    columns = ["term", "doc_id", "hit_count"]
    return P.merge_segments(older.select(columns), newer.select(columns), 30)


@query("""WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN split_part(coalesce(text, ''), chr(10), 1) ELSE coalesce(text, '') END AS text FROM documents WHERE lang <> 'fr')
SELECT doc_id, term, count(*) AS hits FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS term FROM d) WHERE term IN ('from', 'this', 'than', 'der', 'les') GROUP BY ALL""")
def index_delta(spark, sf_dir):
    """A stored index and a small segment that supersedes some of its documents, then a compaction that deletes others,
    read by term."""
    docs = table(spark, sf_dir, "documents")
    index = SegmentedIndex(spark, home(spark, "delta"))
    for part in (docs, docs.where("lang = 'en'").withColumn("text", S.title(F.col("text")))):
        index.add(P.term_positions(part), part.select("doc_id"))
    index.compact(deleted=docs.where("lang = 'fr'").select("doc_id"))
    return index.read([*WORDS, "der", "les"]).select("doc_id", "term", F.size("positions").cast("long").alias("hits"))


@query("SELECT event_id, user_id, event_type FROM events")
def log_append(spark, sf_dir):
    """Events appended to a log in two steps, and read back."""
    rows, path = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), home(spark, "log")
    for part in ("event_type IN ('view', 'click')", "event_type NOT IN ('view', 'click')"):
        Q.append_log(rows.where(part), path)
    return Q.read_log(spark, path, rows.schema)


@query("""WITH s AS (SELECT user_id AS doc_id, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'view') AS act, bool_or(event_type = 'signup') AS inserted,
  arg_max(event_id % 1000, event_id) FILTER (WHERE event_type = 'view') AS plays FROM events WHERE event_type <> 'click' GROUP BY user_id)
SELECT doc_id, inserted AND act <> 'error' AS visible, plays FROM s WHERE inserted OR plays IS NOT NULL""")
def state_stream(spark, sf_dir):
    """The state that a follower keeps of a log: it is stopped after the first half and goes on at its checkpoint."""
    rows, at = messages(spark, sf_dir), home(spark, "state")
    middle = rows.agg(F.expr("percentile(block_id, 0.5)")).first()[0] or 0
    store, schema = StateStore(spark, f"{at}/store", 8), T.StructType.fromDDL(MESSAGE)
    for part in (F.col("block_id") <= middle, F.col("block_id") > middle):
        Q.append_log(rows.where(part), f"{at}/log")
        follow(Q.tail_log(spark, f"{at}/log", schema, WHOLE), store, f"{at}/checkpoint", once=True).awaitTermination()
    return visible(store.read()).select("doc_id", "visible", F.col("values")["plays"].alias("plays"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase'")
def follower_dispatch(spark, sf_dir):
    """A follower that is sent the purchases: its callback stores each batch under the batch's number, so that a batch
    that comes twice is stored once."""
    rows, at = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), home(spark, "follower")
    Q.append_log(rows, f"{at}/log")
    sent = Q.event_subscribe(Q.tail_log(spark, f"{at}/log", rows.schema).withColumn("queue", F.lit("events")), [("events", "purchase")], operation="event_type").drop("queue")
    dispatch(sent, lambda batch, k: batch.write.mode("overwrite").parquet(f"{at}/got/batch={k}"), f"{at}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/got").select("event_id", "user_id", "event_type")


@query("SELECT event_id, CAST(CASE WHEN event_type = 'click' THEN 1 WHEN user_id % 3 = 0 THEN 2 WHEN event_type = 'error' THEN 3 ELSE 0 END AS INTEGER) AS status FROM events")
def ingress_status(spark, sf_dir):
    """What the queue answers to empty messages, senders it does not know, and envelopes without an object as body."""
    good = F.to_json(F.struct(F.lit("events").alias("__QUEUE_NAME__"), F.col("event_type").alias("__OPERATION__"), F.from_json("props", "k long").alias("__OPERATION_BODY__")))
    raw = F.when(F.col("event_type") == "click", "").when(F.col("event_type") == "error", F.to_json(F.struct(F.lit("events").alias("__QUEUE_NAME__")))).otherwise(good)
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("10.0.0."), F.col("user_id") % 3).alias("sender"), raw.alias("raw"))
    return W.ingress(rows, sender="sender", allowed=["10.0.0.1", "10.0.0.2"]).select("event_id", "status")


@query("SELECT DISTINCT user_id AS doc_id, 'DELETE' AS operation, true AS fits FROM events WHERE event_type = 'error'")
def id_lists(spark, sf_dir):
    """Deletions as a client sends them, lists of at most 100 ids in envelopes, and as the queue reads them."""
    gone = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("doc_id")).distinct()
    body = T.StructType([T.StructField("OPERATION", T.StringType()), T.StructField("id_list", T.ArrayType(T.LongType()))])
    valid, _ = Q.envelope_validate(W.envelopes(W.id_messages(gone, "DELETE"), "documents", "DELETE"), "raw", body)
    return valid.select(F.explode("body.id_list").alias("doc_id"), "operation", (F.size("body.id_list") <= W.LONGEST_ID_LIST).alias("fits"))


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS doc_id, string_split(coalesce(text, ''), ' ') AS t FROM conversations),
w AS (SELECT doc_id, t[i] AS term, CAST(coalesce(list_sum(list_transform(t[1:i - 1], lambda x: length(x))), 0) + i - 1 AS BIGINT) AS pos FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM c)),
k AS (SELECT doc_id, term, pos FROM w WHERE term <> ''),
u AS (SELECT doc_id, x AS term, pos FROM (SELECT doc_id, term, pos, unnest(list_distinct(regexp_split_to_array(term, '[^\\p{L}\\p{N}]+'))) AS x FROM (SELECT doc_id, term, min(pos) AS pos FROM k GROUP BY ALL)) WHERE x <> '' AND x <> term),
e AS (SELECT * FROM k UNION ALL SELECT * FROM u)
SELECT doc_id, term, least(count(*), 255) AS hit_count, least(min(pos), 65535) AS offset1, least(max(pos) - min(pos), 65535) AS offset2 FROM e GROUP BY doc_id, term""")
def segmenter_postings(spark, sf_dir):
    """Turns under a segmenter that counts in characters and cuts tokens into sub-tokens, which count at their token's
    first occurrence."""
    docs = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    rules = (FieldRule("doc_id", "DOC_ID"), FieldRule("text", "NLP", position=True))
    spec = IndexSpec(rules, {"weight": 8, "hit_count": 8, "offset1": 16, "offset2": 16})
    return P.build_postings(docs, spec, S.char_segments, subs=True).select("doc_id", "term", "hit_count", "offset1", "offset2")


@query("""WITH d AS (SELECT source, CASE WHEN doc_id > 0 THEN 1 + (doc_id - 1) // 32768 ELSE 0 END AS bucket, doc_id FROM documents)
SELECT source, bucket, count(DISTINCT doc_id) AS n, coalesce(bool_or(doc_id % 32768 = 18), false) AS has_18 FROM d GROUP BY source, bucket""")
def doc_bitmaps(spark, sf_dir):
    """Documents of a source as bitmaps: how many bits are set, and whether one of them is."""
    maps = M.doc_bitmaps(table(spark, sf_dir, "documents"), "source")
    return maps.select("source", "bucket", F.bitmap_count("bitmap").alias("n"), S.bitmap_has(F.col("bitmap"), F.lit(17)).alias("has_18"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, concat_ws('.', event_id % 300, user_id % 256, 0, event_id % 7) AS address FROM events)
SELECT event_id, event_id % 300 <= 255 AS valid, event_type = 'click' AS comment, event_type AS word FROM e""")
def string_helpers(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    address = F.concat_ws(".", *(x.cast("string") for x in (F.col("event_id") % 300, F.col("user_id") % 256, F.lit(0), F.col("event_id") % 7)))
    line = F.concat(F.lit(" \t"), F.when(F.col("event_type") == "click", "# ").otherwise("a #"), F.col("event_type"))
    word = F.concat(F.lit(" \t\n"), F.col("event_type"), F.lit("\t more"))
    return rows.select("event_id", S.is_valid_ip(address).alias("valid"), S.is_comment(line).alias("comment"), S.strip(word).alias("word"))
