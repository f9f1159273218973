"""Named queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.functions import scalars as S
from lodeseek.operators import merge as M
from lodeseek.operators import postings as P
from lodeseek.operators import state as D
from lodeseek.operators import topk as K
from lodeseek.operators.predicates import apply_filters
from lodeseek.engine import SearchEngine
from lodeseek.operators.rank import proximity_scores, ranking
from lodeseek.plans.query import SearchQuery
from lodeseek.plans.spec import FieldRule, IndexSpec
from lodeseek.session import shared_folder
from lodeseek.sources import queue as Q
from lodeseek.sources import tables as A
from lodeseek.sources.segments import SegmentedIndex
from lodeseek.streaming.apply import MESSAGE

Query = Callable[[SparkSession, str], DataFrame]
TERMS = [{"term": "from", "weight": 50}, {"term": "this", "weight": 30}, {"term": "than", "weight": 20}]
WORDS = [t["term"] for t in TERMS]
ZONE = {"field": "n_chars", "method": "ZONE", "min": 500, "max": 3000}
WIDTHS = {"siteno": 20, "quality": 2, "toxic": 2}

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.attribute_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def build_index(spark: SparkSession, sf_dir: str, path: str) -> SegmentedIndex:
    """The documents' postings (doc_id, term, positions), stored."""
    index, docs = SegmentedIndex(spark, path), table(spark, sf_dir, "documents")
    index.add(P.term_positions(docs), docs.select("doc_id"))
    return index


def stored(spark: SparkSession, sf_dir: str) -> SegmentedIndex:
    """The stored index of these tables: built by the application's first query, read by all others."""
    path = f"{shared_folder(spark)}/index-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    index = SegmentedIndex(spark, path)
    return index if index.exists() else build_index(spark, sf_dir, path)


def postings(spark: SparkSession, sf_dir: str, terms: list[str] | None = None) -> DataFrame:
    return stored(spark, sf_dir).read(terms).select("doc_id", "term")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a message log: user_id is the document, event_id the position."""
    names = {"signup": "INSERT", "error": "DELETE", "purchase": "RESTORE"}
    operation = F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("event_type")], F.lit("ATTR"))
    return table(spark, sf_dir, "events").withColumn("operation", operation)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of the engine: inserts, deletions, restorals, and views, which update the attribute plays."""
    acts = {"signup": "INSERT", "error": "DELETE", "purchase": "RESTORE", "view": "UPDATE"}
    kind = F.create_map(*(F.lit(x) for kv in acts.items() for x in kv))[F.col("event_type")]
    listed, view = F.col("event_type").isin("error", "purchase"), F.col("event_type") == "view"
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<long>"))
    columns = [F.lit(0).cast("long"), F.col("event_id"), kind, F.when(~listed, F.col("user_id")), F.when(listed, F.array("user_id")), ~view, F.when(view, F.create_map(F.lit("plays"), F.col("event_id") % 1000)).otherwise(none)]
    names = [c.split()[0] for c in MESSAGE.split(", ")]
    return table(spark, sf_dir, "events").where("event_type <> 'click'").select(*(c.alias(n) for c, n in zip(columns, names)))


#: Pieces of SQL that several queries share.
_P = "p AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS term FROM documents) WHERE term <> '')"
_A = """a AS (SELECT d.doc_id, d.n_chars, CAST(regexp_extract(d.source, '(\\d+)$', 1) AS BIGINT) AS siteno,
  CAST(coalesce(l.quality, 0) AS BIGINT) AS quality, CAST(coalesce(l.toxic, 0) AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_W = "w AS (SELECT doc_id, CAST(sum(CASE term WHEN 'from' THEN 50 WHEN 'this' THEN 30 ELSE 20 END) AS BIGINT) AS weight FROM p WHERE term IN ('from', 'this', 'than') GROUP BY doc_id)"
_TOP = "c AS (SELECT * FROM w ORDER BY weight DESC, doc_id DESC LIMIT {})"
_COLS = "doc_id, n_chars, siteno, quality, toxic"


@query("SELECT doc_id, 'from' AS term FROM documents WHERE list_contains(string_split(text, ' '), 'from')")
def posting_scan(spark, sf_dir):
    return P.posting_scan(postings(spark, sf_dir, ["from"]), "from")


@query(f"WITH {_P} SELECT term, count(*) AS df FROM p GROUP BY term")
def term_dictionary(spark, sf_dir):
    return P.term_dictionary(postings(spark, sf_dir))


@query(f"WITH {_A} SELECT {_COLS} FROM a WHERE doc_id IN (SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'than'))")
def attr_lookup(spark, sf_dir):
    return A.attr_lookup(postings(spark, sf_dir, ["than"]).select("doc_id"), attributes(spark, sf_dir))


def _filtered(name: str, filters: list[dict], where: str) -> None:
    query(f"WITH {_A} SELECT {_COLS} FROM a WHERE {where}", name)(lambda spark, sf_dir: apply_filters(attributes(spark, sf_dir), filters))


_filtered("filter_equal", [{"field": "siteno", "method": 0, "value": 5}], "siteno = 5")
_filtered("filter_bigger", [{"field": "n_chars", "method": 1, "value": 2000}], "n_chars >= 2000")
_filtered("filter_smaller", [{"field": "n_chars", "method": 2, "value": 900}], "n_chars <= 900")
_filtered("filter_zone", [ZONE], "n_chars BETWEEN 500 AND 3000")
_filtered("filter_set", [{"field": "siteno", "method": "SET", "value": [1, 3, 5]}], "siteno IN (1, 3, 5)")
_filtered(
    "filter_mix",
    [{"field": "toxic", "method": "EQUAL", "value": 0}, {"field": "quality", "method": "BIGGER", "value": 1}, {"field": "doc_id", "method": "SMALLER", "value": 900}, ZONE, {"field": "siteno", "method": "SET", "value": [1, 3, 5, 7]}],
    "toxic = 0 AND quality >= 1 AND doc_id <= 900 AND n_chars BETWEEN 500 AND 3000 AND siteno IN (1, 3, 5, 7)",
)


@query("SELECT doc_id FROM documents WHERE list_contains(string_split(split_part(text, chr(10), 1), ' '), 'the')")
def filter_in_title(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where(F.array_contains(S.tokens(S.title(F.col("text"))), "the")).select("doc_id")


_STATE_SQL = """s AS (SELECT user_id AS doc_id, arg_max(CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'RESTORE' END, event_id) AS last_operation,
  bool_or(event_type = 'signup') AS has_insert FROM events WHERE event_type IN ('signup', 'error', 'purchase') GROUP BY user_id)"""


@query(f"WITH {_STATE_SQL} SELECT event_id, user_id FROM events WHERE event_type = 'view' AND user_id IN (SELECT doc_id FROM s WHERE has_insert AND last_operation <> 'DELETE')")
def filter_live(spark, sf_dir):
    messages = log(spark, sf_dir)
    state = D.delete_restore_state(messages, "user_id", "event_id")
    return D.filter_live(messages.where("event_type = 'view'").select("event_id", "user_id"), state, "user_id")


@query(f"""WITH {_STATE_SQL}, v AS (SELECT event_id, user_id FROM events WHERE event_type = 'signup')
SELECT event_id, user_id FROM v WHERE event_id = (SELECT max(event_id) FROM v w WHERE w.user_id = v.user_id) AND user_id IN (SELECT doc_id FROM s WHERE has_insert AND last_operation <> 'DELETE')""")
def filter_superseded(spark, sf_dir):
    """Signups as versions of their user: the newest of each, where the user is visible."""
    messages = log(spark, sf_dir)
    versions = messages.where("event_type = 'signup'").select("event_id", "user_id")
    state = D.delete_restore_state(messages, "user_id", "event_id").join(D.latest_version(versions, "user_id", "event_id", []), "user_id", "left")
    return D.filter_live(versions, state, "user_id", "event_id")


@query(f"""WITH {_P}, {_W}, e AS (SELECT * FROM events WHERE event_type <> 'click'),
s AS (SELECT user_id AS doc_id, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'view') AS act, arg_max(event_id % 1000, event_id) FILTER (WHERE event_type = 'view') AS plays FROM e GROUP BY user_id),
{_TOP.format(2000)}
SELECT c.doc_id, weight, d.n_chars, CAST(coalesce(s.plays, 0) AS BIGINT) AS plays FROM c JOIN documents d ON d.doc_id = c.doc_id LEFT JOIN s ON s.doc_id = c.doc_id
WHERE coalesce(s.act, '') <> 'error' AND coalesce(s.plays, 0) BETWEEN 0 AND 900""")
def engine_replay(spark, sf_dir):
    """The engine over all documents after a log of inserts, attribute updates (views), deletions and restorals."""
    docs = table(spark, sf_dir, "documents").withColumn("plays", F.lit(None).cast("long"))
    spec = IndexSpec((FieldRule("doc_id", "DOC_ID"), FieldRule("text", "NLP")), {"weight": 8, "hit_count": 3}, {"n_chars": 32, "plays": 32})
    engine = SearchEngine(spec, docs, index=stored(spark, sf_dir)).apply(messages(spark, sf_dir))
    return engine.matches(SearchQuery(TERMS, [{"field": "plays", "method": "ZONE", "min": 0, "max": 900}]))


@query(f"WITH {_P}, {_W}, {_TOP.format(2000)} SELECT doc_id, weight FROM c")
def weight_merge(spark, sf_dir):
    return M.weight_merge(postings(spark, sf_dir, WORDS), TERMS)


@query("""WITH x AS (SELECT doc_id, unnest(string_split(text, ' ')) AS term, 1 AS w FROM documents UNION ALL SELECT doc_id, unnest(string_split(split_part(text, chr(10), 1), ' ')), 5 FROM documents),
p AS (SELECT doc_id, term, sum(w) AS w FROM (SELECT DISTINCT * FROM x) WHERE term IN ('from', 'this', 'than') GROUP BY doc_id, term),
c AS (SELECT doc_id, CAST(sum(w * CASE term WHEN 'from' THEN 50 WHEN 'this' THEN 30 ELSE 1 END) AS BIGINT) AS weight FROM p GROUP BY doc_id)
SELECT doc_id, weight FROM c ORDER BY weight DESC, doc_id DESC LIMIT 2000""")
def weight_merge_fields(spark, sf_dir):
    """Postings with weights of their own (title 5, text 1); a term weight of 0 acts as 1."""
    terms = [*TERMS[:2], {"term": "than", "weight": 0}]
    return M.weight_merge(P.index_multifield(table(spark, sf_dir, "documents")), terms)


@query(f"WITH {_P} SELECT doc_id, CAST(min(CASE term WHEN 'from' THEN 0 ELSE 1 END) AS INTEGER) AS list_no FROM p WHERE term IN ('from', 'The') GROUP BY doc_id")
def or_merge(spark, sf_dir):
    rows = postings(spark, sf_dir, ["from", "The"])
    return M.or_merge([rows.where(F.col("term") == t).select("doc_id") for t in ("from", "The")])


@query(f"WITH {_P}, g AS (SELECT doc_id, CASE term WHEN 'this' THEN 30 ELSE 50 END AS w FROM p WHERE term IN ('from', 'The', 'this') GROUP BY ALL), w AS (SELECT doc_id, CAST(sum(w) AS BIGINT) AS weight FROM g GROUP BY doc_id), {_TOP.format(2000)} SELECT doc_id, weight FROM c")
def synonyms(spark, sf_dir):
    terms = [{"term": "from", "weight": 50, "synonyms": ["The"]}, {"term": "this", "weight": 30}]
    return M.weight_merge(postings(spark, sf_dir, ["from", "The", "this"]), terms)


@query(f"WITH {_P} SELECT doc_id, CAST(100 AS BIGINT) AS weight FROM p WHERE term IN ('from', 'this', 'than') GROUP BY doc_id HAVING count(DISTINCT term) = 3")
def must_hit_all(spark, sf_dir):
    return M.must_hit_all(postings(spark, sf_dir, WORDS), TERMS)


def _search(spark, sf_dir, **more) -> tuple[SearchQuery, DataFrame]:
    q = SearchQuery(TERMS, **more)
    return q, q.matches(postings(spark, sf_dir, WORDS), attributes(spark, sf_dir))


_FOUND = f"WITH {_P}, {_A}, {_W}, {{top}} SELECT a.doc_id, weight, n_chars, siteno, quality, toxic FROM c JOIN a ON a.doc_id = c.doc_id"


@query(_FOUND.format(top=_TOP.format(2000)) + " WHERE n_chars BETWEEN 500 AND 3000")
def search_filtered(spark, sf_dir):
    return _search(spark, sf_dir, filters=[ZONE])[1]


@query(_FOUND.format(top=_TOP.format(50)) + " WHERE n_chars BETWEEN 500 AND 3000")
def search_cap(spark, sf_dir):
    return _search(spark, sf_dir, filters=[ZONE], candidates=50)[1]


@query(_FOUND.format(top=_TOP.format(2000)) + " WHERE n_chars BETWEEN 500 AND 3000 ORDER BY n_chars DESC, a.doc_id DESC LIMIT 30 OFFSET 20")
def search_page(spark, sf_dir):
    q, rows = _search(spark, sf_dir, filters=[ZONE], sortby="n_chars", offset=20, size=30)
    return q.page(rows)


@query(f"SELECT count(*) AS all_num FROM ({_FOUND.format(top=_TOP.format(2000))} WHERE n_chars BETWEEN 500 AND 3000)")
def search_all_num(spark, sf_dir):
    return search_filtered(spark, sf_dir).agg(F.count("*").alias("all_num"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100")
def topk_field(spark, sf_dir):
    return K.topk_field(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 100, "o_orderkey")


@query("SELECT o_orderkey, o_totalprice, o_orderdate, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS rank FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 30)")
def topk_nested(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return K.topk_nested(rows, "o_totalprice", 30, "o_orderdate", "o_orderkey")


@query(f"WITH {_P}, f AS (SELECT term FROM p GROUP BY term HAVING count(*) > 100) SELECT term, doc_id FROM p WHERE term IN (SELECT term FROM f) QUALIFY row_number() OVER (PARTITION BY term ORDER BY doc_id DESC) <= 20")
def posting_cap(spark, sf_dir):
    return P.posting_cap(postings(spark, sf_dir), 20, 100)


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def group_count(spark, sf_dir):
    return M.group_count(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query(f"SELECT siteno, count(*) AS n FROM ({_FOUND.format(top=_TOP.format(2000))}) GROUP BY siteno")
def group_count_search(spark, sf_dir):
    q, rows = _search(spark, sf_dir, groupcount="siteno")
    return q.counts(rows)


@query(f"SELECT doc_id, CAST(weight + CASE WHEN quality = 1 THEN 25 ELSE 0 END AS BIGINT) AS weight FROM ({_FOUND.format(top=_TOP.format(2000))})")
def rank_add(spark, sf_dir):
    logic = {"field": "quality", "method": "EQUAL", "value": 1, "operation": "ADD", "weight": 25}
    return ranking(_search(spark, sf_dir)[1], [logic]).select("doc_id", "weight")


@query(f"SELECT doc_id, CAST(weight * CASE WHEN n_chars BETWEEN 500 AND 3000 THEN 2 ELSE 1 END AS BIGINT) AS weight FROM ({_FOUND.format(top=_TOP.format(2000))})")
def rank_mul(spark, sf_dir):
    return _search(spark, sf_dir, ranking=[{**ZONE, "operation": "MUL", "weight": 2}])[1].select("doc_id", "weight")


_POS = "SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS t FROM documents"


@query(f"""WITH d AS ({_POS}), x AS (SELECT doc_id, t[i] AS term, i - 1 AS pos FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM d))
SELECT a.doc_id, min(abs(a.pos - b.pos) + abs(b.pos - c.pos)) AS spread FROM x a JOIN x b ON a.doc_id = b.doc_id JOIN x c ON b.doc_id = c.doc_id
WHERE a.term = 'from' AND b.term = 'this' AND c.term = 'than' GROUP BY a.doc_id""", "proximity")
def proximity_query(spark, sf_dir):
    return proximity_scores(stored(spark, sf_dir).read(WORDS), WORDS)


@query(f"""WITH d AS ({_POS}), x AS (SELECT doc_id, t[i] AS term, i - 1 AS pos FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM d))
SELECT doc_id, term, least(count(*), 7) AS hit_count, min(pos) AS offset1, max(pos) - min(pos) AS offset2 FROM x GROUP BY doc_id, term""")
def index_nlp(spark, sf_dir):
    return P.index_nlp(table(spark, sf_dir, "documents"))


@query("""WITH x AS (SELECT doc_id, unnest(string_split(text, ' ')) AS term, 0 AS t FROM documents UNION ALL SELECT doc_id, unnest(string_split(split_part(text, chr(10), 1), ' ')), 1 FROM documents),
f AS (SELECT doc_id, term, t, count(*) AS n FROM x WHERE term <> '' GROUP BY ALL)
SELECT doc_id, term, CAST(sum(CASE t WHEN 1 THEN 5 ELSE 1 END) AS BIGINT) AS weight, CAST(max(t) AS BIGINT) AS title_hit, CAST(least(sum(n), 7) AS BIGINT) AS hit_count FROM f GROUP BY doc_id, term""")
def index_multifield(spark, sf_dir):
    return P.index_multifield(table(spark, sf_dir, "documents"))


@query("SELECT l_orderkey, CAST(least(sum(l_linenumber), 15) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey")
def saturating_sum(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(S.saturate(F.sum("l_linenumber"), 4).alias("total"))


@query("SELECT doc_id, CAST(len(list_distinct(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS BIGINT) AS n FROM documents")
def distinct_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(S.distinct_tokens(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, 'QUALITY^' || CAST(quality AS VARCHAR) AS term FROM labels")
def prefix_int(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", S.prefixed("QUALITY^", F.col("quality")).alias("term"))


@query("SELECT doc_id, 'LANG^' || lang AS term FROM documents UNION ALL SELECT doc_id, 'SRC^' || source FROM documents")
def prefix_str(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(S.prefixed("LANG^", F.col("lang")), S.prefixed("SRC^", F.col("source")))).alias("term"))


@query("SELECT DISTINCT conv_id, 'ROLE^' || role AS term FROM conversations")
def prefix_list_str(spark, sf_dir):
    roles = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return roles.select("conv_id", F.explode(S.prefixed_list("ROLE^", F.col("roles"))).alias("term"))


@query("SELECT DISTINCT l_orderkey, 'SUPP^' || CAST(l_suppkey AS VARCHAR) AS term FROM lineitem")
def prefix_list_int(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("keys"))
    return keys.select("l_orderkey", F.explode(S.prefixed_list("SUPP^", F.col("keys"))).alias("term"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'signup' GROUP BY user_id")
def latest_version(spark, sf_dir):
    return D.latest_version(log(spark, sf_dir).where("event_type = 'signup'"), "user_id", "event_id", ["value"])


@query("SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_type = 'view') AS views, arg_max(value, event_id) FILTER (WHERE event_type = 'click') AS clicks FROM events GROUP BY user_id")
def attr_carry_forward(spark, sf_dir):
    fields = {"views": F.when(F.col("event_type") == "view", F.col("value")), "clicks": F.when(F.col("event_type") == "click", F.col("value"))}
    return D.attr_carry_forward(log(spark, sf_dir), "user_id", "event_id", fields)


@query(f"WITH {_STATE_SQL} SELECT doc_id AS user_id, last_operation, has_insert, has_insert AND last_operation <> 'DELETE' AS visible FROM s")
def delete_restore_state(spark, sf_dir):
    return D.delete_restore_state(log(spark, sf_dir), "user_id", "event_id")


@query("SELECT DISTINCT event_id, user_id, event_type FROM (SELECT * FROM events UNION ALL SELECT * FROM events)")
def dedup_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return D.dedup_messages(rows.unionByName(rows), ["event_id"])


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 5000")
def queue_seek(spark, sf_dir):
    return D.queue_seek(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["event_id"], (5000,))


@query("SELECT event_id, user_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS seq FROM events")
def queue_replay(spark, sf_dir):
    return D.replay_sequence(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id")


@query("SELECT event_id, event_type AS operation, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error'")
def envelope_validate(spark, sf_dir):
    name = F.when(F.col("event_type") != "error", F.lit("events"))  # an envelope without a queue name is refused
    raw = F.to_json(F.struct(name.alias("__QUEUE_NAME__"), F.col("event_type").alias("__OPERATION__"), F.from_json("props", "k long").alias("__OPERATION_BODY__")))
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    valid, _ = Q.envelope_validate(rows, "raw", T.StructType([T.StructField("k", T.LongType())]))
    return valid.select("event_id", "operation", F.col("body.k").alias("k"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('view', 'click')")
def event_subscribe(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.lit("events").alias("queue"))
    return Q.event_subscribe(rows, [("events", "view"), ("events", "click")], "queue", "event_type").drop("queue")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, max(event_id) AS queue_at, coalesce(max(event_id) FILTER (WHERE event_type = 'purchase'), -1) AS p FROM events GROUP BY 1),
f AS (SELECT day, queue_at, max(p) OVER (ORDER BY day) AS follower_at FROM d),
s AS (SELECT *, queue_at <> lag(queue_at) OVER (ORDER BY day) AS grown, follower_at <> lag(follower_at) OVER (ORDER BY day) AS moved FROM f),
c AS (SELECT *, CASE WHEN grown AND moved THEN 'OK' WHEN grown AND NOT moved THEN 'STOP' END AS change FROM s)
SELECT 'buyer' AS channel, day, queue_at, follower_at, coalesce(last_value(change IGNORE NULLS) OVER (ORDER BY day), 'OK') AS status FROM c""")
def lag_monitor(spark, sf_dir):
    """Daily polls of one follower, which has come as far as the last purchase.  One row a day."""
    from pyspark.sql import Window

    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.max("event_id").alias("queue_at"), F.coalesce(F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))), F.lit(-1)).alias("_p"))
    polls = daily.withColumn("channel", F.lit("buyer")).withColumn("follower_at", F.max("_p").over(Window.partitionBy("channel").orderBy("day"))).drop("_p")
    return Q.lag_monitor(polls, "channel", "day", "queue_at", "follower_at").select("channel", "day", "queue_at", "follower_at", "status")


@query("""WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN split_part(coalesce(text, ''), chr(10), 1) ELSE coalesce(text, '') END AS text FROM documents),
x AS (SELECT doc_id, t[i] AS term, i - 1 AS pos FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS t FROM d))),
p AS (SELECT term, doc_id, count(*) AS hits, min(pos) AS offset1 FROM x GROUP BY ALL)
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY term ORDER BY doc_id DESC) <= 50""")
def index_compact(spark, sf_dir):
    """Three segments, of which later ones hold some documents of the first anew (in English: their title only), as one."""
    docs = table(spark, sf_dir, "documents")
    index = SegmentedIndex(spark, f"{shared_folder(spark)}/compact-{uuid.uuid4().hex[:12]}")
    titles = docs.where("lang = 'en'").withColumn("text", S.title(F.col("text")))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    for part in (docs, titles.where(half), titles.where(~half)):
        index.add(P.term_positions(part), part.select("doc_id"))
    index.compact(last=2)
    index.compact(most=50)
    return index.read().select("term", "doc_id", F.size("positions").cast("long").alias("hits"), F.array_min("positions").cast("long").alias("offset1"))


@query("SELECT page_id, url, length(html) AS n FROM pages WHERE page_id IN (1, 7, 20, 33, 49)")
def detail_lookup(spark, sf_dir):
    pages = A.detail_lookup(table(spark, sf_dir, "pages"), "page_id", [1, 7, 20, 33, 49])
    return pages.select("page_id", "url", F.length("html").cast("long").alias("n"))


_SIGN = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(source, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 131313 + c) & 4294967295) & 2147483647"


@query(f"SELECT doc_id, source, {_SIGN} AS sign FROM documents")
def sign_bkdr(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", S.sign_bkdr(F.col("source")).alias("sign"))


_SIGN_AP = """list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(source, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda h, c, i: xor(h, CASE WHEN i % 2 = 0 THEN xor(xor(h << 7, c), h >> 3) ELSE ~xor(xor(h << 11, c), h >> 5) END) & 4294967295) & 2147483647"""


@query(f"SELECT doc_id, sign, sign % 4 AS shard FROM (SELECT doc_id, ({_SIGN}) * 4294967296 + ({_SIGN_AP}) AS sign FROM documents)")
def shard_assign(spark, sf_dir):
    sign = S.sign64(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", sign.alias("sign"), S.shard(sign).alias("shard"))


@query(f"WITH {_A} SELECT doc_id, siteno + quality * 1048576 + toxic * 4194304 AS packed FROM a")
def bitfield_pack(spark, sf_dir):
    return attributes(spark, sf_dir).select("doc_id", S.bitfield_pack(WIDTHS).alias("packed"))


@query(f"WITH {_A} SELECT doc_id, siteno, quality, toxic FROM a")
def bitfield_unpack(spark, sf_dir):
    packed = bitfield_pack(spark, sf_dir)
    return packed.select("doc_id", *(S.bitfield_get(F.col("packed"), n, WIDTHS).alias(n) for n in WIDTHS))


@query(f"""SELECT doc_id, '{{"doc_id":' || doc_id || ',"weight":' || weight || ',"n_chars":' || n_chars || ',"siteno":' || siteno || ',"quality":' || quality || ',"toxic":' || toxic || '}}' AS json FROM ({_FOUND.format(top=_TOP.format(2000))} WHERE n_chars BETWEEN 500 AND 3000)""")
def result_json(spark, sf_dir):
    return A.result_json(search_filtered(spark, sf_dir))


@query(f"""WITH {_P}, {_A}, {_W}, {_TOP.format(2000)}, f AS (SELECT a.doc_id, weight, n_chars FROM c JOIN a ON a.doc_id = c.doc_id WHERE n_chars BETWEEN 500 AND 3000),
g AS (SELECT * FROM f ORDER BY n_chars DESC, doc_id DESC LIMIT 30 OFFSET 20)
SELECT '{{"all_num":' || (SELECT count(*) FROM f) || ',"doc_list":[' || coalesce(string_agg('{{"doc_id":' || doc_id || ',"weight":' || weight || '}}', ',' ORDER BY n_chars DESC, doc_id DESC), '') || ']}}' AS json FROM g""")
def result_envelope(spark, sf_dir):
    q, rows = _search(spark, sf_dir, filters=[ZONE], sortby="n_chars", offset=20, size=30)
    return A.result_envelope(q.page(rows), rows, ["doc_id", "weight"], "n_chars")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three weighted terms, the zone filter, one page."""
    q, rows = _search(spark, sf_dir, filters=[ZONE], size=100)
    return q.page(rows)
