"""The queries of this subpackage, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeseek.llm.ann import op3_nearest
from lodeseek.llm.bpe import op6_bpe
from lodeseek.llm.chat import op10_chat_format
from lodeseek.llm.decontaminate import op7_decontaminate
from lodeseek.llm.quality import op9_quality
from lodeseek.llm.secret_scan import ENDPOINT, op8_secret_scan
from lodeseek.llm.simhash import op4_simhash
from lodeseek.llm.suffix_dedup import op2_suffix_dedup
from lodeseek.llm.token_binary import op5_token_binary
from lodeseek.llm.token_counts import op1_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_nearest": op3_nearest,
        "op4_simhash": op4_simhash,
        "op5_token_binary": op5_token_binary,
        "op6_bpe": op6_bpe,
        "op7_decontaminate": op7_decontaminate,
        "op8_secret_scan": op8_secret_scan,
        "op9_quality": op9_quality,
        "op10_chat_format": op10_chat_format,
    }


OP2_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS p FROM b WHERE n >= 200)),
r AS (SELECT doc_id, p FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
i AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM i),
sp AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS z FROM g GROUP BY doc_id, s),
k AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM sp
  UNION ALL SELECT b.doc_id, coalesce(max(z), 0), any_value(n) FROM b LEFT JOIN sp ON sp.doc_id = b.doc_id GROUP BY b.doc_id)
SELECT b.doc_id, CAST(any_value(n) AS BIGINT) AS n_bytes, CAST(any_value(n) - sum(t - f) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans,
  sha256(unhex(string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY f))) AS kept_sha256
FROM b JOIN k ON k.doc_id = b.doc_id GROUP BY b.doc_id
"""

_ESCAPED = "length({0}) + length({0}) - length(replace({0}, chr(92), '')) + len(regexp_extract_all({0}, '<s>|</s>|\\[INST\\]|\\[/INST\\]|\\[TURN\\]|\\[TEXT\\]'))"
OP10_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum(12 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")} + CASE role WHEN 'assistant' THEN 0 ELSE 13 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def _spans_sql(name: str, pattern: str, kind: int, keep: str, group: int = 0) -> str:
    """CTEs that end in ``name`` (doc_id, k, s, e): the matches of a pattern, from the pieces between them."""
    pattern = pattern.replace("'", "''")
    return f"""{name}_m AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS g FROM d WHERE regexp_matches(t, '{pattern}')),
{name}_i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_m),
{name} AS (SELECT doc_id, {kind} AS k, s, s + n AS e FROM (SELECT doc_id, m[i] AS x, v[i] AS w, length(m[i]) AS n,
  list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS s FROM {name}_i) WHERE {keep})"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
_NEAR = "{0}.doc_id = {1}.doc_id AND {0}.s - {1}.e <= 400 AND {1}.s - {0}.e <= 400"
_JOINED = "string_agg(['assign', 'access', 'hex', 'secret', 'endpoint'][k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k, e)"
#: A bare secret, which the operator finds with look-around, is a maximal run of the wider class that fits the narrower one.
OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_spans_sql("a", f"""({_KEYS})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0, "length(w) >= 6", 2)},
{_spans_sql("b", "AKIA[A-Z0-9]+", 1, "n >= 20")},
{_spans_sql("c", "[0-9a-f]{24,}", 2, "n >= 24")},
{_spans_sql("f", "[A-Za-z0-9+/=_-]{40,}", 3, "n = 40 AND regexp_full_match(x, '[A-Za-z0-9+/]{40}')")},
{_spans_sql("u", ENDPOINT, 4, "true")},
base AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
secrets AS (SELECT DISTINCT f.* FROM f JOIN b ON {_NEAR.format("f", "b")}),
strong AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM secrets),
found AS (SELECT *, true AS is_base FROM base UNION ALL SELECT *, false FROM secrets UNION ALL SELECT DISTINCT u.*, false FROM u JOIN strong ON {_NEAR.format("u", "strong")})
SELECT d.doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  sha256(coalesce({_JOINED} FILTER (WHERE is_base), '')) AS base_sha256, coalesce({_JOINED} FILTER (WHERE k IS NOT NULL), '') AS spans
FROM d LEFT JOIN found ON found.doc_id = d.doc_id GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """The others are beyond SQL (tokenizers, XXH64, a fitted model, an approximate search): tests hold them against
    brute force."""
    return {"op2_suffix_dedup": OP2_SQL, "op8_secret_scan": OP8_SQL, "op10_chat_format": OP10_SQL}
