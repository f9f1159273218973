import re

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import scalars as S
from lodeseek.operators.merge import doc_bitmaps
from lodeseek.operators.postings import build_postings
from lodeseek.plans.spec import FieldRule, IndexSpec


def bkdr(data: bytes) -> int:
    h = 0
    for c in data:
        h = (h * 131313 + c) % 2**32
    return h % 2**31


def ap(data: bytes) -> int:
    h = 0
    for i, c in enumerate(data):
        mixed = (h << 7) ^ c ^ (h >> 3) if i % 2 == 0 else ~((h << 11) ^ c ^ (h >> 5))
        h = (h ^ mixed) % 2**32
    return h % 2**31


def test_signatures(spark):
    words = ["", "a", "ab", "src12", "Ünïcode 漢字", "x" * 300]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", S.sign_bkdr(F.col("w")), S.sign_ap(F.col("w")), S.sign64(F.col("w"))).collect()
    for w, b, a, both in rows:
        assert (b, a) == (bkdr(w.encode()), ap(w.encode()))
        assert both == b << 32 | a


def test_tokens_and_prefixes(spark):
    rows = spark.createDataFrame([("b  a b ",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(S.tokens(F.col("t"))).collect()] == [["b", "a", "b"], [], []]
    assert [r[0] for r in rows.select(S.distinct_tokens(F.col("t"))).collect()] == [["b", "a"], [], []]
    lists = spark.createDataFrame([([3, None, 3, 4],)], "x array<long>")
    assert lists.select(S.prefixed_list("T^", F.col("x"))).first()[0] == ["T^3", "T^4"]


def test_bit_fields_keep_their_neighbours(spark):
    widths = {"id0": 25, "id1": 7, "id2": 17, "id3": 9, "id4": 5}
    values = {"id0": 33554431, "id1": 100, "id2": 7, "id3": 600, "id4": None}
    packed = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} long" for n in widths)).select(S.bitfield_pack(widths).alias("p"))
    want = {"id0": 33554431, "id1": 100, "id2": 7, "id3": 511, "id4": 0}
    assert packed.select(*(S.bitfield_get(F.col("p"), n, widths).alias(n) for n in widths)).first().asDict() == want
    changed = packed.select(S.bitfield_set(F.col("p"), "id1", F.lit(500), widths).alias("p"))
    assert changed.select(*(S.bitfield_get(F.col("p"), n, widths).alias(n) for n in widths)).first().asDict() == want | {"id1": 127}
    with pytest.raises(ValueError):
        S.bit_layout({"a": 32, "b": 32})


def test_saturating_steps(spark):
    value, seen = 100, []
    for _ in range(4):
        value = spark.range(1).select(S.saturate(F.lit(value) + 10, 7)).first()[0]
        seen.append(value)
    assert seen == [110, 120, 127, 127]


def test_configuration_helpers(spark):
    rows = spark.createDataFrame([(" \t a b", "  # x", "10.0.0.255"), ("a\n", "a # x", "256.1.1.1"), ("", "", "1.2.3"), (None, None, None), ("x", "#", "255.255.255.255")], "a string, b string, c string")
    got = [tuple(r) for r in rows.select(S.strip(F.col("a")), S.is_comment(F.col("b")), S.is_valid_ip(F.col("c"))).collect()]
    assert got == [("a", True, True), ("a", False, False), ("", False, False), (None, False, False), ("x", True, False)]


def _segments(text):
    """Brute force: (pos, term, parts) of each token, places in characters."""
    out = []
    for m in re.finditer("[^ ]+", text or ""):
        parts = [x for x in dict.fromkeys(re.split(r"[\W_]+", m[0])) if x and x != m[0]]
        out.append((m.start(), m[0], [(m.start(), x) for x in parts]))
    return out


def test_segments_count_in_characters(spark):
    texts = [None, "", "   ", "ab", " ab-c  déf \U0001f600 x_y-x ", "a-b a-b\n\tq", "x" * 5000, "ab-c d " * 6000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: [(t.pos, t.term, [(s.pos, s.term) for s in t.subs]) for t in r.s] for r in rows.select("k", S.char_segments(F.col("text")).alias("s")).collect()}
    assert got == {k: _segments(t) for k, t in enumerate(texts)}


def test_sub_tokens_count_once_in_a_long_text(spark):
    rules = (FieldRule("doc_id", "DOC_ID"), FieldRule("text", "NLP", position=True))
    spec = IndexSpec(rules, {"weight": 8, "hit_count": 32, "offset1": 32, "offset2": 32})
    docs = spark.createDataFrame([(1, "ab-c d " * 6000), (2, None), (3, "")], "doc_id long, text string")
    got = {r.term: (r.hit_count, r.offset1, r.offset2) for r in build_postings(docs, spec, S.char_segments, subs=True).collect()}
    assert got == {"ab-c": (6000, 0, 5999 * 7), "d": (6000, 5, 5999 * 7), "ab": (1, 0, 0), "c": (1, 0, 0)}


def test_bitmap_bits(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 18), ("a", 18), ("a", 40000), ("b", 8)], "key string, doc_id long")
    maps = doc_bitmaps(rows, "key").select("key", "bucket", S.bitmap_has(F.col("bitmap"), F.lit(17)).alias("x"), S.bitmap_has(F.col("bitmap"), F.lit(7)).alias("y"))
    assert {(r.key, r.bucket): (r.x, r.y) for r in maps.collect()} == {("a", 0): (False, False), ("a", 1): (True, False), ("a", 2): (False, False), ("b", 1): (False, True)}
