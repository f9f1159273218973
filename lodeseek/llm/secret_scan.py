"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans (assignments, access identifiers, long hex runs) are reported wherever they stand.  Weak
parts, which alone mean little, are a bare 40-character secret and an endpoint URL: an interval join
inside the document reports them only where complementary parts lie within the same scope, that is
at most ``scope`` code points apart: a secret beside an access identifier, an endpoint beside an
access identifier, an assignment or such a secret.

Positions come from the pieces between matches (``split``) and the matches (``regexp_extract_all``)
of the same pattern, summed in blocks, so nothing is quadratic in the number of matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm._common import Scratch, documents

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that starts with the leftmost AKIA ends where the class ends, so asking for the length inside the pattern is the same.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
SECRET = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"""[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"""
KINDS = ("assign", "access", "hex", "secret", "endpoint")
MASK = "[SECRET]"
_BLOCK = 256
_SPAN = "array<struct<s:int,k:int,e:int>>"


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` makes of all elements before each one, from 0 on, in blocks of ``_BLOCK``."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))

    def before(xs: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(xs, zero, lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])

    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), step))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), before(totals, F.lit(0)).alias("o")), lambda z: before(z["b"], z["o"])))


def _spans(text: Column, pattern: str, kind: int, value_group: int | None = None, least: int = 0) -> Column:
    """Array of (s, k, e) of the matches whose value has at least ``least`` characters; empty without a match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else matches
    lens = F.transform(F.arrays_zip(gaps.alias("g"), matches.alias("m")), lambda z: F.struct(F.length(z["g"]).alias("g"), F.coalesce(F.length(z["m"]), F.lit(0)).alias("m")))
    starts = _running(F.transform(lens, lambda x: x["g"] + x["m"]), lambda a, x: a + x)
    rows = F.transform(
        F.arrays_zip(lens.alias("l"), starts.alias("b"), F.transform(values, F.length).alias("v")),
        lambda z: F.struct((z["b"] + z["l"]["g"]).alias("s"), F.lit(kind).alias("k"), (z["b"] + z["l"]["g"] + z["l"]["m"]).alias("e"), F.coalesce(z["v"], F.lit(-1)).alias("v")),
    )
    kept = F.transform(F.filter(rows, lambda r: (r["e"] > r["s"]) & (r["v"] >= least)), lambda r: F.struct(r["s"].alias("s"), r["k"].alias("k"), r["e"].alias("e")))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, scope: int = 400, id_col: str = "doc_id", text_col: str = "text", carry_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, base and linked (arrays of s, k, e: start, index into KINDS, end; code points,
    end exclusive), with ``carry_text`` also row (all input columns as one struct).

    Null texts have no spans; null ids, ties and repeated rows stay as they are, each row on its own; an empty
    table gives an empty table; other columns, whatever their names, are only carried inside ``row``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "secrets")
    text = F.col("_text")
    start = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"), *([F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry_text else []))
    found = start.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", *(["row"] if carry_text else []),
        _spans(text, ASSIGN, 0, 2, 6).alias("assign"), _spans(text, ACCESS, 1).alias("access"), _spans(text, HEX, 2).alias("hex"),
        _spans(text, SECRET, 3).alias("secret"), _spans(text, ENDPOINT, 4).alias("endpoint"),
    )
    # The row number is written with the row, so both sides of the join below see the same one.
    found = scratch.keep(found.select("rid", "doc_id", *(["row"] if carry_text else []), F.sort_array(F.concat("assign", "access", "hex")).alias("base"), F.concat("secret", "endpoint").alias("weak")), "found")

    def cells(df: DataFrame, spread: int) -> DataFrame:
        at = F.floor(F.col("x.s") / scope).cast("int")
        to = F.floor((F.col("x.e") - 1) / scope).cast("int")
        return df.select("rid", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.k").alias("k"), F.explode(F.sequence(at - spread, to + spread)).alias("cell"))

    may_link = (F.size("weak") > 0) & F.exists("base", lambda x: x["k"] < 2)
    both = found.where(may_link)
    strong = both.select("rid", F.explode(F.filter("base", lambda x: x["k"] < 2)).alias("x"))
    weak = both.select("rid", F.explode("weak").alias("x"))

    def near(a: DataFrame, b: DataFrame) -> DataFrame:
        """Rows of ``a`` with a row of ``b`` within the scope: an equi-join on (row, cell), then the interval test."""
        a = cells(a, 0).alias("a")
        b = cells(b, 1).alias("b")
        on = (F.col("a.rid") == F.col("b.rid")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.s") - F.col("b.e") <= scope) & (F.col("b.s") - F.col("a.e") <= scope)
        return a.join(b, on, "left_semi").select("rid", F.struct("s", "k", "e").alias("x")).distinct()

    secrets = near(weak.where("x.k = 3"), strong.where("x.k = 1"))
    endpoints = near(weak.where("x.k = 4"), strong.unionByName(secrets))
    linked = secrets.unionByName(endpoints).groupBy("rid").agg(F.sort_array(F.collect_list("x")).alias("linked"))
    # Only rows whose parts may link are shuffled; the others, with their texts, stay where they are.
    columns = ["doc_id", "base", F.coalesce("linked", F.array().cast(_SPAN)).alias("linked"), *(["row"] if carry_text else [])]
    return both.join(linked, "rid", "left").select(*columns).unionByName(found.where(~may_link).withColumn("linked", F.array().cast(_SPAN)).select(*columns))


def mask_secrets(docs: DataFrame, scope: int = 400, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every reported span, base or linked, replaced by ``MASK``; overlapping spans give one mask.

    Rows without spans, and null texts, come back unchanged; ``length_col`` is set to the new length in code points.
    Null ids, ties and repeated rows stay, each row on its own; an empty table gives an empty table; other columns come
    back as they are.  The cost is linear in the text and in the number of spans.
    """
    text = F.col(f"row.`{text_col}`")
    scanned = scan_secrets(docs, scope, id_col, text_col, carry_text=True).withColumn("_x", F.sort_array(F.concat("base", "linked")))
    # Positions are code points: at four bytes each, a piece is cut without counting from the start of the text.
    scanned = scanned.withColumn("_wide", F.when(F.size("_x") > 0, F.encode(text, "UTF-32")))
    scanned = scanned.withColumn("_to", F.when(F.size("_x") > 0, _running(F.transform("_x", lambda x: x["e"]), lambda a, e: F.greatest(a, e))))

    def cut(start: Column, n: Column) -> Column:
        return F.decode(F.substring(F.col("_wide"), start * 4 + 1, n * 4), "UTF-32")

    pieces = F.transform(F.arrays_zip(F.col("_x").alias("x"), F.col("_to").alias("to")), lambda z: F.when(z["x"]["s"] >= z["to"], F.concat(cut(z["to"], z["x"]["s"] - z["to"]), F.lit(MASK))).otherwise(""))
    last = F.array_max(F.transform("_x", lambda x: x["e"]))
    masked = F.concat(F.array_join(pieces, ""), cut(last, F.length(text) - last))
    scanned = scanned.withColumn("_new", F.when(F.size("_x") > 0, masked).otherwise(text))
    kinds = dict(docs.dtypes)
    return scanned.select(*(F.col("_new").alias(c) if c == text_col else F.when(F.col("_new").isNull(), F.col(f"row.`{c}`")).otherwise(F.length("_new")).cast(kinds[c]).alias(c) if c == length_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")

    found = scan_secrets(documents(spark, sf_dir))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.sort_array(F.concat("base", "linked"))).alias("spans"))
