"""Suffix dedup of long repeats by prefix-free parsing of the corpus.

The question is which suffixes of the corpus share their first ``LENGTH`` bytes with another suffix, so the
corpus order is needed to that depth only.  It is built in the manner of prefix-free parsing:

1. Triggers.  Of every window of ``LENGTH - GRAM + 1`` positions, the one whose ``GRAM``-byte rolling hash is least
   is a trigger.  Triggers depend on nothing but the bytes around them, so equal 200-byte strings have their
   trigger at the same place.  Consecutive suffixes that share a trigger form a phrase, which stands for the
   stretch of text that these suffixes cover to their depth.
2. Dictionary and parse.  Equal phrases have one entry; the parse is the list of entries of all documents, of which
   only the number of each is needed, as every ``LENGTH``-byte string lies inside one phrase.  A phrase whose trigger
   occurs once is unique; a phrase entry that the parse holds twice makes all its suffixes repeats.  Both follow from
   counts, and most of the corpus is settled here.
3. Suffix array of the dictionary.  Where one trigger has several entries, the suffixes inside these entries (each
   entry once, however often the parse has it) are sorted by their bytes, dealt to tasks by ranges of this order; equal
   neighbours are repeats, and the parse's counts are their multiplicities.  The array is sampled first: of each
   ``STEP`` suffixes, the bytes that all of them share are sorted.  A sample without an equal neighbour holds no
   repeat, one whose neighbours are equal in all their bytes is all repeats, and only the suffixes of the others, at
   the ends of matches, are sorted one by one.

A run of equal neighbours may be as long as a group of copies: it is spread over tasks like any other part of the order,
and a task settles the runs that begin and end in it.  Of the others (two a task, and runs of more than ``RUN`` rows) the
counts are combined by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm._common import Scratch, arrow_schema, documents, slices

LENGTH = 200
GRAM = 100
STEP = 8
RUN = 50_000
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    size, power = 1, base
    while size < n:
        m = min(size, n - size)
        out[size : size + m] = out[:m] * np.uint64(power)
        size, power = size + m, power * power % (1 << 64)
    return out


class Rolling:
    """Rolling hashes of all substrings of a byte string, from prefix sums modulo 2^64."""

    _up = _down = np.ones(1, dtype=np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Rolling._up) < n:
            size = max(n, CHUNK + 2 * LENGTH)
            Rolling._up, Rolling._down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(_BYTES[data] * Rolling._up[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * Rolling._down[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * Rolling._down[:n])


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def phrases(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first, number, trigger, entry): phrases of the documents that ``ends`` cuts ``data`` into.

    ``first`` is a phrase's first suffix in ``data`` and ``number`` its number of suffixes.
    """
    return _phrases(data, ends, length, gram)[:4]


def _phrases(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``phrases`` and, fifth, how far the trigger lies behind the first suffix's start."""
    gram = min(gram, (length + 1) // 2)
    if len(data) < length:
        return tuple(np.empty(0, dtype=d) for d in (np.int64, np.int64, np.uint64, np.uint64, np.int64))
    rolling = Rolling(data)
    grams = rolling.grams(gram)
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = _window_min(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)
    at = np.arange(len(least))
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    at = at[owner[at] == owner[at + length - 1]]
    if not len(at):
        return _phrases(data[:0], ends, length, gram)
    trigger = least[at].astype(np.int64)
    new = np.flatnonzero((np.diff(trigger, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1) | (np.diff(owner[at], prepend=-1) != 0))
    first, last = at[new], at[np.append(new[1:] - 1, len(at) - 1)]
    where = trigger[new]
    entry = rolling.of(first, last + length)
    # Where the phrase lies around its trigger is a part of the entry.
    entry = _mix(entry ^ ((where - first).astype(np.uint64) << np.uint64(32)) ^ (last - where + length).astype(np.uint64))
    return first, last - first + 1, grams[where], entry, where - first


def _pieces(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about a megabyte: batch, bytes, document ends."""
    for batch in slices(batches, text_at, CHUNK):
        texts = [t.encode() for t in batch.column(text_at).to_pylist()]
        yield batch, np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts])


def _chunks(data: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of at most ``CHUNK`` suffixes, each with the bytes that its last suffixes need: memory stays bounded for
    any text.  A phrase cut here is two entries; their suffixes are compared like all others."""
    for base in range(0, max(len(data), 1), CHUNK):
        part = data[base : base + CHUNK + length - 1]
        cut = np.clip(ends - base, 0, len(part))
        yield base, part, cut
        if base + len(part) >= len(data):
            break


def repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, spans (array of start, stop in bytes: maximal removed runs), kept (the rest, binary).

    A byte goes if some ``length``-byte string that covers it also starts anywhere else in the corpus, the same
    document and overlaps included; strings are judged on the input.  Null texts count as empty; texts under
    ``length`` bytes keep everything; null ids and repeated rows are rows of their own (and repeats of each other);
    an empty table gives an empty table; other columns are ignored.
    """
    joined = _spans(docs, length, id_col, text_col)
    schema, arrow = arrow_schema("doc_id long, n_bytes long, spans array<struct<start:int,stop:int>>, kept binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out = []
            for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in range(3))):
                data = text.encode()
                merged = merge_spans(spans, length)
                out.append((doc, len(data), [{"start": a, "stop": b} for a, b in merged], keep_rest(data, merged)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return joined.mapInArrow(cut, schema)


def merge_spans(runs: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs that the repeated strings starting at p .. p + n - 1 cover."""
    out: list[list[int]] = []
    for p, n in sorted((r["p"], r["n"]) for r in runs or ()):
        if out and p <= out[-1][1]:
            out[-1][1] = max(out[-1][1], p + n - 1 + length)
        else:
            out.append([p, p + n - 1 + length])
    return [(a, b) for a, b in out]


def keep_rest(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _spans(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, runs) per row; runs: (p, n), suffixes p .. p + n - 1 repeat."""
    scratch = Scratch(docs.sparkSession, "repeats")
    # The row number is written with the row: both joins below see the same one.
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    source = scratch.keep(source.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "source")

    schema, arrow = arrow_schema("rid long, p int, n int, o short, g long, r long")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, ends in _pieces(batches, 1):
            rids, starts = batch.column(0).to_numpy(), np.concatenate([[0], ends[:-1]])
            for base, part, cut in _chunks(data, ends, length):
                first, number, trigger, entry, behind = _phrases(part, cut, length, GRAM)
                first = first + base
                doc = np.searchsorted(ends, first, side="right")
                yield pa.RecordBatch.from_arrays([pa.array(rids[doc]), pa.array((first - starts[doc]).astype(np.int32)), pa.array(number.astype(np.int32)), pa.array(behind.astype(np.int16)), pa.array(trigger.view(np.int64)), pa.array(entry.view(np.int64))], schema=arrow)

    parsed = scratch.keep(source.select("rid", "text").where(F.octet_length("text") >= length).mapInArrow(parse, schema), "parse")
    # Triggers that occur twice at least, and whether they have more than one entry.
    triggers = scratch.keep(parsed.groupBy("g").agg(F.count("*").alias("c"), F.min("r").alias("r0"), F.max("r").alias("r1")).where("c > 1").select("g", (F.col("r0") != F.col("r1")).alias("mixed")), "triggers")
    repeated = scratch.keep(parsed.join(triggers, "g"), "repeated")
    scratch.drop("parse", "triggers")
    entries = scratch.keep(repeated.where("mixed").groupBy("g", "r").agg(F.count("*").alias("c"), F.min(F.struct("rid", "p", "n", "o")).alias("one")), "entries")
    twice = entries.where("c > 1").select("g", "r")
    settled = scratch.keep(repeated.where("not mixed").select("rid", "p", "n").unionByName(repeated.where("mixed").select("rid", "p", "n", "g", "r").join(twice, ["g", "r"]).select("rid", "p", "n")), "settled")
    scratch.drop("repeated")

    # Samples of the suffixes of mixed triggers' entries, each entry once, by distance to the trigger.
    wanted = entries.select("one.rid", F.struct(F.col("one.p").alias("p"), F.col("one.n").alias("n"), F.col("one.o").alias("o"), "g", F.least("c", F.lit(2)).alias("c")).alias("x")).groupBy("rid").agg(F.collect_list("x").alias("xs"))
    sample_schema, sample_arrow = arrow_schema("rid long, p int, n int, c int, off short, tail binary, body binary")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, CHUNK):
            for rid, text, xs in zip(*(batch.column(c).to_pylist() for c in range(3))):
                data = text.encode()
                p, n, o, g, c = (np.array([x[k] for x in xs], dtype=np.int64) for k in ("p", "n", "o", "g", "c"))
                part = np.cumsum(n) // CHUNK
                for k in np.unique(part):
                    yield from _samples(data, rid, *(x[part == k] for x in (p, n, o, g, c)), length, sample_arrow)

    samples = scratch.keep(source.select("rid", "text").join(wanted, "rid").select("rid", "text", "xs").mapInArrow(expand, sample_schema), "samples")
    scratch.drop("entries")
    shared = F.concat(F.substring(F.col("body"), F.col("off") + 1, F.lit(length - STEP + 1)), F.col("tail"))
    ranked = _in_order(samples, shared, scratch, "ranked")
    scratch.drop("samples")

    suffix_schema, suffix_arrow = arrow_schema("rid long, p int, n int, c int, off short, body binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4, CHUNK >> 2):
            rid, p, n, c = (batch.column(k).to_numpy() for k in range(4))
            bodies = [b[i : i + length] for b, size in zip(batch.column(4).to_pylist(), n.tolist()) for i in range(size)]
            number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            columns = np.repeat(rid, n), np.repeat(p, n) + number, np.ones(len(number)), np.repeat(c, n), np.zeros(len(number)), bodies
            yield pa.RecordBatch.from_arrays([pa.array(x if isinstance(x, list) else x.astype(f.type.to_pandas_dtype()), type=f.type) for x, f in zip(columns, suffix_arrow)], schema=suffix_arrow)

    suffixes = scratch.keep(ranked.where(f"kind = {OPEN}").select("rid", "p", "n", "c", "body").mapInArrow(cut, suffix_schema), "suffixes")
    equal = _in_order(suffixes, F.col("body"), scratch, "equal")
    repeated = [x.where(f"kind = {ALIKE} and c = 1").select("rid", "p", "n") for x in (ranked, equal)]
    runs = scratch.keep(settled.unionByName(repeated[0]).unionByName(repeated[1]).groupBy("rid").agg(F.collect_list(F.struct("p", "n")).alias("runs")), "runs")
    scratch.drop("settled", "ranked", "suffixes", "equal")
    return source.join(runs, "rid", "left").select("doc_id", "text", "runs")


def _samples(data: bytes, rid: int, p: np.ndarray, n: np.ndarray, o: np.ndarray, g: np.ndarray, c: np.ndarray, length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Samples of the suffixes of the entries at ``p``: those whose distance to the trigger is STEP * s .. STEP * s + STEP - 1.

    ``body`` is all bytes of the sample's suffixes, the first of which starts at ``p``; at ``off`` lie the bytes that
    all of them share, wherever the entry ends.  ``tail`` is the trigger and s: only suffixes that stand alike to one
    trigger can be equal.
    """
    entry = np.repeat(np.arange(len(p)), n)
    at = p[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
    step = ((p + o)[entry] - at) // STEP
    first = np.flatnonzero((np.diff(entry, prepend=-1) != 0) | (np.diff(step, prepend=-1) != 0))
    size = np.diff(np.append(first, len(entry)))
    lead, e, s = at[first], entry[first], step[first]
    off = (p + o)[e] - STEP * s - lead
    tails = np.zeros(len(e), dtype=[("g", ">i8"), ("s", ">i2")])
    tails["g"], tails["s"] = g[e], s
    tail = pa.FixedSizeBinaryArray.from_buffers(pa.binary(10), len(e), [None, pa.py_buffer(tails.tobytes())]).cast(pa.binary())
    for k in range(0, len(e), 20_000):
        here = slice(k, k + 20_000)
        bodies = [data[a:z] for a, z in zip(lead[here].tolist(), (lead + size - 1 + length)[here].tolist())]
        columns = np.full(len(bodies), rid), lead[here], size[here], c[e][here], off[here]
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(f.type.to_pandas_dtype())) for x, f in zip(columns, schema)), tail[here], pa.array(bodies, pa.binary())], schema=schema)


#: What a row's run of equal neighbours says: all its members are alike and stand twice at least; they are equal in the
#: key only; it reaches over the end of its task.
ALIKE, OPEN, EDGE = 1, 2, 3
_ORDERED = "kind int, rid long, p int, n int, c int, off short, key binary, body binary"


def _in_order(rows: DataFrame, key: Column, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` (rid, p, n, c, off, body) in runs of equal ``key``, from one sort of all rows by key: (kind, rid, p, n,
    c, body) of the rows whose runs stand for two occurrences at least.

    Ranges are of (key, rid), so a long run fills several tasks.
    """
    schema, arrow = arrow_schema(_ORDERED)
    ordered = rows.repartitionByRange(key, "rid").withColumn("key", key).sortWithinPartitions("key", "rid", "p")
    names = ["rid", "p", "n", "c", "off", "key", "body"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, edge, begun = None, None, False

        def out(some: pa.RecordBatch, kind: np.ndarray) -> pa.RecordBatch:
            keep = kind > 0
            some, kind = some.filter(pa.array(keep)), kind[keep]
            key = pc.if_else(pa.array(kind == EDGE), some.column("key"), pa.scalar(None, pa.binary()))
            body = pc.if_else(pa.array(kind != ALIKE), some.column("body"), pa.scalar(None, pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), *(some.column(c) for c in names[:5]), key, body], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            n = batch.num_rows
            as_before = {c: np.append(False, pc.equal(batch.column(c).slice(1), batch.column(c).slice(0, n - 1)).to_numpy(zero_copy_only=False)) for c in ("key", "off", "n", "body")}
            start = np.flatnonzero(~as_before["key"])
            end = np.append(start[1:], n)
            total = np.add.reduceat(batch.column("c").to_numpy().astype(np.int64), start)
            same = as_before["off"] & as_before["n"] & as_before["body"]
            same[start] = True
            alike = np.logical_and.reduceat(same, start)
            verdict = np.where(total < 2, 0, np.where(alike, ALIKE, OPEN))
            if not begun or batch.column("key")[0].as_py() == edge:
                verdict[0], edge, begun = EDGE, batch.column("key")[0].as_py(), True
            last = len(start) - 1
            if verdict[last] != EDGE and end[last] - start[last] > RUN:
                verdict[last], edge = EDGE, batch.column("key")[int(start[last])].as_py()
            # The last run may go on in the next batch; one that is an edge anyway need not be held.
            stop = n if verdict[last] == EDGE else int(start[last])
            held = batch.slice(stop) if stop < n else None
            yield out(batch.slice(0, stop), np.repeat(verdict, end - start)[:stop])
        if held is not None:
            yield out(held, np.full(held.num_rows, EDGE))

    found = scratch.keep(ordered.select(*names).mapInArrow(scan, schema), name)
    edges = found.where(f"kind = {EDGE}")
    member = F.struct("off", "n", "body")
    # Two runs a task at most, and those of more than RUN rows.  Their number grows with that of the tasks, so no broadcast
    # is asked for: the adaptive plan sends them if they turn out small, and else splits the long runs' side of the join.
    sums = edges.groupBy("key").agg(F.sum("c").alias("t"), F.min(member).alias("a"), F.max(member).alias("z")).where("t > 1").select("key", F.when(F.col("a") == F.col("z"), ALIKE).otherwise(OPEN).alias("_kind"))
    decided = edges.join(sums, "key").select(F.col("_kind").alias("kind"), "rid", "p", "n", "c", "body")
    return found.where(f"kind < {EDGE}").select(decided.columns).unionByName(decided)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _spans(documents(spark, sf_dir), LENGTH, "doc_id", "text")
    schema, arrow = arrow_schema("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out = []
            for doc, text, runs in zip(*(batch.column(c).to_pylist() for c in range(3))):
                data = text.encode()
                spans = merge_spans(runs, LENGTH)
                rest = keep_rest(data, spans)
                out.append((doc, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return joined.mapInArrow(digest, schema)
