"""SimHash near-dedup by anchor-point covering.

Anchors are the codewords of a covering code: two sections of 23 bits, each with the binary Golay code
(perfect: every 23-bit word lies within its covering radius 3 of exactly one codeword).  A fingerprint's
home is its nearest anchor.  If two fingerprints differ in at most 2 bits, then the home of the one lies,
section by section, within radius 3 plus the bits in which the other differs there; so each fingerprint
is replicated to every anchor within radius plus threshold (about 61 anchors), and comparing homes with
replicas anchor by anchor finds every pair.  The number of replicas is fixed, and an anchor has the
2^46rd part of the space, so the work grows with the number of distinct fingerprints.

Only distinct fingerprints are compared, and each task reduces the links it finds to stars of its own
components before they leave it, so a large group of near copies gives a few links a member, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm._common import Scratch, arrow_schema, doc_texts, documents, map_batches
from lodeseek.llm.components import connected_components

SEED = 42
THRESHOLD = 2
SECTION = 23
RADIUS = 3
#: Fixed value: the generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
PAIRS = 1 << 21


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, in A-Z lower case; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip((ends - sizes)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


# ---------------------------------------------------------------- anchors


def _remainder(word: int) -> int:
    for k in range(SECTION - 1, 10, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - 11)
    return word


@cache
def _code(threshold: int) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Syndrome tables of the three bytes of a section, and by excess over the radius (0 .. threshold) the patterns
    that lead from a word to a codeword: first, number and flat patterns, by syndrome."""
    bits = np.array([_remainder(1 << k) for k in range(SECTION)], dtype=np.int64)
    bytes_ = [np.zeros(256, dtype=np.int64) for _ in range(3)]
    for b in range(3):
        for v in range(256):
            for k in range(8):
                if v >> k & 1 and 8 * b + k < SECTION:
                    bytes_[b][v] ^= bits[8 * b + k]
    by_excess = []
    for excess in range(threshold + 1):
        found: list[list[int]] = [[] for _ in range(1 << 11)]
        for weight in range(RADIUS + 1) if excess == 0 else [RADIUS + excess]:
            for at in combinations(range(SECTION), weight):
                syndrome = 0
                for k in at:
                    syndrome ^= int(bits[k])
                found[syndrome].append(sum(1 << k for k in at))
        number = np.array([len(f) for f in found], dtype=np.int64)
        by_excess.append((np.cumsum(number) - number, number, np.array([x for f in found for x in f], dtype=np.int64)))
    return bytes_, by_excess


def anchors(fingerprints: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, home) of every anchor that each fingerprint (uint64) is replicated to."""
    bytes_, by_excess = _code(threshold)
    sections = [(fingerprints >> np.uint64(SECTION * k)).astype(np.int64) & ((1 << SECTION) - 1) for k in range(2)]
    syndromes = [bytes_[0][s & 255] ^ bytes_[1][s >> 8 & 255] ^ bytes_[2][s >> 16] for s in sections]
    out = []
    for a in range(threshold + 1):
        for b in range(threshold + 1 - a):
            (first_a, number_a, flat_a), (first_b, number_b, flat_b) = by_excess[a], by_excess[b]
            each = number_a[syndromes[0]] * number_b[syndromes[1]]
            row = np.repeat(np.arange(len(fingerprints)), each)
            local = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            i, j = np.divmod(local, np.maximum(number_b[syndromes[1]], 1)[row])
            one = sections[0][row] ^ flat_a[first_a[syndromes[0]][row] + i]
            two = sections[1][row] ^ flat_b[first_b[syndromes[1]][row] + j]
            out.append((one | two << SECTION, row, np.full(len(row), a == b == 0)))
    return tuple(np.concatenate(x) for x in zip(*out))


def homes(words: np.ndarray) -> np.ndarray:
    """The number (12 bits) of the nearest anchor of one section, for 23-bit words (int64)."""
    bytes_, by_excess = _code(0)
    first, _, flat = by_excess[0]
    syndromes = bytes_[0][words & 255] ^ bytes_[1][words >> 8 & 255] ^ bytes_[2][words >> 16]
    return (words ^ flat[first[syndromes]]) >> 11


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as the links (a, b), one from each node to its component's least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def _compare(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each anchor (rows sorted by anchor), between homes and all rows, as stars."""
    first = np.flatnonzero(np.diff(anchor, prepend=anchor[0] - 1))
    size = np.diff(np.append(first, len(anchor)))
    group = np.repeat(np.arange(len(first)), size)
    homes = np.flatnonzero(home)
    homes = homes[size[group[homes]] > 1]
    found_a, found_b = np.empty(0, fp.dtype), np.empty(0, fp.dtype)
    each = size[group[homes]]
    ends = np.cumsum(each)
    at = 0
    while at < len(homes):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")), at + 1)
        n = each[at:to]
        left = np.repeat(homes[at:to], n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[group[homes[at:to]]], n)
        x, y = fp[left], fp[right]
        near = (x != y) & (np.bitwise_count(x ^ y) <= threshold)
        found_a, found_b = np.concatenate([found_a, x[near]]), np.concatenate([found_b, y[near]])
        if len(found_a) > PAIRS:
            found_a, found_b = stars(found_a, found_b)
        at = to
    return stars(found_a, found_b) if len(found_a) else (found_a, found_b)


def fingerprint_links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp, the bits as a signed long): links that connect what pairs
    within ``threshold`` bits connect.  One shuffle, by anchor; a task holds one anchor's rows (16 bytes each)."""
    schema, arrow = arrow_schema("anchor long, fp long, home boolean")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for k in range(0, len(values), 8192):
                part = values[k : k + 8192]
                anchor, row, home = anchors(part.view(np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row]), pa.array(home)], schema=arrow)

    link_schema, link_arrow = arrow_schema("a long, b long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows, last = 0, None

        def run(parts):
            anchor, fp, home = (np.concatenate(x) for x in zip(*parts))
            a, b = _compare(anchor, fp.view(np.uint64), home, threshold)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=link_arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if rows > 1 << 18 and columns[0][-1] != last:
                # Whole anchors go out; the batch's last anchor may go on in the next batch.
                cut = int(np.searchsorted(columns[0], columns[0][-1]))
                yield run([*held, tuple(c[:cut] for c in columns)])
                columns = tuple(c[cut:] for c in columns)
                held, rows = [], 0
            held.append(columns)
            rows += len(columns[0])
            last = columns[0][-1]
        if held:
            yield run(held)

    spread = distinct.select(distinct["fp"]).mapInArrow(replicate, schema)
    return spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, link_schema)


def _fingerprints(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    def make():
        def work(batch):
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            return {"doc_id": batch.column(0), "fp": found.view(np.int64)}

        return work

    return map_batches(doc_texts(docs, id_col, text_col), make, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 lowercase hex digits), component_id (least doc_id reachable by links).

    Null and empty texts have fingerprint zero and link like any other.  Rows with a null id take part; a component
    of such rows only has a null component_id.  Repeated rows stay.  An empty table gives an empty table; other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(_fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = scratch.keep(fingerprint_links(distinct, threshold), "links")
    roots = connected_components(links, scratch)
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    components = known.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = scratch.keep(known.select("fp", "root").join(components, "root").select("fp", "component_id"), "labelled")
    scratch.drop("links", "distinct")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(labelled, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (all columns) without the rows whose id is not the least of its component.

    Rows with a null id stay.  Where rows repeat an id, one row of each such id stays.
    """
    found = near_duplicates(docs, threshold, shingle, id_col, text_col).where("doc_id is not null")
    scratch = Scratch(docs.sparkSession, "keep")
    found = scratch.keep(found.select(F.col("doc_id").alias("_id"), "component_id"), "found")
    repeated = not found.groupBy("_id").count().where("count > 1").isEmpty()
    drop = found.where("_id != component_id").select("_id").distinct()
    # The ids that go grow with the corpus: they are never broadcast, so the plan is the same at every size.
    kept = docs.join(drop.hint("merge"), docs[id_col].cast("long") == F.col("_id"), "left_anti")
    if repeated:
        kept = kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.where(F.col(id_col).isNull()))
    return kept


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
