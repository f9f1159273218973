"""SimHash near-dedup by content: documents whose sets of word 5-shingles have a Jaccard similarity of at least 0.8.

Fingerprints are SimHashes of the shingle set, ``WORDS`` of 64 bits, each under a hash of its own.  One such word
differs in about 10 bits at a similarity of 0.8, a radius at which the anchors of one covering code are near
everything; so each half of a word has a code of its own, and a text goes only to its home in each: the nearest anchor
of the binary Golay code to 23 bits, told apart by ``SPARE`` bits more.  Texts of similarity 0.8 share one of the
2 x ``WORDS`` homes with a probability of 0.99999 (0.998 for sets of 4 and 5 shingles, the least that are not equal).
Two texts that share a home are candidates if the sizes of their sets allow the similarity and their first words
differ in at most as many bits as ``RADIUS`` says, some four deviations above the mean at 0.8.  Every candidate pair is verified by the exact similarity of its
shingle sets before it links anything, and components come from verified links only.

Rows with equal shingle sets count as one node, so large groups of exact copies make no pairs.  A node with more than
``FEW`` candidates at a home is open: it gives two of them at first, at the homes of the first ``FIRST`` codes; the
other codes leave out pairs of nodes that these have found open, as later rounds take them up in all codes.  Once
these have made components, open nodes do the same with candidates of other components, and at last all candidates
between open nodes of different components are verified.  Candidates of open nodes are ruled out by rare shingles: one
that no other open node has, or whose mark the other lacks, is not common to the two, and what is left bounds their
similarity.  That bound is exact, so no link between components is lost and no bucket is cut.  For a group of texts
about one base the pairs verified grow with its size, not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm._common import Scratch, arrow_schema, map_batches
from lodeseek.llm.components import connected_components
from lodeseek.llm.simhash import SECTION, homes

SIMILARITY = 0.8
SHINGLE = 5
WORDS, SPARE = 64, 2
#: Bits by number of words compared: ``CHECKED`` of all texts, ``CLOSER`` of those with many candidates.
RADIUS = {4: 70, 16: 240}
CHECKED, CLOSER = RADIUS
FEW, FIRST = 2, 16
#: A shingle of at most ``RARE`` open nodes sets one of ``MARKS`` bits in each.
RARE, MARKS = 64, 512
SEED = 42
#: Smaller sets are similar to equal ones only.
LEAST = 4
PART = 4096
#: Pairs compared at once.
PAIRS = 1 << 19
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, size=(2, WORDS), dtype=np.uint64)
_PLUS, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, in A-Z lower case; of fewer words, the whole
    sequence; of none, nothing."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    found = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    return np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in found), dtype=np.uint64, count=len(found)))


def _planes(words: np.ndarray) -> list[np.ndarray]:
    """How many rows of ``words`` have each bit set, in binary: one row of bits for each binary digit, lowest first.

    Three rows of one weight make one of that weight and one of twice the weight, as in an adder."""
    planes = []
    while len(words):
        carries = []
        while len(words) > 2:
            m = len(words) // 3
            a, b, c = words[:m], words[m : 2 * m], words[2 * m : 3 * m]
            odd = a ^ b
            carries.append(a & b | odd & c)
            words = np.concatenate([odd ^ c, words[3 * m :]])
        if len(words) == 2:
            carries.append(words[:1] & words[1:])
            words = words[:1] ^ words[1:]
        planes.append(words[0])
        words = np.concatenate(carries) if carries else words[:0]
    return planes


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` SimHashes (uint64) of a shingle set: a bit is 1 if it is set in over half the hashes of that word."""
    counts = np.zeros(64 * WORDS, dtype=np.int64)
    for k in range(0, len(hashes), PART):
        mixed = (hashes[k : k + PART, None] ^ _PLUS) * _TIMES
        mixed ^= mixed >> np.uint64(32)
        mixed *= _TIMES
        mixed ^= mixed >> np.uint64(29)
        for weight, plane in enumerate(_planes(mixed)):
            counts += np.unpackbits(plane.astype("<u8").view(np.uint8), bitorder="little").astype(np.int64) << weight
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8").astype(np.uint64)


def keys(fingerprints: np.ndarray) -> np.ndarray:
    """The 2 x ``WORDS`` homes (int64) of fingerprints (rows of ``WORDS``); each code has numbers of its own."""
    halves = fingerprints.astype("<u8").view("<u4").astype(np.int64).reshape(len(fingerprints), 2 * WORDS)
    at = homes(halves & ((1 << SECTION) - 1)) << SPARE | halves >> SECTION & ((1 << SPARE) - 1)
    return np.arange(2 * WORDS) << (12 + SPARE) | at


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two shingle sets have at least this Jaccard similarity; two empty sets are equal."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def _sketches(texts: DataFrame) -> DataFrame:
    """Of (row, text, doc_id): row, doc_id, key (128 bits of the shingle set), its size and the packed fingerprint,
    which is empty where only equal sets are similar."""

    def make():
        from xxhash import xxh3_128_digest

        def work(batch):
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            packed = [fingerprint(s).tobytes() if len(s) >= LEAST else b"" for s in sets]
            return {"row": batch.column(0), "doc_id": batch.column(2), "key": [xxh3_128_digest(s.tobytes()) for s in sets], "size": [len(s) for s in sets], "fp": packed}

        return work

    return map_batches(texts, make, "row long, doc_id long, key binary, size long, fp binary")


def _masks(marks: pa.ListArray) -> np.ndarray:
    """Lists of bits (0 to ``MARKS`` - 1) as rows of uint64."""
    bits = np.zeros((len(marks), MARKS), dtype=np.uint8)
    bits[np.repeat(np.arange(len(marks)), marks.value_lengths().to_numpy()), marks.flatten().to_numpy()] = 1
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def _allowed(size: np.ndarray, sole: np.ndarray, masks: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Whether what two sets may have in common allows the similarity.

    Not common are the shingles that only one open set has (``sole``) and, for each mark that the other set lacks, one
    shingle at least."""
    common = [size[one] - sole[one] for one in (left, right)]
    for mask in masks:
        for k, (one, other) in enumerate(((left, right), (right, left))):
            common[k] -= np.bitwise_count(mask[one] & ~mask[other])
    most = np.minimum(*common)
    return most >= similarity * (size[left] + size[right] - most) - 1e-9


def _near(
    at: np.ndarray, row: np.ndarray, root: np.ndarray, checked: np.ndarray, similarity: float, few: int | None, sole: np.ndarray | None = None, masks: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of whole buckets, sorted by ``at`` (home and size of the set): candidates (a, b), and rows that have others too."""
    # In a bucket a set meets those after it that are not too large to be similar.
    most = np.floor((at & 0xFFFFFFFF) / similarity + 1e-6).astype(np.int64)
    each = np.searchsorted(at, at >> 32 << 32 | np.minimum(most, 0xFFFFFFFF), side="right") - np.arange(len(at)) - 1
    ends = np.cumsum(each)
    i = 0
    while i < len(at):
        to = max(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, side="right")), i + 1)
        n = each[i:to]
        left = np.repeat(np.arange(i, to), n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + left + 1
        i = to
        open_ = root[left] != root[right]
        left, right = left[open_], right[open_]
        bits = np.bitwise_count(checked[0][left] ^ checked[0][right]).astype(np.int64)
        for word in checked[1:]:
            bits += np.bitwise_count(word[left] ^ word[right])
        near = bits <= RADIUS[len(checked)]
        left, right, bits = left[near], right[near], bits[near]
        if sole is not None:
            fit = _allowed(at & 0xFFFFFFFF, sole, masks, left, right, similarity)
            left, right, bits = left[fit], right[fit], bits[fit]
        more = np.empty(0, dtype=np.int64)
        if few is not None and len(left):
            over = np.bincount(left)[left] > few
            more = np.unique(row[np.concatenate([left[over], right[over]])])
            take = ~over
            # Of many candidates, the least row and the one with the nearest fingerprint.
            early = at[left] >> 32 + 12 + SPARE < FIRST
            for rank in (row[right], bits):
                order = np.lexsort((row[right], rank, left))
                best = order[np.flatnonzero(np.diff(left[order], prepend=-1))]
                take[best] |= early[best]
            left, right = left[take], right[take]
        a, b = row[left], row[right]
        if len(a):
            # One task holds several codes' buckets, in which a pair may meet again.
            a, b = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
        yield a, b, more


def _candidates(nodes: DataFrame, similarity: float, words: int, few: int | None = None, codes: tuple[int, int] = (0, 2 * WORDS)) -> DataFrame:
    """(a, b): rows that share a home and may be similar, of different roots.  With ``few``, at most that many a row
    and home; rows where these are not all are a with a null b.  Nodes with sole and marks (see ``_rare``) are held to
    these too.  Homes are those of the codes from the one to before the other.  One shuffle, by home."""
    first, end = codes
    marked = "marks" in nodes.columns
    extra = ["sole", *(f"m{k}" for k in range(MARKS // 64))] if marked else []
    names = ["at", "row", "root", *(f"f{k}" for k in range(words)), *extra]
    schema, arrow = arrow_schema(", ".join(f"{name} long" for name in names))
    out_schema, out_arrow = arrow_schema("a long, b long")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                fps = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint64).reshape(-1, WORDS)
                size = np.minimum(batch.column(2).to_numpy(), 0xFFFFFFFF)
                at = (keys(fps)[:, first:end] << 32 | size[:, None]).ravel()
                columns = [batch.column(c).to_numpy() for c in range(2)] + [fps[:, c].view(np.int64) for c in range(words)]
                if marked:
                    columns += [batch.column(4).to_numpy(), *_masks(batch.column(5)).T.copy().view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.repeat(c, end - first)) for c in columns)], schema=arrow)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows, last = 0, None

        def run(parts):
            at, row, root, *rest = (np.concatenate(x) for x in zip(*parts))
            checked, rare = np.array(rest[:words]).view(np.uint64), rest[words:]
            for a, b, more in _near(at, row, root, checked, similarity, few, *([rare[0], np.array(rare[1:]).view(np.uint64)] if marked else [])):
                if len(a) or len(more):
                    ends = pa.concat_arrays([pa.array(b), pa.nulls(len(more), pa.int64())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, more])), ends], schema=out_arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = tuple(batch.column(k).to_numpy() for k in range(len(names)))
            homes_ = columns[0] >> 32
            if rows * len(names) > 1 << 21 and homes_[-1] != last:
                # Whole buckets go out; the batch's last bucket may go on in the next batch.
                cut = int(np.searchsorted(homes_, homes_[-1]))
                yield from run([*held, tuple(c[:cut] for c in columns)])
                columns = tuple(c[cut:] for c in columns)
                held, rows = [], 0
            held.append(columns)
            rows += len(columns[0])
            last = homes_[-1]
        if held:
            yield from run(held)

    spreaded = nodes.select("row", "root", "size", "fp", *(["sole", "marks"] if marked else [])).where(f"size >= {LEAST}").mapInArrow(spread, schema)
    return spreaded.repartition(F.shiftright("at", 32)).sortWithinPartitions("at").mapInArrow(compare, out_schema)


def _rare(rows: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, sole, marks) of the rows that have rare shingles: how many that none of the others has, and the marks of
    those that at most ``RARE`` have."""

    def make():
        def work(batch):
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            return {"row": np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets]), "hash": np.concatenate(sets).view(np.int64)}

        return work

    needed = texts.select("row", "text").join(rows.hint("merge"), "row", "left_semi")
    shingles = scratch.keep(map_batches(needed, make, "row long, hash long"), "shingles")
    held = shingles.groupBy("hash").agg(F.count("*").alias("n")).where(f"n <= {RARE}")
    mark = F.when(F.col("n") > 1, F.pmod(F.shiftright("hash", 20), F.lit(MARKS)).cast("int"))
    rare = shingles.join(held.hint("merge"), "hash").groupBy("row").agg(F.count_if(F.col("n") == 1).alias("sole"), F.collect_set(mark).alias("marks"))
    rare = scratch.keep(rare, "rare")
    scratch.drop("shingles")
    return rare


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of rows whose shingle sets are similar."""
    pairs = scratch.keep(pairs.distinct(), f"{name}_pairs")

    def make():
        return lambda batch: {"row": batch.column(0), "hashes": [shingle_set(t).tobytes() for t in batch.column(1).to_pylist()]}

    # Only texts that stand in a pair become sets, each once.  Rows that pair grow with the corpus: never broadcast.
    rows = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    needed = texts.select("row", "text").join(rows.hint("merge"), "row", "left_semi")
    sets = scratch.keep(map_batches(needed, make, "row long, hashes binary"), f"{name}_sets")
    schema, arrow = arrow_schema("a long, b long")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column(2), batch.column(3))
            good = pa.array([similar(*(np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in pair), similarity) for pair in sides], type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(good) for k in range(2)], schema=arrow)

    one, two = sets.toDF("a", "hashes_a"), sets.toDF("b", "hashes_b")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "hashes_a", "hashes_b")
    links = scratch.keep(both.mapInArrow(verify, schema), f"{name}_links")
    scratch.drop(f"{name}_pairs", f"{name}_sets")
    return links


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (all columns) with one row of each component of near copies.

    The row that stays has the least id of its component, null ids last, and of equal ids the first row.  Each row
    is judged by its own text, whatever rows share its id.  Null and empty texts are copies of each other.  An empty
    table gives an empty table.  The fingerprints are laid out for a ``similarity`` of 0.8 or more.
    """
    scratch = Scratch(docs.sparkSession, "near_copies")
    number = "_row_" + scratch.root[-12:]
    numbered = scratch.keep(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(number).alias("row"), F.coalesce(numbered[text_col].cast("string"), F.lit("")).alias("text"), numbered[id_col].cast("long").alias("doc_id"))
    order = [F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("row")]
    first = _sketches(texts).groupBy("key").agg(F.min(F.struct(*order, "size", "fp")).alias("x"))
    nodes = scratch.keep(first.select("x.row", "x.doc_id", "x.size", "x.fp"), "nodes")

    # Two nodes that the first codes find open need not be told again by the others.
    found = scratch.keep(_candidates(nodes.withColumn("root", F.col("row")), similarity, CHECKED, FEW, (0, FIRST)).distinct(), "found")
    known = found.where("b is null").select(F.col("a").alias("row"), F.lit(-1).cast("long").alias("root"))
    others = nodes.join(known.hint("merge"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    found = found.unionByName(scratch.keep(_candidates(others, similarity, CHECKED, FEW, (FIRST, 2 * WORDS)).distinct(), "found_others"))
    links = _verified(found.where("b is not null"), texts, similarity, scratch, "first")
    open_ = scratch.keep(found.where("b is null").select(F.col("a").alias("row")).distinct(), "open")
    # What the few have not connected: the nearest of it, then all of it.
    rare, steps = None, []
    for few in (FEW, None):
        if open_.isEmpty():
            break
        rare = rare or _rare(open_, texts, scratch)
        step = Scratch(docs.sparkSession, "near_copies")
        steps.append(step)
        roots = step.keep(connected_components(links, step), "roots").withColumnRenamed("node", "row")
        left = nodes.join(open_.hint("merge"), "row", "left_semi").join(roots.hint("merge"), "row", "left").join(rare.hint("merge"), "row", "left")
        left = left.withColumn("root", F.coalesce("root", "row")).withColumn("sole", F.coalesce("sole", F.lit(0))).withColumn("marks", F.coalesce("marks", F.array().cast("array<int>")))
        found = step.keep(_candidates(left, similarity, CLOSER, few).distinct(), "found")
        links = links.unionByName(_verified(found.where("b is not null"), texts, similarity, step, "more"))
        open_ = step.keep(found.where("b is null").select(F.col("a").alias("row")), "open")
        step.drop("roots", "found")

    again = Scratch(docs.sparkSession, "near_copies")
    roots = again.keep(connected_components(links, again), "roots")
    linked = nodes.select("row", "doc_id").join(roots.hint("merge"), nodes["row"] == roots["node"])
    best = linked.groupBy("root").agg(F.min(F.struct(*order)).alias("x")).select("x.row")
    alone = nodes.select("row").join(roots.hint("merge"), nodes["row"] == roots["node"], "left_anti")
    kept = again.keep(alone.unionByName(best), "kept")
    scratch.drop("nodes", "found", "found_others", "open", "rare", "first_links")
    for step in steps:
        step.drop("open", "more_links")
    again.drop("roots")
    return numbered.join(kept.hint("merge"), numbered[number] == kept["row"], "left_semi").drop(number)
