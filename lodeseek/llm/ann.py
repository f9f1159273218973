"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Every vector is indexed, in blocks of bounded size.  A block keeps, for each of ``PROJECTIONS`` directions (random
orthonormal bases), its vectors sorted by their projection.  For a query, a window centred on the query's own
projection is laid over each sorted array; a vector collides where the window holds it.  Vectors that collide in
``SHARE`` of the arrays are candidates.  Virtual rehashing: no buckets are fixed beforehand; all windows of a query
grow (or shrink) by ``STEP`` until the block has ``CANDIDATES`` of its vectors (and at least ``LEAST``) as candidates,
and not ``EXCESS`` times as many.  Candidates are verified on the original vectors.

Sorted arrays are held as nested bit sets: one for each of ``GRAINS`` ends, with the vectors before that end.  A window
is the exclusive or of two of them, and the collisions of a batch of queries are counted 64 vectors at a time by
carry-save adders, so that counting costs the same whatever the number of components and however wide the windows.

The order is by inner product.  Vectors of unequal length are made equally long by one more component before
they are projected, so that the largest inner product is the least distance.  Equal vectors are held once, with
their ids, so a large group of copies is one candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.llm._common import Scratch, arrow_schema

#: Rows of an index block and of a query block, at most; blocks of very long vectors hold fewer (``BLOCK_BYTES``).
BLOCK, QUERY_BLOCK = 8_192, 512
BLOCK_BYTES = 8 << 20
#: Index blocks and query blocks that meet in one task; the task returns the nearest of its blocks, merged.
INDEX_SIDE, QUERY_SIDE = 2, 4
PROJECTIONS = 128
SHARE = 0.7
CANDIDATES = 0.015
EXCESS = 2.5
LEAST = 200
GRAINS = 64
#: Half of the first window, in standard deviations of a projected unit of distance, and its growth.
FIRST, STEP, LEVELS = 0.1, 1.03, 260
GUESS = 85
BATCH = 64
_PACKED = "dim int, part int, ids binary, vectors binary"


def usable(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of components: rows and values of the vectors that take part (finite, not null, not zero)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
        if good.any():
            out[dim] = rows[good], values[good]
    return out


@lru_cache(8)
def directions(dim: int, seed: int = 7) -> np.ndarray:
    """``PROJECTIONS`` columns of random orthonormal bases."""
    rng = np.random.default_rng(seed)
    bases = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-PROJECTIONS // dim))]
    return np.concatenate(bases, axis=1)[:, :PROJECTIONS]


def collisions(windows: Iterator[np.ndarray]) -> list[np.ndarray]:
    """Bits of the number of windows that hold each vector, lowest bit first: carry-save adders over bit sets."""
    levels: list[list[np.ndarray]] = [[]]

    def add(x: np.ndarray, k: int) -> None:
        while True:
            if k == len(levels):
                levels.append([])
            levels[k].append(x)
            if len(levels[k]) < 3:
                return
            a, b, c = levels[k]
            either = a ^ b
            levels[k] = [either ^ c]
            x, k = (a & b) | (either & c), k + 1

    for window in windows:
        add(window, 0)
    k = 0
    while k < len(levels):
        if len(levels[k]) == 2:
            a, b = levels[k]
            levels[k] = [a ^ b]
            add(a & b, k + 1)
        k += 1
    empty = np.zeros_like(next(x[0] for x in levels if x))
    return [x[0] if x else empty for x in levels]


def at_least(bits: list[np.ndarray], need: int) -> np.ndarray:
    """Bit set of the vectors whose count is at least ``need``."""
    if need >= 1 << len(bits):
        return np.zeros_like(bits[0])
    above, equal = np.zeros_like(bits[0]), ~np.zeros_like(bits[0])
    for k in range(len(bits) - 1, -1, -1):
        if need >> k & 1:
            equal &= bits[k]
        else:
            above |= equal & bits[k]
            equal &= ~bits[k]
    return above | equal


class Block:
    """The index of one block: sorted projections of its distinct vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        _, first, group = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        # Of equal vectors, only the k + 1 smallest ids can be among a query's k nearest; rows that repeat both go.
        by_group = np.argsort(group, kind="stable")
        same = (np.diff(group[by_group], prepend=-1) == 0) & (np.diff(ids[by_group], prepend=0) == 0)
        by_group = by_group[~same]
        size = np.bincount(group[by_group], minlength=len(first))
        start = np.cumsum(size) - size
        kept = (np.arange(len(by_group)) - np.repeat(start, size)) <= k
        self.members = ids[by_group[kept]]
        size = np.minimum(size, k + 1)
        self.start, self.size, self.k = np.cumsum(size) - size, size, k
        self.vectors = vectors[first].astype(np.float64)
        n, dim = self.vectors.shape
        self.wanted = max(LEAST, int(CANDIDATES * n), 2 * k)
        self.guess = GUESS
        if self.wanted >= n:
            return
        norms = (self.vectors**2).sum(axis=1)
        self.length = float(np.sqrt(norms.max()))
        self.unit = self.length / np.sqrt(dim + 1)
        long = np.concatenate([self.vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], axis=1)
        projected = (long @ directions(dim + 1)).T
        perm = np.argsort(projected, axis=1)
        ends = np.arange(GRAINS + 1) * n // GRAINS
        grain = np.repeat(np.arange(1, GRAINS + 1), np.diff(ends))
        #: Least projection of each grain, and the bit sets of the vectors before each end.
        self.least = np.take_along_axis(projected, perm[:, ends[:-1]], axis=1)
        self.before = np.zeros((PROJECTIONS, GRAINS + 1, -(-n // 64)), dtype=np.uint64)
        for j in range(PROJECTIONS):
            held = np.zeros((GRAINS + 1, self.before.shape[2] * 64), dtype=bool)
            held[grain, perm[j]] = True
            np.bitwise_or.accumulate(np.packbits(held, axis=1, bitorder="little").view(np.uint64), axis=0, out=self.before[j])

    def _colliding(self, at: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Bit set, by query, of the vectors that collide often enough in windows of ``half`` to either side."""
        low, high = np.empty(at.shape, dtype=np.int64), np.empty(at.shape, dtype=np.int64)
        for j in range(PROJECTIONS):
            low[:, j] = self.least[j].searchsorted(at[:, j] - half, side="right") - 1
            high[:, j] = self.least[j].searchsorted(at[:, j] + half, side="right")
        np.maximum(low, 0, out=low)
        windows = (self.before[j].take(high[:, j], axis=0) ^ self.before[j].take(low[:, j], axis=0) for j in range(PROJECTIONS))
        return at_least(collisions(windows), int(np.ceil(SHARE * PROJECTIONS)))

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """One row of flags by query: the vectors to verify."""
        n = len(self.vectors)
        if self.wanted >= n:
            return np.ones((len(queries), n), dtype=bool)
        # A query's length does not change the order; at the longest vector's length, near and far are furthest apart.
        scaled = queries * (self.length / np.sqrt((queries * queries).sum(axis=1)))[:, None]
        at = np.concatenate([scaled, np.zeros((len(queries), 1))], axis=1) @ directions(queries.shape[1] + 1)
        out = np.zeros((len(queries), self.before.shape[2]), dtype=np.uint64)
        level = np.full(len(queries), self.guess)
        low, high = np.full(len(queries), -1), np.full(len(queries), LEVELS + 1)  # too few there; enough there
        todo = np.arange(len(queries))
        while len(todo):
            here = level[todo]
            half = np.where(here >= LEVELS, np.inf, self.unit * FIRST * STEP**here)
            found = self._colliding(at[todo], half)
            number = np.bitwise_count(found).sum(axis=1, dtype=np.int64)
            enough = number >= self.wanted
            out[todo[enough]] = found[enough]
            high[todo[enough]] = np.minimum(high[todo[enough]], here[enough])
            low[todo[~enough]] = np.maximum(low[todo[~enough]], here[~enough])
            # On: wider where there are too few, narrower where there are too many and narrower is not known to be too few.
            shrink = enough & (number > EXCESS * self.wanted)
            ratio = np.where(enough, number / (EXCESS * self.wanted), self.wanted / np.maximum(number, 1))
            move = np.clip(2 * np.log2(np.maximum(ratio, 1)).astype(np.int64), 1, 32)
            nxt = np.where(enough, np.maximum(here - move, low[todo] + 1), np.minimum(here + move, high[todo] - 1))
            nxt = np.minimum(nxt, LEVELS)
            go = np.where(enough, shrink & (high[todo] - low[todo] > 1), high[todo] - low[todo] > 1)
            level[todo] = nxt
            todo = todo[go]
        self.guess = int(np.median(high))
        return np.unpackbits(out.view(np.uint8), axis=1, bitorder="little", count=n).view(bool)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, inner product) of the candidates that reach their query's ``floor``, without its own id."""
        found = []
        for start in range(0, len(queries), BATCH):
            some = queries[start : start + BATCH]
            row, at = np.nonzero(self.candidates(some))
            scores = (self.vectors[at] * some[row]).sum(axis=1)
            good = scores >= floor[start + row]
            row, at, scores = row[good] + start, at[good], scores[good]
            size = self.size[at]
            member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[at], size)
            row, ids, scores = np.repeat(row, size), self.members[member], np.repeat(scores, size)
            other = ids != query_ids[row]
            found.append(best_of(row[other], ids[other], scores[other], self.k))
        return tuple(np.concatenate(x) for x in zip(*found))


def best_of(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest scores of each row, ties to smaller ids; an id that a row has twice counts by its best score."""
    order = np.lexsort((-scores, ids, row))
    row, ids, scores = row[order], ids[order], scores[order]
    once = (np.diff(row, prepend=-1) != 0) | (np.diff(ids, prepend=0) != 0)
    row, ids, scores = row[once], ids[once], scores[once]
    order = np.lexsort((ids, -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return row[place < k], ids[place < k], scores[place < k]


class Nearest:
    """The nearest found so far of some query blocks of one number of components."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries.astype(np.float64), k
        self.best = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        self.floor = np.full(len(ids), -np.inf)

    def add(self, block: Block) -> None:
        new = block.search(self.ids, self.queries, self.floor)
        self.best = best_of(*(np.concatenate(x) for x in zip(self.best, new)), self.k)
        row, _, scores = self.best
        full = np.bincount(row, minlength=len(self.ids)) == self.k
        last = np.cumsum(np.bincount(row, minlength=len(self.ids))) - 1
        self.floor[full] = scores[last[full]]


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Usable vectors of each partition, packed into blocks of at most ``rows``; ``part`` is the partition."""
    schema, arrow = arrow_schema(_PACKED)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        part = TaskContext.get().partitionId()

        def flush(dim, most):
            ids, values = (np.concatenate(x) for x in zip(*held.pop(dim)))
            for some in np.array_split(np.arange(len(ids)), -(-len(ids) // most)):
                row = [dim, part, ids[some].astype("<i8").tobytes(), values[some].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, arrow)], schema=arrow)

        def most(values):
            return max(1, min(rows, BLOCK_BYTES // values[:1].nbytes))

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for dim, (at, values) in usable(batch.column(1)).items():
                held.setdefault(dim, []).append((ids[at], values))
                if sum(len(i) for i, _ in held[dim]) >= 2 * most(values):
                    yield from flush(dim, most(values))
        for dim in list(held):
            yield from flush(dim, most(held[dim][0][1]))

    return vectors.mapInArrow(pack, schema)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank (from 1), vec_id, score (inner product of the original
    vectors in double precision), ties to the smaller vec_id.

    Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components, take no part;
    vectors are compared with those of as many components.  Rows that repeat an id count once, by their best score;
    rows with the query's id are no candidates.  Fewer candidates than ``k`` are all returned; empty tables give an
    empty table; other columns are ignored.  Queries meet all rows in tiles of ``QUERY_SIDE`` query blocks and
    ``INDEX_SIDE`` index blocks, one tile a task; a tile returns at most ``k`` rows a query.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    kind = vectors.schema[vector_col].dataType.elementType.typeName()
    kind = kind if kind in ("float", "double") else "double"

    def chosen(df):
        return df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast(f"array<{kind}>").alias("v")).where("id is not null and v is not null")

    def dealt(df: DataFrame, rows: int, side: int) -> tuple[DataFrame, int]:
        """Blocks, one partition of rows each (ids that many rows share are spread too), and the number of sides."""
        parts = max(1, -(-df.count() // rows))
        blocks = _blocks(df.repartition(parts), rows)
        return blocks.withColumn("side", F.floor(F.col("part") / side)), -(-parts // side)

    index, n_index = dealt(chosen(vectors), BLOCK, INDEX_SIDE)
    asked, n_asked = dealt(chosen(queries), QUERY_BLOCK, QUERY_SIDE)
    index, asked = scratch.keep(index, "index", "none"), scratch.keep(asked, "queries", "none")
    to_all = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    columns = ["tile", "kind", "dim", "ids", "vectors"]
    meet = asked.withColumn("other", to_all(n_index)).withColumn("tile", F.col("other") * n_asked + F.col("side")).withColumn("kind", F.lit(0)).select(columns)
    meet = meet.unionByName(index.withColumn("other", to_all(n_asked)).withColumn("tile", F.col("side") * n_asked + F.col("other")).withColumn("kind", F.lit(1)).select(columns))
    tasks = min(n_index * n_asked, 100_000)
    work = meet.repartitionById(tasks, F.pmod("tile", F.lit(tasks)).cast("int")).sortWithinPartitions("tile", "kind")
    schema, arrow = arrow_schema("query_id long, vec_id long, score double")
    dtype = np.dtype("<f4" if kind == "float" else "<f8")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, found = None, {}, {}

        def done() -> Iterator[pa.RecordBatch]:
            for one in found.values():
                row, ids, scores = one.best
                yield pa.RecordBatch.from_arrays([pa.array(one.ids[row]), pa.array(ids), pa.array(scores)], schema=arrow)

        for batch in batches:
            for r in range(batch.num_rows):
                tile, index_side, dim, ids, values = (batch.column(c)[r].as_py() for c in range(5))
                if tile != current:
                    yield from done()
                    current, waiting, found = tile, {}, {}
                ids, values = np.frombuffer(ids, "<i8"), np.frombuffer(values, dtype).reshape(-1, dim)
                if not index_side:
                    waiting.setdefault(dim, []).append((ids, values))
                    continue
                if dim in waiting:
                    found[dim] = Nearest(*(np.concatenate(x) for x in zip(*waiting.pop(dim))), k)
                if dim in found:
                    found[dim].add(Block(ids, values, k))
        yield from done()

    found = work.mapInArrow(search, schema).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
