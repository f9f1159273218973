"""Token ids as binary files: canonical length-limited Huffman codes from global counts.

Layout: one table of blocks, in ascending document order over parts (the write tasks, which hold
ascending ranges of ids) and blocks inside a part.  A block is independent: it has its documents' ids
and token counts, the packed bits of their tokens, and a checkpoint, the bit offset, every ``STRIDE``
tokens.  The code book (code lengths by token id; a canonical code needs no more) is written once beside
the blocks.  Decoding looks up ``limit`` bits at a time in one table; all checkpoints of a block are
decoded in step, so the loop runs ``STRIDE`` times a block however long it is.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm._common import BoundedCache, Scratch, arrow_schema, doc_texts, documents, map_batches, per_process
from lodeseek.llm.bpe import byte_symbols

STRIDE = 64
BLOCK_TOKENS = 1 << 18
END = 0


# ---------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code length of each id (0: unused), at most ``limit``; optimal for that limit (package-merge).

    A single used id gets one bit.  Raises ValueError if ``limit`` bits cannot tell the used ids apart.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("the length limit is too small for so many ids")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    # An ordinary Huffman tree first: if it keeps the limit, it is the answer.
    heap = [(w, i) for i, w in enumerate(weights.tolist())]
    heapq.heapify(heap)
    parent = [0] * (2 * len(used) - 1)
    for node in range(len(used), 2 * len(used) - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = node
        heapq.heappush(heap, (a[0] + b[0], node))
    depth = [0] * len(parent)
    for i in range(len(parent) - 2, -1, -1):
        depth[i] = depth[parent[i]] + 1
    if max(depth[: len(used)]) <= limit:
        lengths[used] = depth[: len(used)]
        return lengths
    # Package-merge: at each level, pair the list's neighbours and merge the pairs with the ids.
    levels, merged = [], weights
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weights))
        merged = both[order]
    take = 2 * len(used) - 2
    found = np.zeros(len(used), dtype=np.int64)
    for leaf in reversed(levels):
        n = int(leaf[:take].sum())
        found[:n] += 1
        take = 2 * (take - n)
    found[:take] += 1
    lengths[used] = found
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by id: shorter codes first, then smaller ids."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        n = lengths[order].astype(np.int64)
        top = int(n.max())
        # Left-aligned codes are running sums of the widths that the codes before take up.
        codes[order] = (np.concatenate([[0], np.cumsum(1 << (top - n))[:-1]]) >> (top - n)).astype(np.uint64)
    return codes


class Codec:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical(lengths)
        self.bits = max(int(lengths.max(initial=0)), 1)
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and code length for each value of the next ``bits`` bits."""
        if self._table is None:
            order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
            order = order[self.lengths[order] > 0]
            widths = 1 << (self.bits - self.lengths[order])
            ids = np.zeros(1 << self.bits, dtype=np.int64)
            size = np.ones(1 << self.bits, dtype=np.int64)
            ids[: widths.sum()] = np.repeat(order, widths)
            size[: widths.sum()] = np.repeat(self.lengths[order], widths)
            self._table = ids, size
        return self._table

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Packed bits (first bit highest) and the bit offsets of every ``STRIDE``-th id."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        starts = ends - n
        total = int(ends[-1]) if len(ends) else 0
        # Each code lies in one or two 32-bit words; codes do not overlap, so adding them up sets their bits.
        words = np.zeros(total // 32 + 3, dtype=np.uint64)
        word = starts >> 5
        placed = self.codes[ids] << (64 - (starts & 31) - n).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        if len(ids):
            words[word[first]] += np.add.reduceat(placed >> np.uint64(32), first)
            words[word[first] + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), first)
        return words.astype(">u4").tobytes()[: (total + 7) // 8], starts[::STRIDE]

    def unpack(self, data: bytes, offsets: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` ids of a block; every checkpoint is a stream of its own, and all advance together."""
        table, size = self.table()
        words = np.frombuffer(data + bytes(16 - len(data) % 4), dtype=">u4").astype(np.uint64)
        windows = (words[:-1] << np.uint64(32)) | words[1:]
        at = offsets.astype(np.int64).copy()
        out = np.zeros((len(at), STRIDE), dtype=np.uint32)
        shift, mask, most = 64 - self.bits, (1 << self.bits) - 1, len(windows) - 1
        for k in range(STRIDE):
            word = np.minimum(at >> 5, most)  # the last stream may run past its ids; what it reads there is cut off
            value = (windows[word] >> (shift - (at & 31)).astype(np.uint64)).astype(np.int64) & mask
            out[:, k] = table[value]
            at += size[value]
        return out.reshape(-1)[:count]


# ---------------------------------------------------------------- tokens


#: The splitter's pattern where white space stands alone.
_SINGLE = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


class LibraryEncoder:
    """Ids of the tokenizers library.

    Texts of the Latin blocks go to a second engine, which takes the same vocabulary and is several times faster: where
    a byte-level file numbers its tokens in the order of its merges, the pair with the smallest new id is the pair of
    the smallest merge.  Beyond the Latin blocks, where Unicode versions may split differently, only the stretches
    between single spaces that hold such characters go to the library; it keeps what it knows of them.  (A space
    between two words belongs to the word behind it.  Where a space stands beside other white space, which may be one
    token with it, a text is not cut.)  Texts with special strings, and files of another kind, go to the library whole.
    """

    def __init__(self, tokenizer_file: str, most: int = 200_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.plain = re.compile("[\t\n\r -~\xa0-\u024f]*").fullmatch
        self.run = re.compile(r" \s|\s ").search
        self.double, self.blank = re.compile(r"\s\s").search, re.compile(r"\s{4096}").search
        self.stretches = BoundedCache(self._stretch, most)
        self.engine, self.single = self._engine(tokenizer_file) or (None, None)
        self.code = "I" if self.wide else "H"

    def _engine(self, tokenizer_file: str):
        """The second engine, if the file is plain byte-level BPE whose ids follow its merges: for any text, and for
        texts without white space side by side, where a splitter that need not look ahead finds the same words."""
        import json

        import public_tokenizers
        import tiktoken

        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
        if model.get("type") != "BPE" or spec.get("normalizer") or any(model.get(k) for k in options):
            return None
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return None
        vocab, back = model["vocab"], {s: b for b, s in byte_symbols().items()}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        ranks = {bytes(map(back.__getitem__, s)): i for s, i in vocab.items() if s not in self.special}
        if made != sorted(made) or len(ranks) != len(made) + 256:
            return None
        return [tiktoken.Encoding("bytes", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (public_tokenizers.PATTERN, _SINGLE)]

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype).tobytes()

    def _plain(self, text: str) -> bytes:
        if not self.double(text):
            return array(self.code, self.single(text)).tobytes()
        if self.blank(text):  # a run of white space that may be too long for that engine's splitter
            return self._library(text)
        return array(self.code, self.engine(text)).tobytes()

    def _stretch(self, stretch: str) -> bytes:
        """Ids of a stretch that follows a space."""
        return self._library(" " + stretch)

    def _mixed(self, text: str) -> bytes:
        out, held, (first, *rest) = [], [], text.split(" ")
        if self.plain(first):
            held.append(first)
        else:
            out.append(self._library(first))
        for stretch in rest:
            if self.plain(stretch):
                held.append(stretch)
                continue
            if held:
                out.append(self._plain(" ".join(held if not out else ["", *held])))
                held = []
            out.append(self.stretches[stretch])
        if held:
            out.append(self._plain(" ".join(held if not out else ["", *held])))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids (``dtype``) of each text, without the end id."""
        out = []
        for text in texts:
            if self.engine is None or any(s in text for s in self.special):
                out.append(self._library(text))
            elif self.plain(text):
                out.append(self._plain(text))
            else:
                out.append(self._library(text) if self.run(text) else self._mixed(text))
        return out


def _encoder(tokenizer_file: str) -> LibraryEncoder:
    return per_process(("library", tokenizer_file), lambda: LibraryEncoder(tokenizer_file))


# ---------------------------------------------------------------- files


class TokenFiles:
    """What ``write_tokens`` has written: a folder with the tables ``blocks`` and ``codebook``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def codec(self) -> Codec:
        """The code book is one row: the code length of each id."""
        return Codec(np.frombuffer(self.spark.read.schema("lengths binary").parquet(f"{self.path}/codebook").collect()[0][0], dtype=np.uint8))

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCK_DDL).parquet(f"{self.path}/blocks")

    def ids_before(self) -> DataFrame:
        """Per part, the ids of all parts before it; one row per write task."""
        parts = self.blocks().groupBy("part").agg(F.sum("n_ids").alias("n"))
        rows, before = [], 0
        for part, n in sorted(parts.collect()):
            rows.append((part, before))
            before += n
        return self.spark.createDataFrame(rows, "part int, part_start long")


BLOCK_DDL = "part int, block int, before long, n_ids long, doc_ids array<long>, n_tokens array<int>, offsets binary, bits binary"


def write_tokens(docs: DataFrame, tokenizer_file: str, end_id: int = END, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 16) -> TokenFiles:
    """Encode every text, append ``end_id``, and write the ids in ascending doc_id order.

    Null texts count as empty (just the end id); null ids come first; rows with the same id stand side by
    side; an empty table gives no blocks; other columns are ignored.  Two passes: encode into a scratch
    table, then sort by ranges of doc_id and pack with the code of the global counts.  Only the counts by id, whose
    number the vocabulary bounds, come to the driver.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    path = path or scratch.path("files")

    def make():
        encoder = _encoder(tokenizer_file)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        return lambda batch: {"doc_id": batch.column(0), "ids": [ids + end for ids in encoder.encode(batch.column(1).to_pylist())]}

    encoder = LibraryEncoder(tokenizer_file)
    size, dtype = max(encoder.tokenizer.get_vocab_size(), end_id + 1), encoder.dtype
    encoded = scratch.keep(map_batches(doc_texts(docs, id_col, text_col), make, "doc_id long, ids binary"), "encoded")

    schema, arrow = arrow_schema("id int, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=dtype), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], schema=arrow)

    counts = np.zeros(size, dtype=np.int64)
    for row in encoded.select("ids").mapInArrow(count, schema).groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    lengths = code_lengths(counts, max(limit, int(np.count_nonzero(counts)).bit_length()))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")

    block_schema, block_arrow = arrow_schema(BLOCK_DDL)
    held = spark.sparkContext.broadcast(lengths)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec, part = Codec(held.value), TaskContext.get().partitionId()
        docs_in, packed, pending, block, before = [], [], 0, 0, 0

        def flush():
            nonlocal docs_in, packed, pending, block, before
            ids = np.frombuffer(b"".join(packed), dtype=dtype)
            sizes = [len(p) // dtype.itemsize for p in packed]
            bits, offsets = codec.pack(ids)
            row = [part, block, before, len(ids), docs_in, sizes, offsets.astype("<u8").tobytes(), bits]
            before, block = before + len(ids), block + 1
            docs_in, packed, pending = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, block_arrow)], schema=block_arrow)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs_in.append(doc)
                packed.append(ids)
                pending += len(ids) // dtype.itemsize
                if pending >= BLOCK_TOKENS:
                    yield flush()
        if docs_in:
            yield flush()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # The scratch table is dealt by ranges of doc_id; an id that many rows share is no more than its own rows.
    ordered = encoded.repartitionByRange(parts, "doc_id", F.crc32("ids")).sortWithinPartitions("doc_id", "ids")
    Scratch.keep(_At(scratch, path), ordered.mapInArrow(pack, block_schema), "blocks", "none")
    scratch.drop("encoded")
    return TokenFiles(spark, path)


class _At:
    """Writes below a given folder the way ``Scratch`` writes below its own."""

    def __init__(self, scratch: Scratch, path: str):
        self.spark, self.root = scratch.spark, path

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"


def read_tokens(files: TokenFiles) -> DataFrame:
    """Per document, in file order inside each block: doc_id, start (ids of all documents before it), ids.

    Rows written with a null doc_id come back with it; null and empty texts have the end id only; repeated rows stand
    side by side; files of an empty table give an empty table.
    """
    return _decoded(files, "doc_id long, start long, ids array<int>", lambda ids: {"ids": [x.astype(np.int32) for x in ids]})


def _decoded(files: TokenFiles, ddl: str, describe) -> DataFrame:
    held = files.spark.sparkContext.broadcast(files.codec().lengths)
    schema, arrow = arrow_schema(ddl)
    blocks = files.blocks().join(F.broadcast(files.ids_before()), "part").select("part_start", "before", "n_ids", "doc_ids", "n_tokens", "offsets", "bits")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value)
        for batch in batches:
            for k in range(batch.num_rows):
                first, before, n, docs, sizes, offsets, bits = (batch.column(c)[k].as_py() for c in range(7))
                ids = codec.unpack(bits, np.frombuffer(offsets, dtype="<u8"), n)
                ends = np.cumsum(sizes)
                each = np.split(ids, ends[:-1])
                out = {"doc_id": docs, "start": first + before + ends - np.asarray(sizes), "n_tokens": sizes, **describe(each)}
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return blocks.mapInArrow(unpack, schema)


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return _decoded(files, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: {"ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]})
