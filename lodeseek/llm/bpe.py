"""BPE encoding and decoding over a contiguous rank array.

A short word is a list of parts and, beside it, a contiguous list of the merge ranks of neighbouring
parts.  Each step scans that list for its minimum, deletes the boundary there and refreshes the two
neighbouring ranks.  For words of a few dozen symbols this beats any heap; longer words (no space
for hundreds of characters) take a heap with the same order of merges, so the cost stays n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array

from pyspark.sql import DataFrame, SparkSession

from lodeseek.llm._common import BoundedCache, doc_texts, documents, map_batches, per_process

#: White space of the tokenizer's patterns (Unicode White_Space); str.split() also splits at U+001C-U+001F.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ONLY_PYTHON_SPLITS = re.compile("[\x1c-\x1f]")
NONE = 1 << 60
SHORT = 256


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it prints, else the next free code point from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in prints}
    free = 256
    for b in range(256):
        if b not in names:
            names[b] = chr(free)
            free += 1
    return names


class WordBpe:
    """A byte-level BPE vocabulary with an end-of-word mark, lower case and white space dropped."""

    def __init__(self, tokenizer_file: str):
        import regex
        from tokenizers import Tokenizer

        self.front = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: s for s, i in (self.vocab | self.special).items()}
        self.suffix = model["end_of_word_suffix"] or ""
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[self.vocab[a], self.vocab[b]] = (k, self.vocab[a + b])
        names = byte_symbols()
        self.bytes = {s: b for b, s in names.items()}
        self.plain = [self.vocab[names[b]] for b in range(256)]
        self.final = [self.vocab[names[b] + self.suffix] for b in range(256)]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split.replace("\\s", WHITE))
        self.blank = regex.compile(f"[{WHITE}]+")
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.word_ids = BoundedCache(self._word, 300_000)
        self.chunk_ids = BoundedCache(self._chunk, 250_000)
        self.chunk_text = BoundedCache(lambda c: " ".join(map(self.text.__getitem__, self._ids_of(self.chunk_ids[c]))), 250_000)

    @staticmethod
    def _ids_of(packed: bytes) -> list[int]:
        return memoryview(packed).cast("I").tolist()

    def merge(self, ids: list[int]) -> list[int]:
        if len(ids) > SHORT:
            return self._merge_long(ids)
        rank, none = self.rank, (NONE, -1)
        pairs = [rank.get(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            low = min(pairs)
            if low is none or low[0] == NONE:
                break
            i = pairs.index(low)
            ids[i : i + 2] = [low[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank.get((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = rank.get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        ids, after, before = [*ids], [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(*r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heap = [(k, i, new, a, b) for k, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := rank.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (r[0], left, r[1], ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        data = word.encode()
        ids = self.merge([*map(self.plain.__getitem__, data[:-1]), self.final[data[-1]]])
        return array("I", ids).tobytes()

    def normalize(self, text: str) -> str:
        """NFC, runs of white space as one space, and each character's own lower case (no final-sigma rule)."""
        text = self.blank.sub(" ", unicodedata.normalize("NFC", text))
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a stretch without white space; neither normalization nor words reach across white space.

        Beyond the Latin blocks, the file's own normalizer and splitter find the words: Unicode versions differ there.
        """
        if max(chunk) > "\u024f":
            parts = self.front.pre_tokenizer.pre_tokenize_str(self.front.normalizer.normalize_str(chunk))
            return b"".join(self.word_ids[bytes(map(self.bytes.__getitem__, p)).decode()] for p, _ in parts)
        return b"".join(map(self.word_ids.__getitem__, self.words.findall(self.normalize(chunk))))

    def _chunks(self, text: str) -> list[str]:
        return [c for c in self.blank.split(text) if c] if _ONLY_PYTHON_SPLITS.search(text) else text.split()

    def encode_with_text(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and their decoding."""
        if "<|" in text and self.specials.search(text):
            ids, words, at = [], [], 0
            for m in [*self.specials.finditer(text), None]:
                chunks = self._chunks(text[at : m.start() if m else None])
                ids += map(self.chunk_ids.__getitem__, chunks)
                words += map(self.chunk_text.__getitem__, chunks)
                if m:
                    ids.append(self.special[m[0]].to_bytes(4, "little"))
                    words.append(m[0])
                    at = m.end()
            return b"".join(ids), " ".join(filter(None, words))
        chunks = self._chunks(text)
        return b"".join(map(self.chunk_ids.__getitem__, chunks)), " ".join(map(self.chunk_text.__getitem__, chunks))

    def encode(self, text: str) -> list[int]:
        return self._ids_of(self.encode_with_text(text)[0])

    def decode(self, ids: list[int], to_text: bool = False) -> str:
        """The tokens joined by spaces, as the file (it names no decoder) has it; ``to_text`` gives words instead."""
        tokens = [self.text[i] for i in ids if i in self.text]
        if not to_text:
            return " ".join(tokens)
        back, data = self.bytes, bytearray()
        for t in tokens:
            if t in self.special:
                data += t.encode() + b" "
                continue
            ends = bool(self.suffix) and t.endswith(self.suffix)
            data += bytes(back[c] for c in (t[: -len(self.suffix)] if ends else t)) + b" " * ends
        return data.decode(errors="replace").rstrip(" ")


def word_bpe(tokenizer_file: str) -> WordBpe:
    return per_process(("word_bpe", tokenizer_file), lambda: WordBpe(tokenizer_file))


def bpe_encode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (array of int) and decoded text.

    Null texts count as empty and give no ids; null ids and repeated rows stay, one output row per input row;
    an empty table gives an empty table; other columns are ignored.  A scan and one map, no shuffle.
    """

    def make():
        bpe = word_bpe(tokenizer_file)

        def work(batch):
            both = [bpe.encode_with_text(t) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "ids": [bpe._ids_of(i) for i, _ in both], "decoded": [d for _, d in both]}

        return work

    return map_batches(doc_texts(docs, id_col, text_col), make, "doc_id long, ids array<int>, decoded string")


def bpe_decode(encoded: DataFrame, tokenizer_file: str, to_text: bool = False) -> DataFrame:
    """From (doc_id, ids) to (doc_id, text), one output row per input row.

    Null and empty ``ids`` give an empty text, ids that the file does not know are left out; null doc_ids and repeated
    rows stay; an empty table gives an empty table; other columns are ignored.
    """
    from pyspark.sql import functions as F

    def make():
        bpe = word_bpe(tokenizer_file)
        return lambda batch: {"doc_id": batch.column(0), "text": [bpe.decode(ids, to_text) for ids in batch.column(1).to_pylist()]}

    ids = F.coalesce(encoded["ids"], F.array().cast("array<int>"))

    return map_batches(encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), ids.alias("ids")), make, "doc_id long, text string")


def bpe_pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like ``bpe_encode``, nulls, repeats and empty tables included, but doc_id, n_tokens and the ids packed as
    little-endian unsigned 32-bit integers."""

    def make():
        bpe = word_bpe(tokenizer_file)

        def work(batch):
            ids = [bpe.encode_with_text(t)[0] for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "n_tokens": [len(i) // 4 for i in ids], "ids": ids}

        return work

    return map_batches(doc_texts(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids binary")


def bpe_digests(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like ``bpe_encode``, nulls, repeats and empty tables included, but with digests in place of ids and decoded
    text, so that nothing large leaves Python."""

    def make():
        bpe = word_bpe(tokenizer_file)

        def work(batch):
            both = [bpe.encode_with_text(t) for t in batch.column(1).to_pylist()]
            return {
                "doc_id": batch.column(0),
                "n_tokens": [len(i) // 4 for i, _ in both],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i, _ in both],
                "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for _, d in both],
            }

        return work

    return map_batches(doc_texts(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
