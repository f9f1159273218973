"""Exact token counts at every prefix (prefix dynamic programming over a piece vocabulary).

For a byte-pair vocabulary the encoding of a prefix is fixed by its last token: token ``t`` ends the
encoding of ``s[:i]`` exactly if ``t`` and the token that ends ``s[:i - len(t)]`` stay apart when the
two are encoded together.  So one left-to-right pass stores, for every prefix, its last token and
its exact token count; truncation ("longest prefix within a budget") and budget questions read that
table and never encode again.

No piece crosses from another character into a space mark, so a text falls apart into segments (a
run of spaces and the word behind it), each with a table of its own that is kept per distinct
segment; the count at any prefix of a text is the sum over whole segments plus one table entry.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lodeseek.llm._common import BoundedCache, doc_texts, documents, map_batches, per_process

SPACE = "▁"
_ONE = (1,)
_SEGMENT = re.compile(r" +[^ ]*")


class PieceTable:
    """The pieces of a sentencepiece BPE model and the prefix tables they give."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        # Lengths of the pieces that end in two given characters, longest first, then 1.
        lengths: dict[str, set[int]] = {}
        for piece in self.score:
            if len(piece) > 1:
                lengths.setdefault(piece[-2:], {1}).add(len(piece))
        self.ends = {tail: tuple(sorted(found, reverse=True)) for tail, found in lengths.items()}
        crossing = [p for p in self.score if SPACE in p.lstrip(SPACE)]
        if crossing:
            raise ValueError("pieces that run from a word into the next space are not supported")
        # Merge order: characters are there from the start, then better scores first.
        order = sorted((p for p in self.score if len(p) > 1), key=lambda p: -self.score[p])
        self.rank = {c: -1 - k for k, c in enumerate({c for p in self.score for c in p})} | {p: k for k, p in enumerate(order)}
        self.halves = {p: self._merge(p, 2) for p in self.score}
        self.apart: dict[tuple[str, str], bool] = {}
        self.tables = BoundedCache(self._table, 400_000)
        self.totals = BoundedCache(lambda segment: self.tables[segment][0][-1], 1_000_000)

    def _merge(self, text: str, stop: int = 1) -> list[str]:
        """Plain BPE of a short string: best score first, leftmost on ties; ``stop=2``: up to the last merge."""
        parts, score = list(text), self.score
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether encoding ``left + right`` gives just these two tokens.

        Undo the merges of the two tokens, latest first; the pair fails if the parts that face each other at some
        moment could have merged before the later of the merges undone so far.
        """
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) > 400_000:
                self.apart.clear()
            known = self.apart[left, right] = self._faces_apart(left, right) if left else len(right) == 1 or self._merge(right) == [right]
        return known

    def _faces_apart(self, left: str, right: str) -> bool:
        rank, halves, limit = self.rank, self.halves, 1 << 60
        while True:
            joined = rank.get(left + right)
            if joined is not None and joined < limit:
                return False
            if rank[left] > rank[right]:
                if len(left) > 1:
                    limit, left = rank[left], halves[left][-1]
                    continue
            elif len(right) > 1:
                limit, right = rank[right] + 1, halves[right][0]
                continue
            if len(left) > 1:
                limit, left = rank[left], halves[left][-1]
            elif len(right) > 1:
                limit, right = rank[right] + 1, halves[right][0]
            else:
                return True

    def _table(self, segment: str) -> tuple[bytes | list[int], bytes]:
        """For the prefixes of a segment (behind its first space) of 1 to all characters: token counts, and the
        lengths of their last tokens (0: an unknown character, which never merges and counts its UTF-8 bytes)."""
        text = SPACE + segment.replace(" ", SPACE)
        score, ends, apart = self.score, self.ends, self.apart
        stem = self.tables.get(segment[:-1]) if segment else None  # a word and the same word with a comma share a table
        counts, last = [0, *(stem[0] if stem else ())], [0, *(stem[1] if stem else ())]
        for i in range(len(counts), len(text) + 1):
            for n in ends.get(text[max(i - 2, 0) : i], _ONE):
                if n > i:
                    continue
                token = text[i - n : i]
                if token in score:
                    j = i - n
                    pair = (text[j - last[j] : j], token)
                    ok = apart.get(pair)
                    if ok or (ok is None and self._stay_apart(*pair)):
                        last.append(n)
                        counts.append(counts[j] + 1)
                        break
            else:
                last.append(0)
                counts.append(counts[i - 1] + len(text[i - 1].encode()))
        counts, last = counts[1:], bytes(last[1:])
        return (bytes(counts) if max(counts) < 256 else counts), last

    @staticmethod
    def segments(text: str) -> list[str]:
        """Segments of a non-empty text, each without its first space."""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " ":
            return [s[1:] for s in _SEGMENT.findall(" " + text)]
        return text.split(" ")

    def count(self, text: str) -> int:
        return sum(map(self.totals.__getitem__, self.segments(text))) if text else 0

    def prefix_counts(self, text: str) -> list[int]:
        """Exact token count of ``text[:i]`` for i = 0 .. len(text)."""
        counts, before = [0], 0
        for k, segment in enumerate(self.segments(text) if text else ()):
            table = self.tables[segment][0]
            counts += [before + c for c in table[(k == 0) :]]
            before += table[-1]
        return counts

    def fit(self, text: str, budget: int) -> int:
        """Characters in the longest prefix of ``text`` that has at most ``budget`` tokens."""
        if not text or budget <= 0:
            return 0
        segments = self.segments(text)
        ends = list(accumulate(map(self.totals.__getitem__, segments)))
        k = bisect_left(ends, budget + 1)
        if k == len(segments):
            return len(text)
        best, at = 0, -1  # the text's first space mark is not one of its characters
        for j, segment in enumerate(segments[: k + 1]):
            before = ends[j - 1] if j else 0
            if j >= k:
                fits = [i for i, c in enumerate(self.tables[segment][0]) if before + c <= budget]
                best = at + fits[-1] + 1 if fits else best
            at += 1 + len(segment)
            if j < k:
                best = at
        return max(best, 0)


def piece_table(model_file: str) -> PieceTable:
    return per_process(("pieces", model_file), lambda: PieceTable(model_file))


def token_counts(docs: DataFrame, model_file: str, budget: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more than ``budget`` tokens), fit_chars and fit_bytes
    (longest prefix within the budget).

    Null texts count as empty (0 tokens); null ids and repeated rows stay as they are, one output row per
    input row; an empty table gives an empty table; other columns are ignored.  No shuffle: a scan and one map.
    """

    def make():
        table = piece_table(model_file)

        def work(batch):
            texts = batch.column(1).to_pylist()
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            counts = [table.count(t) for t in texts]
            over = [n > budget for n in counts]
            chars = [table.fit(t, budget) if o else len(t) for t, o in zip(texts, over)]
            cut = [len(t[:c].encode()) if o else b for t, c, o, b in zip(texts, chars, over, sizes)]
            return {"doc_id": batch.column(0), "n_bytes": sizes, "n_tokens": counts, "over_limit": over, "fit_chars": chars, "fit_bytes": cut}

        return work

    return map_batches(doc_texts(docs, id_col, text_col), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, fit_bytes long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
