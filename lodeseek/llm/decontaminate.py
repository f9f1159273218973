"""Benchmark decontamination: a BM25 index of the test items, searched with block-max WAND.

The roles are turned round: test items are the indexed entries, each training document is a query, as one passage, so
that parts of an item that stand far apart count together.  A long enough question (all but an item's last sentence) is
an entry of its own beside the whole item: a document that holds the question leaks it, with whatever answer.

A leak holds at least ``overlap`` of an entry's word 5-shingles.  Each shingle that is missing uncovers one word at
most, so such a document has all of the entry's impacts but the largest few: that remainder is the entry's threshold,
and retrieval loses no leak.  Impacts are divided by it, so one threshold, 1, holds for all entries.

A document's essential terms are summed by entry first: an entry whose essential terms (those without which no document
reaches the threshold) sum to too little is out.  Where any is left, block-max WAND runs over the postings of the terms
that these have: posting lists are cut into blocks with their largest impacts, and a block is opened only if those
largest impacts reach the threshold.  Hits are verified by the overlap of question and answer.

The index is broadcast in shards of bounded size (``SHARD`` items, ``SHARD_BYTES`` of text): a larger benchmark takes
more shards, one pass over the documents each, never a larger broadcast.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm._common import doc_texts, documents, map_batches

SHARD = 20_000
SHARD_BYTES = 8 << 20
BLOCK = 64
#: Least words of a question that is looked for without its answer; shorter ones are anyone's.
QUESTION_WORDS = 8
OVERLAP = 0.8
K1, B = 1.2, 0.75
WORDS = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def shingles(words: list[str], n: int = 5) -> set[tuple[str, ...]]:
    """Word n-shingles; of fewer words, the whole sequence; of none, nothing."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def split_answer(text: str) -> tuple[str, str]:
    """Question and answer of an item: all but the last sentence, and that sentence."""
    parts = _SENTENCE.split(text.strip())
    return (text, "") if len(parts) < 2 else (text[: text.rindex(parts[-1])], parts[-1])


def least_share(impacts: list[float], n_shingles: int, overlap: float) -> float:
    """The least share of an entry's impacts that a text with ``overlap`` of its shingles has."""
    missing = n_shingles - math.ceil(overlap * n_shingles - 1e-9)
    return max(1 - sum(sorted(impacts, reverse=True)[:missing]) / (sum(impacts) or 1), 1e-6)


@dataclass
class Index:
    """Postings of one shard, by term: entry numbers, impacts, and (last entry, largest impact) of each block.

    An entry is a whole item or its question; ``owner`` is its item's place in ``items``.  Impacts are divided by the
    entry's threshold, ``least`` of its own score.
    """

    items: list[tuple[int | None, str]]
    overlap: float = OVERLAP
    question_words: int = QUESTION_WORDS
    owner: list[int] = field(default_factory=list)
    least: list[float] = field(default_factory=list)
    terms: list[frozenset[str]] = field(default_factory=list)
    postings: dict[str, tuple[array, array, array, array]] = field(default_factory=dict)
    largest: dict[str, float] = field(default_factory=dict)
    #: By term: entries for which it is essential, and their impacts; by entry: what their sum must reach.
    essential: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    need: np.ndarray | None = None
    _parts: dict[int, tuple[set, set, set]] = field(default_factory=dict)

    @classmethod
    def build(cls, items: list[tuple[int | None, str]], overlap: float = OVERLAP, question_words: int = QUESTION_WORDS) -> Index:
        index, texts = cls(items, overlap, question_words), []
        for k, (_, text) in enumerate(items):
            whole, question = words_of(text), words_of(split_answer(text)[0])
            for words in (whole, *([question] if question_words <= len(question) < len(whole) else [])):
                index.owner.append(k)
                texts.append(words)
        counts = [Counter(w) for w in texts]
        df = Counter(w for c in counts for w in c)
        mean = sum(map(len, texts)) / max(len(texts), 1) or 1
        found: dict[str, list[tuple[int, float]]] = defaultdict(list)
        essential: dict[str, list[tuple[int, float]]] = defaultdict(list)
        need = []
        for i, c in enumerate(counts):
            norm = K1 * (1 - B + B * len(texts[i]) / mean)
            impact = {w: math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in c.items()}
            least = least_share([*impact.values()], len(shingles(texts[i])), overlap)
            own = (sum(impact.values()) or 1) * least
            index.least.append(least)
            index.terms.append(frozenset(impact))
            for w, x in impact.items():
                found[w].append((i, x / own))
            # The most common terms of the entry, up to half the threshold, are not essential.
            common = 0.0
            for w in sorted(impact, key=lambda w: (-df[w], w)):
                if common + impact[w] / own <= 0.5:
                    common += impact[w] / own
                else:
                    essential[w].append((i, impact[w] / own))
            need.append(1 - common - 1e-6)
        index.need = np.array(need)
        index.essential = {w: (np.array([i for i, _ in row], dtype=np.int32), np.array([x for _, x in row])) for w, row in essential.items()}
        for w, row in found.items():
            ids, xs = array("i", (i for i, _ in row)), array("d", (x for _, x in row))
            cut = range(0, len(row), BLOCK)
            index.postings[w] = ids, xs, array("i", (ids[min(k + BLOCK, len(ids)) - 1] for k in cut)), array("d", (max(xs[k : k + BLOCK]) for k in cut))
            index.largest[w] = max(index.postings[w][3])
        return index

    def parts(self, item: int) -> tuple[set, set, set]:
        """Shingles of an item, of its question and of its answer."""
        if item not in self._parts:
            text = self.items[item][1]
            self._parts[item] = tuple(shingles(words_of(x)) for x in (text, *split_answer(text)))
        return self._parts[item]

    def likely(self, words: set[str]) -> np.ndarray:
        """Entries whose essential terms in a text sum to enough."""
        found = [self.essential[w] for w in words & self.essential.keys()]
        if not found:
            return np.empty(0, dtype=np.int64)
        return np.flatnonzero(np.bincount(np.concatenate([i for i, _ in found]), np.concatenate([x for _, x in found]), len(self.need)) >= self.need)

    def search(self, terms: set[str], least: float = 1.0) -> list[tuple[int, float]]:
        """All (entry, score) with a score of at least ``least``: block-max WAND over the terms' postings."""
        lists = [[*self.postings[t], self.largest[t], 0] for t in terms]
        least -= 1e-6
        hits = []
        while True:
            lists = [x for x in lists if x[5] < len(x[0])]
            lists.sort(key=lambda x: x[0][x[5]])
            bound, pivot = 0.0, None
            for k, x in enumerate(lists):
                bound += x[4]
                if bound >= least:
                    pivot = x[0][x[5]]
                    break
            if pivot is None:
                return hits
            while k + 1 < len(lists) and lists[k + 1][0][lists[k + 1][5]] == pivot:
                k += 1
            blocks = [(x, bisect_left(x[2], pivot)) for x in lists[: k + 1]]
            shallow = sum(x[3][b] for x, b in blocks if b < len(x[2]))
            if shallow >= least:
                score = 0.0
                for x, _ in blocks:
                    x[5] = bisect_left(x[0], pivot, x[5])
                    if x[5] < len(x[0]) and x[0][x[5]] == pivot:
                        score += x[1][x[5]]
                        x[5] += 1
                if score >= least:
                    hits.append((pivot, score))
            else:  # no entry up to the first end of these blocks can reach the threshold
                ends = [x[2][b] for x, b in blocks if b < len(x[2])]
                to = min(ends, default=pivot) + 1
                if k + 1 < len(lists):
                    to = min(to, lists[k + 1][0][lists[k + 1][5]])
                to = max(to, pivot + 1)
                for x, _ in blocks:
                    x[5] = bisect_left(x[0], to, x[5])


def scan_text(index: Index, text: str) -> list[tuple[int | None, float, float, float]]:
    """(item_id, BM25 share, question overlap, answer overlap) of the items that a whole text leaks."""
    words = words_of(text)
    present = set(words)
    likely = index.likely(present)
    if not len(likely):
        return []
    best: dict[int, float] = {}
    for entry, score in index.search(present & frozenset().union(*(index.terms[i] for i in likely))):
        item = index.owner[entry]
        best[item] = max(best.get(item, 0), score * index.least[entry])
    have: dict[int, set] = {}

    def held(part: set) -> float:
        """The share of a part's shingles that the text has; parts of under five words are sequences of their own length."""
        if not part:
            return 1.0
        n = len(next(iter(part)))
        if n not in have:
            have[n] = shingles(words, n)
        return len(part & have[n]) / len(part)

    out = []
    for item, score in sorted(best.items()):
        whole, question, answer = index.parts(item)
        alone = index.question_words <= len(words_of(split_answer(index.items[item][1])[0]))
        asked, answered = held(question), held(answer)
        if held(whole) >= index.overlap - 1e-9 or (alone and asked >= index.overlap - 1e-9):
            out.append((index.items[item][0], score, asked, answered))
    return out


def _shards(benchmark: DataFrame, overlap: float, question_words: int):
    """Index shards of bounded size, one at a time on the driver, in item order; items without words are left out."""
    rows = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("text is not null").distinct().orderBy("item_id", "text")
    shard, size = [], 0
    for r in rows.toLocalIterator():
        if WORDS.search(r.text):
            shard.append((r.item_id, r.text))
            size += len(r.text)
        if len(shard) >= SHARD or size >= SHARD_BYTES:
            yield Index.build(shard, overlap, question_words)
            shard, size = [], 0
    if shard:
        yield Index.build(shard, overlap, question_words)


def leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, question_words: int = QUESTION_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per leaking document row and item: doc_id, item_id, score (share of the item's, or its question's, own
    BM25 score), question_overlap, answer_overlap.

    A leak holds, anywhere in its text, at least ``overlap`` of the word 5-shingles of the item, or of the item's
    question if that has ``question_words`` words or more.  Null and empty texts leak nothing, null items are left out;
    null ids and repeated rows stay; empty tables give an empty table; other columns are ignored.  One scan of the
    documents for each shard of the benchmark, no shuffle.
    """
    texts, context = doc_texts(docs, id_col, text_col), docs.sparkSession.sparkContext
    ddl = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    for index in _shards(benchmark, overlap, question_words):
        held = context.broadcast(index)

        def make(held=held):
            def work(batch):
                rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in scan_text(held.value, t)]
                return dict(zip(("doc_id", "item_id", "score", "question_overlap", "answer_overlap"), zip(*rows))) if rows else None

            return work

        found = map_batches(texts, make, ddl)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], ddl) if out is None else out


def _leaking(held):
    def leaking(texts):
        return pa.array([bool(t) and bool(scan_text(held.value, t)) for t in texts.to_pylist()], type=pa.bool_())

    return F.arrow_udf(leaking, "boolean", F.ArrowUDFType.SCALAR)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP, question_words: int = QUESTION_WORDS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns, as they are) whose whole text leaks no item.

    Rows with a null or empty text stay, and so do rows with a null id that leak nothing: each row is judged by its
    own text.  Repeated rows stay or go alike; empty tables give an empty table, an empty benchmark all rows.
    """
    context = docs.sparkSession.sparkContext
    for index in _shards(benchmark, overlap, question_words):
        docs = docs.where(~_leaking(context.broadcast(index))(docs[text_col].cast("string")))
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaking documents with the benchmark items that they hold."""
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
