"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

All grades share one weight vector ``w`` over hashed features and differ only in ordered thresholds:
P(grade <= k) = sigmoid(theta[k] - w.x).  From these come the expected grade and the tail probability
P(grade >= k) that selection uses.  Ratings: 0 toxic, 1 clean but of low quality, 2 clean and good.

Features are the presence of each word (lower case, punctuation stripped) and of its beginnings and, in buckets, the shares
of tokens in capitals, with mark or symbol endings, of bare separators, of digits, and of repeats.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm._common import BoundedCache, doc_texts, documents, map_batches, per_process

BITS = 18
GRADES = 3
#: At most this many labelled documents are fitted on, the ones with the smallest hash of their id.
SAMPLE = 12_000
_STRIP = re.compile(r"^\W+|\W+$")
_SHAPES = ("caps", "marks", "symbols", "bare", "digits")
_PREFIXES = (3, 5, 7)
_EDGES = (0.02, 0.1, 0.3, 0.6, 0.9)


def _hash(name: str) -> int:
    return crc32(name.encode()) & ((1 << BITS) - 1)


def _token(token: str) -> tuple[tuple[int, ...], int]:
    """Features of the word and its beginnings (none: empty), and a bit set of shapes."""
    word = _STRIP.sub("", token)
    shape = (
        (len(word) > 1 and word.isupper())
        | token.endswith(("!!", "??")) << 1
        | bool(re.search(r"[%$&#*@~^]{2,}$", token)) << 2
        | (not word) << 3
        | word.isdigit() << 4
    )
    word = word.lower()
    return (tuple({_hash(word), *(_hash(f"{word[:n]}*") for n in _PREFIXES if len(word) > n)}) if word else (), shape)


def _bucket(name: str, share: float) -> int:
    return _hash(f"\0{name}:{sum(share > e for e in _EDGES)}")


def features(text: str, tokens: dict) -> list[int]:
    """Distinct hashed features of a whole text."""
    counts = Counter(text.split())
    total = sum(counts.values())
    if not total:
        return [_bucket("empty", 1.0)]
    out, shapes = set(), [0] * len(_SHAPES)
    for token, n in counts.items():
        found, shape = tokens[token]
        out.update(found)
        if shape:
            for k in range(len(_SHAPES)):
                if shape >> k & 1:
                    shapes[k] += n
    out.update(_bucket(name, n / total) for name, n in zip(_SHAPES, shapes))
    out.add(_bucket("repeats" if total > 20 else "repeats-short", 1 - len(counts) / total))
    return list(out)


def _tokens() -> BoundedCache:
    return per_process("quality-tokens", lambda: BoundedCache(_token, 250_000))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[r].sum() for r in rows])

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES - 1, one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def fit(rows: list[list[int]], grades: list[int], steps: int = 400, l2: float = 1e-4, rate: float = 0.08, least_z: float = 4.0) -> OrdinalModel:
    """Full-batch Adam on the cumulative-link likelihood; thresholds stay ordered as a first value and positive gaps.

    Features enter if a score test of the model without features gives them |z| >= ``least_z`` for some split of
    the grades, so that the many words that tell nothing have no weight, however long a text is.

    Without rows, or with one grade only, every score is zero and the thresholds follow the counts.
    """
    flat = np.concatenate([np.asarray(r, dtype=np.int32) for r in rows]) if rows else np.empty(0, dtype=np.int32)
    return fit_arrays(flat, np.array([len(r) for r in rows], dtype=np.int64), np.asarray(grades, dtype=np.int64), steps, l2, rate, least_z)


def fit_arrays(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = 400, l2: float = 1e-4, rate: float = 0.08, least_z: float = 4.0) -> OrdinalModel:
    """``fit`` on the documents' features one after another, with each document's number of them."""
    freq = np.array([(np.sum(y < k) + 0.5) / (len(y) + 1) for k in range(1, GRADES)])
    theta = np.log(freq / (1 - freq))
    weights = np.zeros(1 << BITS)
    if len(np.unique(y)) < 2:
        return OrdinalModel(weights, theta)
    row = np.repeat(np.arange(len(y), dtype=np.int32), sizes)
    z = np.zeros(1 << BITS)
    for k in range(1, GRADES):
        residual = (y >= k) - np.mean(y >= k)
        spread = np.sqrt(np.bincount(flat, minlength=1 << BITS) * max(np.var(residual), 1e-12)) + 0.5
        z = np.maximum(z, np.abs(np.bincount(flat, weights=residual[row], minlength=1 << BITS)) / spread)
    used = np.flatnonzero(z >= least_z)
    column = np.full(1 << BITS, -1, dtype=np.int32)
    column[used] = np.arange(len(used))
    flat = column[flat]
    row, flat = row[flat >= 0], flat[flat >= 0]
    w, params = np.zeros(len(used)), np.array([theta[0], *np.log(np.maximum(np.diff(theta), 1e-2))])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(params), np.zeros_like(params)]
    balance = len(y) / (GRADES * np.maximum(np.bincount(y, minlength=GRADES), 1))
    cost = np.sqrt(balance)[y]
    cost /= cost.mean()
    for t in range(1, steps + 1):
        gaps = np.exp(params[1:])
        theta = np.concatenate([params[:1], params[0] + np.cumsum(gaps)])
        s = np.bincount(row, weights=w[flat], minlength=len(y))
        cut = 1 / (1 + np.exp(np.clip(s[:, None] - np.concatenate([[-60.0], theta, [60.0]])[None, :], -60, 60)))
        cut[:, 0], cut[:, -1] = 0, 1
        upper, lower = cut[np.arange(len(y)), y + 1], cut[np.arange(len(y)), y]
        p = np.maximum(upper - lower, 1e-12)
        du, dl = cost * upper * (1 - upper) / p, cost * lower * (1 - lower) / p
        gs = (du - dl) / len(y)
        gt = np.array([(dl[y == k + 1].sum() - du[y == k].sum()) / len(y) for k in range(GRADES - 1)])
        gp = np.array([gt.sum(), *(gaps * np.cumsum(gt[::-1])[::-1][1:])])
        gw = np.bincount(flat, weights=gs[row], minlength=len(used)) + l2 * w
        for x, g, m, v in ((w, gw, *state[:2]), (params, gp, *state[2:])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    weights[used] = w
    return OrdinalModel(weights, np.concatenate([params[:1], params[0] + np.cumsum(np.exp(params[1:]))]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on at most ``sample`` labelled documents; null labels and ids are left out.

    An id that several labels have counts by its lowest grade; of several rows with one id, the one whose text has the
    smallest hash is fitted.  Null texts count as empty.  Empty tables give a model that scores every text alike.
    The sample of labels is broadcast (bounded by ``sample``); features are made on the executors, and only hashed
    features of the sample, one row an id, come to the driver.
    """
    rated = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    grade = F.when(F.col("toxic") > 0, 0).otherwise(1 + F.least(F.greatest(F.col("quality"), F.lit(0)), F.lit(1))).cast("int")
    chosen = rated.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min(grade).alias("grade")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    texts = doc_texts(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "grade", F.xxhash64("text").alias("hash"))

    def make():
        tokens = _tokens()
        return lambda batch: {"doc_id": batch.column(0), "grade": batch.column(2), "hash": batch.column(3), "features": [np.array(sorted(features(t, tokens)), dtype="<i4").tobytes() for t in batch.column(1).to_pylist()]}

    # Rows of one id are cut to one before they are shuffled, so an id that many rows share is no burden.
    made = map_batches(texts, make, "doc_id long, grade int, hash long, features binary")
    got = made.groupBy("doc_id").agg(F.min(F.struct("hash", "features", "grade")).alias("x")).select("doc_id", "x.features", "x.grade").toArrow().sort_by([("doc_id", "ascending")]).combine_chunks()
    packed = got.column("features").to_pylist()
    sizes = np.array([len(p) // 4 for p in packed], dtype=np.int64)
    return fit_arrays(np.frombuffer(b"".join(packed), dtype="<i4"), sizes, got.column("grade").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, expected_grade, p_clean = P(grade >= 1), p_good = P(grade >= 2).

    Null texts count as empty; null ids and repeated rows stay, one output row per input row; an empty table
    gives an empty table; other columns are ignored.  The model is broadcast: its size is fixed by ``BITS``.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def make():
        weights, thresholds = held.value
        fitted, tokens = OrdinalModel(weights.astype(np.float64), thresholds), _tokens()

        def work(batch):
            tails = fitted.tails(fitted.score([features(t, tokens) for t in batch.column(1).to_pylist()]))
            return {"doc_id": batch.column(0), "expected_grade": tails.sum(axis=1), "p_clean": tails[:, 0], "p_good": tails[:, -1]}

        return work

    return map_batches(doc_texts(docs, id_col, text_col), make, "doc_id long, expected_grade double, p_clean double, p_good double")


def keep_good(docs: DataFrame, model: OrdinalModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns, as they are) whose P(grade >= 2) is at least ``least``.

    Null texts are judged as empty ones; null ids and repeated rows are judged by their own text; an empty table gives
    an empty table.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def p_good(texts):
        weights, thresholds = held.value
        fitted, tokens = OrdinalModel(weights.astype(np.float64), thresholds), _tokens()
        return pa.array(fitted.tails(fitted.score([features(t or "", tokens) for t in texts.to_pylist()]))[:, -1] if len(texts) else [], type=pa.float64())

    p_good = F.arrow_udf(p_good, "double", F.ArrowUDFType.SCALAR)
    return docs.where(p_good(docs[text_col].cast("string")) >= least)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that selection keeps, with their expected grade and tail probabilities."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where("p_good >= 0.5")
