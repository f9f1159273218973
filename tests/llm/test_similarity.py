"""Suffix dedup, SimHash and nearest neighbours against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash

from lodeseek.llm import ann, simhash
from lodeseek.llm import suffix_dedup as S
from lodeseek.llm._common import Scratch
from lodeseek.llm.components import connected_components
from tests.llm.test_tokens import rows


def brute_repeats(docs, length=200):
    seen = Counter(b[p : p + length] for _, b in docs for p in range(len(b) - length + 1))
    out = []
    for d, b in docs:
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def digests(rows_):
    return sorted((r.doc_id, r.n_bytes, sum(x["stop"] - x["start"] for x in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows_)


def test_repeats_of_documents(spark, sf):
    docs = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, S.op2_suffix_dedup(spark, sf).collect())) == sorted(brute_repeats(docs))


def test_repeats_of_periodic_and_mixed_texts(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    shared = [word(260) for _ in range(3)]
    texts = ["ab" * 300, "a" * 199, "a" * 200, "a" * 201, "", word(500), shared[0], shared[0]]
    texts += [word(rng.randint(0, 90)) + rng.choice(shared)[rng.randint(0, 50) :] + word(rng.randint(0, 300)) + rng.choice(shared)[: rng.randint(190, 260)] for _ in range(40)]
    data = [(i, t) for i, t in enumerate(texts)]
    got = S.repeats(spark.createDataFrame(data, "doc_id long, text string"))
    assert digests(got.collect()) == sorted(brute_repeats([(i, t.encode()) for i, t in data]))


def test_long_runs_over_small_batches(spark, monkeypatch):
    """One passage in many contexts: runs of equal suffixes that reach over batches and tasks, and longer ones than a
    task settles itself."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [word(230), word(400)]
    data = [(i, word(rng.randint(0, 60)) + rng.choice(shared)[: rng.randint(200, 400)] + word(rng.randint(0, 60))) for i in range(150)]
    data += [(200 + i, word(300)) for i in range(10)] + [(300 + i, shared[0]) for i in range(20)]
    want = sorted(brute_repeats([(i, t.encode()) for i, t in data]))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for rows_, longest in ((10_000, S.RUN), (7, 3), (50, 20)):
            spark.conf.set(size, rows_)
            monkeypatch.setattr(S, "RUN", longest)
            assert digests(S.repeats(docs).collect()) == want
    finally:
        spark.conf.set(size, before)


def test_chunks_do_not_change_the_result(spark, monkeypatch):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdef ") for _ in range(3000))
    docs = [(1, (base + base[500:900]).encode()), (2, base[1000:2500].encode())]
    counts = Counter()
    for size in (S.CHUNK, 700):
        monkeypatch.setattr(S, "CHUNK", size)
        for d, data in docs:
            array = np.frombuffer(data, np.uint8)
            covered = []
            for at, part, cut in S._chunks(array, np.array([len(array)]), 200):
                first, number, _, _ = S.phrases(part, cut)
                covered += [at + f + i for f, n in zip(first.tolist(), number.tolist()) for i in range(n)]
            assert sorted(covered) == list(range(len(data) - 199))
            counts[size, d] = len(covered)
    assert len(counts) == 4


def test_repeats_of_odd_rows(spark):
    data = [(1, "q" * 250), (1, "q" * 250), (None, None), (None, "short"), (3, "")]
    got = S.repeats(spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS rid", "2 AS runs")).collect()
    assert sorted((r.n_bytes, len(r.kept)) for r in got) == [(0, 0), (0, 0), (5, 5), (250, 0), (250, 0)]
    assert S.repeats(rows(spark).limit(0)).collect() == []


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, threshold=2):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    fps = np.array(fps, dtype=np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= threshold):
            parent[find(int(j))] = find(i)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(ids))]


def test_fingerprints_and_components(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in simhash.op4_simhash(spark, sf).collect()}
    fps = [brute_fingerprint(d.text) for d in docs]
    want = brute_components([d.doc_id for d in docs], fps)
    for d, fp, component in zip(docs, fps, want, strict=True):
        assert (int(got[d.doc_id].fingerprint, 16), got[d.doc_id].component_id) == (fp, component)


def test_every_close_pair_meets_at_a_home():
    rng = random.Random(2)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for k in rng.sample(range(64), rng.randint(0, 2)):
            y ^= 1 << k
        anchor, _, home = simhash.anchors(np.array([x], dtype=np.uint64))
        other, _, _ = simhash.anchors(np.array([y], dtype=np.uint64))
        assert home.sum() == 1
        assert anchor[home][0] in other


def test_links_of_clustered_fingerprints(spark):
    rng = random.Random(8)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(30):
            fps.add(x)
            for k in rng.sample(range(64), rng.choice([0, 1, 2, 3])):
                x ^= 1 << k
    fps = sorted(fps)
    links = simhash.fingerprint_links(spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long"))
    roots = {r.node: r.root for r in connected_components(links, Scratch(spark, "t")).collect()}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    assert [roots.get(x, x) for x in signed] == brute_components(signed, fps)


def test_components_of_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 500 for k in range(500, 540)}


def test_components_of_no_links(spark):
    for links in ([], [(1, 1)], [(None, 2)]):
        assert connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect() == []


def test_keep_one_of_odd_rows(spark):
    data = [(5, "a b c d e"), (3, "A b c d e"), (3, "A b c d e"), (None, "a b c d e"), (9, None), (8, ""), (1, "other words stand here")]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS fp", "'x' AS component_id")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 8]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    assert {r.fingerprint for r in simhash.near_duplicates(docs).where("doc_id in (8, 9)").collect()} == {"0" * 16}


def exact(ids, vectors, q, k):
    scores = (vectors * vectors[q]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(scores[i])) for i in order]


def test_recall(spark):
    d = "/root/testdata/sf0.1"
    found = {}
    for r in ann.op3_nearest(spark, d).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    table = spark.read.parquet(f"{d}/embeddings.parquet").toArrow()
    ids, vectors = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), dtype=np.float64)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        want = exact(ids, vectors, q, 20)
        got = [found[int(ids[q])][k] for k in range(1, 21)]
        assert got == sorted(got, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in got} & {i for i, _ in want})
        total += 20
    assert hits >= 0.95 * total


def test_recall_with_unequal_lengths_and_copies():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(4000, 24)) * rng.gamma(2, 1, (4000, 1))
    vectors[1000:2500] = vectors[7]
    ids = rng.permutation(4000).astype(np.int64)
    asked = np.arange(0, 4000, 100)
    found = ann.Nearest(ids[asked], vectors[asked], 20)
    found.add(ann.Block(ids, vectors, 20))
    row, got, _ = found.best
    hits = sum(len({*got[row == k].tolist()} & {i for i, _ in exact(ids, vectors, q, 20)}) for k, q in enumerate(asked))
    assert hits >= 0.9 * 40 * 20


def test_recall_and_share_verified_over_many_blocks(monkeypatch):
    """50,000 vectors in seven blocks: few are verified, and nearly all of the nearest are found."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(50_000, 64)) + 0.3 * rng.normal(size=(10, 64))[rng.integers(0, 10, 50_000)]
    vectors = (vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.float32)
    ids, asked, seen = np.arange(50_000), np.arange(0, 50_000, 500), []
    candidates = ann.Block.candidates
    monkeypatch.setattr(ann.Block, "candidates", lambda block, queries: seen.append(candidates(block, queries)) or seen[-1])
    found = ann.Nearest(ids[asked], vectors[asked], 20)
    for some in np.array_split(ids, 7):
        found.add(ann.Block(some, vectors[some], 20))
    row, got, _ = found.best
    scores = vectors[asked].astype(np.float64) @ vectors.T.astype(np.float64)
    scores[np.arange(len(asked)), asked] = -2
    want = np.argsort(-scores, axis=1)[:, :20]
    assert sum(len({*got[row == k].tolist()} & {*want[k].tolist()}) for k in range(len(asked))) >= 0.9 * 20 * len(asked)
    assert sum(x.sum() for x in seen) <= 0.1 * sum(x.size for x in seen)


def test_collision_counts_are_those_of_a_sum():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 64, 128):
        flags = rng.random((n, 3, 128)) < rng.random()
        windows = [np.packbits(x, axis=1, bitorder="little").view(np.uint64) for x in flags]
        for need in (0, 1, n // 2, n, n + 1):
            got = np.unpackbits(ann.at_least(ann.collisions(iter(windows)), need).view(np.uint8), axis=1, bitorder="little")
            assert (got == (flags.sum(axis=0) >= need)).all()


def test_nearest_of_odd_rows(spark):
    nan = float("nan")
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [0.5, 0.5]), (8, [1.0, 0.0, 0.0]), (9, []), (20, [1.0, 0.0])]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS score")
    got = sorted(map(tuple, ann.nearest(vectors, vectors.where("vec_id in (20, 3, 8)"), 3).collect()))
    assert got == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 7, 0.5)]
    assert ann.nearest(vectors.limit(0), vectors, 3).collect() == ann.nearest(vectors, vectors.limit(0), 3).collect() == []
