"""The near-dedup stage against a brute-force Jaccard join."""

import random

import numpy as np

from lodeseek.llm import near_copies, simhash
from lodeseek.llm.near_copies import drop_near_copies


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_kept(data, similarity=0.8):
    """Positions of the rows that stay: of each component the least id (nulls last), then the first row."""
    sets = [shingles(t) for _, t in data]
    label = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if label[i] != label[j] and jaccard(sets[i], sets[j]) >= similarity:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    best = {}
    for k, (d, _) in enumerate(data):
        rank = (d is None, d or 0, k)
        best[label[k]] = min(best.get(label[k], rank), rank)
    return sorted(x[2] for x in best.values())


def kept(spark, data):
    docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(data)], "doc_id long, text string, k int")
    return sorted(r.k for r in drop_near_copies(docs.coalesce(1)).collect())


def edited(rng, words, n):
    words = [*words]
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.getrandbits(40)}"
    return words


def test_near_copies_are_those_of_a_jaccard_join(spark):
    """Copies with a few words changed: their fingerprints differ in more than two bits."""
    rng = random.Random(4)
    data = []
    for _ in range(25):
        words = [f"w{rng.getrandbits(20)}" for _ in range(rng.randint(60, 260))]
        for _ in range(4):
            words = edited(rng, words, rng.randint(0, len(words) // 40))
            data.append((len(data), " ".join(words)))
    want = brute_kept(data)
    assert 25 <= len(want) < 60
    assert kept(spark, data) == want


def test_texts_that_share_a_fingerprint_stay(spark):
    """One shingle that makes up most of a text sets its fingerprint, not its likeness."""
    from lodeseek.llm.simhash import fingerprint

    rng = random.Random(6)
    data = [(k, " ".join([f"w{rng.getrandbits(30)}" for _ in range(100)] + ["-"] * 150)) for k in range(2)]
    assert fingerprint(data[0][1]) == fingerprint(data[1][1])
    assert kept(spark, data) == [0, 1]


def test_rows_that_share_or_lack_an_id(spark):
    """Each row is judged by its own text."""
    data = [(3, "one two three four five six"), (7, "one two three four five six"), (7, "quite other words stand in this row"), (7, "and a third text under this id"), (None, "rows without any id hold this"), (None, "rows without any id hold this"), (None, "One two three four five six"), (9, None), (8, "")]
    assert kept(spark, data) == brute_kept(data) == [0, 2, 3, 4, 8]


def test_fingerprints_are_simhashes_of_the_shingle_set():
    """Each bit is the majority of that bit over the shingles' hashes, ties to 0; sets longer than a part too."""
    rng, mask = np.random.default_rng(3), (1 << 64) - 1
    for n in (1, 2, 4, 37, near_copies.PART + 5):
        hashes = rng.integers(0, 1 << 64, size=n, dtype=np.uint64)
        got = near_copies.fingerprint(hashes)
        assert len(got) == near_copies.WORDS
        for w in (0, near_copies.WORDS - 1):
            counts = [0] * 64
            for h in hashes.tolist():
                z = (h ^ int(near_copies._PLUS[w])) * int(near_copies._TIMES[w]) & mask
                z = (z ^ z >> 32) * int(near_copies._TIMES[w]) & mask
                z ^= z >> 29
                counts = [c + (z >> b & 1) for b, c in enumerate(counts)]
            assert int(got[w]) == sum(1 << b for b, c in enumerate(counts) if 2 * c > n)


def test_homes_are_the_nearest_anchors():
    anchors = [0]
    for k in range(12):
        anchors += [a ^ simhash.GENERATOR << k for a in anchors]
    anchors = np.array(anchors, dtype=np.int64)
    words = np.random.default_rng(5).integers(0, 1 << simhash.SECTION, size=300)
    nearest = [anchors[np.bitwise_count(anchors ^ w).argmin()] >> 11 for w in words]
    assert simhash.homes(words).tolist() == nearest
    assert len(set(simhash.homes(anchors).tolist())) == 1 << 12


def test_similar_sets_share_a_home():
    """At a similarity of exactly 0.8, where fingerprints differ most."""
    rng = np.random.default_rng(8)
    for n, m, common in ((8, 10, 8), (9, 9, 8), (90, 90, 80), (36, 45, 36)):
        for _ in range(100):
            hashes = rng.integers(0, 1 << 64, size=n + m - common, dtype=np.uint64)
            a, b = near_copies.fingerprint(hashes[:n]), near_copies.fingerprint(hashes[n - common :])
            assert near_copies.similar(np.sort(hashes[:n]), np.sort(hashes[n - common :]))
            assert (near_copies.keys(a[None]) == near_copies.keys(b[None])).any()
            assert all(np.bitwise_count(a[:w] ^ b[:w]).sum() <= r for w, r in near_copies.RADIUS.items())


def test_candidates_come_from_fingerprints(spark):
    """Pairs that share a home, of sizes and within bits that allow the similarity; no others, and none twice told."""
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        words = [f"w{rng.getrandbits(20)}" for _ in range(rng.randint(8, 120))]
        texts += [" ".join(edited(rng, words, k)) for k in range(3)]
    sets = [near_copies.shingle_set(t) for t in texts]
    fps = np.array([near_copies.fingerprint(s) for s in sets])
    at = near_copies.keys(fps)
    want = set()
    for a in range(len(texts)):
        for b in range(a):
            low, high = sorted((len(sets[a]), len(sets[b])))
            bits = np.bitwise_count(fps[a, : near_copies.CHECKED] ^ fps[b, : near_copies.CHECKED]).sum()
            if (at[a] == at[b]).any() and high <= low / 0.8 and bits <= near_copies.RADIUS[near_copies.CHECKED]:
                want.add((a, b))
    nodes = spark.createDataFrame([(k, k, len(s), bytearray(f.tobytes())) for k, (s, f) in enumerate(zip(sets, fps))], "row long, root long, size long, fp binary")
    for few in (None, near_copies.FEW):
        got = near_copies._candidates(nodes, 0.8, near_copies.CHECKED, few).distinct().collect()
        assert {(r.a, r.b) for r in got} == want
    assert len(want) > 12


def test_more_near_copies_than_are_compared_at_first(spark):
    """Large groups: one that drifts, whose ends are not similar, and one of texts that are similar or just not."""
    rng = random.Random(12)
    words, data = [f"w{rng.getrandbits(20)}" for _ in range(120)], []
    for k in range(80):
        words = edited(rng, words, 2)
        data.append((1000 - len(data), " ".join(words)))
    base = [f"v{rng.getrandbits(20)}" for _ in range(160)]
    for k in range(80):
        data.append((1000 - len(data), " ".join(edited(rng, base, rng.randint(2, 6)))))
    want = brute_kept(data)
    assert 2 < len(want) < 100
    assert kept(spark, data) == want


def test_verified_pairs_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    """A large group of texts about a base, many of which are candidates but not similar; some share an edit."""
    counts = []
    verified = near_copies._verified

    def counted(pairs, *rest):
        counts[-1] += pairs.distinct().count()
        return verified(pairs, *rest)

    monkeypatch.setattr(near_copies, "_verified", counted)
    rng = random.Random(14)
    base = [f"w{rng.getrandbits(20)}" for _ in range(150)]
    data = []
    for k in range(640):
        words = edited(rng, base, rng.randint(1, 7))
        if k % 3 == 0:
            words[rng.randrange(150)] = f"y{rng.randrange(4)}"
        data.append((k, " ".join(words)))
    for n in (320, 640):
        counts.append(0)
        want = brute_kept(data[:n])
        assert n / 4 < len(want) < n
        assert kept(spark, data[:n]) == want
    assert counts[1] < 3 * counts[0]
    assert counts[1] < 640 * 639 / 2 / 4
