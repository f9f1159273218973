"""Token operators against the libraries that they must agree with."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodeseek.llm import token_binary as B
from lodeseek.llm import token_counts as C
from lodeseek.llm.bpe import WordBpe, bpe_decode, bpe_digests, bpe_encode, bpe_pack, op6_bpe

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "B", "the", "'s", "'S", " ", "  ", "\n", "\t", "\x00", "\x1c", "\x85", "\xa0", "Σ", "İ", "é", "é", "漢", "▁", "<|endoftext|>", "<|startoftext|>", "<|", "</s>", "0", "½", "!", "​", "ǅ", "ﬁ", "　", "😀"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(n)] + ["", " ", "x" * 700, "ab" * 400]


def rows(spark):
    """Nulls, empty, very long, repeated rows, and extra columns whose names clash with results."""
    long = "Ordinary words, and more of them. " * 20_000
    data = [(1, "ab c", 5, "z"), (1, "ab c", 5, "z"), (None, "x", None, None), (2, None, 1, None), (3, "", 1, ""), (4, long, 9, "q")]
    return spark.createDataFrame(data, "doc_id long, text string, n_tokens long, `fingerprint` string")


def test_prefix_counts_are_those_of_the_library(spark):
    import sentencepiece

    table, library = C.PieceTable(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for k, text in enumerate(texts(400, 1)):
        counts = table.prefix_counts(text)
        assert len(counts) == len(text) + 1
        for i in {0, len(text), *random.Random(k).sample(range(len(text) + 1), min(4, len(text) + 1))}:
            assert counts[i] == len(library.encode(text[:i]))
        budget = k % 13
        assert table.fit(text, budget) == max(i for i, n in enumerate(counts) if n <= budget)


def test_token_counts_of_odd_rows(spark):
    got = C.token_counts(rows(spark), PIECES).collect()
    assert len(got) == 6
    assert sorted((r.doc_id or 0, r.n_bytes, r.over_limit) for r in got)[0] == (0, 1, False)
    by = {r.doc_id: r for r in got}
    assert (by[2].n_tokens, by[3].n_tokens, by[2].n_bytes) == (0, 0, 0)
    assert by[4].over_limit
    assert 0 < by[4].fit_chars < by[4].n_bytes
    assert C.token_counts(rows(spark).limit(0), PIECES).collect() == []


def test_documents_match_the_library(spark, sf):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: len(library.encode(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in C.token_counts(docs, PIECES).collect()} == want


def test_word_bpe_is_the_library():
    bpe, library = WordBpe(WORDS), Tokenizer.from_file(WORDS)
    for text in texts(2500, 2):
        ids = library.encode(text, add_special_tokens=False).ids
        packed, decoded = bpe.encode_with_text(text)
        assert bpe._ids_of(packed) == ids
        assert decoded == library.decode(ids, skip_special_tokens=False) == bpe.decode(ids)
    assert bpe.decode(bpe.encode("Hello, World"), to_text=True) == "hello , world"


def test_heap_and_scan_merge_alike():
    bpe = WordBpe(WORDS)
    rng = random.Random(5)
    for _ in range(300):
        word = "".join(rng.choice("abtheinrs") for _ in range(rng.randint(1, 120))).encode()
        ids = [*map(bpe.plain.__getitem__, word[:-1]), bpe.final[word[-1]]]
        assert bpe.merge([*ids]) == bpe._merge_long(ids)


def test_bpe_rows(spark):
    docs = rows(spark)
    encoded = bpe_encode(docs, WORDS)
    by = {r.doc_id: r for r in encoded.collect()}
    assert encoded.count() == 6
    assert by[2].ids == by[3].ids == []
    back = {r.doc_id: r.text for r in bpe_decode(encoded, WORDS).collect()}
    assert all(back[k] == by[k].decoded for k in by)
    packed = {r.doc_id: r for r in bpe_pack(docs, WORDS).collect()}
    digests = {r.doc_id: r for r in bpe_digests(docs, WORDS).collect()}
    for k in by:
        assert np.frombuffer(packed[k].ids, "<u4").tolist() == by[k].ids
        assert digests[k].ids_sha256 == hashlib.sha256(packed[k].ids).hexdigest()
        assert digests[k].decoded_sha256 == hashlib.sha256(by[k].decoded.encode()).hexdigest()
    for operator in (bpe_encode, bpe_pack, bpe_digests):
        assert operator(docs.limit(0), WORDS).collect() == []
        assert operator(docs.selectExpr("*", "1 AS ids", "2 AS decoded"), WORDS).count() == 6
    odd = spark.createDataFrame([(None, None, "x"), (1, [], "x"), (1, [], "x"), (2, [10**6], "x")], "doc_id long, ids array<int>, text string")
    assert sorted((r.doc_id or 0, r.text) for r in bpe_decode(odd, WORDS).collect()) == [(0, ""), (1, ""), (1, ""), (2, "")]
    assert bpe_decode(odd.limit(0), WORDS).collect() == []


def test_queries_are_those_of_the_libraries(spark):
    """op1 and op6 over a whole table, every column."""
    import sentencepiece

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    pieces, words = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(WORDS)
    words.no_truncation()
    words.no_padding()
    sha = lambda data: hashlib.sha256(data).hexdigest()
    counts, encoded = {}, {}
    for r in docs:
        text = r.text or ""
        n, ids = len(pieces.encode(text)), words.encode(text, add_special_tokens=False).ids
        counts[r.doc_id] = (len(text.encode()), n, n > 4096)
        encoded[r.doc_id] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(words.decode(ids, skip_special_tokens=False).encode()))
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in C.op1_token_counts(spark, d).collect()} == counts
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op6_bpe(spark, d).collect()} == encoded


@pytest.mark.parametrize(("n", "limit"), [(1, 16), (2, 4), (5, 3), (300, 9), (300, 16), (5000, 13)])
def test_codes(n, limit):
    rng = np.random.default_rng(n)
    counts = (rng.pareto(0.5, n) * 3).astype(np.int64) + 1
    lengths = B.code_lengths(counts, limit)
    assert lengths.max() <= limit
    assert sum(2.0 ** -lengths.astype(float)) <= 1 + 1e-9
    codec = B.Codec(lengths)
    ids = rng.choice(n, size=3000, p=counts / counts.sum())
    for m in (0, 1, 63, 64, 65, 3000):
        bits, offsets = codec.pack(ids[:m])
        assert codec.unpack(bits, offsets, m).tolist() == ids[:m].tolist()
    with pytest.raises(ValueError):
        B.code_lengths(np.ones(5, dtype=np.int64), 2)


def test_limited_lengths_are_optimal():
    """Package-merge against all Kraft-feasible length vectors of a small alphabet."""
    from itertools import product

    for seed in range(6):
        counts = np.sort(np.random.default_rng(seed).geometric(0.05, 6))
        best = min(sum(a * b for a, b in zip(ls, counts)) for ls in product(range(1, 4), repeat=6) if sum(2.0**-x for x in ls) <= 1)
        assert int((B.code_lengths(counts, 3).astype(int) * counts).sum()) == best


def test_library_encoder_is_the_library():
    library, encoder = Tokenizer.from_file(BYTES), B.LibraryEncoder(BYTES)
    for text in texts(2500, 3):
        assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_spaces_beside_other_white_space():
    library, encoder = Tokenizer.from_file(BYTES), B.LibraryEncoder(BYTES)
    for gap in (" \xa0 \xa0 ", " \xa0" * 8 + " ", "\xa0 \xa0 ", " \n \n ", " \t ", "\u3000 \x85 "):
        for text in (f"foo{gap}bar", f"{gap}bar baz", f"foo bar{gap}"):
            assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_second_engine_is_the_library():
    """Texts of the Latin blocks, long runs of one kind, and texts that mix in other scripts."""
    library, encoder = Tokenizer.from_file(BYTES), B.LibraryEncoder(BYTES)
    assert encoder.engine
    assert B.LibraryEncoder(WORDS).engine is None
    rng = random.Random(12)
    latin = [*map(chr, (9, 10, 13, *range(32, 127), *range(0xA0, 0x250))), "the", " of", "ing", "'ll", " 12", "$%"]
    said = ["".join(rng.choice(latin) for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    said += [" ".join(rng.choice(["the", "漢字", "a's", "€5", "naïve", "x\ny", "“so”"]) for _ in range(rng.randint(1, 9))) for _ in range(500)]
    for text in [*said, " " * 1_000_000, "\n" * 300_000 + "a", "x" * 300_000, "a" + " " * 4000 + "b"]:
        assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_files_round_trip(spark, sf):
    library = Tokenizer.from_file(BYTES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    files = B.write_tokens(docs, BYTES)
    got = sorted(B.read_tokens(files).collect())
    before = 0
    for r, d in zip(got, docs.select("doc_id", "text").orderBy("doc_id").collect(), strict=True):
        ids = library.encode(d.text, add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.ids) == (d.doc_id, before, ids)
        before += len(ids)
    crc = {r.doc_id: r.ids_crc32 for r in B.op5_token_binary(spark, sf).collect()}
    assert all(crc[r.doc_id] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)


def test_files_of_odd_rows(spark):
    got = B.read_tokens(B.write_tokens(rows(spark), BYTES)).collect()
    assert len(got) == 6
    assert sorted(r.start for r in got)[0] == 0
    assert [r.ids for r in got if r.doc_id in (2, 3)] == [[0], [0]]
    assert B.read_tokens(B.write_tokens(rows(spark).limit(0), BYTES)).collect() == []
