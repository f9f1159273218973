"""The corpus pipeline: each stage's rows against brute force, and stages of odd and of empty tables."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodeseek.llm import quality
from lodeseek.llm._common import Scratch
from lodeseek.llm.secret_scan import MASK
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_text_ops import brute_leaks, brute_spans

STAGES = dict(corpus_pipeline.STAGES)
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Each stage's input and output over the whole smallest tables."""
    scratch, out = Scratch(spark, "stages"), {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        kept = scratch.keep(stage(spark, docs, sf), name)
        out[name] = docs.collect(), kept.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == columns
        docs = kept
    return out


def test_quality_keeps_what_the_model_keeps(spark, sf, stages):
    given, kept = stages["quality_classifier"]
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    tails = model.tails(model.score([quality.features(r.text or "", quality._tokens()) for r in given]))
    assert [r.doc_id for r, t in zip(given, tails) if t[-1] >= 0.5] == [r.doc_id for r in kept]


def test_near_dedup_keeps_one_of_each_component(stages):
    """The rule of the stage: word 5-shingles with a Jaccard similarity of 0.8 or more."""
    given, kept = stages["simhash_near_dedup"]
    data = [(r.doc_id, r.text) for r in given]
    assert sorted(r.doc_id for r in kept) == sorted(data[k][0] for k in brute_kept(data))


def test_decontamination_drops_leaks_only(spark, sf, stages):
    given, kept = stages["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaking = {d for d, _ in brute_leaks([(r.doc_id, r.text) for r in given], items)}
    assert {r.doc_id for r in kept} == {r.doc_id for r in given} - leaking


def test_secrets_are_masked_and_nothing_else_changes(stages):
    given, kept = stages["secret_scans"]
    after = {r.doc_id: r for r in kept}
    assert after.keys() == {r.doc_id for r in given}
    for r in given:
        spans, new = brute_spans(r.text), after[r.doc_id]
        assert brute_spans(new.text) == []
        assert new.n_chars == len(new.text)
        if not spans and MASK not in new.text:
            assert new == r
        for s, _, e in spans:
            assert r.text[s:e] not in new.text or r.text.count(r.text[s:e]) > len(spans)


def test_encoding_is_that_of_the_library(stages):
    given, kept = stages["bpe_encoding"]
    library = Tokenizer.from_file(WORDS)
    got = {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in kept}
    assert len(got) == len(given)
    for r in given:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), np.array(ids, "<u4").tobytes())


def test_run_is_all_stages(spark, sf, stages):
    got = sorted((r.doc_id, hashlib.sha256(r.ids).hexdigest()) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == sorted((r.doc_id, hashlib.sha256(r.ids).hexdigest()) for r in stages["bpe_encoding"][1])


DDL = "doc_id long, text string, lang string, source string, n_chars long, `base` string, row long"


def odd_rows(spark, sf):
    """Good texts and, beside them, nulls in every column, an empty and a very long text, repeated rows, shared and
    null ids, and columns whose names the stages use themselves."""
    good = [r.text for r in STAGES["quality_classifier"](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).where("length(text) > 400").limit(6).collect()]
    data = [(1, good[0], "en", "s", 5, "b", 1), (1, good[0], "en", "s", 5, "b", 1), (None, good[1], None, None, None, None, None), (None, good[1], "x", None, 1, "", 2)]
    data += [(7, good[2], "en", "s", 1, "b", 1), (7, good[3], "en", "s", 1, "b", 1), (3, None, None, None, None, None, None), (4, "", "", "", 0, "", 0)]
    data += [(5, " ".join([good[4] + " token = abcdefgh1"] * 500), "en", "s", 1, "b", 1), (6, good[5], None, "s", None, "b", None)]
    return spark.createDataFrame(data, DDL)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_of_odd_rows(spark, sf, name):
    docs = odd_rows(spark, sf)
    got = STAGES[name](spark, docs, sf)
    if name != "bpe_encoding":
        assert got.columns == docs.columns
    ids = sorted(r.doc_id or -1 for r in got.collect())
    everything = [-1, -1, 1, 1, 3, 4, 5, 6, 7, 7]
    want = {"simhash_near_dedup": [-1, 1, 3, 5, 6, 7, 7], "benchmark_decontamination": everything, "secret_scans": everything, "bpe_encoding": everything}
    if name in want:
        assert ids == want[name]
    else:  # a null text is judged as an empty one, and rows with one text alike
        assert (3 in ids) == (4 in ids)
        assert {ids.count(1), ids.count(-1)} <= {0, 2}


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_of_empty_tables(spark, sf, name):
    empty = spark.createDataFrame([], DDL)
    assert STAGES[name](spark, empty, sf).collect() == []
