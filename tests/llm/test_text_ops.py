"""Secret scans, decontamination, quality and chat formatting against brute force."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import chat, decontaminate, quality, secret_scan
from lodeseek.llm.template import TemplateError, compile_template, fold, parse
from tests.llm.test_tokens import rows

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def secret_texts():
    rng = random.Random(4)
    bits = ["password", "PassWD", "token", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "abc", "hunter22", "AKIA", "A1B2C3D4E5F6G7H8", "Z", "é", "😀", "0123456789abcdef", "f", "\n", "https://h.example/p", "=="]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)] + ["token = abcdefgh " * 700]


def test_base_spans(spark):
    data = list(enumerate(secret_texts()))
    for r in secret_scan.scan_secrets(spark.createDataFrame(data, "doc_id long, text string")).collect():
        assert [tuple(x) for x in r.base] == brute_spans(data[r.doc_id][1])


def test_weak_parts_need_each_other(spark):
    key, bare, url = "AKIA" + "A1B2" * 4, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "https://s3.example.com/bucket"
    far = " x" * 400
    data = [(1, f"{key} {bare} {url}"), (2, f"{bare} {url}"), (3, f"{key}{far} {bare}"), (4, f"password = hunter22 {url} {bare}"), (5, f"{bare} {url}{far}{far} {key}"), (6, f"{'x ' * 190}{bare} {key}")]
    got = {r.doc_id: [secret_scan.KINDS[x["k"]] for x in r.linked] for r in secret_scan.scan_secrets(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: ["secret", "endpoint"], 2: [], 3: [], 4: ["endpoint"], 5: [], 6: ["secret"]}


def test_links_are_those_of_all_pairs(spark):
    rng = random.Random(9)
    parts = ["AKIA" + "B7C8" * 4, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "https://e.example/x", "token=abcdefgh"]
    data = [(i, "".join(rng.choice([*parts, " y" * rng.randint(1, 250)]) + " " for _ in range(12))) for i in range(40)]
    for r in secret_scan.scan_secrets(spark.createDataFrame(data, "doc_id long, text string")).collect():
        text = data[r.doc_id][1]
        base = brute_spans(text)
        near = lambda a, b: a[0] - b[2] <= 400 and b[0] - a[2] <= 400
        bare = [(m.start(), 3, m.end()) for m in re.finditer(secret_scan.SECRET, text)]
        bare = [w for w in bare if any(near(w, b) for b in base if b[1] == 1)]
        urls = [(m.start(), 4, m.end()) for m in re.finditer(secret_scan.ENDPOINT, text)]
        urls = [w for w in urls if any(near(w, b) for b in [*[x for x in base if x[1] < 2], *bare])]
        assert [tuple(x) for x in r.linked] == sorted(bare + urls)


def test_masks(spark):
    data = [(1, "a token = abcdefgh b", 3), (2, None, None), (3, "clean", 5), (3, "clean", 5), (None, "x password: 'hunter22' y deadbeefdeadbeefdeadbeef", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, base long")
    masked = secret_scan.mask_secrets(docs, length_col="base")
    assert masked.columns == docs.columns
    got = {r.doc_id: (r.text, r.base) for r in masked.collect()}
    assert got == {1: ("a [SECRET] b", 12), 2: (None, None), 3: ("clean", 5), None: ("x [SECRET]' y [SECRET]", 22)}
    assert masked.count() == 5
    assert secret_scan.mask_secrets(docs.limit(0)).collect() == []


def test_masks_of_long_texts_and_overlaps(spark):
    """Many spans in a long text, beyond the basic plane, spans that overlap or touch, against a plain loop."""
    rng = random.Random(5)
    parts = ["token = abcdefgh ", "é😀 ", "AKIA" + "B7C8" * 4 + " ", "secret=" + "0123456789abcdef" * 2 + " ", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY ", "https://e.example/x ", "x" * 50 + " "]
    data = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for k in range(60)] + [(99, "😀 token = abcdefgh " * 12_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    spans = {r.doc_id: sorted(tuple(x) for x in [*r.base, *r.linked]) for r in secret_scan.scan_secrets(docs).collect()}
    began = time.perf_counter()
    got = {r.doc_id: r.text for r in secret_scan.mask_secrets(docs).collect()}
    assert time.perf_counter() - began < 60
    for d, text in data:
        out, at = [], 0
        for s, _, e in spans[d]:
            if s >= at:
                out += [text[at:s], secret_scan.MASK]
            at = max(at, e)
        assert got[d] == "".join(out) + text[at:]


def test_secret_scan_is_native(spark, sf):
    plan = secret_scan.op8_secret_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- decontamination


def test_search_is_exhaustive(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = decontaminate.Index.build(items)
    rng = random.Random(1)
    for _ in range(200):
        terms = set(rng.sample(sorted(index.postings), rng.randint(1, 60)))
        least = rng.choice([0.05, 0.1, 0.2, 0.3])
        scores = defaultdict(float)
        for t in terms:
            for i, x in zip(*index.postings[t][:2]):
                scores[i] += x
        assert {i for i, s in scores.items() if s >= least} == {i for i, _ in index.search(terms, least)}
        reached = {i for i, s in scores.items() if s >= 1}
        assert reached <= set(index.likely(terms).tolist())


def brute_leaks(docs, items, overlap=0.8):
    """Documents with enough of an item's shingles, or of those of its question, counted over the whole text."""

    def grams(words, n=5):
        return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}

    words_of = lambda text: decontaminate.WORDS.findall((text or "").lower())
    out = set()
    for d, text in docs:
        have = grams(words_of(text))
        for i, item in items:
            question = words_of(decontaminate.split_answer(item)[0])
            for want in (grams(words_of(item)), grams(question) if len(question) >= 8 else None):
                if want and len(want & have) >= overlap * len(want) - 1e-9:
                    out.add((d, i))
    return out


def test_leaks_are_those_of_brute_force(spark, sf):
    docs, benchmark = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    extra = [(10**6 + k, "Before that. " * k + text.upper() + " and after", None) for k, (_, text) in enumerate(items)]
    docs = docs.select("doc_id", "text", F.lit(1).alias("score")).unionByName(spark.createDataFrame(extra, "doc_id long, text string, score int"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert got == brute_leaks([(r.doc_id, r.text) for r in docs.collect()], items)
    assert len(got) >= len(items)
    kept = decontaminate.drop_leaks(docs, benchmark)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {d for d, _ in got}
    assert kept.columns == docs.columns


def test_split_items_and_lone_questions(spark, sf):
    """Items in two to four parts far apart, items with changed words, and questions without their answers."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rng = random.Random(3)
    filler = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(50).collect()]
    between = lambda: " ".join(" ".join(rng.choice(filler).split()[:150]) for _ in range(2))
    data = []
    for _, text in items:
        words = text.split()
        for parts in (2, 3, 4):
            cut = sorted(rng.sample(range(1, len(words)), parts - 1))
            data.append(f" {between()} ".join(" ".join(words[a:b]) for a, b in zip([0, *cut], [*cut, len(words)])))
        for share in (0.02, 0.04):
            data.append(" ".join(w if rng.random() > share else "changed" for w in words))
        data.append(f"{between()} {decontaminate.split_answer(text)[0]} {between()}")
        rare = sorted(words, key=len)[-max(1, len(words) // 25) :]
        data.append(" ".join("x" if w in rare else w for w in words))  # without its rarest words
    docs = [*enumerate(data)]
    want = brute_leaks(docs, items)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want
    assert len(want) >= 3 * len(items)


def test_decontamination_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six. seven eight nine"), (1, "one two three four five six. seven eight nine"), (2, None), (3, ""), (None, "red blue green black white grey pink")], "item_id long, text string")
    docs = rows(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(7, "x one two three four five six. seven eight nine y"), (8, "red blue green black white grey pink")], "doc_id long, text string"))
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect() if r.item_id)
    assert got == [(7, 1)]
    assert decontaminate.leaks(docs, items).count() == 2
    assert decontaminate.leaks(docs, items.limit(0)).collect() == decontaminate.leaks(docs.limit(0), items).collect() == []
    assert decontaminate.drop_leaks(docs, items.limit(0)).count() == 8
    assert sorted(r.doc_id or 0 for r in decontaminate.drop_leaks(docs.unionByName(docs.where("doc_id = 7")), items).collect()) == [0, 1, 1, 2, 3, 4]
    assert decontaminate.drop_leaks(docs.limit(0), items).collect() == []


# ---------------------------------------------------------------- quality


def test_fit_orders_grades():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 1500)
    made = [[10 + k for k in range(3) if rng.random() < (0.9 if k == g else 0.1)] + rng.integers(100, 4000, 20).tolist() for g in y]
    model = quality.fit(made[:1000], y[:1000].tolist())
    tails = model.tails(model.score(made[1000:]))
    assert (np.diff(model.thresholds) > 0).all()
    assert (tails[:, 0] >= tails[:, 1]).all()
    expected = tails.sum(axis=1)
    assert [expected[y[1000:] == g].mean() for g in range(3)] == sorted(expected[y[1000:] == g].mean() for g in range(3))


def plain_loss(params, made, y, cost, l2):
    """The penalised cumulative-link likelihood, term by term."""
    *w, t0, log_gap = params
    cuts = [-math.inf, t0, t0 + math.exp(log_gap), math.inf]
    below = lambda k, s: 0.0 if k == 0 else 1.0 if k == 3 else 1 / (1 + math.exp(-(cuts[k] - s)))
    total = 0.0
    for row, g, c in zip(made, y, cost):
        s = sum(w[f] for f in row)
        total -= c * math.log(max(below(g + 1, s) - below(g, s), 1e-300))
    return total / len(y) + l2 / 2 * sum(x * x for x in w)


def test_fit_is_that_of_another_optimiser():
    """Against gradient descent on numeric gradients of the likelihood written out term by term."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 240)
    made = [[k for k in range(3) if rng.random() < (0.7 if k == g else 0.25)] for g in y]
    model = quality.fit(made, y.tolist(), steps=3000, l2=0.01, rate=0.02, least_z=0.0)
    balance = np.sqrt(len(y) / (3 * np.bincount(y, minlength=3)))
    cost = balance[y] / balance[y].mean()
    loss = lambda p: plain_loss(p, made, y.tolist(), cost.tolist(), 0.01)
    at = np.zeros(5)
    for _ in range(400):
        slope = np.array([(loss(at + d) - loss(at - d)) / 2e-5 for d in 1e-5 * np.eye(5)])
        at -= 1.5 * slope
    fitted = np.array([*model.weights[:3], model.thresholds[0], np.log(np.diff(model.thresholds)[0])])
    assert abs(loss(fitted) - loss(at)) < 1e-5
    assert np.abs(fitted - at).max() < 0.02


def test_training_rows_are_one_an_id(spark, monkeypatch):
    """At most ``sample`` rows are fitted, one of each id, however often a table repeats it; the choice is defined."""
    data = [(1, f"word{k % 2} same", "x") for k in range(50)] + [(2, "bad words", "x"), (None, "no id", "x"), (3, None, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (3, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit_arrays", lambda flat, sizes, y: seen.append((flat.tolist(), sizes.tolist(), y.tolist())))
    quality.train(docs, labels)
    quality.train(docs.repartition(7), labels)
    assert seen[0] == seen[1]
    assert seen[0][2] == [2, 0, 1]
    quality.train(docs, labels, sample=1)
    assert len(seen[2][1]) == 1
    quality.train(docs.limit(0), labels)
    assert seen[3] == ([], [], [])


def test_selection_is_that_of_the_scores(spark, sf):
    """op9's rows and the stage's rows against the model applied text by text."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    want = {}
    for r in docs.collect():
        score = sum(model.weights[f].astype(np.float32).astype(float) for f in quality.features(r.text or "", quality._tokens()))
        tails = [1 / (1 + math.exp(min(max(t - score, -60), 60))) for t in model.thresholds]
        if tails[-1] >= 0.5:
            want[r.doc_id] = (sum(tails), *tails)
    got = {r.doc_id: (r.expected_grade, r.p_clean, r.p_good) for r in quality.op9_quality(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == want.keys()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 3 > 0"))
    held = quality.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    right = sum((r.p_good >= 0.5) == (r.quality > 0 and r.toxic == 0) for r in held)
    assert right >= 0.85 * len(held)


def test_quality_of_odd_rows(spark):
    model = quality.fit([[1], [2], [3]] * 20, [0, 1, 2] * 20)
    got = quality.score(rows(spark), model).collect()
    assert len(got) == 6
    assert all(0 <= r.p_good <= r.p_clean <= 1 for r in got)
    assert quality.score(rows(spark).limit(0), model).collect() == []
    assert quality.keep_good(rows(spark), model, least=0).columns == rows(spark).columns
    assert quality.keep_good(rows(spark), model, least=0).count() == 6
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(rows(spark), empty).weights.any() == np.False_


# ---------------------------------------------------------------- chat


def test_template_language():
    render = compile_template("{% set a = 1 + 2 %}{% if a == 3 and not none %}x{{ '<' ~ a ~ '>' }}{% elif true %}y{% else %}z{% endif %}{% for m in ms %}{{ loop.index }}{{ m.t | trim | upper }}{% if not loop.last %},{% endif %}{% endfor %}")
    assert render(ms=[{"t": " a "}, {"t": "b"}, {}])[0] == "x<3>1A,2B,3"
    assert fold(parse("a{{ 1 + 2 }}{% if false %}no{% else %}b{% endif %}{{ 'C' | lower }}"), {"lower": str.lower}) == ("block", [("text", "a3bc")])
    text, marks = compile_template("q{% generation %}é😀{% endgeneration %}r{% generation %}{% endgeneration %}")()
    assert (text, marks) == ("qé😀r", [(1, 3), (4, 4)])


@pytest.mark.parametrize("bad", ["{% if a %}", "{% what %}", "{{ a b }}", "{{ }}", "{% for in x %}{% endfor %}", "{{ a | nope }}", "{{ f() }}", "{{ " + "(" * 100 + "1" + ")" * 100 + " }}"])
def test_template_errors(bad):
    with pytest.raises(TemplateError):
        compile_template(bad)


def test_templates_reach_nothing_but_their_variables():
    assert compile_template("{{ a.__class__ }}{{ a['__init__'] }}{{ b.x }}")(a="s", b=object())[0] == ""
    with pytest.raises(TemplateError):
        compile_template("{% for x in xs %}{{ x }}{% endfor %}", most=10)(xs=["aaaaaa"] * 3)


def test_escape_round_trip():
    rng = random.Random(1)
    render = compile_template(chat.TEMPLATE, chat.escape)
    bits = ["\\", "<", "s>", "</s>", "<s>", "[INST]", "[/", "INST]", "[TURN]", "[TEXT]", "x", "\n"]
    for _ in range(1500):
        said = [{"role": rng.choice(["user", "assistant", "[TURN]", "a\\"]), "text": "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))} for _ in range(rng.randint(0, 4))]
        text, marks = render(messages=said)
        assert chat.read_back(text) == [(m["role"], m["text"]) for m in said]
        assert [chat.unescape(text[a:b]) for a, b in marks] == [m["text"] for m in said if m["role"] == "assistant"]


def test_conversations(spark, sf):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("turn").collect():
        turns[r.conv_id].append((r.role, r.text))
    turns[-7] = [(p[2], p[3]) for p in chat.PROBE]
    got = {r.conv_id: r for r in chat.op10_chat_format(spark, sf).collect()}
    assert got.keys() == turns.keys()
    for k, said in turns.items():
        loss = "".join(t for role, t in said if role == "assistant")
        want = (len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[k])[1:5] == want


def test_odd_conversations(spark):
    data = [(1, 1, "assistant", None, "f"), (1, 0, "user", "a", "f"), (1, 0, "user", "a", "f"), (None, None, None, "n", "f"), (2, 0, "assistant", "x" * 300_000, "f")]
    turns = spark.createDataFrame(data, "conv_id long, turn int, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(turns)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (3, 0), None: (1, 0), 2: (1, 300_000)}
    assert chat.format_chats(turns.limit(0)).collect() == []
