import math
import random
import zlib

import numpy as np
import pytest

from palisade.llm import attention
from tests.llm.helpers import ODD, WORD, documents, rows_of


def plain(text):
    """The measures of each passage, with loops over words."""
    found = list(WORD.finditer(text))
    words = [m[0] for m in found]
    seen, rows = set(), []
    repeated = []
    for k in range(len(words)):
        three = tuple(words[k - 2:k + 1]) if k >= 2 else None
        repeated.append(three in seen if three else False)
        seen.add(three)
    for low in range(0, len(words), 64):
        own = words[low:low + 64]
        chars = "".join(own)
        share = lambda test: sum(map(test, chars)) / len(chars)
        ascii_ = lambda c: ord(c) < 127
        of = lambda test: sum(map(test, own)) / len(own)
        begin = found[low].start()
        end = found[low + 64].start() if low + 64 < len(words) else len(text)
        named = lambda c: ascii_(c) and (c.isalnum() or c in attention.SYMBOLS)
        rows.append([
            min(len(own) / 64, 1), math.log1p(len(chars) / len(own)),
            share(lambda c: ascii_(c) and c.islower()), share(lambda c: ascii_(c) and c.isupper()), share(lambda c: ascii_(c) and c.isdigit()),
            share(lambda c: ord(c) > 127), share(lambda c: ord(c) <= 127 and not named(c)),
            of(lambda w: ascii_(w[0]) and w[0].isupper()), len(set(own)) / len(own), sum(repeated[low:low + 64]) / len(own),
            of(lambda w: len(w) <= 3), of(lambda w: len(w) > 15), min(text[begin:end].count("\n") / len(own), 2),
            *[math.sqrt(chars.count(s) / len(chars)) for s in attention.SYMBOLS],
        ])
    return rows or [[0.0] * attention.FEATURES]


def strings(count):
    rng = random.Random(7)
    odd = ["the", "Word", "LOUD!!", "a.b", "é", "日本語", "12", "\x00", "\x7f", "#*", "x" * 20, "\U0001f600"]
    for _ in range(count):
        yield "".join(rng.choice(odd) + rng.choice([" ", "\n", "  ", "\t", " \n "]) for _ in range(rng.choice([0, 1, 3, 63, 64, 65, 200])))


def test_measures_equal_plain_loops():
    texts = ["", " ", *strings(60), "", "\n\nlead", "end\n", "one"]
    made = attention.passages(texts)
    want = [(k, row) for k, t in enumerate(texts) for row in plain(t)]
    assert made.text.tolist() == [k for k, _ in want]
    assert np.allclose(made.features, np.array([r for _, r in want]), atol=1e-6)
    assert len(attention.passages(["", " \n"]).text) == 2


def small_model(rng):
    return attention.learn(np.arange(6) // 2, rng.normal(size=(6, attention.FEATURES)), np.array([0.0, 1.0, 1.0]), epochs=1)


def test_forward_equals_one_text_at_a_time():
    rng = np.random.default_rng(1)
    model = small_model(rng)
    bags = np.array([0, 0, 0, 2, 5, 5])
    x = rng.normal(size=(6, attention.FEATURES))
    found = attention.Forward(model, bags, x)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for at, bag in enumerate((0, 2, 5)):
        h = np.tanh((x[bags == bag] - model.centre) / model.spread @ model.encode + model.encode_bias)
        a = np.exp((np.tanh(h @ model.gate_v) * sigmoid(h @ model.gate_u)) @ model.attend)
        a = a / a.sum()
        assert np.allclose(found.weight[bags == bag], a)
        assert np.isclose(found.score[at], sigmoid((a @ h) @ model.score + model.score_bias[0]))


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    model = small_model(rng)
    bags, x, y = np.array([0, 0, 1, 2, 2, 2]), rng.normal(size=(6, attention.FEATURES)), np.array([1.0, 0.0, 1.0])
    def loss(m):
        p = attention.Forward(m, bags, x).score
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    for name, g in attention.Forward(model, bags, x).gradients(model, y).items():
        value = getattr(model, name)
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(5)]:
            step = np.zeros_like(value)
            step[at] = 1e-6
            slope = (loss(model._replace(**{name: value + step})) - loss(model._replace(**{name: value - step}))) / 2e-6
            assert np.isclose(slope, g[at], atol=1e-7)


def test_attention_finds_the_passage_that_decides():
    rng = np.random.default_rng(3)
    bags = np.repeat(np.arange(200), 6)
    x = rng.normal(0, 0.1, (1200, attention.FEATURES)) + 1
    y = (np.arange(200) % 2).astype(float)
    at = rng.integers(0, 6, 200)
    low = np.flatnonzero(y == 0)
    x[low * 6 + at[low], :5] += 3  # one bad passage of six
    model = attention.learn(bags, x, y)
    found = attention.Forward(model, bags, x)
    assert ((found.score >= 0.5) == y).mean() > 0.97
    top = found.weight.reshape(200, 6).argmax(axis=1)
    assert (top[low] == at[low]).mean() > 0.9


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3


def test_whole_query_against_one_text_at_a_time(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in texts and fold(r.doc_id) != 1}
    ids = sorted(known)
    each = [attention.passages([texts[i]]).features for i in ids]
    model = attention.learn(np.repeat(np.arange(len(ids)), [len(e) for e in each]), np.concatenate(each), np.array([known[i] for i in ids], float))
    got = {r.doc_id: r for r in attention.quality_scores(docs, labels).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        made = attention.passages([text])
        want = attention.Forward(model, made.text, made.features.astype(float))
        assert abs(got[i].score - want.score[0]) < 1e-9 and got[i].held_out == (fold(i) == 1)
        assert got[i].predicted == int(got[i].score >= 0.5) and got[i].n_passages == len(made.text)


def test_held_out_accuracy(spark, medium):
    docs, labels = (spark.read.parquet(f"{medium}/{t}.parquet") for t in ("documents", "labels"))
    marks = {r.doc_id: r.quality for r in labels.collect()}
    held = [(marks[r.doc_id], r.predicted) for r in attention.quality_scores(docs, labels).collect() if r.held_out and r.doc_id in marks]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) >= 0.97


def test_odd_rows(spark):
    docs = documents(spark, ODD + [(100 + k, t) for k, t in enumerate(strings(40))], "score quality held_out row")
    labels = spark.createDataFrame(
        [(100 + k, k % 2) for k in range(40)] + [(100, 1), (None, 1), (101, None), (10 ** 6, 0)], "doc_id long, quality int")
    got = attention.quality_scores(docs, labels)
    rows = rows_of(got, "doc_id", "score", "predicted")
    assert len(rows) == len(ODD) + 40 and all(0 <= s <= 1 and p == int(s >= 0.5) for _, s, p in rows)
    assert attention.quality_scores(docs.where("false"), labels).count() == 0
    lone = rows_of(attention.quality_scores(docs, labels.where("quality = 1")), "score")
    assert {s for s, in lone} == {1.0}
    assert {s for s, in rows_of(attention.quality_scores(docs, labels.where("false")), "score")} == {0.5}


@pytest.mark.parametrize("name", ["lang", "source"])
def test_only_the_text_is_an_input(spark, small, name):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    changed = docs.withColumn(name, docs[name].substr(1, 0))
    a, b = (rows_of(attention.quality_scores(d, labels), "doc_id", "score") for d in (docs, changed))
    assert a == b
