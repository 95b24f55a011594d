import math
import random
import zlib

import numpy as np

from palisade.llm import toxicity
from tests.llm.helpers import ODD, documents

LABELS = "doc_id long, quality int, toxic int, text string"


def labelled(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id", "left").collect()


def test_held_out_accuracy(spark, medium):
    rows = [r for r in labelled(spark, medium) if r.toxic is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) >= 0.95


def test_nearest_examples_are_exact():
    rng = random.Random(13)
    idf = np.array([1 + rng.random() * 4 for _ in range(40)])
    draw = lambda: (sorted(rng.sample(range(40), rng.randint(0, 6))), rng.randint(0, 300))
    examples = []
    for k in range(700):
        terms, rest = draw()
        examples.append((k, rng.randint(0, 1), terms, [rng.randint(1, 4) for _ in terms], rest))
    index = toxicity.Index(idf, examples)
    dense = np.zeros((700, 41))
    for row, t, c, r in ((index.place[i], t, c, r) for i, _, t, c, r in examples):
        at, weights = index.vector(t, c, r)
        dense[row, at] = weights
    for _ in range(200):
        terms, rest = draw()
        counts = [rng.randint(1, 4) for _ in terms]
        query = np.zeros(41)
        at, weights = index.vector(terms, counts, rest)
        query[at] = weights
        places, cosines = index.nearest(terms, counts, rest, 15)
        want = np.sort(dense @ query)[::-1][:15]
        assert np.allclose(cosines, want, atol=1e-8)
        assert np.allclose(dense[places] @ query, cosines)
        places, _ = index.nearest(terms, counts, rest, 15, without=int(places[0]))
        assert len(set(places.tolist())) == 15


def test_whole_query_against_dense_vectors(spark):
    """Terms, weights, neighbours, votes, curve and scores, each the plain way."""
    rng = random.Random(15)
    def text(toxic):
        words = [rng.choice(["nice", "day", "sunny", "walk", "rain", "clouds"]) for _ in range(rng.randint(3, 60))]
        return " ".join(words + [rng.choice(["vileword", "vilest", "scum"]) for _ in range(rng.randint(1, 4) if toxic else rng.random() < 0.03)])
    rows = [(k, text(k % 5 == 0)) for k in range(300)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0), "x") for k in range(250)], LABELS)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and r.doc_id in texts}
    train = {i: y for i, y in marks.items() if zlib.crc32(str(i).encode()) % 5}
    words = {i: toxicity._LETTERS.findall(t.lower()) for i, t in texts.items()}
    terms_of = lambda w: {"=" + w, *("^" + w[:k] for k in (3, 4, 5, 6) if len(w) > k)}
    seen = {i: set().union(*map(terms_of, words[i]), set()) for i in train}
    toxic, every = sum(train.values()), len(train)
    chosen = []
    for term in set().union(*seen.values()):
        a = sum(train[i] for i in train if term in seen[i])
        n = sum(term in seen[i] for i in train)
        cells = [(a, n * toxic / every), (n - a, n * (1 - toxic / every)), (toxic - a, toxic - n * toxic / every),
                 (every - toxic - n + a, every - toxic - n * (1 - toxic / every))]
        g = 2 * sum(o * math.log(o / e) for o, e in cells if o > 0)
        if a > n * toxic / every and g > toxicity.MIN_G:
            chosen.append(term)
    chosen.sort()
    counts = {i: [sum(t in terms_of(w) for w in ws) for t in chosen] for i, ws in words.items()}
    rest = {i: sum(not terms_of(w) & set(chosen) for w in ws) for i, ws in words.items()}
    idf = [math.log((1 + len(texts)) / (1 + sum(c[k] > 0 for c in counts.values()))) + 1 for k in range(len(chosen))]
    def vector(i):
        v = np.array([c * w for c, w in zip(counts[i], idf)] + [1 + math.log(1 + rest[i])])
        return v / np.sqrt(v @ v)
    vectors = {i: vector(i) for i in texts}
    def votes(i, among):
        """The vote, or None where the last neighbour is one of several with its cosine."""
        near = sorted(((round(float(vectors[i] @ vectors[j]), 9), train[j]) for j in among), reverse=True)
        k = toxicity.NEIGHBOURS
        if len(near) > k and near[k - 1][0] == near[k][0]:
            return None
        near = near[:k]
        return sum(c * c * y for c, y in near) / sum(c * c for c, _ in near)
    assert 0 < len(chosen)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert set(got) == set(texts)
    # The curve is one for all: scores are ordered as votes, equal votes score alike, and two votes fix it.
    told = {i: votes(i, train) for i in texts}
    known = sorted((v, got[i]) for i, v in told.items() if v is not None)
    assert len(known) > 20
    logit = lambda p: math.log(p / (1 - p))
    (v0, p0), (v1, p1) = known[0], known[-1]
    slope = (logit(p1) - logit(p0)) / (v1 - v0)
    assert slope > 0 and all(abs(logit(p) - logit(p0) - slope * (v - v0)) < 1e-6 for v, p in known)


def test_scores_depend_on_the_text_alone(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    twice = docs.union(docs.selectExpr("doc_id + 1000000", "text", "'xx'", "'other'", "n_chars"))
    scores = {}
    for r in toxicity.toxicity(twice, labels).collect():
        scores.setdefault(r.doc_id % 1000000, set()).add(r.score)
    assert all(len(s) == 1 for s in scores.values())


def test_odd_rows(spark):
    docs = documents(spark, ODD, "toxic score terms")
    labels = spark.createDataFrame([(1, 1, None, "x"), (None, 1, 1, "x"), (77, 1, 1, "x")], LABELS)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(ODD) and all(r.score == 0 and r.predicted == 0 for r in got)
    rng = random.Random(14)
    rows = [(k, " ".join(rng.choice(["nice", "day", "sun"]) for _ in range(9)) + (" vileword" if k % 4 == 0 else "")) for k in range(100, 400)]
    docs = documents(spark, ODD + rows)
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0), "x") for k, _ in rows], LABELS)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[k].predicted == int(k % 4 == 0) for k, _ in rows)
    assert got[1].predicted == got[2].predicted == 0 and got[400 - 100].evidence
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0
