"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and the beginnings of words (three to six letters). From a bounded sample of labelled
rows the terms that go with the label are chosen by their G-squared; all other words of a text are one more
term, so that few toxic terms in a long text weigh less. Document frequencies are counted over
the whole corpus.

The examples stand in an inverted index cut into blocks. Each term has its largest weight per
block, which bounds the cosine of every example of a block; blocks are searched in the order
of their bounds until no bound is above the worst of the neighbours found, so the neighbours
are exact. Their votes are weighted by the squared cosine and calibrated with a logistic curve fitted to
the votes that examples get from the others. Labels, language, source and id are no inputs.

The cosine is exact over these terms, the rest being one of them: with every word of a text as a
term of its own, neighbours are texts that share rare words of any kind, and the label is lost.
The sample's bound (``train_rows``) bounds the terms and the index, which is what tasks receive.
"""

from __future__ import annotations

import re
from collections import Counter
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import over_batches
from palisade.session import settle

TRAIN_ROWS = 8192
MIN_G = 30.0
NEIGHBOURS = 15
BLOCK = 64
FOLDS = 5
BINS = 200

class Recent(dict):
    """What ``make`` gives for a key, kept for the keys met lately: a bounded number of them."""

    def __init__(self, make, bound: int) -> None:
        super().__init__()
        self.make, self.bound, self.older = make, bound // 2, {}

    def __missing__(self, key: str):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.bound:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


_LETTERS = re.compile(r"[^\W\d_]+")
_PREFIXES = (3, 4, 5, 6)


def word_terms(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in _PREFIXES if len(word) > k)]


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


class Terms:
    """Counts of the chosen terms in a text."""

    def __init__(self, chosen: list[str]) -> None:
        place = {t: k for k, t in enumerate(chosen)}
        self.of_word = Recent(lambda w: tuple(place[t] for t in word_terms(w) if t in place), 200_000)

    def counts(self, text: str) -> tuple[dict[int, int], int]:
        """Chosen terms with their counts, and the number of words without any."""
        found: Counter = Counter()
        rest = 0
        for ids in map(self.of_word.__getitem__, words_of(text)):
            if ids:
                found.update(ids)
            else:
                rest += 1
        return dict(sorted(found.items())), rest


class Index:
    """Examples as a block-max inverted index. Its last term is the rest of a text."""

    def __init__(self, idf: np.ndarray, examples: list[tuple[int, int, list[int], list[int], int]]) -> None:
        """``examples``: id, label, terms, counts, rest."""
        self.idf = idf
        vectors = [self.vector(t, c, r) for _, _, t, c, r in examples]
        # Examples with the same strongest term stand together, which keeps block bounds tight.
        order = sorted(range(len(examples)), key=lambda k: (
            int(vectors[k][0][np.argmax(vectors[k][1])]), round(float(vectors[k][1].max()), 2), examples[k][0]))
        self.ids = np.array([examples[k][0] for k in order], np.int64)
        self.labels = np.array([examples[k][1] for k in order], np.float64)
        self.place = {int(examples[k][0]): at for at, k in enumerate(order)}
        terms, self.blocks = len(idf) + 1, -(-len(order) // BLOCK)
        lists: list[list[tuple[int, float]]] = [[] for _ in range(terms)]
        for at, k in enumerate(order):
            for t, w in zip(*vectors[k]):
                lists[t].append((at, w))
        self.at = [np.array([a for a, _ in x], np.int64) for x in lists]
        self.weight = [np.array([w for _, w in x]) for x in lists]
        self.cuts = np.array([np.searchsorted(a, np.arange(self.blocks + 1) * BLOCK) for a in self.at]).reshape(terms, -1)
        self.most = np.zeros((terms, self.blocks))
        for t in range(terms):
            np.maximum.at(self.most[t], self.at[t] // BLOCK, self.weight[t])

    def vector(self, terms: list[int], counts: list[int], rest: int) -> tuple[np.ndarray, np.ndarray]:
        weights = np.append(np.array(counts, np.float64) * self.idf[terms], 1 + log(1 + rest))
        return np.append(np.array(terms, np.int64), len(self.idf)), weights / np.sqrt(weights @ weights)

    def nearest(self, terms: list[int], counts: list[int], rest: int, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` nearest examples, nearest first, except ``without``.

        Equal cosines go by the order of the index, within the blocks that had to be searched.
        """
        query, weights = self.vector(terms, counts, rest)
        bounds = weights @ self.most[query]
        places, cosines, worst = np.zeros(0, np.int64), np.zeros(0), -1.0
        for b in np.argsort(-bounds, kind="stable").tolist():
            # Bounds are raised by more than their rounding, so that no neighbour is missed.
            if len(places) == k and bounds[b] * (1 + 1e-12) < worst:
                break
            size = min(BLOCK, len(self.ids) - b * BLOCK)
            scores = np.zeros(size)
            for t, w in zip(query.tolist(), weights.tolist()):
                lo, hi = self.cuts[t, b], self.cuts[t, b + 1]
                if lo < hi:
                    scores[self.at[t][lo:hi] - b * BLOCK] += w * self.weight[t][lo:hi]
            own = np.arange(b * BLOCK, b * BLOCK + size)
            if without >= 0:
                scores, own = scores[own != without], own[own != without]
            places, cosines = np.append(places, own), np.append(cosines, scores)
            best = np.lexsort((places, -cosines))[:k]
            places, cosines = places[best], cosines[best]
            worst = cosines[-1] if len(cosines) else -1.0
        return places, cosines

    def vote(self, found: tuple[np.ndarray, np.ndarray]) -> float:
        weights = found[1] ** 2
        whole = weights.sum()
        return float(weights @ self.labels[found[0]] / whole) if whole > 0 else 0.0


def fit_curve(votes: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through counts per vote, with smoothed targets."""
    p, n = positive.sum(), negative.sum()
    high, low = (p + 1) / (p + 2), 1 / (n + 2)
    weight = positive + negative
    aim = (positive * high + negative * low) / np.maximum(weight, 1e-12)
    theta = np.array([4.0, -2.0])
    x = np.stack([votes, np.ones_like(votes)], axis=1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (q - aim)) + 1e-3 * theta
        bend = (x.T * (weight * q * (1 - q))) @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        theta = theta - np.clip(step, -2, 2)
    return float(theta[0]), float(theta[1])


def _sample(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """``doc_id, text, toxic`` of the labelled rows to learn from: the first by a hash of the id."""
    train = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (_fold(F.col("doc_id")) != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )
    # The sample is bounded, so it is sent to the texts. A repeated document is one example.
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(settle(train, "labelled-sample")), "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    )


def _fold(doc_id):
    return F.crc32(doc_id.cast("string")) % FOLDS


def _chosen(sample: DataFrame) -> list[str]:
    """The terms that go with the toxic label, strongest first."""
    def task(batch: pa.RecordBatch) -> dict:
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            (toxic if label else clean).update({t for w in set(words_of(text)) for t in word_terms(w)})
        terms = list(toxic.keys() | clean.keys())
        return {"term": terms, "a": [toxic[t] for t in terms], "b": [clean[t] for t in terms]}

    counted = over_batches(sample, "term string, a long, b long", task).groupBy("term").agg(
        F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    sizes = sample.agg(F.sum("toxic"), F.count("*")).first()
    toxic, every = float(sizes[0] or 0), float(sizes[1])
    if not 0 < toxic < every:
        return []
    n = F.col("a") + F.col("b")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    share = toxic / every
    g = 2 * (part(F.col("a"), n * share) + part(F.col("b"), n * (1 - share))
             + part(toxic - F.col("a"), toxic - n * share)
             + part(every - toxic - F.col("b"), every - toxic - n * (1 - share)))
    best = (
        counted.where(F.col("a") > n * share).withColumn("g", g).where(F.col("g") > MIN_G)
        .orderBy(F.desc("g"), "term")
    )
    return [r["term"] for r in best.collect()]


_COUNTED = "doc_id long, terms array<int>, counts array<int>, rest long"


def _counted(docs: DataFrame, chosen: list[str]) -> DataFrame:
    def task(batch: pa.RecordBatch) -> dict:
        terms = _terms(chosen)
        made = [terms.counts(t or "") for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "terms": [list(c) for c, _ in made],
                "counts": [list(c.values()) for c, _ in made], "rest": [r for _, r in made]}

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), _COUNTED, task)


_kept: dict = {}


def _terms(chosen: list[str]) -> Terms:
    """One per worker process, so that words met in earlier tasks are known."""
    key = tuple(chosen)
    if _kept.get("key") != key:
        _kept.update(key=key, terms=Terms(chosen))
    return _kept["terms"]


def toxicity(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS,
    neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence``: one row per row of ``docs``.

    ``evidence`` lists the ids of the nearest examples that voted for toxic. A null or empty text has only
    the rest term and gets the score of texts without any toxic term. Labels that are null
    or belong to no document are passed over; of conflicting ones the toxic one counts. Without examples
    of both labels every score is 0. A null id is not held out. Repeated rows get a row each. An
    empty table gives no rows; other columns are ignored.
    """
    sample = settle(_sample(docs, labels, train_rows), "labelled-texts")
    chosen = _chosen(sample)
    held_out = F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    if not chosen:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, F.lit(0.0).alias("score"),
                           F.lit(0).alias("predicted"), F.array().cast("array<long>").alias("evidence"))
    counted = settle(_counted(docs, chosen), "term-counts")
    frequency = np.zeros(len(chosen))
    for row in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        frequency[row["t"]] = row["count"]
    idf = np.log((1 + counted.count()) / (1 + frequency)) + 1
    examples = _counted(sample, chosen).join(sample.select("doc_id", "toxic"), "doc_id")
    index = Index(idf, [tuple(r) for r in examples.select("doc_id", "toxic", "terms", "counts", "rest").collect()])
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def votes(batch: pa.RecordBatch) -> dict:
        index = shared.value
        made = Counter()
        for i, t, c, r in zip(*(x.to_pylist() for x in batch.columns)):
            at = index.place[i]
            vote = index.vote(index.nearest(t, c, r, neighbours, without=at))
            made[int(round(vote * BINS)), int(index.labels[at])] += 1
        return {"bin": [b for b, _ in made], "label": [y for _, y in made], "k": list(made.values())}

    tally = over_batches(examples.select("doc_id", "terms", "counts", "rest"), "bin int, label int, k long", votes)
    bins = np.zeros((BINS + 1, 2))
    for row in tally.groupBy("bin", "label").agg(F.sum("k").alias("k")).collect():
        bins[row["bin"], row["label"]] += row["k"]
    slope, offset = fit_curve(np.arange(BINS + 1) / BINS, bins[:, 1], bins[:, 0])

    def scores(batch: pa.RecordBatch) -> dict:
        index, scored, plain = shared.value, [], None
        for t, c, r in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            # Texts with the rest term alone all have the same direction.
            found = plain if not t else None
            if found is None:
                near = index.nearest(t, c, r, neighbours)
                score = 1 / (1 + exp(-(slope * index.vote(near) + offset)))
                found = score, index.ids[near[0][index.labels[near[0]] > 0]].tolist()
                if not t:
                    plain = found
            scored.append(found)
        return {"doc_id": batch.column(0), "score": [s for s, _ in scored], "evidence": [e for _, e in scored]}

    return over_batches(counted, "doc_id long, score double, evidence array<long>", scores).select(
        "doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
