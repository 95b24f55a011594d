"""Quality classifier: attention-based multiple-instance learning over the passages of a text.

A text is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded: the shape of its
characters and words is measured, standardised, and put through a learned hidden layer h. Gated
attention gives it the weight a = softmax(w . (tanh(V h) * sigmoid(U h))) within its text, and the
text's score is a logistic function of the weighted passage representation, the sum of a h.
All parameters are learned together, from the labels of whole documents.

The learning sample is bounded (``train_rows`` documents, ``train_passages`` passages of each,
evenly spread); its passages are what the driver receives, and the parameters, some thousand
numbers, are what tasks receive. Scoring encodes every passage of every text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import over_batches
from palisade.session import settle

PASSAGE_WORDS = 64
TRAIN_ROWS = 4096
TRAIN_PASSAGES = 64
FOLDS, HELD_OUT = 3, 1
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 60, 128, 0.01, 1e-4
SEED = 5

SYMBOLS = "#*$%&|<>!?.,;:()[]{}\"'-_/\\=+@~^`"
_LETTER, _UPPER, _DIGIT, _SPACE, _BREAK, _SYMBOL, _OTHER, _WIDE = range(8)


def _kinds() -> np.ndarray:
    """The kind of each of the first 128 code points."""
    made = np.full(128, _OTHER, np.uint8)
    for c in range(128):
        s = chr(c)
        if s.islower():
            made[c] = _LETTER
        elif s.isupper():
            made[c] = _UPPER
        elif s.isdigit():
            made[c] = _DIGIT
        elif s == "\n":
            made[c] = _BREAK
        elif s in " \t\v\f\r":
            made[c] = _SPACE
        elif s in SYMBOLS:
            made[c] = _SYMBOL
    return made


_KIND = _kinds()
_MARK = np.array([SYMBOLS.find(chr(c)) for c in range(128)], np.int64)
FEATURES = 13 + len(SYMBOLS)


class Passages(NamedTuple):
    text: np.ndarray      # which text of the batch each passage belongs to, ascending
    features: np.ndarray  # one row per passage


def passages(texts: list[str], words: int = PASSAGE_WORDS) -> Passages:
    """The passages of all texts, measured side by side. A text without words is one passage without measures.

    Shares are of the passage's characters inside words, or of its words.
    """
    coded = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    ends = np.cumsum([len(c) // 4 for c in coded])
    points = np.frombuffer(b"".join(coded), "<u4")
    low = np.minimum(points, 127)
    kind = _KIND[low]
    kind[points > 127] = _WIDE
    inside = (kind != _SPACE) & (kind != _BREAK)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    edges = edges[edges < len(points)]
    first[edges] = inside[edges]  # a word ends with its text
    at = np.flatnonzero(first)
    if not len(at):
        return Passages(np.arange(len(texts)), np.zeros((len(texts), FEATURES), np.float32))
    owner = np.searchsorted(ends, at, side="right")
    of_text = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(of_text) - of_text
    place = np.arange(len(at)) - begin[owner]
    # A passage is a run of words of one text.
    new = (place % words) == 0
    passage = np.cumsum(new) - 1
    count = int(passage[-1]) + 1
    n_words = np.bincount(passage, minlength=count).astype(np.float64)
    word = np.cumsum(first) - 1
    held = np.flatnonzero(inside)
    of_char = passage[word[held]]
    tally = lambda chosen: np.bincount(of_char[chosen], minlength=count)
    kinds = kind[held]
    chars = np.maximum(tally(slice(None)), 1)
    marks = np.bincount(of_char[kinds == _SYMBOL] * len(SYMBOLS) + _MARK[points[held][kinds == _SYMBOL]],
                        minlength=count * len(SYMBOLS)).reshape(count, -1)
    length = np.bincount(word[held], minlength=len(at))
    # Words and three words in a row, by a hash of their code points and places in the word.
    offset = (held - at[word[held]]).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (points[held].astype(np.uint64) + np.uint64(0x9E3779B9)) * (offset * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashed = np.add.reduceat(mixed, np.searchsorted(held, at))
        three = hashed.copy()
        three[1:] += hashed[:-1] * np.uint64(0x2545F4914F6CDD1D)
        three[2:] += hashed[:-2] * np.uint64(0x5851F42D4C957F2D)
        whole = np.flatnonzero(place >= 2)
        three = three[whole] + owner[whole].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        per_passage = hashed + passage.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    seen_before = place >= 2
    seen_before[whole[np.unique(three, return_index=True)[1]]] = False
    distinct = np.zeros(len(at), bool)
    distinct[np.unique(per_passage, return_index=True)[1]] = True
    of_words = lambda chosen: np.bincount(passage[chosen], minlength=count) / n_words
    starts = kind[at]
    breaks = np.flatnonzero(kind == _BREAK)
    breaks = breaks[word[breaks] >= 0]
    breaks = breaks[np.searchsorted(ends, breaks, side="right") == owner[word[breaks]]]  # not those before a text's first word
    features = np.column_stack([
        np.minimum(n_words / words, 1), np.log1p(chars / n_words),
        tally(kinds == _LETTER) / chars, tally(kinds == _UPPER) / chars, tally(kinds == _DIGIT) / chars,
        tally(kinds == _WIDE) / chars, tally(kinds == _OTHER) / chars,
        of_words(starts == _UPPER), of_words(distinct), of_words(seen_before), of_words(length <= 3), of_words(length > 15),
        np.minimum(np.bincount(passage[word[breaks]], minlength=count) / n_words, 2),
        np.sqrt(marks / chars[:, None]),
    ]).astype(np.float32)
    owners = owner[new]
    empty = np.flatnonzero(of_text == 0)
    if len(empty):
        owners = np.concatenate([owners, empty])
        features = np.concatenate([features, np.zeros((len(empty), FEATURES), np.float32)])
        order = np.argsort(owners, kind="stable")
        owners, features = owners[order], features[order]
    return Passages(owners, features)


class Model(NamedTuple):
    """Parameters; ``centre`` and ``spread`` standardise the measures."""

    centre: np.ndarray
    spread: np.ndarray
    encode: np.ndarray
    encode_bias: np.ndarray
    gate_v: np.ndarray
    gate_u: np.ndarray
    attend: np.ndarray
    score: np.ndarray
    score_bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _bag_starts(bags: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, bags[1:] != bags[:-1]])


class Forward:
    """One pass over bags of passages: ``bags`` ascending, every bag has a passage."""

    def __init__(self, model: Model, bags: np.ndarray, features: np.ndarray) -> None:
        self.starts = _bag_starts(bags)
        self.sizes = np.diff(np.r_[self.starts, len(bags)])
        self.bag = np.repeat(np.arange(len(self.starts)), self.sizes)
        self.x = (features - model.centre) / model.spread
        self.h = np.tanh(self.x @ model.encode + model.encode_bias)
        self.v, self.u = np.tanh(self.h @ model.gate_v), _sigmoid(self.h @ model.gate_u)
        raw = (self.v * self.u) @ model.attend
        shifted = np.exp(raw - np.maximum.reduceat(raw, self.starts)[self.bag])
        self.weight = shifted / np.add.reduceat(shifted, self.starts)[self.bag]
        self.z = np.add.reduceat(self.weight[:, None] * self.h, self.starts, axis=0)
        self.score = _sigmoid(self.z @ model.score + model.score_bias[0])

    def gradients(self, model: Model, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, by parameter."""
        error = (self.score - labels) / len(labels)
        to_z = error[:, None] * model.score
        to_h = self.weight[:, None] * to_z[self.bag]
        to_weight = np.einsum("nh,nh->n", self.h, to_z[self.bag])
        mean = np.add.reduceat(self.weight * to_weight, self.starts)[self.bag]
        to_raw = self.weight * (to_weight - mean)
        gated = to_raw[:, None] * model.attend
        to_v, to_u = gated * self.u * (1 - self.v ** 2), gated * self.v * self.u * (1 - self.u)
        to_h += to_v @ model.gate_v.T + to_u @ model.gate_u.T
        to_pre = to_h * (1 - self.h ** 2)
        return {
            "encode": self.x.T @ to_pre, "encode_bias": to_pre.sum(axis=0), "gate_v": self.h.T @ to_v, "gate_u": self.h.T @ to_u,
            "attend": (self.v * self.u).T @ to_raw, "score": self.z.T @ error, "score_bias": np.array([error.sum()]),
        }


def learn(bags: np.ndarray, features: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """The parameters after ``epochs`` passes of Adam over mini-batches of documents, in a seeded order.

    ``bags`` are ascending and ``labels`` has one value per bag.
    """
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    features = features.astype(np.float64)
    # Measures that hardly vary in the sample are not blown up.
    model = Model(features.mean(axis=0), np.maximum(features.std(axis=0), 0.02), draw(features.shape[1], HIDDEN), np.zeros(HIDDEN),
                  draw(HIDDEN, GATE), draw(HIDDEN, GATE), draw(GATE), draw(HIDDEN), np.zeros(1))
    starts = _bag_starts(bags)
    ends = np.r_[starts[1:], len(bags)]
    learned = Model._fields[2:]
    mean = {k: np.zeros_like(getattr(model, k)) for k in learned}
    square = {k: np.zeros_like(getattr(model, k)) for k in learned}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(starts))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for k in range(0, len(order), BATCH):
            chosen = np.sort(order[k:k + BATCH])
            rows = np.concatenate([np.arange(starts[b], ends[b]) for b in chosen])
            found = Forward(model, bags[rows], features[rows]).gradients(model, labels[chosen])
            step += 1
            changed = {}
            for name, g in found.items():
                value = getattr(model, name)
                g = g + DECAY * value
                mean[name] = 0.9 * mean[name] + 0.1 * g
                square[name] = 0.999 * square[name] + 0.001 * g * g
                changed[name] = value - rate * (mean[name] / (1 - 0.9 ** step)) / (np.sqrt(square[name] / (1 - 0.999 ** step)) + 1e-8)
            model = model._replace(**changed)
    return model


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def _sample(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """``doc_id, text, quality`` of the labelled rows to learn from: the first by a hash of the id."""
    train = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (_fold(F.col("doc_id")) != HELD_OUT))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )
    # The sample is bounded, so it is sent to the texts. A repeated document is one example.
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(settle(train, "labelled-sample")), "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    )


def _measured(sample: DataFrame, train_passages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bags, measures and labels of the sample, in the order of its ids."""
    def task(batch: pa.RecordBatch) -> dict:
        made = passages(batch.column(1).to_pylist())
        bounds = np.searchsorted(made.text, np.arange(batch.num_rows + 1))
        rows = []
        for low, high in zip(bounds, bounds[1:]):
            evenly = np.linspace(low, high - 1, min(high - low, train_passages)).astype(np.int64)
            rows.append(made.features[evenly].tobytes())
        return {"doc_id": batch.column(0), "quality": batch.column(2), "features": rows}

    found = sorted(over_batches(sample.select("doc_id", "text", "quality"), "doc_id long, quality int, features binary", task).collect())
    each = [np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES) for r in found]
    bags = np.repeat(np.arange(len(each)), [len(e) for e in each])
    features = np.concatenate(each) if each else np.zeros((0, FEATURES), np.float32)
    return bags, features, np.array([r["quality"] for r in found], np.float64)


def quality_scores(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_passages: int = TRAIN_PASSAGES,
) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_passages, evidence``: one row per row of ``docs``.

    ``evidence`` is the number, from 0, of the passage with the largest weight (ties: the
    first). A null text is an empty one; texts without words are one passage without measures,
    and score as such. Labels that are null or belong to no document are passed over; of
    conflicting ones the lower counts. Without examples of both labels every score is their
    mean, or 0.5 if there are none. A null id is not held out. Repeated rows get a row each. A very long text
    takes some hundred bytes a code point while it is measured. An empty table gives no
    rows; other columns, and the labels, language, source and id of a row, are no inputs of a score.
    """
    sample = settle(_sample(docs, labels, train_rows), "quality-sample")
    bags, features, marks = _measured(sample, train_passages)
    held_out = F.coalesce(_fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    constant = None if 0 < marks.sum() < len(marks) else float(marks.mean()) if len(marks) else 0.5
    model = learn(bags, features, marks) if constant is None else None

    def task(batch: pa.RecordBatch) -> dict:
        made = passages([t or "" for t in batch.column(1).to_pylist()])
        starts = _bag_starts(made.text)
        sizes = np.diff(np.r_[starts, len(made.text)])
        if model is None:
            score, evidence = np.full(len(starts), constant), np.zeros(len(starts), np.int64)
        else:
            found = Forward(model, made.text, made.features.astype(np.float64))
            score = found.score
            top = found.weight >= np.maximum.reduceat(found.weight, starts)[found.bag]
            evidence = np.minimum.reduceat(np.where(top, np.arange(len(top)), len(top)), starts) - starts
        return {"doc_id": batch.column(0), "score": score, "n_passages": sizes, "evidence": evidence}

    return over_batches(
        docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, score double, n_passages long, evidence long", task,
    ).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "evidence")
