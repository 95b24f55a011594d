"""Token counts of a unigram vocabulary, with forward scores shared along a trie.

The distinct pre-tokens of a batch go into a trie. A node holds the best score of segmenting the string
that leads to it, and the number of tokens of that segmentation; both follow from nodes above
it and the pieces that end there, so a prefix that many pre-tokens share is scored once. The count at a
pre-token's last node is its token count, and a text's count is the sum over its pre-tokens.
Nothing is shuffled; tries, and the counts kept from earlier batches, have a bounded size.

The scores are an input. Where none are given they follow from the rank of a piece in its
vocabulary file, since no unigram model comes with a merge vocabulary and none is trained here.
"""

from __future__ import annotations

from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm import tries
from palisade.llm.common import over_batches
from palisade.llm.pieces import load

UNKNOWN_PENALTY = 10.0


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log-probabilities by rank: a vocabulary lists its pieces by falling frequency.

    The k-th piece has a share in proportion to 1 / (k + 1), which needs no counting.
    """
    whole = log(sum(1 / (k + 1) for k in range(len(pieces))))
    return {p: -log(k + 1) - whole for k, p in enumerate(pieces)}


class Unigram:
    """Best segmentations under fixed piece scores. Ties go to fewer tokens.

    A character outside the vocabulary counts as many tokens as it has UTF-8 bytes.
    """

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.vocabulary = tries.Vocabulary(list(scores))
        self.values = np.array(list(scores.values()))
        self.solved = tries.Solved(self.counts)

    def count(self, token: str) -> int:
        return self.counts([token])[0] if token else 0

    def counts(self, tokens: list[str]) -> list[int]:
        """Tokens of each pre-token. They are distinct, sorted and not empty."""
        trie = tries.Trie(tokens)
        found = trie.matches(self.vocabulary)
        # Nodes of characters outside the vocabulary start from the node above them.
        single = np.zeros(trie.nodes, bool)
        single[found.node[found.length == 1]] = True
        alone = np.flatnonzero(~single[1:]) + 1
        place = trie.place[alone]
        above = np.where(trie.depth[place] == 1, 0, trie.node[place - 1])
        points = trie.points[place]
        size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        node = np.concatenate([found.node, alone])
        order = np.argsort(node, kind="stable")
        pick = lambda a, b: np.concatenate([a, b])[order].tolist()
        best, tokens_at = [-np.inf] * trie.nodes, [0] * trie.nodes
        best[0] = 0.0
        for at, start, score, more in zip(
                node[order].tolist(), pick(found.before, above),
                pick(self.values[found.piece], np.full(len(alone), self.unknown)), pick(np.ones(len(found.node), np.int64), size)):
            score += best[start]
            if score > best[at]:
                best[at], tokens_at[at] = score, tokens_at[start] + more
            elif score == best[at] and tokens_at[start] + more < tokens_at[at]:
                tokens_at[at] = tokens_at[start] + more
        return [tokens_at[n] for n in trie.last.tolist()]


@lru_cache(maxsize=2)
def unigram(model_file: str) -> Unigram:
    """The counter of a vocabulary file with scores by rank, once per worker process."""
    ids = load(model_file).ids
    return Unigram(zipf_scores(sorted(ids, key=ids.get)))


@lru_cache(maxsize=2)
def _scored(scores: tuple[tuple[str, float], ...]) -> Unigram:
    return Unigram(dict(scores))


def token_counts(docs: DataFrame, model_file: str, scores: dict[str, float] | None = None) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` for every row of ``docs``.

    ``model_file`` says where pre-tokens end, ``scores`` are log-probabilities of the pieces
    (default: ``zipf_scores`` of the file's vocabulary). Null and empty texts have neither. Repeated rows get a
    row each; a null id stays null. A pre-token of any length takes time and memory in proportion to its
    length. An empty table gives no rows; other columns are ignored.
    """
    given = None if scores is None else tuple(scores.items())

    def task(batch: pa.RecordBatch) -> dict:
        cut = load(model_file).cut
        model = unigram(model_file) if given is None else _scored(given)
        units = [cut(t or "") for t in batch.column(1).to_pylist()]
        counts = model.solved(units)
        return {"doc_id": batch.column(0), "n_pretokens": list(map(len, units)),
                "n_tokens": [sum(map(counts.__getitem__, u)) for u in units]}

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, n_pretokens long, n_tokens long", task)
