import random

import public_tokenizers

from palisade.llm import token_counts, tries
from palisade.llm.pieces import load
from tests.llm.helpers import ODD, documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute(scores, unknown, token):
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        options = []
        for start in range(max(0, end - 20), end):
            score = scores.get(token[start:end])
            if score is not None:
                options.append((best[start][0] + score, -(-best[start][1] + 1)))
        if token[end - 1] not in scores:
            options.append((best[end - 1][0] + unknown, best[end - 1][1] - len(token[end - 1].encode())))
        # Higher score, then fewer tokens.
        top = max(options)
        best.append(top)
    return -best[-1][1]


def test_counts_against_a_plain_table(spark, small):
    own = token_counts.unigram(MODEL)
    cut = load(MODEL).cut
    for row in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect():
        for token in set(cut(row.text)):
            assert own.count(token) == brute(own.scores, own.unknown, token), token


def strings(letters, count, longest):
    rng = random.Random(9)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(count)})


SCORES = {"a": -2.0, "b": -2.0, "ab": -2.5, "abc": -9.0, "c": -3.0, "aa": -4.0, "bca": -5.0, "éa": -1.0, "日": -2.0}


def test_one_trie_of_many_tokens_and_small_ones(monkeypatch):
    own = token_counts.Unigram(SCORES)
    tokens = strings("abcxé日\U0001f600", 3000, 9)
    want = [brute(SCORES, own.unknown, t) for t in tokens]
    assert own.counts(tokens) == want
    monkeypatch.setattr(tries, "CHARACTERS", 20)
    parts = list(tries.parts(tokens))
    assert len(parts) > 100 and [t for p in parts for t in p] == tokens
    assert [c for p in parts for c in own.counts(p)] == want
    monkeypatch.setattr(tries, "KEPT", 200)
    for k in range(0, len(tokens), 30):
        got = own.solved([tokens[k:k + 40], tokens[k:k + 40][::-1]])
        assert got == dict(zip(tokens[k:k + 40], want[k:k + 40]))
        assert sum(map(len, own.solved.recent)) <= 200 and sum(map(len, own.solved.older)) <= 200


def test_a_node_for_each_prefix():
    tokens = strings("ab", 200, 8) + ["b" * 40]
    trie = tries.Trie(sorted(set(tokens)))
    prefixes = sorted({t[:k] for t in tokens for k in range(1, len(t) + 1)}, key=lambda p: (len(p), p))
    assert trie.nodes == len(prefixes) + 1
    assert [prefixes[n - 1] for n in trie.last.tolist()] == sorted(set(tokens))
    assert trie.levels.tolist() == [1 + sum(len(p) <= d for p in prefixes) for d in range(41)]
    found = trie.matches(tries.Vocabulary(["a", "ab", "bb", "bbab", "x"]))
    want = [(n + 1, prefixes.index(p[:-len(q)]) + 1 if p != q else 0, q) for n, p in enumerate(prefixes)
            for q in ("bbab", "ab", "bb", "a") if p.endswith(q)]
    assert [(n, b, ["a", "ab", "bb", "bbab", "x"][q]) for n, b, q in zip(
        found.node.tolist(), found.before.tolist(), found.piece.tolist())] == want


def test_a_very_long_token():
    own = token_counts.Unigram({"a": -1.0, "aa": -1.5})
    assert own.count("a" * 500_001) == 250_001 and own.count("") == 0


def test_scores_are_an_input(spark):
    docs = documents(spark, [(1, "abab"), (2, "ab ab")])
    scores = {"▁": -1.0, "a": -1.0, "b": -1.0, "▁ab": -1.0}
    counts = lambda s: [r.n_tokens for r in token_counts.token_counts(docs, MODEL, s).orderBy("doc_id").collect()]
    assert counts(scores) == [3, 2] and counts({**scores, "▁abab": -0.5}) == [1, 2]


def test_odd_rows(spark):
    docs = documents(spark, ODD, "n_tokens tokens")
    got = {r.doc_id: r for r in token_counts.token_counts(docs, MODEL).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[4].n_tokens > 30000 and None in got
    assert token_counts.token_counts(docs, MODEL).count() == len(ODD)
    assert token_counts.token_counts(docs.where("false"), MODEL).count() == 0
