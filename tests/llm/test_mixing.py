import random

import pytest

from palisade.llm import mixing
from tests.llm.helpers import ODD, WORD, documents


def brute_targets(sizes, weights=(1, 2, 3), limit=3):
    """Share, hold what is above its limit, share the rest again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    held, rest = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in held]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > limit * sizes[s]]
        if not over:
            return {**held, **share}
        for s in over:
            held[s] = limit * sizes[s]
            rest -= held[s]


def corpus(seed, sources):
    rng = random.Random(seed)
    rows = []
    for k in range(400):
        source = rng.choice(sources) if k % 3 else sources[0]
        rows.append((k, " ".join(["w"] * int(rng.paretovariate(1) * 8)), source))
    return rows + [(1000, "tiny source", "\U0001f600"), (1001, "", "￿"), (1002, None, "nowords")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_words_taken(spark, seed):
    rows = corpus(seed, ["src0", "src10", "src2", "Z", "a", None])
    got = mixing.mix(documents(spark, rows, "size target draw")).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    assert len(got) == len(rows)


def test_reruns_and_layouts_agree(spark):
    docs = documents(spark, corpus(4, ["a", "b", "c"]))
    tell = lambda f: sorted((r.doc_id, r.taken) for r in f.collect())
    assert tell(mixing.mix(docs)) == tell(mixing.mix(docs.repartition(7))) != tell(mixing.mix(docs, seed=18))


def test_many_sources_without_broadcast(spark):
    docs = documents(spark, corpus(5, ["a", "b", None]))
    tell = lambda f: sorted((r.doc_id, r.taken) for r in f.collect())
    want = tell(mixing.mix(docs))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert tell(mixing.mix(docs)) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_rows_of_the_mix(spark):
    rows = corpus(6, ["a", "b"])
    docs = documents(spark, rows, "_id taken")
    plan = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    made = mixing.mixed(docs)
    assert made.columns == docs.columns
    words, texts = {}, {i: t for i, t, _ in rows}
    for r in made.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert words == {i: n for i, n in plan.items() if n}


def test_odd_rows(spark):
    docs = documents(spark, ODD, "size whole")
    got = mixing.mix(docs).collect()
    assert len(got) == len(ODD) and sum(r.taken for r in got) == sum(r.size for r in got)
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.mixed(docs.where("false")).count() == 0
