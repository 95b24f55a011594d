from itertools import combinations
import random

import xxhash
import pytest

from palisade.llm import simhash
from tests.llm.helpers import ODD, WORD, documents, groups, rows_of


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    prints = [brute_fingerprint(t) for _, t in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= radius]
    name = groups(links, range(len(rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[name[k]] = min(i, least.get(name[k], i))
    return [(i, f"{prints[k]:016x}", least.get(name[k])) for k, (i, _) in enumerate(rows)]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == in_order(brute(rows))


def test_odd_rows(spark):
    docs = documents(spark, ODD, "fp component fingerprint")
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == in_order(brute(ODD))
    assert simhash.near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("shard_rows", [20_000, 5])
def test_links_connect_as_all_pairs_do(spark, shard_rows):
    """Dense clusters, chains and far values, with shards cut into pieces and without."""
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(150)}
    seeds = list(values)[:6]
    for seed in seeds[:3]:
        for _ in range(40):
            values.add(seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    for seed in seeds[3:]:
        for _ in range(25):
            seed ^= sum(1 << b for b in rng.sample(range(64), 4))
            values.add(seed)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(frame, 4, shard_rows).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    close = [(a, b) for a, b in combinations(values, 2) if (a ^ b).bit_count() <= 4]
    assert groups(found, values) == groups(close, values)


def test_a_dense_group_links_as_a_forest():
    tree, found = simhash.Tree(simhash.Links(), 4), []
    for k in range(500):
        found += tree.add(sum(1 << b for b in range(9) if k >> b & 1))
    assert len(found) == 499


def test_keep_one(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text), (3, text), (3, text), (9, "other words stand here now"), (None, "lone text of four"), (None, "lone text of four")]
    docs = documents(spark, rows, "_x fp")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id") == [(None,), (3,), (9,)]
    assert simhash.keep_one(docs.where("false")).count() == 0
