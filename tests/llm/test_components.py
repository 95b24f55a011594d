import random

from palisade.llm.common import components
from tests.llm.helpers import groups


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(0, 200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(7, 7), (5000, 4999)]
    links += [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(200)]
    rng.shuffle(links)
    nodes = {n for a, b in links for n in (a, b) if a != b}
    want = groups([x for x in links if x[0] != x[1]], nodes)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
