"""Components against a plain search on random, star-shaped and chained links."""

import random

from sieverank.llm import graph as G


def plain(links):
    label = {x: x for e in links for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    links += [(5000, 1000 + i) for i in range(200)]  # a star whose centre is the greatest
    chain = rng.sample(range(6000, 6060), 60)
    links += list(zip(chain, chain[1:]))
    links = [e for e in links if e[0] != e[1]]
    df = spark.createDataFrame([*links, (7, 7), (None, 3), (3, None)], "a long, b long")
    got = {r.node: r.root for r in G.components(df).collect()}
    want = plain(links)
    assert set(got) == set(want)
    assert len(set(got.values())) == len(set(want.values())) == len({(got[n], want[n]) for n in want})
    nodes = spark.createDataFrame([(n, n + 1) for n in [*want, 9999]], "node long, least long")
    ids = {r.node: r.component_id for r in G.least_ids(nodes, G.components(df)).collect()}
    assert ids == {n: r + 1 for n, r in want.items()} | {9999: 10000}
    assert G.components(df.limit(0)).count() == 0


def test_guessed_sizes_do_not_multiply(spark):
    """The size that the optimizer guesses for the result stays small after some rounds (a path in bit-reversed order)."""
    order = [int(f"{i:06b}"[::-1], 2) for i in range(64)]
    found = G.components(spark.createDataFrame(list(zip(order, order[1:])), "a long, b long"))
    assert len({r.root for r in found.collect()}) == 1 and found.count() == 64
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**9
