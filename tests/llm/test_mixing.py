import collections
import random

import pytest

from cohortia.llm import mixing
from tests.llm import helpers as H


def water(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by handing out the excess again and again; ``sizes`` in source order."""
    goal = {}
    weight = {s: weights[i % 3] for i, s in enumerate(sizes)}
    open_, mass = set(sizes), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if mass * weight[s] / total > most * sizes[s]}
        if not over:
            return goal | {s: mass * weight[s] / total for s in open_}
        for s in over:
            goal[s] = most * sizes[s]
            mass -= goal[s]
        open_ -= over
    return goal


def check(rows, docs):
    size = {}
    for d in docs:
        size[d[3]] = size.get(d[3], 0) + len(H.words(d[1]))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    goal = water({s: size[s] for s in order})
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in size:
        assert abs(taken[s] - goal[s]) <= largest[s] + 1e-6


def test_targets_and_taken(spark):
    rng = random.Random(8)
    docs = [(i, H.prose(rng, rng.randrange(0, 200)), None, rng.choice(["hot"] * 10 + ["a", "Z", "é", "", None, "tiny"]), 0) for i in range(2500)]
    docs += H.awkward()
    df = H.clashing(H.table(spark, docs))
    rows = mixing.mix(df).collect()
    assert collections.Counter((r.doc_id, r["size"]) for r in rows) == collections.Counter((d[0], len(H.words(d[1]))) for d in docs)
    check(rows, docs)
    again = mixing.mix(H.table(spark, docs[::-1]).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_copies_are_unbiased(spark):
    docs = [(i, "w " * (1 + i % 7), None, "s" if i < 40 else "t", 0) for i in range(60)]
    df = H.table(spark, docs)
    total, seeds = collections.Counter(), 12
    for seed in range(seeds):
        for r in mixing.mix(df, seed=seed).collect():
            total[r.source] += r.copies / seeds
            rate = {r.source: r.target / r.source_size}
    assert total["s"] / 40 == pytest.approx(1.5 * 1 if "s" not in rate else rate["s"], abs=0.2)


def test_nothing_to_take(spark):
    assert mixing.mix(H.table(spark, [])).count() == 0
    rows = mixing.mix(H.table(spark, [(1, None, None, None, 0), (2, " ", None, "a", 0)])).collect()
    assert [(r["size"], r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_many_sources_share_by_weight(spark):
    docs = [(i, "w " * (1 + 37 * i % 90), None, f"s{i % 130:03d}", 0) for i in range(700)]
    check(mixing.mix(H.table(spark, docs)).collect(), docs)
