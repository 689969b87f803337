import collections
import random

from cohortia.llm import components, neardup
from tests.llm import helpers as H


def shingles(text):
    w = H.words(H.lower(text))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    """{id: (n_shingles, component)} for distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {i: (len(sets[i]), top(i)) for i in ids}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def family(rng, n, size, most):
    base = H.prose(rng, size, 10**6)
    return [edited(rng, base, rng.randrange(most + 1)) for _ in range(n)]


def test_matches_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "one two", "One TWO", " one\ttwo ", "one two three", H.prose(rng, 5000)]
    for n, size, most in ((3, 100, 3), (5, 400, 10), (300, 150, 3), (2, 7, 0), (20, 60, 2), (8, 1000, 30)):
        texts += family(rng, n, size, most)
    texts += [H.prose(rng, 100, 10**6) + " the same closing passage of every page here" for _ in range(60)]
    rows = list(enumerate(texts))
    df = H.clashing(H.table(spark, [(i, t, None, None, None) for i, t in rows]))
    got = neardup.near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_awkward_rows(spark):
    got = neardup.near_duplicates(H.table(spark, H.awkward())).collect()
    assert len(got) == len(H.awkward())
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert {c for i in (4, 5, 6, 11) for _, c, _ in by[i]} == {4}
    assert by[0] == {(0, 0, True)} and by[1] == {(0, 1, True)} and by[2] == {(0, 2, True)}
    assert by[None] == {(116, 4, False), (0, None, True)}
    assert neardup.near_duplicates(H.table(spark, [])).count() == 0


def test_one_id_with_two_texts(spark):
    rng = random.Random(4)
    a, b = H.prose(rng, 80, 10**6), H.prose(rng, 80, 10**6)
    got = neardup.near_duplicates(H.table(spark, [(7, a, None, None, 0), (7, b, None, None, 0), (9, a, None, None, 0), (8, edited(rng, b, 1), None, None, 0)])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(7, 7), (8, 7), (9, 7)}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000), (1300, 1299), (1299, 1300)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1301)}}
