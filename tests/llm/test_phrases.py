import collections
import random
import re

import pytest

from cohortia.llm import phrases, queries
from tests.llm import helpers as H
from tests.oracle import compare, connect

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def counts(rows, longest=3):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", H.lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    return f, n


def brute(rows, least=10, longest=3, top=2000, inside=50):
    f, n = counts(rows, longest)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                part = w[i:i + m]
                if 100 * a >= inside * cand[lang, part]:
                    gone.add((lang, part))
    by = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            score, _, l, r = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            by[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, v in by.items() for k, (s, a, p, l, r) in enumerate(sorted(v)[:top])}


def found(df):
    return {tuple(r) for r in df.select(COLUMNS).collect()}


def made(seed, n=500):
    rng = random.Random(seed)
    heads = ["the cat sat", "New York City", "of the", "a b c d e"]
    text = lambda: "".join(rng.choice([f"w{int(rng.paretovariate(1))} ", rng.choice(heads) + " ", rng.choice([". ", ", ", "\n", "\t", " "]), "é "]) for _ in range(rng.randrange(60)))
    return [(i, text(), rng.choice(["en", "en", "en", "de", None, "und"]), "a", 0) for i in range(n)]


def test_query_equals_sql(spark, sf_dir):
    key = "op12_dynamic_phrases"
    ok, message = compare(spark, connect(sf_dir), key, queries.QUERIES[key], queries.ORACLES[key], sf_dir)
    assert ok, message


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_any_number_of_shards_gives_brute_force(spark, shards):
    rows = made(1)
    df = H.clashing(H.table(spark, rows).repartition(4))
    assert found(phrases.collocations(df, shards=shards)) == brute([r[1:3] for r in rows])


def test_longer_phrases_and_a_crowded_filter(spark, monkeypatch):
    """Every hash shared: more is counted than need be, nothing comes out differently."""
    monkeypatch.setattr(phrases, "FILTER_BITS", 6)
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 700)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 900)
    rows = made(2, 300)
    got = phrases.collocations(H.table(spark, rows), least=6, longest=5, top=40, inside=80)
    assert found(got) == brute([r[1:3] for r in rows], 6, 5, 40, 80)


def test_counts_meet_by_range(spark, monkeypatch):
    """A scan sends one row for each range and length, not one for each phrase; many small ranges change no count."""
    words = " ".join(f"w{i}" for i in range(3000))
    block = phrases.Block()
    for _, texts in phrases.W.slices(phrases.pa.array([words, words])):
        block.add(texts, ["en"] * texts.n)
    active = {m: phrases.np.zeros(1 << phrases.FILTER_BITS, phrases.np.uint8) for m in (1, 2)}
    sent = [r for b in block.count(1, 3, active, 3, phrases.np.array([1 << 62, 1 << 63], phrases.np.uint64)) for r in b.to_pylist()]
    assert len(sent) <= 1 + 3 * 3
    assert [sum(len(r["n"]) // 8 for r in sent if r["m"] == m) for m in range(4)] == [1, 3000, 2999, 2998]
    monkeypatch.setattr(phrases, "RANGE_BYTES", 500)
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 700)
    rows = made(4, 200)
    got = phrases.frequent(H.table(spark, rows), least=4).collect()
    f, _ = counts([r[1:3] for r in rows])
    assert sorted((r.g, r.m, r.n) for r in got if r.m) == sorted((g, len(w), c) for (g, w), c in f.items() if c >= 4)


def test_counts_are_exact(spark):
    rows = made(3, 200)
    f, n = counts([r[1:3] for r in rows])
    got = phrases.frequent(H.table(spark, rows), least=4).collect()
    assert {(r.g, r.n) for r in got if r.m == 0} == set(n.items()) - {(k, 0) for k in n}
    assert {(r.g, r.word, r.n) for r in got if r.m == 1} == {(g, w[0], c) for (g, w), c in f.items() if len(w) == 1 and c >= 4}
    for m in (2, 3):
        assert sorted((r.g, r.n) for r in got if r.m == m) == sorted((g, c) for (g, w), c in f.items() if len(w) == m and c >= 4)


def test_awkward_rows(spark):
    rows = H.awkward() * 3
    assert found(phrases.collocations(H.clashing(H.table(spark, rows)), least=3)) == brute([r[1:3] for r in rows], 3)
    assert phrases.collocations(H.table(spark, [])).collect() == []
    assert phrases.collocations(H.table(spark, [(1, None, "en", "a", 1), (2, "", None, None, 1)])).collect() == []


def test_rows_tell_groups_and_steps_in_runs():
    """A phrase costs the digests of its words, its count and its step; groups are told once, and steps lie together."""
    rng = random.Random(5)
    block = phrases.Block()
    texts = [" ".join(f"w{rng.randrange(2000)}" for _ in range(9000)) for _ in range(4)]
    for _, t in phrases.W.slices(phrases.pa.array(texts)):
        block.add(t, ["en", "de", "en", "fr"][:t.n])
    active = {m: phrases.np.array([rng.randrange(3) for _ in range(1 << 12)] * (1 << phrases.FILTER_BITS - 12), phrases.np.uint8) for m in (1, 2)}
    edges = phrases.np.array([1 << 62, 1 << 63], phrases.np.uint64)
    for r in (r for b in block.count(2, 3, active, 3, edges) for r in b.to_pylist()):
        n, since = len(r["n"]) // 8, r["since"]
        if r["m"] > 1:
            assert sum(len(x) for x in r.values() if isinstance(x, bytes)) <= n * (8 * r["m"] + 8 + 1) + 3 * 12
            assert sum(a != b for a, b in zip(since, since[1:])) <= 3 * 3


def test_scans_leave_their_result_only(spark):
    """Texts in shards and the totals of the scans are deleted; the session keeps its setting."""
    from cohortia import session

    since = len(session._SCRATCH)
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows = made(6, 100)
    f, _ = counts([r[1:3] for r in rows])
    got = phrases.frequent(H.table(spark, rows), least=4).collect()
    assert sorted((r.g, r.m, r.n) for r in got if r.m) == sorted((g, len(w), c) for (g, w), c in f.items() if c >= 4)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    left = [p for s, p in session._SCRATCH[since:] if path(p).getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).exists(path(p))]
    assert [p.split("/")[-1].split("-")[0] for p in left] == ["cut"]
