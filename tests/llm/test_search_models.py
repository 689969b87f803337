import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cohortia.llm import mixlm, search, toxicity, words
from tests.llm import helpers as H


def brute_top(rows, k, step):
    def whole(v):
        return [math.floor(256.0 * float(x)) for x in v]

    sound = [(i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for qid in {i for i, _ in sound if i % step == 0}:
        q = min(v for i, v in sound if i == qid)
        held = ((max(min(sum(a * b for a, b in zip(q, v)), 2**63 - 1), -2**63), i) for i, v in sound if i != qid)
        scores = sorted((-s, i) for s, i in held)[:k]
        out |= {(qid, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


def found(spark, rows, step):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.selectExpr("*", "1 as block", "1 as id", "1 as score", "1 as v")
    return {tuple(r) for r in search.top_k(df, df.filter(f"vec_id % {step} = 0")).collect()}


def test_search_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "CANDIDATES", 90)
    monkeypatch.setattr(search, "QUERIES", 7)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=40).astype(np.float32).tolist()) for i in range(600)]
    rows += [(600 + i, rows[i % 3][1]) for i in range(60)]  # ties
    rows += [(700, None), (None, rows[0][1]), (702, [1.0, None]), (703, [float("nan")] * 40), (704, [float("inf")]), (705, [1.0]), (720, []), (740, [0.5] * 40)]
    assert found(spark, rows, 20) == brute_top(rows, 5, 20)


def test_search_beyond_doubles_and_few_rows(spark):
    rows = [(0, [3e12, 1.0, 0.25]), (1, [3e12, 2.0, 1.0]), (2, [3e12, 2.0, 1.004]), (3, [-3e12, 0.0, 0.0])]
    assert found(spark, rows, 3) == brute_top(rows, 5, 3)
    assert found(spark, rows[:1], 1) == set() and found(spark, [], 1) == set()


def test_search_on_the_table(spark, sf_dir):
    import pyarrow.parquet as pq

    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()]
    assert found(spark, rows, 50) == brute_top(rows, 5, 50)


def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n == 0


def check_base(rows, got):
    tokens = [[*H.words(H.lower(t)), None] for _, t in rows]
    c = collections.Counter(w for (i, _), t in zip(rows, tokens) if not fold(i, 10) for w in t)
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for (i, _), t in zip(rows, tokens):
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want[(i, fold(i, 10), len(t), sum(c[w] > 0 for w in t), n, f"{base:.6f}")] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score + 0.0:.6f}") for r in got) == want


def test_mixing_counts_and_gain(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixlm, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(mixlm, "RANGE_WORDS", 5000)
    docs = H.documents(sf_dir) + H.awkward()
    got = mixlm.score(H.clashing(H.table(spark, docs))).collect()
    check_base([(d[0], d[1]) for d in docs], got)
    assert all(math.isfinite(r.score) and r.score <= 0 and r.bits_per_byte >= 0 for r in got)
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_mixing_without_training_texts(spark):
    got = mixlm.score(H.table(spark, [(None, "a b", None, None, 0)])).collect()
    assert [(r.train_tokens, r.n_known, r.base_score, r.score) for r in got] == [(0, 0, 0.0, 0.0)]
    assert mixlm.score(H.table(spark, [])).count() == 0


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    h = words.mix(np.arange(1, 1501, dtype=np.uint64))
    c = rng.integers(1, 40, 1500)
    code = mixlm.code_of(h)
    totals = mixlm.Totals(int(c.sum()), 1500, int((c == 1).sum()), np.bincount(code, c, 1 << mixlm.BITS), np.sort(h[:5]))
    zeros, ones = np.zeros(mixlm.SLOTS, np.int64), np.zeros(mixlm.SLOTS, np.int64)
    table = np.zeros(2 * mixlm.SLOTS, np.int64)
    stream = np.repeat(h, c)
    rng.shuffle(stream)
    mixlm.count_bits(stream, np.array([len(stream)]), np.isin(stream, totals.frequent), np.ones(len(stream), bool), table)
    zeros, ones = table[::2], table[1::2]
    mixer = mixlm.Mixer(*mixlm.predictors(zeros, ones), totals)
    # every possible next token after one history of 70 tokens (the weights have been updated once by then)
    past = stream[:70]
    nexts = np.append(h, np.uint64(12345))
    every = np.concatenate([np.append(past, x) for x in nexts])
    counts = np.array([dict(zip(h.tolist(), c.tolist())).get(int(x), 0) for x in every])
    both = mixer.score(every, counts, np.full(len(nexts), 71), np.isin(every, totals.frequent))
    alone = mixer.score(past, counts[:70], np.array([70]), np.isin(past, totals.frequent))
    if not (mixlm.code_of(h) == np.arange(64)[:, None]).any(axis=1).all():
        pytest.skip("some code has no word")
    assert np.exp2(both - alone).sum() == pytest.approx(1, abs=1e-6)


def test_scores_do_not_depend_on_blocks(spark, sf_dir, monkeypatch):
    df = H.table(spark, H.documents(sf_dir)[:60])
    one = {r.doc_id: round(r.score, 6) for r in mixlm.score(df.coalesce(1)).collect()}
    monkeypatch.setattr(mixlm, "BLOCK_BYTES", 20_000)
    assert {r.doc_id: round(r.score, 6) for r in mixlm.score(df.repartition(3)).collect()} == one


@pytest.fixture(scope="module")
def cost():
    rng = random.Random(3)
    common = "idiot moron stupid clown trash loser the and of with people think that this".split()
    text = " ".join(rng.choice(common) for _ in range(5000))
    return toxicity.language(toxicity.trigrams(words.Words(next(words.slices(pa.array([text])))[1], lower=True)))


@pytest.mark.parametrize("shown, meant", [("1d10t", "idiot"), ("m0r0n", "moron"), ("st*pid", "stupid"), ("i.d.i.o.t", "idiot"), ("idiooot", "idiot"),
                                          ("cl0wn", "clown"), ("tr@sh", "trash"), ("l-o-s-e-r", "loser"), ("think", "think")])
def test_restore(cost, shown, meant):
    assert toxicity.restore(shown, cost) == meant


def restored(cost, text):
    t = next(words.slices(pa.array([text])))[1]
    return set(toxicity.features(t, cost)[0].tolist())


def test_disguised_words_have_the_features_of_the_plain_ones(cost):
    for text in ("1d10t", "i d i o t", "xx, IDIOOOT!! yy", "i.d.i.o.t"):
        assert restored(cost, "idiot") <= restored(cost, text)
    assert restored(cost, "") == set() and restored(cost, "123 --- !!") == set()


def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        bad = [rng.choice(["idiot", "moron", "st*pid", "1d10t", "s t u p i d"]) for _ in range(2)] if toxic else []
        rows.append((i, " ".join([H.prose(rng, 30), *bad, "the people think"]), None, None, 0))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled(random.Random(7), 900)
    odd = [(None, "idiot moron", None, None, 0), (5000, None, None, None, 0), (5001, "", None, None, 0), (3, rows[3][1], None, None, 0)]
    lab = spark.createDataFrame([*labels, (None, 1), (7, None), (9999, 1)], "doc_id long, toxic int")
    got = toxicity.score(H.clashing(H.table(spark, rows + odd)), lab).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == 1 and by[5000].predicted == by[5001].predicted == 0
    assert all(r.held_out == fold(r.doc_id, 5) for r in got)


def test_toxicity_without_labels(spark):
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(H.table(spark, H.awkward()), lab).collect()
    assert len(got) == len(H.awkward()) and not any(r.predicted for r in got)
    assert toxicity.score(H.table(spark, []), lab).count() == 0


def test_mixing_starts_from_weights_of_the_training_texts(spark):
    rng = np.random.default_rng(3)
    follow = {i: rng.integers(0, 400, 3) for i in range(400)}
    def text(n):
        w = [int(rng.integers(400))]
        while len(w) < n:
            w.append(int(rng.choice(follow[w[-1]])))
        return " ".join(f"w{i}" for i in w)
    df = H.table(spark, [(i, text(150), "en", "a", 0) for i in range(120)])
    blocked = mixlm.blocks(df, "doc_id", "text").cache()
    r = blocked.first()
    h = np.frombuffer(r.words, np.uint64)[np.frombuffer(r.at, np.uint32)]
    sizes, train = np.array(r.sizes), ~np.repeat(np.array(r.held), r.sizes)
    blocked = spark.createDataFrame([r], blocked.schema)
    table = np.zeros(2 * mixlm.SLOTS, np.int64)
    none = np.zeros(len(h), bool)
    mixlm.count_bits(h, sizes, none, train, table)
    zeros, ones = table[::2], table[1::2]
    weights, refine = mixlm.learn(blocked, np.zeros(0, np.uint64), zeros, ones)
    slope = lambda w: np.abs(mixlm.slopes(h, sizes, none, train, zeros, ones, w)[:weights.size])
    assert slope(weights).max() < 0.2 * slope(np.full(weights.shape, mixlm.NEUTRAL)).max() and refine.any()
    # a plain-Python count of the slope of one gate and context, each bit without its own count
    code, want = mixlm.code_of(h), np.zeros(weights.shape)
    slots = mixlm.contexts(h, sizes, none)
    for i in np.flatnonzero(train)[:200]:
        for b in range(mixlm.BITS):
            node, bit = (1 << b) | (int(code[i]) >> (mixlm.BITS - b)), (int(code[i]) >> (mixlm.BITS - 1 - b)) & 1
            z, o = [zeros[s[i] + node] - (1 - bit) for s in slots], [ones[s[i] + node] - bit for s in slots]
            x = [math.log((b1 + 0.4) / (b0 + 0.4)) for b0, b1 in zip(z, o, strict=True)]
            g = int(z[-1] + o[-1] > 0) + int(z[-1] + o[-1] > 12)
            p = 1 / (1 + math.exp(-min(12, max(-12, sum(w * v for w, v in zip(weights[g].tolist(), x, strict=True))))))
            want[g] += [(bit - p) * v for v in x]
    some = np.zeros(len(h), bool)
    some[np.flatnonzero(train)[:200]] = True
    assert np.allclose(mixlm.slopes(h, sizes, none, some, zeros, ones, weights)[:weights.size].reshape(weights.shape), want, rtol=1e-3, atol=1e-3)


def test_short_texts_are_mixed_online(monkeypatch):
    """A text of 40 tokens: its later tokens are scored by weights that its first ones moved."""
    rng = np.random.default_rng(2)
    h = words.mix(rng.integers(1, 30, 4000).astype(np.uint64))
    distinct, at, n = np.unique(h, return_inverse=True, return_counts=True)
    totals = mixlm.Totals(len(h), len(distinct), 0, np.bincount(mixlm.code_of(distinct), n, 1 << mixlm.BITS), np.zeros(0, np.uint64))
    table = np.zeros(2 * mixlm.SLOTS, np.int64)
    mixlm.count_bits(h, np.array([len(h)]), np.zeros(len(h), bool), np.ones(len(h), bool), table)
    mixer = mixlm.Mixer(*mixlm.predictors(table[::2], table[1::2]), totals)
    told = lambda k: mixer.score(h[:k], n[at][:k], np.array([k]), np.zeros(k, bool))[0]
    online = {k: told(k) for k in (4, 5, 40)}
    monkeypatch.setattr(mixlm, "RATE", 0.0)
    monkeypatch.setattr(mixlm, "REFINE_RATE", 0.0)
    assert online[4] == told(4) and online[5] != told(5) and online[40] != told(40)


def test_mixing_works_through_a_block_in_chunks(spark, sf_dir, monkeypatch):
    """Chunks are whole texts in order, within the limit or alone; scoring through them takes little memory and gives the same."""
    import tracemalloc

    monkeypatch.setattr(mixlm, "CHUNK_TOKENS", 100)
    sizes = np.array([1, 99, 1, 250, 40, 60, 1])
    assert [(t.start, t.stop, z.start, z.stop) for t, z in mixlm.chunks(sizes)] == [(0, 2, 0, 100), (2, 3, 100, 101), (3, 4, 101, 351), (4, 6, 351, 451), (6, 7, 451, 452)]
    assert list(mixlm.chunks(np.zeros(0, np.int64))) == []
    monkeypatch.undo()
    rng = np.random.default_rng(2)
    sizes = np.full(4000, 200)
    h = words.mix(rng.integers(0, 3000, sizes.sum(), np.uint64))
    table = np.zeros(2 * mixlm.SLOTS, np.int64)
    common = np.zeros(len(h), bool)
    tracemalloc.start()
    for some, now in mixlm.chunks(sizes):
        mixlm.count_bits(h[now], sizes[some], common[now], np.ones(now.stop - now.start, bool), table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = np.zeros_like(table)
    mixlm.count_bits(h, sizes, common, np.ones(len(h), bool), whole)
    assert (table == whole).all() and peak < 40e6
    df = H.table(spark, H.documents(sf_dir)[:60])
    one = {r.doc_id: round(r.score, 6) for r in mixlm.score(df).collect()}
    monkeypatch.setattr(mixlm, "CHUNK_TOKENS", 300)
    monkeypatch.setattr(mixlm, "SLICE_BYTES", 3000)
    assert {r.doc_id: round(r.score, 6) for r in mixlm.score(df).collect()} == one


def test_triples_are_counted_over_all_other_training_texts(spark, monkeypatch):
    """Counts of what follows two words, met by range, equal a plain-Python count without the text's own; they grow with the corpus."""
    rng = random.Random(4)
    texts = {i: [f"w{rng.randrange(6)}" for _ in range(rng.randrange(0, 40))] for i in range(90)}
    monkeypatch.setattr(mixlm, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(mixlm, "CHUNK_TOKENS", 50)
    df = H.table(spark, [(i, " ".join(w), "en", "a", 0) for i, w in texts.items()])
    blocked = mixlm.blocks(df.coalesce(2), "doc_id", "text").cache()
    totals = mixlm.Totals(1)
    told = {}
    for r in mixlm.triple_totals(blocked, 5, totals).orderBy("block", "part").collect():
        told.setdefault(r.block, []).append(r)
    steps = lambda w: list(zip([None, None, *w], [None, *w], [*w, ""]))
    triple, pair = collections.Counter(), collections.Counter()
    for i, w in texts.items():
        if not fold(i, 10):
            triple.update(steps(w))
            pair.update(x[:2] for x in steps(w))
    seen_rows = 0
    for b in blocked.collect():
        h, sizes = np.frombuffer(b.words, np.uint64)[np.frombuffer(b["at"], np.uint32)], np.array(b.sizes)
        keys = mixlm.triples(h, sizes, 5)
        back = np.unique(keys, return_inverse=True)[1]
        follow, seen = (np.concatenate([mixlm._unpack(r[name], r.n) for r in told[b.block]])[back] for name in ("follow", "seen"))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        got = mixlm.others(keys, doc, ~np.array(b.held)[doc], follow, seen)
        want = []
        for i in b.ids:
            own = steps(texts[i])
            mine = collections.Counter(own), collections.Counter(x[:2] for x in own)
            take = 0 if fold(i, 10) else 1
            want += [(triple[x] - take * mine[0][x], pair[x[:2]] - take * mine[1][x[:2]]) for x in own]
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want
        seen_rows += len(want)
    assert seen_rows == sum(len(w) + 1 for w in texts.values()) and len(told) > 1
    assert ((totals.follows > 0) & (totals.follows < 1)).all()


def test_probabilities_sum_to_one_where_words_have_followed():
    h = words.mix(np.arange(1, 301, dtype=np.uint64))
    c = np.random.default_rng(1).integers(1, 40, 300)
    code = mixlm.code_of(h)
    totals = mixlm.Totals(int(c.sum()), 300, 5, np.bincount(code, c, 1 << mixlm.BITS), np.sort(h[:5]), np.linspace(0.2, 0.9, mixlm.SEEN_GATES))
    table = np.zeros(2 * mixlm.SLOTS, np.int64)
    stream = np.repeat(h, c)
    mixlm.count_bits(stream, np.array([len(stream)]), np.isin(stream, totals.frequent), np.ones(len(stream), bool), table)
    mixer = mixlm.Mixer(*mixlm.predictors(table[::2], table[1::2]), totals)
    past, nexts = stream[:9], np.append(h, np.uint64(12345))
    every = np.concatenate([np.append(past, x) for x in nexts])
    counts = np.array([dict(zip(h.tolist(), c.tolist(), strict=True)).get(int(x), 0) for x in every])
    # after this past 3 words have followed, 10 times in all
    after = {int(h[3]): 5, int(h[7]): 4, int(h[100]): 1}
    follow = np.concatenate([[*[2] * 9, after.get(int(x), 0)] for x in nexts])
    seen = np.tile([*[4] * 9, 10], len(nexts))
    both = mixer.score(every, counts, np.full(len(nexts), 10), np.isin(every, totals.frequent), follow, seen)
    alone = mixer.score(past, counts[:9], np.array([9]), np.isin(past, totals.frequent), follow[:9], seen[:9])
    # bits of codes that no word has
    lost = 1 - (np.bincount(code, minlength=64) > 0).mean()
    assert np.exp2(both - alone).sum() == pytest.approx(1, abs=1e-6 if not lost else 0.2)
    assert (both - alone)[[3, 7]].min() > np.delete(both - alone, [3, 7, 100]).max()


def test_texts_that_occur_twice_are_told_from_others(spark):
    """The model holds what whole texts say: one that has a copy is far likelier, word for word, than one like it without."""
    rng = random.Random(9)
    once = {i: " ".join(f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(60)) for i in range(400)}
    docs = {**once, **{1000 + i: once[i] for i in range(0, 400, 8)}}
    got = {r.doc_id: r.score / r.n_tokens for r in mixlm.score(H.table(spark, [(i, t, "en", "a", 0) for i, t in docs.items()])).collect()}
    copied = [got[i] for i in range(0, 400, 8) if not (fold(i, 10) or fold(1000 + i, 10))]
    others = sorted(got[i] for i in range(400) if i % 8)
    assert len(copied) > 30 and np.mean(np.array(copied) > others[int(0.95 * len(others))]) > 0.95
