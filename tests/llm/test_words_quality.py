import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from cohortia.llm import quality, words
from tests.llm import helpers as H

LIMITS = quality.Limits()


def covered(w, k):
    seen = collections.Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return {j for i in range(len(w) - k + 1) if seen[tuple(w[i:i + k])] > 1 for j in range(i, i + k)}


def plain(text):
    t, w = text or "", H.words(text)
    lines = [x for x in t.split("\n") if H.words(x)]
    cover = covered(w, LIMITS.min_repeat)
    longest = 0
    if cover:
        longest = LIMITS.min_repeat
        while covered(w, longest + 1):
            longest += 1
    repeat = len(covered(w, 3))
    failed = len(w) < LIMITS.min_words or 100 * repeat > LIMITS.max_repeat_percent * len(w)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat, "n_covered_words": len(cover), "longest_repeat": longest,
            "base_failed": failed, "kept": not failed and 100 * len(cover) <= LIMITS.max_covered_percent * len(w) and longest <= LIMITS.max_longest}


def repeating(rng):
    once = H.prose(rng, rng.randrange(5, 60))
    return " ".join([H.prose(rng, 200), once, H.prose(rng, 80), once, H.prose(rng, 40)])


@pytest.fixture(scope="module")
def texts(sf_dir):
    rng = random.Random(1)
    return ([r[1] for r in H.awkward() if not r[1] or len(r[1]) < 5000] + [repeating(rng) for _ in range(40)]
            + [H.prose(rng, rng.randrange(0, 120), 6) for _ in range(40)] + [r[1] for r in H.documents(sf_dir) if len(r[1]) < 3000][:80])


@pytest.mark.parametrize("limit", [1, 3000, 10**6])
def test_measures_match_brute_force_however_sliced(texts, limit):
    got = []
    for _, t in words.slices(pa.array(texts), limit):
        m = quality.measure(t, LIMITS)
        got += [{k: v[i].item() for k, v in m.items()} for i in range(t.n)]
    assert got == [plain(t) for t in texts]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 5, 400).astype(np.uint64)
    doc = np.sort(rng.integers(0, 4, 400))
    sa = quality.suffix_array(h, doc)
    suffixes = [(int(doc[i]), *h[i:np.searchsorted(doc, doc[i], "right")].tolist()) for i in sa]
    assert suffixes == sorted(suffixes) and sorted(sa) == list(range(400))


def test_rows_and_clashing_columns(spark):
    df = H.clashing(H.table(spark, H.awkward()))
    rows = quality.judge(df, keep=["doc_id", "lang", "kept"]).collect()
    assert rows[0].asDict().keys() >= {"doc_id", "lang", "kept", "n_words"}
    want = collections.Counter((r[0], *[plain(r[1])[c] for c in ("n_words", "base_failed")]) for r in H.awkward())
    assert collections.Counter((r.doc_id, r.n_words, r.base_failed) for r in rows) == want
    assert quality.judge(df.limit(0), keep=["doc_id"]).count() == 0


def test_long_repeat_and_cover_reject(spark):
    rng = random.Random(9)
    long, half, clean = H.prose(rng, 150), H.prose(rng, 60), H.prose(rng, 400, 10**6)
    rows = [(1, f"{H.prose(rng, 900, 10**6)} {long} mid {long}", None, None, 0), (2, f"{half} a b {half} {H.prose(rng, 130, 10**6)}", None, None, 0), (3, clean, None, None, 0)]
    got = {r.doc_id: r for r in quality.judge(H.table(spark, rows), keep=["doc_id"]).collect()}
    assert got[1].longest_repeat == 150 and not got[1].kept and not got[1].base_failed
    assert got[2].n_covered_words == 120 and not got[2].kept
    assert got[3].kept
