import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortia.llm import align, queries, tokens
from cohortia.llm import words as W
from tests.llm import helpers as H

PATHS = tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return align.Pair(*PATHS)


def plain(pair, text):
    """(ids of A, ids of B, tokens of A and B before each shared end) by whole-text calls, or None."""
    if not text:
        return None
    a = pair.sides[0].tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = pair.sides[1].model.encode(text)
    raw = [[s.bytes.join(np.array([i])).tobytes() for i in ids] for s, ids in zip(pair.sides, (a, b), strict=True)]
    if any(b"".join(r) != (" " + text).encode() for r in raw):
        return None
    ends = [np.cumsum([len(x) for x in r]).tolist() for r in raw]
    shared = sorted(set(ends[0]) & set(ends[1]))
    place = [{e: k + 1 for k, e in enumerate(x)} for x in ends]
    return a, b, [place[0][e] for e in shared], [place[1][e] for e in shared]


def check(pair, texts, limit=3000):
    for first, part in W.slices(pa.array(texts), limit):
        ok, (a, b) = pair.encode(part)
        cut_a, cut_b = align.shared_cuts(a, b)
        for j in range(part.n):
            want = plain(pair, texts[first + j])
            assert ok[j] == (want is not None), texts[first + j]
            if want:
                inside = (cut_a >= a.at[j]) & (cut_a < a.at[j + 1])
                got = (a.ids[a.at[j]:a.at[j + 1]].tolist(), b.ids[b.at[j]:b.at[j + 1]].tolist(), (cut_a[inside] + 1 - a.at[j]).tolist(), (cut_b[inside] + 1 - b.at[j]).tolist())
                assert got == want, texts[first + j]


SIGNS = list("abc de  .,\n\t 'sé中 1<>|▁  é😀A\x00\u0085  ") + ["<|endoftext|>", "<s>", " ", "  ", "the ", "can't", "<0x41>"]


@given(st.lists(st.lists(st.sampled_from(SIGNS), max_size=30).map("".join), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_units_and_cuts_equal_whole_texts(pair, texts):
    check(pair, texts)


def test_ends_and_long_runs(pair):
    check(pair, [None, "", " ", "x", " x ", "x  ", "a" * 3000 + " ", "é" * 2000, "▁", "a▁b", "\n\n", "中文" * 500, "a b " * 2000])


def test_probes_grow_with_tokens(pair, monkeypatch):
    """A text without inner cuts costs no more probes than its tokens; so does one with cuts at the far end only."""
    probes = []
    real = np.searchsorted
    monkeypatch.setattr(align.np, "searchsorted", lambda a, v, *x: probes.append(np.size(v)) or real(a, v, *x))
    for a_ends, b_ends in [(range(2, 4001, 2), range(1, 4002, 2)), (range(2, 4001, 2), [*range(1, 3900, 2), *range(3900, 4001)]), (range(1, 4001), range(1, 4001))]:
        a_ends, b_ends = np.array([*a_ends]), np.array([*b_ends])
        b_ends[-1] = a_ends[-1]
        side = lambda e: align.Side(np.zeros(len(e), np.int32), np.array([0, len(e)]), e)
        probes.clear()
        cut_a, _ = align.shared_cuts(side(a_ends), side(b_ends))
        assert a_ends[cut_a].tolist() == sorted(set(a_ends.tolist()) & set(b_ends.tolist()))
        assert sum(probes) <= 4 * len(a_ends)


def brute(pair, rows):
    found = [(i, plain(pair, t)) for i, t in rows]
    links = {n: [(w[0][x - 1], w[1][y - 1]) for x, y in zip(w[2], w[3], strict=True)] if w else [] for n, (_, w) in enumerate(found)}
    count = collections.Counter(x for v in links.values() for x in v)
    top = collections.defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = collections.Counter()
    for n, (i, w) in enumerate(found):
        text = ""
        if w:
            a, b = [0, *w[2]], [0, *w[3]]
            text = ";".join(",".join(map(str, w[0][a[k]:a[k + 1]])) + "|" + ",".join(map(str, w[1][b[k]:b[k + 1]])) for k in range(len(w[2])))
        own = links[n]
        out[i, len(w[0]) if w else 0, len(w[1]) if w else 0, len(own), len(own), sum(count[x] == top[x[1]] for x in own), sum(count[x] for x in own),
            hashlib.sha256(text.encode()).hexdigest() if w else ""] += 1
    return out


def test_query_equals_brute_force(spark, sf_dir, pair):
    got = queries.QUERIES["op13_token_alignment"](spark, sf_dir)
    want = brute(pair, [r[:2] for r in H.documents(sf_dir)])
    assert collections.Counter(tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()) == want
    assert {f.dataType.simpleString() for f in got.schema if f.name != "groups_sha256"} == {"bigint"}


def test_awkward_rows_and_small_blocks(spark, pair, monkeypatch):
    rows = H.awkward(random.Random(2)) + [(50, "a▁b", None, None, 1), (51, "<|endoftext|> <s>", "en", "a", 2)]
    for limits in ((align.BLOCK_BYTES, align.BLOCK_LINKS), (5000, 300)):
        monkeypatch.setattr(align, "BLOCK_BYTES", limits[0])
        monkeypatch.setattr(align, "BLOCK_LINKS", limits[1])
        got = align.link_strength(H.clashing(H.table(spark, rows)), *PATHS)
        assert collections.Counter(tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()) == brute(pair, [r[:2] for r in rows])


def test_empty_table_and_lists(spark, pair):
    docs = H.table(spark, [(1, "one two, three", "en", "a", 1)])
    assert align.link_strength(docs.filter("doc_id > 5"), *PATHS).collect() == []
    row = align.align(docs, *PATHS).first()
    assert (row.ids_a, row.ids_b, row.cuts_a, row.cuts_b) == plain(pair, "one two, three")
