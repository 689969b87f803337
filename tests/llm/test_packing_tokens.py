import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortia.llm import packing, tokenfiles, tokens, words
from cohortia.session import scratch_path
from tests.llm import helpers as H

ODD = ["a<|endoftext|>b é́  x y \x1c z", "don't İstanbul ﬁ 123 4.5 <|startoftext|> <|", "ÀÉ×÷ß ʼn Ωmega ΣΑΣ.", "x y z", "'s ''s it's", "\x00\x07 a", "A" * 3000]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokens.vocabulary())


def ids_of(plain, text, end):
    return [*plain.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("limit", [50, 10**6])
def test_ids_equal_the_tokenizer(sf_dir, plain, limit):
    texts = [r[1] for r in H.awkward()] + ODD + [r[1] for r in H.documents(sf_dir)]
    encoder = tokens.WordEncoder(tokens.vocabulary())
    for first, t in words.slices(pa.array(texts), limit):
        ids, at = tokens.with_end(*encoder.encode(t), 1)
        for i in range(t.n):
            assert ids[at[i]:at[i + 1]].tolist() == ids_of(plain, texts[first + i], 1)


def test_full_table_begins_anew(plain, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 50)
    encoder, rng = tokens.WordEncoder(tokens.vocabulary()), random.Random(3)
    for _ in range(5):
        text = H.prose(rng, 60)
        ids, _ = encoder.encode(next(words.slices(pa.array([text])))[1])
        assert ids.tolist() == ids_of(plain, text, 1)[:-1]


def optimum(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity:
                go(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1:]])
        go(i + 1, [*bins, items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


def used(plan):
    out = collections.Counter()
    for content, bins in plan:
        for length, k in content:
            out[length] += k * bins
    return out


def test_plans_are_whole_and_near_the_optimum():
    rng = random.Random(1)
    over = 0
    for _ in range(60):
        items = [rng.randrange(1, 41) for _ in range(9)]
        histogram = collections.Counter(items)
        for plan in (packing.complete(histogram, 40), packing.best_fit(histogram, 40), packing.plan_bins(histogram, 40)):
            assert used(plan) == histogram
            assert all(sum(length * k for length, k in content) <= 40 for content, _ in plan)
        over += sum(n for _, n in packing.plan_bins(histogram, 40)) - optimum(items, 40)
    assert over == 0
    big = {length: rng.randrange(1, 3000) for length in range(1, 4097)}
    plan = packing.plan_bins(big, 4096)
    assert used(plan) == big and sum(n for _, n in plan) <= 1.005 * sum(a * b for a, b in big.items()) / 4096 + 1
    assert packing.plan_bins({}, 4096) == []


def test_packing_documents(spark, plain):
    rng = random.Random(2)
    rows = H.awkward() + [(100 + i, H.prose(rng, rng.choice([3, 3, 3, 40, 900, 3000])), None, None, 0) for i in range(150)]
    df = H.clashing(H.table(spark, rows))
    got = packing.pack(packing.pieces(df, tokens.vocabulary(), capacity=512), capacity=512).collect()
    docs = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and r.start == 512 * r.piece
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    want = {r[0]: ids_of(plain, r[1], 1) for r in rows if r[0] is not None}
    for i, ids in want.items():
        copies = sum(r[0] == i for r in rows)
        joined = b"".join(r.ids for r in sorted(docs[i], key=lambda r: r.piece)[::copies])
        assert np.frombuffer(joined, "<u4").tolist() == ids
    assert len(bins) <= -(-sum(r.length for r in got) // 512) + 1
    assert packing.pack(packing.pieces(H.table(spark, []), tokens.vocabulary())).count() == 0


def test_one_length_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 100)
    df = spark.range(2500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 5 < 4, 300).otherwise(700).cast("long").alias("length"))
    got = packing.pack(df, capacity=1000).collect()
    assert len(got) == 2500 and len({r.sequence_id for r in got}) == 1000
    assert len({(r.sequence_id, r.offset) for r in got}) == 2500


def test_files_round_trip(spark, plain, sf_dir):
    rows = H.awkward() + [r for r in H.documents(sf_dir) if r[0] > 20]
    folder = scratch_path(spark, "test-tokens")
    manifest = tokenfiles.write(H.clashing(H.table(spark, rows)).repartition(5), tokens.vocabulary(), folder, length=64)
    got = sorted(tokenfiles.read(manifest).collect(), key=lambda r: r.start)
    stream, want = [], collections.Counter()
    for r in rows:
        want[(r[0], zlib.crc32(np.array(ids_of(plain, r[1], 2), "<u4").tobytes()))] += 1
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == want
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    for m in sorted(manifest.collect(), key=lambda m: m.shard):
        shard = tokenfiles.Shard(m.path)
        stream += [x for b in shard.batches() for x in b.tolist()]
        last = (m.n_tokens - 1) // 64
        for number in {0, last // 2, last}:
            values, mask = shard.sequence(number)
            assert len(values) == 64 and values[mask].tolist() == stream[m.start + 64 * number:m.start + 64 * number + int(mask.sum())]
    by_start = {r.start: r for r in got}
    some = by_start[got[40].start]
    assert zlib.crc32(np.array(stream[some.start:some.start + some.n_tokens], "<u4").tobytes()) == some.ids_crc32
    assert tokenfiles.read(tokenfiles.write(H.table(spark, []), tokens.vocabulary())).count() == 0
