import collections
import importlib.util
import random

from pyspark.sql import functions as F

import corpus_pipeline
from cohortia.llm import neardup, queries
from tests.llm import helpers as H
from tests.llm.test_mixing import water
from tests.llm.test_neardup import brute, edited, shingles
from tests.llm.test_secrets_html import base_spans
from tests.llm.test_words_quality import plain
from tests.oracle import compare, connect


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_stages_one_by_one(spark, sf_dir):
    rows = H.awkward() + [(10_000 + i, f"{t} token = abcdef{i:020d} {H.prose(random.Random(i), 60)}", None, "a", 3) for i, t in enumerate(["x", "y"])]
    docs = spark.createDataFrame(rows, H.SCHEMA).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet")
                                                             .withColumn("doc_id", F.col("doc_id") + 100_000).select(corpus_pipeline.COLUMNS))
    docs = H.clashing(docs)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "secret_scan", "mix_sources", "pack_sequences"]
    stage = dict(corpus_pipeline.STAGES)
    every = rows_of(docs.select(corpus_pipeline.COLUMNS))

    good = stage["quality_rules"](spark, docs, sf_dir)
    assert good.columns == corpus_pipeline.COLUMNS
    want = collections.Counter({r: n for r, n in every.items() if len(r[1] or "") < 50_000 and plain(r[1])["kept"]})
    assert collections.Counter({r: n for r, n in rows_of(good).items() if len(r[1]) < 50_000}) == want

    one = stage["near_dedup"](spark, good, sf_dir)
    kept = rows_of(one)
    ids = {r[0]: r[1] for r in rows_of(good) if r[0] is not None}
    groups = brute(list(ids.items()), percent=80)
    assert max(kept.values()) == 1
    assert {r[0] for r in kept if r[0] is not None} >= {c for _, c in groups.values()} - {4} and len({groups[r[0]][1] for r in kept if r[0] is not None}) == sum(r[0] is not None for r in kept)

    clean = stage["secret_scan"](spark, one, sf_dir)
    after = {r[0]: r for r in rows_of(clean)}
    assert len(after) == len(kept) and clean.columns == corpus_pipeline.COLUMNS
    for r in kept:
        new = after[r[0]]
        assert (base_spans(r[1]) == []) == (new == r) and base_spans(new[1]) == []
        if new != r:
            assert "[SECRET]" in new[1] and new[4] == len(new[1]) and new[2:4] == r[2:4]

    mixed = stage["mix_sources"](spark, clean, sf_dir)
    taken, size = rows_of(mixed), collections.Counter()
    assert set(taken) <= set(after.values()) and max(taken.values()) <= 2 and mixed.columns == corpus_pipeline.COLUMNS
    for r in after.values():
        size[r[3]] += len(H.words(r[1]))
    goal = water({s: size[s] for s in sorted(size, key=lambda s: (s is None, (s or "").encode()))})
    for s in size:
        got = sum(len(H.words(r[1])) * n for r, n in taken.items() if r[3] == s)
        assert abs(got - goal[s]) <= max(len(H.words(r[1])) for r in after.values() if r[3] == s)

    packed = stage["pack_sequences"](spark, mixed, sf_dir).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(r[0] for r in taken.elements())


def test_near_dedup_links_from_similarity_80(spark, sf_dir):
    rng = random.Random(12)
    texts = []
    for _ in range(30):
        base = H.prose(rng, 400, 10**6)
        texts += [base, edited(rng, base, rng.choice([6, 7, 8, 9, 10]))]
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[i] = up[j]
    between = [j for j in range(0, 60, 2) if 80 <= 100 * len(sets[j] & sets[j + 1]) / len(sets[j] | sets[j + 1]) < 85]
    assert len(between) > 5 and len(set(up)) > 30
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], H.SCHEMA), sf_dir)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(up))
    assert corpus_pipeline.NEAR.least() == 12 and neardup.Banding().least() == 10


def test_near_dedup_of_an_id_with_several_texts(spark, sf_dir):
    rng = random.Random(13)
    for _ in range(3):
        a, b, c = (H.prose(rng, 120, 10**6) for _ in range(3))
        rows = [(3, a, "en", "s", 0), (7, a, "en", "s", 0), (7, b, "en", "s", 0), (7, b, "en", "s", 0), (7, edited(rng, b, 1), "en", "s", 0), (8, c, "en", "s", 0), (9, c, "en", "s", 0)]
        got = rows_of(corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, H.SCHEMA), sf_dir))
        near_b = {rows[2], rows[4]}
        assert {r for r in got if r[0] != 7} == {rows[0], rows[5]} and max(got.values()) == 1
        assert len(got) == 3 and set(got) & near_b


def test_run_and_empty_table(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    spark.createDataFrame([], H.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_ten_are_registered():
    names = [k.split("_")[0] for k in queries.QUERIES]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert importlib.util.find_spec("cohortia.llm")


def test_queries_match_sql(spark, sf_dir):
    con = connect(sf_dir)
    for key, sql in queries.ORACLES.items():
        ok, message = compare(spark, con, key, queries.QUERIES[key], sql, sf_dir)
        assert ok, f"{key}: {message}"
