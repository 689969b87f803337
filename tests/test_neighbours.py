"""Nearest neighbours against brute force, and how much work the pivots save."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortia.operators import neighbours as N


@pytest.fixture(scope="module")
def clustered(spark):
    """Twelve clusters, a third of all points equal, far outliers, and rows without a usable vector."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 20, (12, 8))
    x = np.concatenate([centres[rng.integers(0, 12, 1000)] + rng.normal(0, 0.5, (1000, 8)), np.repeat(centres[:1], 500, axis=0), rng.normal(0, 500, (3, 8))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [1.0] * 7 + [float("nan")]), (9003, [1.0] * 7 + [None])]
    return spark.createDataFrame(rows, "id long, v array<double>"), x


def test_nearest_equals_brute_force(clustered):
    df, x = clustered
    got = N.nearest(df, "id", "v", 5, block=64).toPandas().sort_values(["id", "rank"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :5]
    assert (got.neighbour.to_numpy().reshape(-1, 5) == want).all() and got.id.nunique() == len(x)
    assert np.allclose(got.distance.to_numpy().reshape(-1, 5), np.take_along_axis(d, want, axis=1))


def test_few_pairs_of_blocks_meet(clustered):
    df, x = clustered
    slim = df.filter("id < 9000")
    pivots = N._pivots(slim, len(x))
    rows = N.placed(slim, pivots, 5, 64)
    met = N.visits(rows, pivots, 5).join(rows.select("id", rows.part.alias("own")), "id").select("own", "part").distinct().count()
    assert met < rows.select("part").distinct().count() ** 2 / 3
    assert rows.groupBy("part").count().agg({"count": "max"}).first()[0] <= 64


def test_more_neighbours_than_points(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], "id long, v array<double>")
    got = N.nearest(df, "id", "v", 10).toPandas()
    assert sorted(got.groupby("id").size()) == [3, 3, 3, 3]
    assert N.nearest(df.filter("id > 9"), "id", "v", 3).collect() == []


def test_gaps_are_filled_from_few_blocks(spark):
    """Clustered rows with gaps: values as by brute force, and the bound on what both hold rules out most pairs of blocks."""
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 2, (6, 20)) * 10.0
    x = centres[rng.integers(0, 6, 600)] + rng.normal(0, 0.1, (600, 20))
    x[rng.random(x.shape) < 0.03] = np.nan
    long = pd.DataFrame(x).reset_index(names="sample_id").melt("sample_id", var_name="assay", value_name="value")
    long["assay"] = [f"a{int(a):02d}" for a in long["assay"]]
    df = spark.createDataFrame([(int(s), a, None if np.isnan(v) else float(v)) for s, a, v in long.itertuples(index=False)], "sample_id long, assay string, value double")
    got = N.nearest_observed(df, 3, block=40).groupBy("sample_id", "assay").agg({"neighbour_value": "avg", "neighbour": "count"}).toPandas()
    low, high = np.nanmin(x, axis=0), np.nanmax(x, axis=0)
    s = (x - low) / (high - low)
    assert len(got) == np.isnan(x).sum()
    for r in got.itertuples(index=False):
        i, j = int(r.sample_id), int(r.assay[1:])
        d = np.nanmean(np.abs(s - s[i]), axis=1)
        d[i] = np.inf
        ok = np.flatnonzero(~np.isnan(x[:, j]))
        best = ok[np.lexsort((ok, d[ok]))][:3]
        assert r[2] == pytest.approx(x[best, j].mean(), abs=1e-9) or r[3] == pytest.approx(x[best, j].mean(), abs=1e-9)
    packed = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r], [None if np.isnan(v) else float(v) for v in q])
                                    for i, (r, q) in enumerate(zip(s, x))], "id long, s array<double>, x array<double>")
    rows, pairs = N.observed_blocks(packed, 3, 40)
    assert pairs.count() < rows.select("part").distinct().count() ** 2 / 2


def test_a_vector_is_shipped_to_halls_not_to_blocks(spark, monkeypatch):
    """Where bounds rule out nothing, a vector has a copy for each hall, whatever the number of blocks; results stay exact, also with copies."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 24))
    x[600:] = x[:100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    monkeypatch.setattr(N, "HALL_BYTES", 700 * 24 * 8 // 3)
    monkeypatch.setattr(N, "HELD", 64)
    pivots = N._pivots(df, len(x))
    rows = N.placed(df, pivots, 4, 16)
    rings = rows.groupBy("part", "cell").agg(F.min("away").alias("near"), F.max("away").alias("far"), F.count(F.lit(1)).alias("n")).orderBy("part").toArrow()
    assert len(rings) > 40 and N.halls_for(700, 24) == 3
    assert N.asked(rows, pivots, 4, rings, N._halls(rings["n"].to_numpy(), 3)).count() <= 3 * 700
    got = N.nearest(df, "id", "v", 4, block=16).toPandas().sort_values(["id", "rank"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :4]
    assert (got.neighbour.to_numpy().reshape(-1, 4) == want).all()


def test_gaps_meet_halls_as_they_meet_all_rows(spark, monkeypatch):
    """Rows without order: halls and screened blocks give what all rows at once give, ties by id, rows with nothing in common left out."""
    rng = np.random.default_rng(6)
    s = rng.integers(0, 5, (300, 7)) / 4
    s[rng.random(s.shape) < 0.15] = np.nan
    s[0] = np.nan
    ids, reach = rng.permutation(300), np.full(300, np.inf)
    monkeypatch.setattr(N, "HELD", 200)
    want = N._best_holding(s, ids, s, ids, 3)
    got = N._met_holding(s, ids, reach, np.arange(300) // 40, s, ids, np.arange(300) // 40, np.ones((8, 8), bool), 3)
    told = [sorted(zip(x[0], x[1], ids[x[2]], np.round(x[3], 12), strict=True)) for x in (want, got)]
    assert told[0] == told[1] and len(told[0]) > 600
    monkeypatch.setattr(N, "HALL_BYTES", 300 * 7 * 16 // 4)
    long = [(i, f"a{j}", None if np.isnan(v) else float(v)) for i, r in enumerate(s) for j, v in enumerate(r)]
    found = N.nearest_observed(spark.createDataFrame(long, "sample_id long, assay string, value double"), 3, block=20).toPandas()
    each = N._best_holding(s, np.arange(300), s, np.arange(300), 3)
    assert sorted(zip(found.sample_id, found.assay, found.neighbour, strict=True)) == sorted((i, f"a{j}", o) for i, j, o in zip(*each[:3], strict=True))


def test_products_bound_distances_and_rule_out_nearly_all_pairs(monkeypatch):
    """Rows without clusters, some entries constant, in steps or missing: every pair is bounded from below, few are worked out one by one,
    and two halls that meet once give both what all rows at once give."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 48))
    x[:, 0], x[:, 1], x[40:60] = 3.0, rng.integers(0, 2, 3000), x[:20]
    x[rng.random(x.shape) < 0.04] = np.nan
    low, high = np.nanmin(x, axis=0), np.nanmax(x, axis=0)
    s = np.where(np.isnan(x), np.nan, (x - low) / np.where(high > low, high - low, 1))
    few, shared = s[:200], (~np.isnan(s[:200])).astype(float) @ (~np.isnan(s)).T
    total = np.nansum(np.abs(few[:, None] - s[None]), axis=2)
    knots = N._knots(s)
    bound = N._against(N._features(few, knots), 0.1) @ N._features(s, knots).T
    slack = total - 0.1 * shared - bound
    assert slack.min() > -1e-3 and np.median(slack) < 0.1 * np.median(total)
    ids, reach = rng.permutation(3000), N._reach(s, s, np.arange(3000), 4)
    reach = np.where(np.isnan(s).any(axis=1), np.where(np.isnan(s), reach, 0).max(axis=1), -1.0)
    tried = []
    exactly = N._exactly
    monkeypatch.setattr(N, "_exactly", lambda s, r, c: tried.append(len(r)) or exactly(s, r, c))
    found = N._Found(s, ids, reach, 4)
    blocks, first, second = np.arange(3000) // 200, np.arange(1400), np.arange(1400, 3000)
    for half in ((first, None), (second, None), (first, second)):
        N._meet(found, *half, blocks, np.ones((15, 15), bool))
    found.keep()
    row, pos, other, d = N._best_holding(s, ids, s, ids, 4)
    told = sorted(zip(row * 48 + pos, ids[other], d, strict=True))
    assert told == sorted(zip(found.best[0], ids[found.best[1]], found.best[2], strict=True))
    assert sum(tried) < 3000 * 2999 / 2 / 20


def test_a_row_with_gaps_meets_each_hall_once(spark, monkeypatch):
    """Pairs of halls meet in one task for both of them: as many groups as there are pairs, and a row is dealt to as many as there are halls."""
    rng = np.random.default_rng(13)
    s = rng.random((400, 9))
    s[rng.random(s.shape) < 0.1] = np.nan
    monkeypatch.setattr(N, "HALL_BYTES", 400 * 9 * 8 // 4)
    seen = []
    cogroup = type(spark.range(1).groupBy("id")).cogroup
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "cogroup", lambda a, b: seen.append((a._df, b._df)) or cogroup(a, b))
    long = [(i, f"a{j}", None if np.isnan(v) else float(v)) for i, r in enumerate(s) for j, v in enumerate(r)]
    N.nearest_observed(spark.createDataFrame(long, "sample_id long, assay string, value double"), 3, block=25)
    (first, second), = seen
    assert first.select("low", "high").distinct().count() == 4 * 5 // 2 and first.count() + second.count() == 4 * 400
