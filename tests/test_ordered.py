"""Ordered operators against one window, numpy and plain Python."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortia import session
from cohortia.plans import catalog
from cohortia.operators import ordered as O
from cohortia.operators import prepare as P
from cohortia.operators import windows as W


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({
        "id": np.arange(n), "g": np.where(rng.random(n) < 0.6, "hot", rng.choice(["b", "c", "d"], n)),
        "v": np.round(rng.exponential(10, n), 1), "w": rng.normal(size=n)})
    pdf.loc[rng.random(n) < 0.1, "w"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("w", F.nanvl("w", F.lit(None)))
    return df, pdf


OUT = {"total": ("sum", "w"), "low": ("min", "w"), "high": ("max", "w"), "seen": ("count", "w"), "latest": ("last", "w"),
       "place": ("row_number", None), "rk": ("rank", None)}


def by_window(df, keys, out, descending, peers):
    first = F.col("v").desc() if descending else F.col("v").asc()
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    rows = part.orderBy(first, "id").rowsBetween(Window.unboundedPreceding, 0)
    shared = part.orderBy(first).rangeBetween(Window.unboundedPreceding, 0)
    made = {}
    for name, (fn, col) in out.items():
        if fn in ("rank", "row_number"):
            made[name] = F.rank().over(part.orderBy(first)) if fn == "rank" else F.row_number().over(part.orderBy(first, "id"))
        elif fn == "last":
            made[name] = F.last(col, ignorenulls=True).over(rows)
        else:
            made[name] = getattr(F, fn)(F.lit(1) if col is None else col).over(shared if peers else rows)
    return df.withColumns(made)


def same(a, b):
    a, b = [x.toPandas().sort_values("id").reset_index(drop=True) for x in (a, b)]
    pd.testing.assert_frame_equal(a[sorted(a.columns)], b[sorted(a.columns)], check_dtype=False, atol=1e-9)


@pytest.mark.parametrize("keys,descending", [(["g"], False), (["g"], True), ([], False)])
def test_running_equals_window(skewed, keys, descending):
    df, _ = skewed
    same(O.running(df, keys, "v", OUT, tie_break=["id"], descending=descending), by_window(df, keys, OUT, descending, False))


def test_running_peers(skewed):
    df, _ = skewed
    out = {"n": ("count", None), "low": ("min", "w"), "all": ("sum", "w"), "rk": ("rank", None)}
    same(O.running(df, ["g"], "v", out, peers=True, descending=True), by_window(df, ["g"], out, True, True))


@pytest.mark.parametrize("keys", [["g"], []])
def test_quantiles_equal_numpy(skewed, keys):
    df, pdf = skewed
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    for value in ("w", "v"):
        got = O.quantiles(df, keys, value, probs, extra=[F.count(value).alias("n")]).toPandas()
        for _, row in got.iterrows():
            want = pdf[pdf.g == row.g] if keys else pdf
            assert row.n == want[value].notna().sum()
            for name, p in probs.items():
                assert row[name] == pytest.approx(np.nanquantile(want[value], p), abs=1e-12)


def test_bh_by_hand(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.random(400) ** 2, 2)
    df = spark.createDataFrame([(i, "f", float(v)) for i, v in enumerate(p)] + [(999, "f", None), (998, "f", float("nan"))], "id long, f string, p_value double")
    order = np.argsort(-p, kind="stable")
    want = np.empty(len(p))
    want[order] = np.minimum(1, np.minimum.accumulate(p[order] * len(p) / np.arange(len(p), 0, -1)))
    for family in (["f"], []):
        got = W.bh_adjust(df, family).toPandas().sort_values("id").set_index("id")
        assert np.allclose(got.adj_p.iloc[:400], want)
        assert got.adj_p.loc[[998, 999]].isna().all()


@pytest.mark.parametrize("descending", [True, False])
def test_top_with_many_ties(skewed, descending):
    df, _ = skewed
    odd = df.unionByName(df.limit(5).withColumn("v", F.lit(None).cast("double")))
    by = F.col("v").desc() if descending else F.col("v").asc()
    for keys, n in ((["g"], 1), (["g"], 40), ([], 7)):
        want = odd.withColumn("r", F.rank().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(by))).filter(F.col("r") <= n).drop("r")
        got = W.top_with_ties(odd, keys, "v", n, descending)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hash_rank_is_a_stable_permutation(skewed):
    df, _ = skewed
    d = df.withColumn("h", F.md5(F.col("id").cast("string")))
    a = O.hash_rank(d, ["g"], "h", "r", ["id"]).toPandas()
    b = O.hash_rank(d.repartition(5), ["g"], "h", "r", ["id"]).toPandas()
    assert a.set_index("id").r.sort_index().equals(b.set_index("id").r.sort_index())
    for _, part in a.groupby("g"):
        assert sorted(part.r) == list(range(1, len(part) + 1))
        assert list(part.sort_values("r").h) == sorted(part.h)


def test_split_folds_and_balance(skewed):
    df, pdf = skewed
    s = P.split(df, "id", "g", seeds=[1, 2], prop=0.7).toPandas()
    for (seed, g), part in s.groupby(["seed", "g"]):
        assert (part.role == "train").sum() == int(np.floor(0.7 * (pdf.g == g).sum()))
        assert part.id.is_unique
    f = P.folds(df, "id", "g", v=4).toPandas()
    sizes = f.groupby(["g", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1)).max() <= 1 and len(f) == len(pdf)
    down = P.downsample(df, "g", "id").toPandas()
    assert set(down.groupby("g").size()) == {pdf.g.value_counts().min()}


def test_quantiles_of_values_that_lie_close(spark):
    """Several rounds of narrowing: neighbours of one double, both signs, zeros, ties, far ends, whole numbers beyond 2^53."""
    rng = np.random.default_rng(3)
    near = 1.0 + np.arange(3000) * 2.0 ** -52
    groups = {
        "near": np.concatenate([near, [1.0001]]), "signs": np.concatenate([-rng.lognormal(0, 9, 800), [0.0, -0.0, 0.0], rng.lognormal(0, 9, 700)]),
        "ties": np.repeat([2.5, 2.5000001, 2.5000002], [500, 3, 400]), "small": np.array([5e-324, 1e-323, 1.5e-323, 2e-323, 2.2e-308]),
        "one": np.array([7.0]), "below": -near}
    rows = [(g, float(v), 2 ** 60 + i) for g, vs in groups.items() for i, v in enumerate(rng.permutation(vs))] + [("none", None, None), ("one", None, None)]
    df = spark.createDataFrame(rows, "g string, v double, whole long")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.77, "e": 1.0}
    got = O.quantiles(df, ["g"], "v", probs, mean="m", count="n").toPandas().set_index("g")
    assert set(got.index) == {*groups, "none"} and got.loc["none"].drop("n").isna().all() and got.n["none"] == 0
    for g, vs in groups.items():
        assert got.n[g] == len(vs) and got.m[g] == pytest.approx(vs.mean(), rel=1e-9)
        ordered = np.sort(vs)
        for name, p in probs.items():
            h = (len(vs) - 1) * p
            lo, hi = ordered[int(np.floor(h))], ordered[int(np.ceil(h))]
            assert got.loc[g, name] == lo + (h - np.floor(h)) * (hi - lo)
    whole = O.quantiles(df.filter("g = 'near'"), [], "whole", {"lo": 0.0, "third": 1 / 3, "hi": 1.0}).toPandas().iloc[0]
    assert whole.lo == 2 ** 60 and whole.hi == 2 ** 60 + 3000 and whole.third == 2 ** 60 + 1000


def test_quantiles_with_endless_values(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(v,) for v in (nan, inf, -inf, 1.0, 2.0)], "v double")
    got = O.quantiles(df, [], "v", {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0}).toPandas().iloc[0]
    assert list(got)[:4] == [-inf, 1.0, 2.0, inf] and np.isnan(got.q4)
    assert O.quantiles(df.filter("v = 5").withColumn("k", F.lit("x")), ["k"], "v", {"q": 0.5}).count() == 0


def test_lookups_of_many_rows_are_hashed_and_the_order_holds(spark, sf_dir, monkeypatch):
    key = "K24_publication_table"
    few = [tuple(r) for r in catalog.QUERIES[key](spark, sf_dir).collect()]
    monkeypatch.setattr(session, "MANY_ROWS", 0)
    monkeypatch.setattr(session, "SORTED_ROWS", 500)
    many = catalog.QUERIES[key](spark, sf_dir)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and plan.count("ShuffledHashJoin") >= 5
    got = [tuple(r) for r in many.collect()]
    by = lambda r: (*r[:3], -r[5])
    assert sorted(got) == sorted(few) and [by(r) for r in got] == sorted(map(by, got))
