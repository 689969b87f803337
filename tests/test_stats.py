"""Statistical operators against dense numpy and brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortia.functions import tails as T
from cohortia.operators import enrich, layers, linear, matching, neighbours, prepare, prior, reshape, roc, single


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(3)
    n = 120
    meta = pd.DataFrame({"sample_id": np.arange(n), "disease": rng.choice(["H", "A", "B", "C"], n), "sex": rng.choice(["F", "M"], n),
                         "age": rng.uniform(20, 80, n), "bmi": rng.normal(25, 3, n)})
    meta.loc[meta.disease == "C", "sex"] = "F"
    meta["class"] = meta.disease.map({"H": "Healthy", "A": "K1", "B": "K1", "C": "K2"})
    rows = []
    for j in range(6):
        v = 0.02 * meta.age + 0.5 * (meta.sex == "M") + (meta.disease == "A") * 0.8 + rng.normal(size=n)
        part = meta.assign(assay=f"P{j}", value=v)
        part.loc[rng.random(n) < 0.1, "value"] = np.nan
        rows.append(part)
    pdf = pd.concat(rows, ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("value", F.nanvl("value", F.lit(None)))
    return df, pdf, spark.createDataFrame(meta), meta


def ols(x, y):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    return beta, ((y - x @ beta) ** 2).sum()


def test_anova_matches_dense(cohort):
    df, pdf, _, _ = cohort
    got = linear.anova(df).toPandas()
    for assay, part in pdf.dropna(subset=["value"]).groupby("assay"):
        y = part.value.to_numpy()
        cols = {"(Intercept)": np.ones((len(y), 1)), "age": part[["age"]].to_numpy(), "sex": (part.sex != "F").to_numpy(float)[:, None],
                "bmi": part[["bmi"]].to_numpy(), "disease": np.column_stack([(part.disease == d).to_numpy(float) for d in ["B", "C", "H"]])}
        _, rss = ols(np.hstack(list(cols.values())), y)
        df_res = len(y) - 7
        g = got[got.assay == assay].set_index("term")
        assert g.loc["Residuals", "ss"] == pytest.approx(rss, rel=1e-9) and g.loc["Residuals", "df"] == df_res
        for term, x in cols.items():
            _, without = ols(np.hstack([v for k, v in cols.items() if k != term]), y)
            f = (without - rss) / x.shape[1] / (rss / df_res)
            assert g.loc[term, "ss"] == pytest.approx(without - rss, rel=1e-7)
            assert g.loc[term, "f"] == pytest.approx(f, rel=1e-7)
            assert g.loc[term, "p_value"] == pytest.approx(float(T.f_upper(f, x.shape[1], df_res)), rel=1e-6)


def test_contrast_fit_matches_dense_and_drops_constant_covariate(cohort):
    df, pdf, meta, mp = cohort
    plan = linear.contrast_plan(meta, "Healthy", "H")
    rows = df.select("sample_id", "assay", F.col("value").alias("y"), linear.numeric_sex(F.col("sex")).alias("sex"), "age")
    mom = linear.contrast_moments(rows, linear.contrast_members(plan, meta), ["sex", "age", "y"], ["control", "contrast"])
    got = linear.contrast_fit(mom, ["control", "contrast"], ["sex", "age"], linear.pick_design(meta, plan, healthy="H")).toPandas()
    for _, r in got.iterrows():
        part = pdf[(pdf.assay == r.assay) & pdf.disease.isin([r.contrast, "H"])].dropna(subset=["value"])
        case = (part.disease == r.contrast).to_numpy(float)
        x = [np.ones(len(part)), case, part.age]
        if r.contrast != "C":
            x.append((part.sex != "F").to_numpy(float))
        x = np.column_stack(x)
        beta, rss = ols(x, part.value.to_numpy())
        s2 = rss / (len(part) - x.shape[1])
        assert r.df == len(part) - x.shape[1]
        assert r.log_fc == pytest.approx(beta[1], rel=1e-8) and r.s2 == pytest.approx(s2, rel=1e-8)
        assert r.se == pytest.approx(math.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1]), rel=1e-8)


def test_group_moments_equal_sample_moments(cohort):
    df, _, meta, _ = cohort
    plan = linear.contrast_plan(meta, "All other diseases", "H")
    rows = df.select("sample_id", "assay", "disease", F.col("value").alias("y"))
    a = linear.contrast_fit(linear.group_contrast_moments(rows, plan, ["y"]), ["control", "contrast"], [])
    b = linear.contrast_fit(linear.contrast_moments(rows, linear.contrast_members(plan, meta), ["y"], ["control", "contrast"]), ["control", "contrast"], [])
    cols = ["control", "contrast", "assay", "n_case", "n_control", "log_fc", "s2", "t"]
    left, right = [x.select(cols).toPandas().sort_values(cols[:3]).reset_index(drop=True) for x in (a, b)]
    pd.testing.assert_frame_equal(left, right, rtol=1e-8)


def test_prior_recovers_known_values(spark):
    rng = np.random.default_rng(0)
    d0, s0, d = 8.0, 0.5, 20.0
    n = 30000
    s2 = (d0 * s0 / rng.chisquare(d0, n)) * rng.chisquare(d, n) / d
    fit = spark.createDataFrame(pd.DataFrame({"k": "a", "s2": s2, "df": d}))
    for robust in (False, True):
        got = linear.variance_prior(fit, ["k"], robust).toPandas().iloc[0]
        assert got.prior_df == pytest.approx(d0, rel=0.08) and got.prior_s2 == pytest.approx(s0, rel=0.03)
    dirty = s2.copy()
    dirty[:600] *= 1e4
    got = linear.variance_prior(spark.createDataFrame(pd.DataFrame({"k": "a", "s2": dirty, "df": d})), ["k"], True).toPandas().iloc[0]
    assert got.prior_df == pytest.approx(d0, rel=0.3)


def plain_assay_priors(s2, df, d0, s0):
    """Prior df of each assay, one array after another."""
    n, pooled = len(s2), df * len(s2)
    f, endless, d0 = s2 / s0, np.isinf(d0), min(d0, pooled)
    tail = np.maximum(T.chi2_upper(df * f, df) if endless else T.f_upper(f, df, d0), 1e-300)
    order = np.argsort(tail, kind="stable")
    k = np.arange(1, n + 1)
    chance = np.minimum(tail[order] / ((k - 0.5) / n), 1)
    if endless:
        along = np.where(chance < 1, chance * pooled, np.inf)
    else:
        small = np.log(0.5) / np.log(min(tail[order][0], 0.5)) * d0
        small *= np.log(0.5) / np.log(min(T.f_upper(f[order][0], df, small), 0.5))
        along = chance * d0 + (1 - chance) * small
        means = np.cumsum(along) / k
        along[:means.argmin() + 1] = means.min()
    out = np.empty(n)
    out[order] = np.maximum.accumulate(along)
    return out


def test_outlying_assays_get_a_small_prior_df(spark):
    rng = np.random.default_rng(5)
    d = 20.0
    parts, wanted = [], {}
    for key, d0, s0, n in (("a", 8.0, 0.5, 400), ("b", np.inf, 0.5, 300), ("c", 8.0, 0.5, 1)):
        s2 = (d0 * s0 / rng.chisquare(d0, n) if np.isfinite(d0) else s0) * rng.chisquare(d, n) / d
        s2[:n // 40] *= 1e3
        parts.append(pd.DataFrame({"k": key, "assay": [f"x{i}" for i in range(n)], "s2": s2, "df": d, "prior_df": d0, "prior_s2": s0}))
        wanted[key] = plain_assay_priors(s2, d, d0, s0)
    rows = pd.concat([*parts, pd.DataFrame({"k": "a", "assay": ["flat", "short"], "s2": [0.0, 1.0], "df": [d, 0.0], "prior_df": 8.0, "prior_s2": 0.5})])
    fit = spark.createDataFrame(rows[["k", "assay", "s2", "df"]])
    prior = spark.createDataFrame(rows[["k", "prior_df", "prior_s2"]].drop_duplicates())
    got = linear.assay_priors(fit, prior, ["k"], "assay").toPandas().set_index(["k", "assay"]).prior_df
    assert len(got) == len(rows)
    for key, values in wanted.items():
        assert np.allclose([got[key, f"x{i}"] for i in range(len(values))], values, rtol=1e-9)
    assert got["a", "flat"] == 8.0 and got["a", "short"] == 8.0
    assert max(got["a", f"x{i}"] for i in range(10)) < 1.0 and np.median([got["a", f"x{i}"] for i in range(10, 400)]) > 7.9
    assert max(got["b", f"x{i}"] for i in range(7)) < 1e-3 and np.median([got["b", f"x{i}"] for i in range(7, 300)]) > 100 * d


def test_tails_against_known_values():
    assert T.t_two_sided([2.0], [10])[0] == pytest.approx(0.07338803, rel=1e-6)
    assert T.f_upper(4.0, 2, 10) == pytest.approx(0.05292215, rel=1e-6)
    assert T.chi2_upper([3.841459], [1])[0] == pytest.approx(0.05, rel=1e-6)
    assert T.t_quantile(0.025, [10, np.inf]) == pytest.approx([2.228139, 1.959964], rel=1e-6)
    assert np.isnan(T.t_two_sided([np.nan], [3])[0])


def brute_match(case, control):
    """Closest neighbours on the line first; ``{id: (score, age, sex)}`` of each side, scores at 9 digits."""
    line = sorted((round(v[0] * 1e9), *v[1:], side, i) for side, d in (("case", case), ("control", control)) for i, v in d.items())
    out = set()
    while pairs := [(line[k + 1][0] - line[k][0], k) for k in range(len(line) - 1) if line[k][3] != line[k + 1][3]]:
        k = min(pairs)[1]
        two = sorted(line[k:k + 2], key=lambda x: x[3])
        out.add((two[0][4], two[1][4]))
        del line[k:k + 2]
    return out


def test_matching_equals_closest_first(spark):
    rng = np.random.default_rng(11)
    meta = pd.DataFrame({"sample_id": np.arange(150), "disease": rng.choice(["H", "H", "A", "B"], 150), "sex": rng.choice(["F", "M"], 150),
                         "age": rng.uniform(20, 80, 150)})
    meta.loc[meta.disease == "B", "sex"] = "F"
    m = spark.createDataFrame(meta)
    plan = spark.createDataFrame([("A", "H"), ("B", "H"), ("A", "B")], "case_disease string, control_disease string")
    got = matching.match_samples(m, plan).toPandas()
    scores = matching.propensity(matching.pair_cells(m, plan)).toPandas()
    for (case, control), part in got.groupby(["case_disease", "control_disease"]):
        assert part.case_sample.is_unique and part.control_sample.is_unique
        s = scores[(scores.case_disease == case) & (scores.control_disease == control)].set_index(["age", "sex"]).score
        pick = lambda dis: {r.sample_id: (s[(r.age, r.sex)], r.age, r.sex) for r in meta[meta.disease == dis].itertuples() if (r.age, r.sex) in s.index}
        assert set(zip(part.case_sample, part.control_sample)) == brute_match(pick(case), pick(control))
        if case == "B":
            assert set(part.control_sex) == {"F"}


def test_a_stretch_matches_only_what_is_certain():
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(2, 14))
        score = np.sort(rng.integers(0, rng.choice([8, 30, 1000]), n))
        side = rng.random(n) < 0.5
        left = rng.integers(1, 4, n)
        line = lambda a, b, *out: list(matching.Line(score[a:b], np.where(side, left, 0)[a:b], np.where(side, 0, left)[a:b], *out).matches())
        units = [(int(score[i]), i, c) for i in range(n) for c in range(left[i])]
        want = {}
        while pairs := [(units[k + 1][0] - units[k][0], units[k][1], k) for k in range(len(units) - 1) if side[units[k][1]] != side[units[k + 1][1]]]:
            k = min(pairs)[2]
            i, j = sorted((units[k][1], units[k + 1][1]), key=lambda x: not side[x])
            want[i, j] = want.get((i, j), 0) + 1
            del units[k:k + 2]
        assert {(i, j): k for i, j, k in line(0, n)} == want
        a, b = sorted(rng.choice(n + 1, 2, replace=False))
        part = line(a, b, int(score[a - 1]) if a else None, int(score[b]) if b < n else None)
        assert all(want[i + a, j + a] == k for i, j, k in part)


def test_a_long_chain_takes_few_passes(spark):
    """Gaps that shrink to the right: only the last pair is certain at any time, so a round a pair would take 5,000 rounds."""
    n = 10_000
    at = np.cumsum(np.arange(2 * n, n, -1)) / 1e9
    cells = pd.DataFrame({"case_disease": "A", "control_disease": "H", "age": np.arange(n, dtype=float), "sex": "F",
                          "cases": np.arange(n) % 2, "controls": (np.arange(n) + 1) % 2, "score": at})
    status = spark.sparkContext.statusTracker()
    before = len(status.getJobIdsForGroup())
    for stretch in (20_000, 1_500):
        got = matching.match_cells(spark.createDataFrame(cells), stretch).toPandas()
        assert len(got) == n // 2 and (np.abs(got.case_age - got.control_age) == 1).all() and got.k.sum() == n // 2
    assert len(status.getJobIdsForGroup()) - before < 400


def test_matching_with_ties_uses_the_smaller_side(spark):
    meta = pd.DataFrame({"sample_id": range(9), "disease": ["A"] * 6 + ["H"] * 3, "sex": ["F", "M"] * 4 + ["F"], "age": [40.0] * 6 + [41.0, 40.0, 40.0]})
    plan = spark.createDataFrame([("A", "H")], "case_disease string, control_disease string")
    got = matching.match_samples(spark.createDataFrame(meta), plan).toPandas()
    assert len(got) == 3 and got.case_sample.is_unique and got.control_sample.is_unique


def test_knn_impute_and_neighbours_by_brute_force(cohort):
    df, pdf, _, _ = cohort
    wide = pdf.pivot(index="sample_id", columns="assay", values="value")
    x = wide.to_numpy()
    scaled = x / (np.nanmax(x, axis=0) - np.nanmin(x, axis=0))
    got = prepare.knn_impute(df, k=3, block=17).toPandas().pivot(index="sample_id", columns="assay", values="value").to_numpy()
    for i, j in np.argwhere(np.isnan(x)):
        d = np.nanmean(np.abs(scaled - scaled[i]), axis=1)
        d[i] = np.inf
        ok = np.flatnonzero(~np.isnan(x[:, j]))
        best = ok[np.lexsort((ok, d[ok]))][:3]
        assert got[i, j] == pytest.approx(x[best, j].mean(), abs=1e-12)
    vec = df.sparkSession.createDataFrame([(int(i), [float(v) for v in row]) for i, row in enumerate(np.nan_to_num(x))], "id long, v array<double>")
    edges = neighbours.nearest(vec, "id", "v", 4, block=13).toPandas()
    z = np.nan_to_num(x)
    for i, part in edges.groupby("id"):
        d = np.sqrt(((z - z[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert list(part.sort_values("rank").neighbour) == list(np.lexsort((np.arange(len(z)), d))[:4])
    w = neighbours.neighbour_graph(vec.sparkSession.createDataFrame(edges), "id", 4).toPandas()
    assert np.allclose(w.groupby("id").weight.sum(), 2.0, atol=1e-6)


def test_auc_ties_and_missing_class(spark):
    rng = np.random.default_rng(2)
    rows = [("g", float(s), bool(c)) for s, c in zip(rng.integers(0, 12, 80), rng.random(80) < 0.4)] + [("one", 1.0, True), ("one", 2.0, True)]
    df = spark.createDataFrame(rows, "k string, s double, c boolean")
    got = roc.auc(roc.score_levels(df, ["k"], "s", F.col("c")), ["k"]).toPandas().set_index("k")
    a = np.array([r[1] for r in rows if r[0] == "g" and r[2]])
    b = np.array([r[1] for r in rows if r[0] == "g" and not r[2]])
    psi = (a[:, None] > b) + 0.5 * (a[:, None] == b)
    assert got.loc["g", "auc"] == pytest.approx(psi.mean())
    assert got.loc["g", "se"] == pytest.approx(math.sqrt(psi.mean(1).var(ddof=1) / len(a) + psi.mean(0).var(ddof=1) / len(b)))
    assert np.isnan(got.loc["one", "auc"])
    curve = roc.roc_curve(roc.score_levels(df, [], "s", F.col("c")), []).toPandas()
    assert {-np.inf, np.inf} <= set(curve.threshold)


def test_single_logit_solves_the_score_equations(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(3, 2, 300)
    y = rng.random(300) < 1 / (1 + np.exp(-(x - 3)))
    df = spark.createDataFrame([("a", float(v), bool(c)) for v, c in zip(x, y)], "k string, x double, c boolean")
    fit = single.logit_fit(df, ["k"], "x", F.col("c")).toPandas().iloc[0]
    p = 1 / (1 + np.exp(-(fit.intercept + fit.slope * x)))
    assert abs((y - p).sum()) < 1e-5 and abs(((y - p) * x).sum()) < 1e-5


def test_near_zero_variance_edges(spark):
    rows = [("flat", 1.0)] * 100 + [("rare", 0.0)] * 96 + [("rare", 1.0)] * 4 + [("even", float(i % 2)) for i in range(100)] + [("gone", None)] * 5
    out = prepare.near_zero_variance(spark.createDataFrame(rows, "assay string, value double")).toPandas().set_index("assay").nzv
    assert out["flat"] and out["rare"] and not out["even"]


def test_enrichment_score_by_hand(spark):
    rows = [("d", f"g{i}", float(10 - i)) for i in range(20)]
    sets = spark.createDataFrame([("t", f"g{i}") for i in (0, 1, 2, 9)], "term string, gene string")
    df = spark.createDataFrame(rows, "disease string, gene string, score double")
    out = enrich.enrichment(df, sets, sizes=(2, 10), permutations=30).toPandas().iloc[0]
    run, total, best = 0.0, sum(abs(10 - i) for i in (0, 1, 2, 9)), 0.0
    for i in range(20):
        run += abs(10 - i) / total if i in (0, 1, 2, 9) else -1 / 16
        best = run if abs(run) > abs(best) else best
    assert out.es == pytest.approx(best) and 0 < out.p_value <= 1


def test_deals_are_even_permutations():
    for n in (1, 2, 7, 100, 257):
        assert sorted(enrich.deal_places(n, [3], n, 213)[0]) == list(range(1, n + 1))
        assert list(enrich.deal_places(n, [3], 5, 213)[0]) == list(enrich.deal_places(n, [3], n, 213)[0][:5])
    n, deals = 40, 8000
    places = enrich.deal_places(n, np.arange(deals), 6, 213)
    for column in places.T:  # 39 degrees of freedom: 72 is passed once in a thousand
        assert ((np.bincount(column, minlength=n + 1)[1:] - deals / n) ** 2 / (deals / n)).sum() < 80
    gaps = np.abs(places[:, 0] - places[:, 1])
    expected = deals * 2 * (n - np.arange(1, n)) / (n * (n - 1))
    assert ((np.bincount(gaps, minlength=n)[1:] - expected) ** 2 / expected).sum() < 80


def test_null_scores_against_plain_running_sums(spark):
    rows = [("d", f"g{i}", float((i * 7) % 13 - 6)) for i in range(30)] + [("e", f"h{i}", 0.0) for i in range(4)]
    df = spark.createDataFrame(rows, "disease string, gene string, score double")
    ranked = enrich.rank_list(df, "disease", "gene", "score")
    sizes = spark.createDataFrame([("d", 3), ("d", 9), ("d", 30), ("e", 4), ("e", 2)], "disease string, set_size long")
    out = enrich.null_scores(ranked, sizes, "disease", 6, 5).toPandas()
    assert len(out) == 5 * 6
    at = {(r.disease, r.position): abs(r.score) for r in ranked.toPandas().itertuples()}
    length = {"d": 30, "e": 4}
    for (group, size), part in out.groupby(["disease", "set_size"]):
        n, wanted = length[group], []
        for deal in range(1, 7):
            inside = set(enrich.deal_places(n, [deal], size, 5)[0].tolist())
            total, run, best, worst = sum(at[group, p] for p in inside), 0.0, 0.0, 0.0
            for p in range(1, n + 1):
                if p in inside:
                    run += at[group, p] / total if total else 0.0
                else:
                    run -= 1 / (n - size)
                best, worst = max(best, run), min(worst, run)
            wanted.append(0.0 if not total else best if best > -worst + 1e-12 else worst if best < -worst - 1e-12 else 0.0)
        assert sorted(part.null_es) == pytest.approx(sorted(wanted))


def test_histogram_without_facets(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "v double")
    out = layers.histogram(df, [], "v", 5).toPandas().sort_values("bin")
    assert list(out.n) == [2, 2, 2, 2, 3]


def test_plain_prior_without_extra_spread():
    d0, s2 = prior._plain(np.array([0.0]), np.array([0.01]), np.array([0.2]))
    assert np.isinf(d0[0]) and s2[0] == 1.0


def test_tails_on_the_driver_and_then_in_a_column(spark):
    assert T.t_two_sided(1.0, 1.0) == pytest.approx(0.5)
    row = spark.range(1).select(T.t_tail(F.lit(1.0), F.lit(1.0)).alias("p"), T.log_variance_shift(F.lit(4.0)).alias("s")).first()
    assert row.p == pytest.approx(0.5)
    assert T._lgamma(np.array([0.5, 1, 7.25, 30, 1e5])) == pytest.approx([math.lgamma(x) for x in (0.5, 1, 7.25, 30, 1e5)], rel=1e-13, abs=1e-13)


def test_moments_with_large_means(spark):
    df = spark.createDataFrame([("a" if i % 2 else "b", 1e8 + i, float(i % 7), 3.0e8) for i in range(100)], "g string, x double, y double, z double")
    m = linear.moments(df, ["g"], ["x", "y", "z"])
    p = linear.pool(m.withColumn("k", F.lit(1)), ["k"], ["x", "y", "z"]).first()
    assert p.c_x_x == pytest.approx(83325.0) and p.c_z_z == 0 and p.c_x_y == pytest.approx(sum((i - 49.5) * (i % 7) for i in range(100)))


def test_absent_rows_are_missing_values(spark):
    rows = [("s1", "A", 1.0), ("s1", "B", 7.0), ("s2", "A", 1.1), ("s2", "C", 50.0), ("s3", "A", 1.0), ("s3", "B", 7.0), ("s3", "C", 50.0)]
    df = spark.createDataFrame(rows, "sample_id string, assay string, value double")
    vec = {r.sample_id: r.vector for r in reshape.vectors(df, "sample_id", "assay", "value").collect()}
    assert vec == {"s1": [1.0, 7.0, None], "s2": [1.1, None, 50.0], "s3": [1.0, 7.0, 50.0]}
    filled = {(r.sample_id, r.assay): r.value for r in prepare.knn_impute(df, k=1).collect()}
    assert filled[("s2", "B")] == 7.0 and filled[("s1", "C")] == 50.0 and len(filled) == 9


def test_no_sample_is_lost_in_features(spark):
    from cohortia.operators import learn

    df = spark.createDataFrame([("s1", "A", 1.0), ("s2", "A", None), ("s3", "B", 2.0)], "sample_id string, assay string, value double")
    features = spark.createDataFrame([("A", 0.0, 2.0, 0), ("B", 1.0, 1.0, 1)], "assay string, mean double, sd double, row int")
    got = {r.sample_id: r.features.toArray().tolist() for r in learn.feature_vectors(df, features).collect()}
    assert got == {"s1": [0.5, 0.0], "s2": [0.0, 0.0], "s3": [0.0, 1.0]}


def test_a_constant_prediction_has_no_correlation(spark):
    """The strongest penalty leaves the intercept alone: an error of the prediction, but no correlation."""
    rows = [("flat", float(i), 2.5) for i in range(6)] + [("good", float(i), 2.0 * i + 1) for i in range(6)] + [("good", 7.0, None)]
    df = spark.createDataFrame(rows, "g string, y double, p double")
    got = {r.g: r for r in roc.regression_metrics(df, ["g"], "y", "p").collect()}
    assert got["flat"].r2 is None and got["flat"].rmse == pytest.approx(np.sqrt(np.mean((np.arange(6) - 2.5) ** 2)))
    assert got["good"].r2 == pytest.approx(1.0) and got["good"].n == 7


def test_the_report_works_filled_rows_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def looked(v):
        seen.add(1)
        return True

    before = spark.createDataFrame([(i, a, None if i == 2 and a == "x" else 1.0) for i in range(20) for a in "xy"], "sample_id long, assay string, value double")
    after = before.fillna(0.0, subset=["value"]).filter(looked("value"))
    got = prepare.imputation_report(before, after).first()
    assert (got.n_samples, got.n_assays, got.n_imputed) == (20, 2, 1) and got.percent == pytest.approx(100 / 60)
    assert seen.value == 40
