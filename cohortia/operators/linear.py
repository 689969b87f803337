"""Per-assay linear models from grouped moments.

Facts are reduced once to counts, means and centred cross-products per (assay, group); every
model below is arithmetic on those few rows, kept in generated column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.cohort import DEFAULT, Cohort
from cohortia.functions.scalar import significance
from cohortia.functions.tails import chi2_tail, f_tail, log_variance_shift, t_tail, t_upper_point, trigamma_half
from cohortia.operators.ordered import quantiles, running
from cohortia.operators.windows import attach_totals, bh_adjust
from cohortia.session import cut, join_on

TOLERANCE = 1e-9


def _pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations_with_replacement(names, 2))


def _clean(expr: str, scale: str, square: bool) -> Column:
    """A centred sum; a square that is only rounding noise next to its squared mean becomes zero."""
    return F.expr(f"CASE WHEN {expr} > 1e-26D * {scale} THEN {expr} ELSE 0D END" if square else expr)


def moments(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Count, means and centred cross-products of the named columns per group, complete rows only.

    Spark merges centred moments of partial aggregates, so large means cancel nothing.
    """
    whole = df.filter(" AND ".join(f"`{v}` IS NOT NULL" for v in names))
    sums = whole.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in names],
        *[F.expr(f"var_pop(`{a}`)" if a == b else f"covar_pop(`{a}`, `{b}`)").alias(f"q_{a}_{b}") for a, b in _pairs(names)])
    return sums.select(*keys, "n", *[f"mean_{v}" for v in names], *[
        _clean(f"n * `q_{a}_{b}`", f"n * `mean_{a}` * `mean_{a}`", a == b).alias(f"c_{a}_{b}") for a, b in _pairs(names)])


def pool(mom: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Merge the moments of several groups into those of their union.

    Adds ``w_*``, the cross-products within the merged groups. Group means are taken from the mean of
    the union before they are multiplied.
    """
    centred = attach_totals(mom, keys, **{f"__m_{v}": F.expr(f"sum(n * `mean_{v}`) / sum(n)") for v in names})
    out = [F.expr("sum(n) AS n"), F.expr("count(1) AS groups"), *[F.max(f"__m_{v}").alias(f"mean_{v}") for v in names]]
    for a, b in _pairs(names):
        between = f"sum(n * (`mean_{a}` - `__m_{a}`) * (`mean_{b}` - `__m_{b}`))"
        scale = f"sum(n * `mean_{a}` * `mean_{a}`)"
        out += [F.expr(f"sum(`c_{a}_{b}`)").alias(f"w_{a}_{b}"),
                (F.expr(f"sum(`c_{a}_{b}`)") + _clean(between, scale, a == b)).alias(f"c_{a}_{b}")]
    return centred.groupBy(*keys).agg(*out)


def sweep(df: DataFrame, prefix: str, xs: Sequence[str], y: str) -> DataFrame:
    """Sweep the covariates out of a symmetric cross-product matrix held in columns.

    Afterwards ``<prefix>_b_<x>`` is a coefficient, ``<prefix>_v_<a>_<b>`` the inverse and
    ``<prefix>_rss`` the residual sum of squares. A covariate without variation of its own is
    left out: its coefficient is NULL and it costs no degree of freedom (``<prefix>_rank``).
    """
    names, q = [*xs, y], len(xs) + 1
    cell = {}
    for a, b in _pairs(names):
        cell[a, b] = cell[b, a] = f"coalesce(CAST(`{prefix}_{a}_{b}` AS DOUBLE), 0D)"
    m, live = f"__{prefix}_m", f"__{prefix}_live"
    start = ", ".join(cell[a, b] for a in names for b in names)
    out = df.withColumns({m: F.expr(f"array({start})"), live: F.expr("CAST(array() AS ARRAY<BOOLEAN>)")})
    for k, name in enumerate(xs):
        d, r, c = f"{m}[{k * q + k}]", f"(i div {q})", f"(i % {q})"
        swept = (f"CASE WHEN {r} = {k} AND {c} = {k} THEN 1 / {d} WHEN {r} = {k} THEN v / {d} WHEN {c} = {k} THEN -v / {d} "
                 f"ELSE v - {m}[int({r} * {q} + {k})] * {m}[int({k * q} + {c})] / {d} END")
        step = f"transform({m}, (v, i) -> CASE WHEN __keep THEN {swept} WHEN {r} = {k} OR {c} = {k} THEN 0D ELSE v END)"
        keep = f"{d} > {TOLERANCE!r}D * greatest(abs({cell[name, name]}), 1e-12D)"
        out = (out.withColumn("__keep", F.expr(keep))
               .withColumns({m: F.expr(step), live: F.expr(f"array_append({live}, __keep)")}))
    made = {f"{prefix}_rss": f"{m}[{q * q - 1}]", f"{prefix}_rank": f"size(filter({live}, v -> v))"}
    for i, a in enumerate(xs):
        made[f"{prefix}_b_{a}"] = f"CASE WHEN {live}[{i}] THEN {m}[{i * q + q - 1}] END"
        for j, b in enumerate(xs):
            made[f"{prefix}_v_{a}_{b}"] = f"{m}[{i * q + j}]"
    return out.withColumns({n: F.expr(e) for n, e in made.items()}).drop(m, live, "__keep")


def numeric_sex(sex: Column, reference: str = "F") -> Column:
    return F.when(sex.isNotNull(), (sex != reference).cast("double"))


def anova(long: DataFrame, covariates: Sequence[str] = ("age", "sex", "bmi"), p_values: bool = True,
          cohort: Cohort = DEFAULT) -> DataFrame:
    """Type-III table of ``value ~ covariates + disease`` per assay.

    A text ``sex`` column is coded 0/1. One row per term (also intercept and residuals) with
    sum of squares, df, F, partial eta squared in percent and, if asked for, the p-value.
    """
    c, xs, y = cohort, list(covariates), "y"
    rows = long.select(c.assay, c.disease, F.col(c.value).alias(y), *[
        numeric_sex(F.col(x)).alias(x) if x == c.sex else F.col(x).cast("double").alias(x) for x in xs])
    names = [*xs, y]
    groups = moments(rows, [c.assay, c.disease], names)
    both = sweep(sweep(pool(groups, [c.assay], names), "w", xs, y), "c", xs, y)
    first = groups.groupBy(c.assay).agg(F.min_by(F.struct("n", *[f"mean_{v}" for v in names]), c.disease).alias("ref"))
    m = both.join(first, c.assay)
    df_res = F.col("n") - F.col("groups") - F.col("w_rank")
    ms = F.col("w_rss") / df_res
    intercept = F.col(f"ref.mean_{y}") - sum((F.coalesce(F.col(f"w_b_{x}"), F.lit(0.0)) * F.col(f"ref.mean_{x}") for x in xs), F.lit(0.0))
    spread = 1 / F.col("ref.n") + sum((F.col(f"w_v_{a}_{b}") * F.col(f"ref.mean_{a}") * F.col(f"ref.mean_{b}")
                                       for a in xs for b in xs), F.lit(0.0))
    nothing = F.lit(None).cast("double")

    def row(term: str, ss: Column, df: Column, tested: bool = True, effect: bool = True) -> Column:
        return F.struct(F.lit(term).alias("term"), ss.alias("ss"), df.cast("long").alias("df"),
                        (F.when(df > 0, ss / df / ms) if tested else nothing).alias("f"),
                        (F.when(df > 0, ss / (ss + F.col("w_rss")) * 100) if effect else nothing).alias("eta2_percent"))

    terms = [row("(Intercept)", intercept * intercept / spread, F.lit(1), effect=False)]
    for x in xs:
        terms.append(row(x, F.pow(F.col(f"w_b_{x}"), 2) / F.col(f"w_v_{x}_{x}"),
                         F.when(F.col(f"w_b_{x}").isNotNull(), 1).otherwise(0)))
    terms.append(row(c.disease, F.col("c_rss") - F.col("w_rss"), F.col("groups") - 1 + F.col("w_rank") - F.col("c_rank")))
    terms.append(row("Residuals", F.col("w_rss"), df_res, tested=False, effect=False))
    out = (m.withColumn("df_residual", df_res.cast("long"))
           .select(c.assay, "df_residual", F.explode(F.array(*terms)).alias("t")).select(c.assay, "df_residual", "t.*"))
    if p_values:
        out = out.withColumn("p_value", f_tail(F.col("f"), F.col("df"), F.col("df_residual")))
    return out.drop("df_residual")


# --- contrasts ------------------------------------------------------------------------------

def contrast_plan(meta: DataFrame, control: str, healthy: str = "Healthy",
                  sexes: DataFrame | None = None, cohort: Cohort = DEFAULT) -> DataFrame:
    """Control diseases of every disease: ``Healthy``, its ``Class``, or ``All other diseases``.

    One row per (case disease, control disease), so it stays as small as the disease list
    squared and facts are never copied to plan a contrast. ``sexes`` (disease, sex) drops
    controls that share no sex with the case.
    """
    c = cohort
    dis = meta.select(c.disease, c.klass).distinct()
    cases = dis.filter(F.col(c.disease) != healthy).select(
        F.col(c.disease).alias("case_disease"), F.col(c.klass).alias("__class"))
    if control == "Healthy":
        plan = cases.withColumn("control_disease", F.lit(healthy))
    elif control == "Class":
        plan = cases.join(dis.select(F.col(c.disease).alias("control_disease"), F.col(c.klass).alias("__class")), "__class")
    elif control == "All other diseases":
        from cohortia.operators.joins import level_pairs
        others = dis.filter(F.col(c.disease) != healthy)
        plan = level_pairs(others, c.disease, ("case_disease", "control_disease"))
    else:
        raise ValueError(f"unknown control {control!r}")
    plan = plan.filter("case_disease <> control_disease").select("case_disease", "control_disease")
    if sexes is not None:
        a = sexes.select(F.col(c.disease).alias("case_disease"), c.sex)
        b = sexes.select(F.col(c.disease).alias("control_disease"), c.sex)
        shared = plan.join(a, "case_disease").join(b, ["control_disease", c.sex]).select("case_disease", "control_disease")
        plan = plan.join(shared.distinct(), ["case_disease", "control_disease"], "left_semi")
    return plan.withColumn("control", F.lit(control))


def contrast_members(plan: DataFrame, meta: DataFrame, matched: DataFrame | None = None,
                     matched_cases: DataFrame | None = None, cohort: Cohort = DEFAULT) -> DataFrame:
    """(control, contrast, sample, role) of planned contrasts.

    ``matched`` (case_disease, control_disease, sample) keeps only matched control samples;
    ``matched_cases`` (control, case_disease, sample) lists the cases of the controls it names, whose
    contrasts leave unmatched cases out (as against healthy samples); other contrasts keep all cases.
    """
    c = cohort
    sick = meta.select(c.sample, F.col(c.disease).alias("case_disease"))
    cases = (plan.select("control", "case_disease").distinct().join(sick, "case_disease")
             .select("control", F.col("case_disease").alias("contrast"), c.sample, F.lit("case").alias("role")))
    if matched_cases is not None:
        strict = matched_cases.select("control").distinct()
        some = matched_cases.select("control", F.col("case_disease").alias("contrast"), c.sample, F.lit("case").alias("role"))
        cases = cases.join(strict, "control", "left_anti").unionByName(some)
    if matched is None:
        well = meta.select(c.sample, F.col(c.disease).alias("control_disease"))
        controls = plan.join(well, "control_disease")
    else:
        controls = plan.join(matched, ["case_disease", "control_disease"])
    return cases.unionByName(controls.select(
        "control", F.col("case_disease").alias("contrast"), c.sample, F.lit("control").alias("role"))).distinct()


def contrast_moments(long: DataFrame, members: DataFrame, names: Sequence[str], keys: Sequence[str],
                     cohort: Cohort = DEFAULT) -> DataFrame:
    """Moments per (contrast, assay, role). A sample's contrasts ride along as one array, so
    the fact table crosses the join once and is multiplied only inside the partial aggregate."""
    c = cohort
    packed = members.groupBy(c.sample).agg(F.collect_list(F.struct(*keys, "role")).alias("__in"))
    rows = (long.join(packed, c.sample).select(c.assay, *names, F.explode("__in").alias("__m"))
            .select(c.assay, *names, "__m.*"))
    return moments(rows, [*keys, c.assay, "role"], names)


def group_contrast_moments(long: DataFrame, plan: DataFrame, names: Sequence[str],
                           cohort: Cohort = DEFAULT) -> DataFrame:
    """Moments per (contrast, assay, role) for contrasts made of whole diseases.

    Facts are aggregated once per (assay, disease); contrasts merge those rows.
    """
    c = cohort
    per = moments(long, [c.assay, c.disease], names)
    named = plan.select("control", F.col("case_disease").alias("contrast"), F.col("control_disease").alias(c.disease))
    roles = (plan.select("control", F.col("case_disease").alias("contrast"), F.col("case_disease").alias(c.disease)).distinct()
             .withColumn("role", F.lit("case")).unionByName(named.withColumn("role", F.lit("control"))))
    merged = pool(per.join(roles, c.disease), ["control", "contrast", c.assay, "role"], names)
    return merged.drop("groups", *[f"w_{a}_{b}" for a, b in _pairs(names)])


def contrast_fit(mom: DataFrame, keys: Sequence[str], covariates: Sequence[str],
                 design: DataFrame | None = None, cohort: Cohort = DEFAULT) -> DataFrame:
    """Case minus control effect of each (contrast, assay) from its two rows of moments.

    ``design`` gives, per contrast, 0/1 columns ``use_<covariate>``; covariates without
    variation in a contrast drop out by themselves. Effects need both roles present.
    """
    c, xs, y = cohort, list(covariates), "y"
    names = [*xs, y]
    on = [*keys, c.assay]
    means = [F.max(F.when(F.col("role") == r, F.col(col))).alias(f"{col}_{r}")
             for r in ("case", "control") for col in ["n", *[f"mean_{v}" for v in names]]]
    wide = mom.groupBy(*on).agg(*means, *[F.sum(f"c_{a}_{b}").alias(f"w_{a}_{b}") for a, b in _pairs(names)])
    wide = wide.filter("n_case > 0 AND n_control > 0")
    if design is not None:
        wide = join_on(wide, design, keys, "left")
        for x in xs:
            use = F.coalesce(F.col(f"use_{x}"), F.lit(0))
            wide = wide.withColumns({f"w_{a}_{b}": F.col(f"w_{a}_{b}") * use for a, b in _pairs(names) if x in (a, b)})
        wide = wide.drop(*[f"use_{x}" for x in xs])
    fit = sweep(wide, "w", xs, y)
    gap = {v: F.col(f"mean_{v}_case") - F.col(f"mean_{v}_control") for v in names}
    effect = gap[y] - sum((F.coalesce(F.col(f"w_b_{x}"), F.lit(0.0)) * gap[x] for x in xs), F.lit(0.0))
    unscaled = (1 / F.col("n_case") + 1 / F.col("n_control")
                + sum((F.col(f"w_v_{a}_{b}") * gap[a] * gap[b] for a in xs for b in xs), F.lit(0.0)))
    n = F.col("n_case") + F.col("n_control")
    out = fit.select(
        *on, F.col("n_case"), F.col("n_control"), effect.alias("log_fc"),
        ((F.col("n_case") * F.col(f"mean_{y}_case") + F.col("n_control") * F.col(f"mean_{y}_control")) / n).alias("average"),
        F.sqrt(unscaled).alias("stdev_unscaled"), (n - 2 - F.col("w_rank")).cast("double").alias("df"), F.col("w_rss"))
    s2 = F.when(F.col("df") > 0, F.col("w_rss") / F.col("df"))
    return (out.withColumn("s2", s2).drop("w_rss")
            .withColumn("se", F.sqrt("s2") * F.col("stdev_unscaled"))
            .withColumn("t", F.col("log_fc") / F.col("se")))


def pick_design(meta: DataFrame, plan: DataFrame, correct: bool = True, pediatric: Sequence[str] = (),
                healthy: str = "Healthy", cohort: Cohort = DEFAULT) -> DataFrame:
    """Which covariates each contrast adjusts for: age only for a one-sex disease, sex only for
    a pediatric disease against healthy, both otherwise, none when uncorrected."""
    c = cohort
    seen = meta.groupBy(F.col(c.disease).alias("contrast")).agg(F.countDistinct(c.sex).alias("__sexes"))
    young = (F.col("contrast").isin(list(pediatric)) if pediatric else F.lit(False)) & (F.col("control") == healthy)
    one_sex = F.col("__sexes") < 2
    out = plan.select("control", F.col("case_disease").alias("contrast")).distinct().join(seen, "contrast", "left")
    if not correct:
        return out.select("control", "contrast", F.lit(0).alias("use_sex"), F.lit(0).alias("use_age"))
    return out.select("control", "contrast", F.when(one_sex, 0).otherwise(1).alias("use_sex"),
                      F.when(young & ~one_sex, 0).otherwise(1).alias("use_age"))


# --- moderated variances --------------------------------------------------------------------

def variance_prior(fit: DataFrame, keys: Sequence[str], robust: bool = False,
                   winsor: tuple[float, float] = (0.05, 0.1)) -> DataFrame:
    """Prior df and variance of each contrast, from the spread of its log variances.

    ``robust`` pulls log variances beyond the given lower and upper tail shares in to those
    quantiles first, and matches the moments of an equally trimmed F distribution.
    """
    from cohortia.operators.prior import plain_prior, robust_prior

    live = (fit.filter((F.col("s2") > 0) & (F.col("df") > 0))
            .withColumn("z", F.log("s2") - log_variance_shift(F.col("df")))
            .withColumn("__tri", trigamma_half(F.col("df"))))
    one = "__one"
    base = live if keys else live.withColumn(one, F.lit(1))
    on = list(keys) or [one]
    plain = base.groupBy(*on).agg(F.avg("z").alias("z_mean"), F.var_samp("z").alias("z_var"),
                                  F.avg("__tri").alias("tri"), F.count(F.lit(1)).alias("n_assays"))
    if not robust:
        out = plain_prior(plain)
    else:
        raw = base.withColumn("lz", F.log("s2"))
        q = quantiles(raw, on, "lz", {"lo": winsor[0], "hi": 1 - winsor[1]}, extra=[F.avg("df").alias("df_mean")])
        inside = (join_on(raw.select(*on, "lz"), q, on, "inner")
                  .withColumn("lz", F.least(F.greatest("lz", "lo"), "hi")))
        w = inside.groupBy(*on).agg(F.avg("lz").alias("w_mean"), F.var_samp("lz").alias("w_var"), F.max("df_mean").alias("df_mean"))
        out = robust_prior(join_on(plain, w, on, "inner"), winsor)
    return out.select(*keys, "prior_df", "prior_s2")


def assay_priors(fit: DataFrame, prior: DataFrame, keys: Sequence[str], assay: str) -> DataFrame:
    """Prior df of each assay: variances that the prior cannot explain get a smaller share of it.

    The upper tail of a variance under the prior, over the share of assays at least as variable, is the
    chance that it is no outlier (1 at most). It mixes the contrast's prior df with one so small that
    the largest variance would be a median one. Along falling tails the result never falls; the most variable assays
    share the least running mean. Where the prior has infinite df, outliers get their chance of the
    pooled df instead. Tails below 1e-300 count as that; assays without a variance keep the contrast's df.
    """
    on = [*keys, assay]
    held = join_on(fit.select(*on, "s2", "df"), prior, keys, "inner")
    live = attach_totals(held.filter((F.col("s2") > 0) & (F.col("df") > 0)), keys,
                         __pooled=F.sum("df"), __n=F.count(F.lit(1)))
    endless = F.col("prior_df") == F.lit(float("inf"))
    live = live.withColumns({"__f": F.col("s2") / F.col("prior_s2"), "__d0": F.least("prior_df", "__pooled"), "__endless": endless})
    upper = lambda d2: F.greatest(F.when(F.col("__endless"), chi2_tail(F.col("df") * F.col("__f"), F.col("df")))
                                  .otherwise(f_tail(F.col("__f"), F.col("df"), d2)), F.lit(1e-300))
    tails = live.withColumn("__tail", upper(F.col("__d0"))).select(*on, "df", "__f", "__d0", "__pooled", "__n", "__endless", "__tail")
    placed = cut(running(tails, keys, "__tail", {"__k": ("row_number", None)}, tie_break=[assay]))
    worst = placed.filter("__k = 1")
    small = F.log(F.lit(0.5)) / F.log(F.least("__tail", F.lit(0.5))) * F.col("__d0")
    worst = worst.withColumn("__small", small).withColumn("__again", upper(F.col("__small")))
    worst = worst.select(*keys, (F.log(F.lit(0.5)) / F.log(F.least("__again", F.lit(0.5))) * F.col("__small")).alias("__least"))
    chance = F.least(F.col("__tail") * F.col("__n") / (F.col("__k") - 0.5), F.lit(1.0))
    mixed = F.when(~F.col("__endless"), chance * F.col("__d0") + (1 - chance) * F.col("__least")).when(
        chance < 1, chance * F.col("__pooled")).otherwise(F.lit(float("inf")))
    shrunk = join_on(placed, worst, keys, "inner").withColumn("__df", mixed)
    means = cut(running(shrunk, keys, "__k", {"__run": ("sum", "__df")}))
    least = F.min_by(F.struct((F.col("__run") / F.col("__k")).alias("m"), F.col("__k").alias("k")),
                     F.struct(F.col("__run") / F.col("__k"), F.col("__k")))
    level = attach_totals(means, keys, __least_mean=least)
    level = level.withColumn("__df", F.when(~F.col("__endless") & (F.col("__k") <= F.col("__least_mean.k")), F.col("__least_mean.m"))
                             .otherwise(F.col("__df")))
    risen = running(level.select(*on, "__k", "__df"), keys, "__k", {"__own": ("max", "__df")})
    return (join_on(held, risen.select(*on, "__own"), on, "left")
            .select(*on, F.coalesce("__own", "prior_df").alias("prior_df"), "prior_s2"))


def moderate(fit: DataFrame, prior: DataFrame, keys: Sequence[str], level: float = 0.95,
             tails: bool = True, assay: str | None = None) -> DataFrame:
    """Posterior variance, moderated t and, with ``tails``, its p-value and interval.

    ``prior`` has a row for each contrast or, where ``assay`` names its column, for each contrast and assay.
    """
    on = [*keys, assay] if assay else keys
    joined = attach_totals(join_on(fit, prior, on, "left"), keys, __pooled=F.sum("df"))
    endless = F.col("prior_df") == F.lit(float("inf"))
    s2 = F.when(endless, F.col("prior_s2")).otherwise(
        (F.col("prior_df") * F.col("prior_s2") + F.col("df") * F.col("s2")) / (F.col("prior_df") + F.col("df")))
    out = (joined.withColumn("s2_post", s2)
           .withColumn("se_post", F.sqrt("s2_post") * F.col("stdev_unscaled"))
           .withColumn("t_mod", F.col("log_fc") / F.col("se_post"))
           .withColumn("df_total", F.least(F.col("df") + F.col("prior_df"), F.col("__pooled"))).drop("__pooled"))
    if not tails:
        return out
    out = (out.withColumn("p_value", t_tail(F.col("t_mod"), F.col("df_total")))
           .withColumn("__q", t_upper_point(F.lit((1 - level) / 2), F.col("df_total"))))
    return (out.withColumns({"ci_low": F.col("log_fc") - F.col("__q") * F.col("se_post"),
                             "ci_high": F.col("log_fc") + F.col("__q") * F.col("se_post")}).drop("__q"))


def differential(fit: DataFrame, keys: Sequence[str], robust: bool = True, p_cut: float = 0.05,
                 effect_cut: float = 0.0, assay: str = DEFAULT.assay) -> DataFrame:
    """Moderated test of every (contrast, assay), adjusted per contrast, with its call.

    ``robust`` fits the prior to pulled-in log variances and gives outlying assays a prior df of their own.
    """
    once = cut(fit)
    prior = variance_prior(once, keys, robust)
    if robust:
        prior = assay_priors(once, cut(prior), keys, assay)
    tested = cut(moderate(once, prior, keys, assay=assay if robust else None))
    adjusted = bh_adjust(tested, keys)
    return adjusted.withColumn("sig", significance(F.col("adj_p"), F.col("log_fc"), p_cut, effect_cut))


def threshold_calls(results: DataFrame, thresholds: Sequence[tuple[str, float, float]], p: str = "adj_p",
                    effect: str = "log_fc") -> DataFrame:
    """Significance call under every named threshold, one row per threshold."""
    t = F.array(*[F.struct(F.lit(n).alias("threshold"), F.lit(a).alias("__p"), F.lit(b).alias("__fc")) for n, a, b in thresholds])
    long = results.withColumn("__t", F.explode(t)).select("*", "__t.*").drop("__t")
    return long.withColumn("sig", significance(F.col(p), F.col(effect), F.col("__p"), F.col("__fc"))).drop("__p", "__fc")
