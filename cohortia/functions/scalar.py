"""Column expressions: flags, bands, labels and p-value helpers (all JVM-side)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Detectability labels.
NEVER, ALWAYS, RARELY, MOSTLY = "None", "All", "Some: < 50%", "Some: > 50%"

# Upper bounds (inclusive) and labels of the time-to-diagnosis bands, by granularity.
TIME_BANDS = {
    7: [(-7.0, "> 7 years before"), (-5.0, "5-7 years before"), (-3.0, "3-5 years before"),
        (-1.0, "1-3 years before"), (1.0, "1 year before/after"), (3.0, "1-3 years after"),
        (None, "> 3 years after")],
    5: [(-5.0, "> 5 years before"), (-3.0, "3-5 years before"), (-1.0, "1-3 years before"),
        (1.0, "1 year before/after"), (None, "> 1 year after")],
    3: [(-3.0, "> 3 years before"), (0.0, "Up to 3 years before"), (None, "After diagnosis")],
}

# Significance labels and the five (name, p cutoff, fold-change cutoff) settings.
UP, DOWN, NOT_SIGNIFICANT = "significant up", "significant down", "not significant"
THRESHOLDS = [("original", 0.05, 0.5), ("FC1_pval05", 0.05, 1.0), ("FC05_pval005", 0.005, 0.5),
              ("FC1_pval005", 0.005, 1.0), ("FC1_pval0005", 0.0005, 1.0)]
P_FLOOR = 1e-320


def above(value: Column, limit: Column, yes: str = "Yes", no: str = "No") -> Column:
    """Yes/No flag; NULL when either side is NULL."""
    return F.when(value > limit, yes).when(value <= limit, no)


def band(value: Column, bands: Sequence[tuple[float | None, str]]) -> Column:
    """Label by the first upper bound (inclusive) the value does not exceed; None is open."""
    out = None
    for upper, label in bands:
        test = value.isNotNull() if upper is None else value <= upper
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def detect_class(share: Column) -> Column:
    """Detectability class of a share of visits; shares above one have no class."""
    return (F.when(share == 0, NEVER).when(share == 1, ALWAYS)
            .when((share > 0) & (share <= 0.5), RARELY)
            .when((share < 1) & (share > 0.5), MOSTLY))


def years_to_diagnosis(age_sampled: Column, age_diagnosed: Column) -> Column:
    return age_sampled - age_diagnosed


def time_band(years: Column, granularity: int = 5) -> Column:
    return band(years, TIME_BANDS[granularity])


def recode(value: Column, mapping: Mapping[str, str]) -> Column:
    """Replace listed values, keep the others."""
    if not mapping:
        return value
    out = None
    for old, new in mapping.items():
        out = F.when(value == old, new) if out is None else out.when(value == old, new)
    return out.otherwise(value)


def sentinel_null(value: Column, sentinel: object) -> Column:
    return F.nullif(value, F.lit(sentinel))


def case_control(value: Column, case: str, controls: Sequence[str] | None = None,
                 case_label: str = "1_Case", control_label: str = "0_Control") -> Column:
    """Case or control; with ``controls`` given, other values become NULL."""
    rest = value.isin(list(controls)) if controls is not None else value != case
    return F.when(value == case, case_label).when(rest, control_label)


def interest_group(value: Column, named: Mapping[str, str], other: str = "Other") -> Column:
    """Named groups keep their label, all remaining values share one."""
    out = None
    for old, new in named.items():
        out = F.when(value == old, new) if out is None else out.when(value == old, new)
    return out.otherwise(F.lit(other))


def to_number(text: Column, decimal_comma: bool = False) -> Column:
    """Text to double; what does not parse becomes NULL."""
    return (F.replace(text, F.lit(","), F.lit(".")) if decimal_comma else text).try_cast("double")


def neg_log10(p: Column) -> Column:
    return -F.log10(p)


def p_floor(p: Column, floor: float = P_FLOOR) -> Column:
    return F.when(p == 0, F.lit(floor)).otherwise(p)


def significance(adj_p: Column, effect: Column, p_cut: float | Column = 0.05,
                 effect_cut: float | Column = 0.0) -> Column:
    cut = effect_cut if isinstance(effect_cut, Column) else F.lit(effect_cut)
    return (F.when((adj_p < p_cut) & (effect < -cut), DOWN)
            .when((adj_p < p_cut) & (effect > cut), UP).otherwise(NOT_SIGNIFICANT))


def replication(in_first: Column, in_second: Column) -> Column:
    """Replicated in both cohorts, new in the second only, other else."""
    return (F.when(in_first & in_second, "replicated").when(~in_first & in_second, "new")
            .otherwise("other"))


def prediction_offset(truth: Column, predicted: Column) -> Column:
    return truth - predicted


def label_above(value: Column, threshold: float) -> Column:
    """The value as text above the threshold, blank otherwise."""
    return F.when(value > threshold, value.cast("string")).otherwise("")


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of the rows that hold both (an aggregate); NULL where either does not vary."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    varies = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
