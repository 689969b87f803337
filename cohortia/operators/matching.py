"""Propensity scores and one-to-one matching for many case/control disease pairs at once.

Samples of a disease with equal age and sex form one cell, so everything iterative runs on
cells. Matching needs no candidate pairs: scores lie on a line, so the nearest free
opposite of a cell is next to it, and stretches of the line are matched side by side.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.cohort import DEFAULT, Cohort
from cohortia.operators.linear import numeric_sex, sweep
from cohortia.operators.ordered import running
from cohortia.session import cut, join_on

PAIR = ["case_disease", "control_disease"]
#: Digits of a score that count in matching.
DIGITS = 9


def cells(meta: DataFrame, cohort: Cohort = DEFAULT) -> DataFrame:
    """Samples per (disease, age, sex); samples without age or sex are left out."""
    c = cohort
    return (meta.filter(F.col(c.age).isNotNull() & F.col(c.sex).isNotNull())
            .groupBy(c.disease, F.col(c.age).cast("double").alias("age"), F.col(c.sex).alias("sex"))
            .agg(F.count(F.lit(1)).alias("n")))


def pair_cells(meta: DataFrame, plan: DataFrame, cohort: Cohort = DEFAULT) -> DataFrame:
    """Case and control counts of every planned pair per (age, sex); controls are kept to the
    sexes seen among the cases when those are of one sex."""
    c = cohort
    base = cells(meta, c)
    pairs = plan.select(*PAIR).distinct()
    case = pairs.join(base.withColumnRenamed(c.disease, "case_disease"), "case_disease")
    control = pairs.join(base.withColumnRenamed(c.disease, "control_disease"), "control_disease")
    both = (case.select(*PAIR, "age", "sex", F.col("n").alias("cases"), F.lit(0).cast("long").alias("controls"))
            .unionByName(control.select(*PAIR, "age", "sex", F.lit(0).cast("long").alias("cases"), F.col("n").alias("controls")))
            .groupBy(*PAIR, "age", "sex").agg(F.sum("cases").alias("cases"), F.sum("controls").alias("controls")))
    sexes = case.select("case_disease", "sex").distinct()
    return both.join(sexes, ["case_disease", "sex"], "left_semi").withColumn("x_sex", numeric_sex(F.col("sex")))


def propensity(levels: DataFrame, steps: int = 25, tolerance: float = 1e-10) -> DataFrame:
    """Logistic regression of case on age and sex for every pair; adds ``score``.

    One grouped aggregate per Newton step serves all pairs. Age is centred and scaled per pair. A pair that
    sex or age separates has no finite optimum; its scores are 0 or 1 within rounding long before ``steps``.
    """
    w = F.col("cases") + F.col("controls")
    shape = (levels.groupBy(*PAIR).agg(
        (F.sum(w * F.col("age")) / F.sum(w)).alias("m"), (F.sum("cases") / F.sum(w)).alias("rate"),
        F.sum(w).alias("n")))
    spread = (join_on(levels, shape.select(*PAIR, "m"), PAIR, "inner").groupBy(*PAIR)
              .agg(F.sum(w * F.pow(F.col("age") - F.col("m"), 2)).alias("ss")))
    shape = (join_on(shape, spread, PAIR, "inner").withColumn("s", F.sqrt(F.col("ss") / F.col("n")))
        .withColumn("s", F.when(F.col("s") > 1e-9, F.col("s")).otherwise(1.0))
        .filter("rate > 0 AND rate < 1"))
    data = cut(join_on(levels, shape.select(*PAIR, "m", "s"), PAIR, "inner")
               .withColumn("x_age", (F.col("age") - F.col("m")) / F.col("s")).drop("m", "s"))
    beta = cut(shape.select(*PAIR, F.log(F.col("rate") / (1 - F.col("rate"))).alias("b0"),
                            F.lit(0.0).alias("b_sex"), F.lit(0.0).alias("b_age"), F.lit(1.0).alias("move")))
    eta = F.col("b0") + F.col("b_sex") * F.col("x_sex") + F.col("b_age") * F.col("x_age")
    for _ in range(steps):
        p = 1 / (1 + F.exp(-eta))
        at = join_on(data, beta, PAIR, "inner").withColumn("p", p)
        q = w * F.col("p") * (1 - F.col("p"))
        x = {"one": F.lit(1.0), "sex": F.col("x_sex"), "age": F.col("x_age")}
        names = list(x)
        sums = [F.sum(q * x[a] * x[b]).alias(f"h_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
        sums += [F.sum((F.col("cases") - w * F.col("p")) * x[a]).alias(f"h_{a}_g") for a in names]
        hess = at.groupBy(*PAIR).agg(*sums, F.lit(0.0).alias("h_g_g"))
        step = sweep(hess, "h", names, "g")
        clip = lambda n: F.greatest(F.least(F.coalesce(F.col(f"h_b_{n}"), F.lit(0.0)), F.lit(5.0)), F.lit(-5.0))
        d0, d1, d2 = clip("one"), clip("sex"), clip("age")
        beta = cut(join_on(beta, step, PAIR, "inner").select(
            *PAIR, (F.col("b0") + d0).alias("b0"), (F.col("b_sex") + d1).alias("b_sex"),
            (F.col("b_age") + d2).alias("b_age"), F.greatest(F.abs(d0), F.abs(d1), F.abs(d2)).alias("move")))
        if (beta.agg(F.max("move")).first()[0] or 0) < tolerance:
            break
    return join_on(data, beta, PAIR, "inner").withColumn("score", 1 / (1 + F.exp(-eta))).select(
        *PAIR, "age", "sex", "cases", "controls", "score")


class Line:
    """Free cells of one stretch of the score line, matched closest first as far as that is certain.

    Free cells are a linked list; a heap holds neighbouring cells of opposite kind by (distance, place). Beyond either end of
    the stretch (``before``, ``after``: the score where it goes on, None where it does not) anything may lie. When that, or an
    opposite cell whose fate is open already, is no further from the outermost certain cell than the closest pair left, the
    cell's fate is open as well, and so on inwards. Every match made is one of the whole line's.
    """

    def __init__(self, score: np.ndarray, case: np.ndarray, control: np.ndarray, before: int | None = None, after: int | None = None):
        self.score, self.case = score.tolist(), (case > 0).tolist()
        self.left = np.where(case > 0, case, control).tolist()
        n = len(self.score)
        self.back, self.next = list(range(-1, n - 1)), list(range(1, n + 1))
        # nearest that a certain cell of either kind (case: True) might meet on each side outside
        self.low = {True: before, False: before}
        self.high = {True: after, False: after}
        self.first, self.last = 0, n - 1  # outermost certain cells
        self.heap: list[tuple[int, int, int]] = []
        for i in range(n - 1):
            self._pair(i, i + 1)

    def _pair(self, i: int, j: int) -> None:
        if self.case[i] != self.case[j]:
            heapq.heappush(self.heap, (self.score[j] - self.score[i], i, j))

    def _open(self, limit: float) -> bool:
        """Give up one outermost cell that may be matched outside within ``limit``."""
        if self.first > self.last:
            return False
        i, j = self.first, self.last
        if self.low[self.case[i]] is not None and self.score[i] - self.low[self.case[i]] <= limit:
            self.low[not self.case[i]] = self.score[i]
            self.first = self.next[i]
            return True
        if self.high[self.case[j]] is not None and self.high[self.case[j]] - self.score[j] <= limit:
            self.high[not self.case[j]] = self.score[j]
            self.last = self.back[j]
            return True
        return False

    def _leave(self, i: int) -> None:
        b, a = self.back[i], self.next[i]
        if b >= 0:
            self.next[b] = a
        if a < len(self.score):
            self.back[a] = b
        if i == self.first:
            self.first = a
        if i == self.last:
            self.last = b

    def matches(self) -> Iterator[tuple[int, int, int]]:
        """(case cell, control cell, how many)."""
        while self.heap:
            d, i, j = self.heap[0]
            if not self.left[i] or not self.left[j] or self.next[i] != j or i < self.first or j > self.last:
                heapq.heappop(self.heap)
                continue
            if self._open(d):
                continue
            heapq.heappop(self.heap)
            k = min(self.left[i], self.left[j])
            self.left[i] -= k
            self.left[j] -= k
            yield (i, j, k) if self.case[i] else (j, i, k)
            b, a = self.back[i], self.next[j]
            ends = [x for x in (i, j) if not self.left[x]]
            for x in ends:
                self._leave(x)
            inner = [x for x in (i, j) if self.left[x]]
            chain = [x for x in (b, *inner, a) if self.first <= x <= self.last]
            for x, y in zip(chain, chain[1:], strict=False):
                self._pair(x, y)


def match_cells(scored: DataFrame, stretch: int = 20_000) -> DataFrame:
    """Closest-first one-to-one matching of counts on the score line; ties go to the lower score.

    Scores are rounded to `DIGITS` digits, so equal distances are equal whatever the order of sums. Stretches of about
    ``stretch`` cells are matched by themselves as far as what lies beyond their ends cannot matter (`Line`); what is left
    open is dealt to longer stretches, until a pair of diseases has no case or no control left. So the number of passes
    grows with the logarithm of a pair's cells (its distinct ages and sexes), and one pass does where they fit a stretch.
    """
    unit = 10 ** DIGITS
    whole = scored.withColumn("at", F.round(F.col("score") * unit).cast("long"))
    same = F.least("cases", "controls")
    done = [whole.filter(same > 0).select(
        *PAIR, F.col("age").alias("case_age"), F.col("sex").alias("case_sex"), F.col("age").alias("control_age"),
        F.col("sex").alias("control_sex"), same.alias("k"), F.lit(0).cast("long").alias("case_from"),
        F.lit(0).cast("long").alias("control_from"), F.lit(0.0).alias("distance"))]
    state = cut(whole.select(*PAIR, "age", "sex", "at", (F.col("cases") - same).alias("case_left"), (F.col("controls") - same).alias("control_left"),
                             same.alias("case_used"), same.alias("control_used")))
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    made = ["case_age", "case_sex", "control_age", "control_sex", "k", "case_from", "control_from", "distance"]
    out = (", ".join(f"{c} {kinds[c]}" for c in (*PAIR, "age", "sex", "at", "case_left", "control_left", "case_used", "control_used"))
           + f", case_age {kinds['age']}, case_sex {kinds['sex']}, control_age {kinds['age']}, control_sex {kinds['sex']}, k long, case_from long, control_from long, distance double")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        edge = lambda name: None if pd.isna(rows[name].iloc[0]) else int(rows[name].iloc[0])
        line = Line(rows["at"].to_numpy(), rows["case_left"].to_numpy(), rows["control_left"].to_numpy(), edge("before"), edge("after"))
        used = {c: rows[f"{c}_used"].to_numpy().copy() for c in ("case", "control")}
        found = []
        for i, j, k in line.matches():
            found.append((i, j, k, used["case"][i], used["control"][j]))
            used["case"][i] += k
            used["control"][j] += k
        left = rows.assign(case_left=rows["case_left"] - used["case"] + rows["case_used"], control_left=rows["control_left"] - used["control"] + rows["control_used"],
                           case_used=used["case"], control_used=used["control"])
        left = left[(left["case_left"] > 0) | (left["control_left"] > 0)][[*PAIR, "age", "sex", "at", "case_left", "control_left", "case_used", "control_used"]]
        i, j, k, a, b = (np.array(x, int) for x in (zip(*found, strict=True) if found else [()] * 5))
        at = rows["at"].to_numpy()
        met = pd.DataFrame({PAIR[0]: rows[PAIR[0]].iloc[0], PAIR[1]: rows[PAIR[1]].iloc[0],
                            "case_age": rows["age"].to_numpy()[i], "case_sex": rows["sex"].to_numpy()[i], "control_age": rows["age"].to_numpy()[j],
                            "control_sex": rows["sex"].to_numpy()[j], "k": k, "case_from": a, "control_from": b, "distance": np.abs(at[i] - at[j]) / unit})
        return pd.concat([left, met]).reindex(columns=[c.split()[0] for c in out.split(", ")]).astype(
            {c: "Int64" for c in ("at", "case_left", "control_left", "case_used", "control_used", "k", "case_from", "control_from")})

    while True:
        both = state.groupBy(*PAIR).agg(F.sum("case_left").alias("c"), F.sum("control_left").alias("t")).filter("c > 0 AND t > 0").select(*PAIR)
        live = cut(state.filter("case_left > 0 OR control_left > 0").join(both, PAIR, "left_semi"))
        if live.isEmpty():
            break
        dealt = cut(running(live, PAIR, "at", {"pos": ("row_number", None)}, tie_break=["age", "sex"])
                    .withColumn("part", F.floor((F.col("pos") - 1) / stretch).cast("long")))
        ends = cut(dealt.groupBy(*PAIR, "part").agg(F.min("at").alias("lo"), F.max("at").alias("hi")))
        before = ends.select(*PAIR, (F.col("part") + 1).alias("part"), F.col("hi").alias("before"))
        after = ends.select(*PAIR, (F.col("part") - 1).alias("part"), F.col("lo").alias("after"))
        told = dealt.join(before, [*PAIR, "part"], "left").join(after, [*PAIR, "part"], "left")
        passed = cut(told.groupBy(*PAIR, "part").applyInPandas(run, out))
        done.append(passed.filter("k IS NOT NULL").select(*PAIR, *made))
        state = passed.filter("k IS NULL").drop(*made)
        stretch *= 3
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def match_samples(meta: DataFrame, plan: DataFrame, cohort: Cohort = DEFAULT) -> DataFrame:
    """Matched sample pairs of every planned (case disease, control disease)."""
    c = cohort
    found = match_cells(propensity(pair_cells(meta, plan, c)))
    slots = found.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    live = (meta.filter(F.col(c.age).isNotNull() & F.col(c.sex).isNotNull())
            .select(c.sample, F.col(c.disease).alias("d"), F.col(c.age).cast("double").alias("a"), F.col(c.sex).alias("s")))
    ranked = running(live, ["d", "a", "s"], c.sample, {"i": ("row_number", None)})

    def side(role: str) -> DataFrame:
        return ranked.select(F.col(c.sample).alias(f"{role}_sample"), F.col("d").alias(f"{role}_disease"),
                             F.col("a").alias(f"{role}_age"), F.col("s").alias(f"{role}_sex"), F.col("i").alias(f"{role}_i"))

    slots = slots.withColumns({"case_i": F.col("case_from") + F.col("i"), "control_i": F.col("control_from") + F.col("i")})
    on = lambda role: [f"{role}_disease", f"{role}_age", f"{role}_sex", f"{role}_i"]
    return (slots.join(side("case"), on("case")).join(side("control"), on("control"))
            .select(*PAIR, "case_sample", "control_sample", "distance", "case_age", "control_age", "case_sex", "control_sex"))
