"""Exact ordered operators (rank, running totals, quantiles) for groups of any size.

Rows are dealt by ranges of (group, order), so a range is about one task's share of the data and a
large group lies in several. Windows run inside each range; the totals of earlier ranges of a group are
carried over. Where rows of equal order value share a result, rows are first counted to levels, so
many ties cost no more than one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.session import cut, join_on

_PARTIAL = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_CARRY = {"sum": F.sum, "count": F.sum, "row_number": F.sum, "min": F.min, "max": F.max}


def _along(df: DataFrame, keys: Sequence[str], ordering: Sequence[Column],
           outputs: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """Cumulative columns row by row in the given order."""
    by = [*[F.col(k).asc() for k in keys], *ordering]
    # the write fixes which rows make up a range: both uses below must see the same ones
    dealt = cut(df.repartitionByRange(*by).sortWithinPartitions(*by)
                .withColumns({"__range": F.spark_partition_id(), "__nth": F.monotonically_increasing_id()}))
    part = ["__range", *keys]
    inside = Window.partitionBy(*part).orderBy("__nth")
    framed = inside.rowsBetween(Window.unboundedPreceding, 0)
    made, totals = {}, []
    for name, (fn, col) in outputs.items():
        if fn == "row_number":
            made[name], total = F.row_number().over(inside).cast("long"), F.count(F.lit(1))
        elif fn == "last":
            made[name] = F.last(col, ignorenulls=True).over(framed)
            total = F.max_by(col, F.when(F.col(col).isNotNull(), F.col("__nth")))
        else:
            of = F.lit(1) if col is None else F.col(col)
            made[name], total = _PARTIAL[fn](of).over(framed), _PARTIAL[fn](of)
        totals.append(total.alias(f"__c_{name}"))
    earlier = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__range")
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = dealt.groupBy(*part).agg(*totals).withColumns({
        f"__c_{name}": (F.last(f"__c_{name}", ignorenulls=True) if fn == "last" else _CARRY[fn](f"__c_{name}")).over(earlier)
        for name, (fn, _) in outputs.items()})
    joined = join_on(dealt.withColumns(made), carry, part, "left")
    final = {}
    for name, (fn, _) in outputs.items():
        here, past = F.col(name), F.col(f"__c_{name}")
        if fn == "min":
            final[name] = F.least(here, past)
        elif fn == "max":
            final[name] = F.greatest(here, past)
        elif fn == "last":
            final[name] = F.coalesce(here, past)
        elif fn == "sum":
            final[name] = F.when(here.isNotNull() | past.isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0)))
        else:
            final[name] = here + F.coalesce(past, F.lit(0))
    return joined.withColumns(final).drop("__range", "__nth", *[f"__c_{n}" for n in outputs])


def _by_level(df: DataFrame, keys: Sequence[str], order: str, descending: bool,
              outputs: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """Cumulative columns that rows of equal order value share."""
    partial, steps = {}, {}
    for name, (fn, col) in outputs.items():
        if fn not in ("rank", *_PARTIAL):
            raise ValueError(f"{fn} has no value that ties share")
        of = F.lit(1) if col is None else F.col(col)
        partial[f"__p_{name}"] = F.count(F.lit(1)) if fn == "rank" else _PARTIAL[fn](of)
        steps[name] = ("sum" if fn in ("rank", "count") else fn, f"__p_{name}")
    on = [*keys, order]
    levels = df.groupBy(*on).agg(*[x.alias(n) for n, x in partial.items()])
    run = _along(levels, keys, [F.col(order).desc() if descending else F.col(order).asc()], steps)
    run = run.withColumns({n: F.col(n) - F.col(f"__p_{n}") + 1 for n, (fn, _) in outputs.items() if fn == "rank"})
    return join_on(df, run.drop(*partial), on, "left")


def running(df: DataFrame, keys: Sequence[str], order: str,
            outputs: Mapping[str, tuple[str, str | None]], *, tie_break: Sequence[str] = (),
            descending: bool = False, peers: bool = False) -> DataFrame:
    """Cumulative columns along ``order`` inside each group.

    ``outputs`` maps a new name to ``(fn, column)`` with fn one of sum, count, min, max, last,
    rank, row_number. ``peers`` makes rows of equal order value share the result, as ``rank`` always
    does. ``last`` is the latest non-NULL value. NULL order values are the caller's to remove.
    """
    keys = list(keys)
    shared = {n: o for n, o in outputs.items() if peers or o[0] == "rank"}
    single = {n: o for n, o in outputs.items() if n not in shared}
    out = df
    if single:
        first = F.col(order).desc() if descending else F.col(order).asc()
        out = _along(out, keys, [first, *[F.col(c).asc() for c in tie_break]], single)
    return _by_level(out, keys, order, descending, shared) if shared else out


CELLS = 8192  # per e-fold of a value's size, and of an interval that is looked at again


def _log_cell(value: Column) -> Column:
    """A whole number that never falls as the value grows: equal parts of the logarithm on both sides of zero."""
    v = value.cast("double")
    part = lambda x: F.floor(F.log(x) * CELLS) + 750 * CELLS
    endless = F.lit(float("inf"))
    return (F.when(F.isnan(v), 3000 * CELLS).when(v == endless, 2000 * CELLS).when(v == -endless, -2000 * CELLS)
            .when(v > 0, part(v)).when(v < 0, -part(-v)).when(v == 0, 0)).cast("long")


def _settled(rank: Column, held: Column) -> Column:
    """The value at a rank, where the cell that holds the rank tells it: one value only, or the cell's first or last row."""
    return (F.when((held["lo"] == held["hi"]) | (rank == held["start"]), held["lo"])
            .when(rank == held["start"] + held["n"] - 1, held["hi"]))


def _values_at(rows: DataFrame, on: Sequence[str], value: str, todo: DataFrame) -> DataFrame:
    """Values at ranks inside intervals; ``todo`` holds (keys, tag, rank, held), the result (keys, tag, v).

    An interval is cut into equal cells from its smallest to its largest value, which counts again
    narrow down. Every round splits an interval, down to single values after a few. ``todo`` reads a written table.
    """
    found = []
    while not todo.isEmpty():
        spans = todo.select(*on, "held.cell", F.col("held.lo").alias("__lo"), F.col("held.hi").alias("__hi")).distinct()
        inside = (join_on(rows, spans.withColumnRenamed("cell", "__cell"), [*on, "__cell"], "inner")
                  .filter(F.col(value).between(F.col("__lo"), F.col("__hi"))))
        gone = (F.col(value) - F.col("__lo")).cast("double") / (F.col("__hi") - F.col("__lo")).cast("double")
        part = [*on, "__cell", "__lo"]
        counts = inside.groupBy(*part, F.floor(gone * CELLS).alias("__sub")).agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        along = Window.partitionBy(*part).orderBy("__sub").rowsBetween(Window.unboundedPreceding, 0)
        placed = counts.withColumn("start", F.sum("n").over(along) - F.col("n"))
        asked = todo.select(*on, "tag", (F.col("rank") - F.col("held.start")).alias("rank"),
                            F.col("held.cell").alias("__cell"), F.col("held.lo").alias("__lo"))
        at = (join_on(asked, placed, part, "inner")
              .filter((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("n")))
              .select(*on, "tag", "rank", F.struct("lo", "hi", "start", "n", F.col("__cell").alias("cell")).alias("held")))
        at = cut(at.withColumn("v", _settled(F.col("rank"), F.col("held"))))
        found.append(at.filter(F.col("v").isNotNull()).select(*on, "tag", "v"))
        todo = at.filter(F.col("v").isNull()).drop("v")
    out = None
    for f in found:
        out = f if out is None else out.unionByName(f)
    return out


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], *,
              extra: Sequence[Column] = (), mean: str | None = None, count: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group; NULL values are skipped, NaN is the largest.

    Selection by counts: values are counted in cells of a fixed logarithmic grid, so a hot group is
    combined to its cells before any shuffle, and no row is sorted or written. Only cells that hold a
    wanted rank among several values are looked at again (`_values_at`). ``mean`` and ``count`` name columns
    that the same counts give; ``extra`` holds other aggregate expressions, for one more aggregate over the rows.
    """
    one = "__one"
    base = df if keys else df.withColumn(one, F.lit(1))
    on = list(keys) or [one]
    rows = base.select(*on, value).withColumn("__cell", _log_cell(F.col(value)))
    cells = rows.groupBy(*on, "__cell").agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"),
                                            *([F.sum(value).alias("__sum")] if mean else []))
    every = Window.partitionBy(*on)
    along = every.orderBy(F.col("__cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.withColumns({"__total": F.sum("n").over(every), "start": F.sum("n").over(along) - F.col("n")})
    ends = {f"{tag}_{n}": fn((F.col("__total") - 1) * F.lit(float(p))) for n, p in probs.items()
            for tag, fn in (("lo", F.floor), ("hi", F.ceil))}
    here = F.struct("lo", "hi", "start", "n", F.col("__cell").alias("cell"))
    picked = placed.groupBy(*on).agg(
        F.max("__total").alias("__total"), *([F.sum("__sum").alias("__sum")] if mean else []),
        *[F.max(F.when((rank >= F.col("start")) & (rank < F.col("start") + F.col("n")), here)).alias(f"__at_{t}") for t, rank in ends.items()])
    picked = cut(picked.withColumns({f"__v_{t}": _settled(rank, F.col(f"__at_{t}")) for t, rank in ends.items()}))
    open_ends = F.array(*[F.struct(F.lit(t).alias("tag"), rank.alias("rank"), F.col(f"__at_{t}").alias("held"), F.col(f"__v_{t}").alias("v"))
                          for t, rank in ends.items()])
    todo = (picked.select(*on, F.explode(open_ends).alias("e")).select(*on, "e.*")
            .filter(F.col("v").isNull() & F.col("held").isNotNull()).drop("v"))
    found = _values_at(rows, on, value, todo)
    if found is not None:
        wide = found.groupBy(*on).agg(*[F.max(F.when(F.col("tag") == t, F.col("v"))).alias(f"__f_{t}") for t in ends])
        picked = join_on(picked, wide, on, "left").withColumns({f"__v_{t}": F.coalesce(f"__v_{t}", f"__f_{t}") for t in ends})
    out = picked
    if extra:
        out = join_on(out, base.groupBy(*on).agg(*extra), on, "left")
    made = out.columns[len(picked.columns):]
    h = {n: (F.col("__total") - 1) * F.lit(float(p)) for n, p in probs.items()}
    lo, hi = {n: F.col(f"__v_lo_{n}") for n in probs}, {n: F.col(f"__v_hi_{n}") for n in probs}
    between = {n: F.when(lo[n] == hi[n], lo[n] * F.lit(1.0)).otherwise(lo[n] + (h[n] - F.floor(h[n])) * (hi[n] - lo[n])) for n in probs}
    shared = {**({mean: F.col("__sum") / F.nullif("__total", F.lit(0))} if mean else {}), **({count: F.col("__total")} if count else {})}
    return out.select(*keys, *made, *[c.alias(n) for n, c in {**shared, **between}.items()])


def hash_rank(df: DataFrame, keys: Sequence[str], digest: str, out: str = "rank",
              tie_break: Sequence[str] = ()) -> DataFrame:
    """Position of each row in the order of a hex digest column, per group.

    Digests are spread evenly, so the first two hex digits split every group 256 ways.
    """
    tagged = df.withColumn("__bucket", F.substring(digest, 1, 2))
    part = [*keys, "__bucket"]
    sizes = tagged.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
    before = (Window.partitionBy(*(list(keys) or [F.lit(0)])).orderBy("__bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    every = Window.partitionBy(*(list(keys) or [F.lit(0)]))
    offsets = sizes.withColumns({
        "__before": F.coalesce(F.sum("__n").over(before), F.lit(0)),
        "group_size": F.sum("__n").over(every)}).drop("__n")
    inner = Window.partitionBy(*part).orderBy(digest, *tie_break)
    ranked = tagged.withColumn(out, F.row_number().over(inner))
    return (join_on(ranked, offsets, part, "left")
            .withColumn(out, (F.col(out) + F.col("__before")).cast("long"))
            .drop("__bucket", "__before"))
