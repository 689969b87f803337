"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only.

Each source gets a target of words; a document then has an expected number of copies, the same for
all of its source: target / source size. The whole part is given; the fraction is rounded. Rounding
is pivotal: two documents with fractional probabilities trade words of probability mass at random,
so that the expected words stay the same and one of the two becomes 0 or 1; the other goes on to the
next pair. Documents of a source are dealt into chunks by digest, each chunk is folded to one
fractional document at most, and those residuals are folded again, level by level, as a reduction
tree: a source of n documents has log(n) / log(CHUNK) levels and no task ever holds more than
chunks. What a source takes therefore differs from its target by less than one document.

Randomness is a digest of the seed, the level and the pair, so reruns agree.

Defined results: NULL sources are one source, last in order; NULL or empty texts have size 0 and take
nothing; repeated rows are documents of their own; an empty table gives an empty result; if all
sizes are 0 so are all targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.session import cut, join_on

CHUNK = 48
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Below this a probability counts as 0 or 1 (sums of doubles leave such rests).
EPSILON = 1e-9


def words(text: Column | str) -> Column:
    """Number of words; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _places(df: DataFrame, order: list[Column], totals: list[str]) -> DataFrame:
    """``df`` with ``place`` (from 0, in order) and, for each of ``totals``, the running total ``run_<name>``.

    Rows are dealt by ranges, each range is numbered by itself, and the totals of the ranges are added.
    """
    parted = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
                 .withColumn("__nth", F.monotonically_increasing_id()))
    inside = Window.partitionBy("__part").orderBy("__nth")
    own = parted.withColumns({"place": (F.row_number().over(inside) - 1).cast("long"),
                              **{f"run_{c}": F.sum(c).over(inside) for c in totals}})
    sums = parted.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{c}") for c in totals])
    # one row for each range
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n"),
                       *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in totals])
    out = own.join(sums, "__part")
    return out.select(*df.columns, (F.col("place") + F.col("__n")).alias("place"),
                      *[(F.col(f"run_{c}") + F.col(f"__{c}")).alias(f"run_{c}") for c in totals])


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, source_size, n_docs).

    Weights go round by source in code point order, NULL last. No target is above ``most`` times its
    source; what is over goes to the others by weight. In order of cap over weight the capped sources
    come first, so the level that all others get is found from running totals.
    """
    ordered = _places(sizes, [F.col("source").asc_nulls_last()], [])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = cut(ordered.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")))
    total = weighed.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("weights")).first()
    mass, weight_sum = share * (total["all"] or 0), total["weights"] or 0.0
    ranked = _places(weighed.drop("place"), [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], ["cap", "weight"])
    # the level if this source and all after it are below their caps; the first such source has it
    before = F.col("run_weight") - F.col("weight")
    level = (mass - (F.col("run_cap") - F.col("cap"))) / (weight_sum - before)
    fits = level * F.col("weight") <= F.col("cap")
    found = ranked.filter(fits).agg(F.min_by(level, "place").alias("level")).first()["level"]
    target = F.col("cap") if found is None else F.least("cap", F.col("weight") * F.lit(float(found)))
    return weighed.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def _fold(items: Column, seed: int, level: int) -> Column:
    """(done, rest) of an array of documents: ``done`` have p of 0 or 1, ``rest`` is the fractional one or NULL.

    An item is a struct (h, doc_id, size, base, source_size, target, p); p of ``done`` is rounded.
    """
    def with_p(item: Column, p: Column) -> Column:
        return item.withField("p", p)

    def trade(acc: Column, x: Column) -> Column:
        r = acc["rest"]
        # words that may move to r (so that r is whole or x is out), and to x
        up = F.least(r["size"] * (1 - r["p"]), x["size"] * x["p"])
        down = F.least(r["size"] * r["p"], x["size"] * (1 - x["p"]))

        def moved(m: Column) -> Column:
            u = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), r["h"], x["h"], r["p"]), F.lit(1 << 52)) / float(1 << 52)
            return F.when(u * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"])

        def settled(d: Column) -> Column:
            rp, xp = r["p"] + d / r["size"], x["p"] - d / x["size"]
            return F.struct(with_p(r, _snap(rp)).alias("r"), with_p(x, _snap(xp)).alias("x"))

        def parted(s: Column) -> Column:
            whole = lambda i: (i["p"] == 0) | (i["p"] == 1)
            both = whole(s["r"]) & whole(s["x"])
            rest = F.when(both, F.lit(None)).when(whole(s["r"]), s["x"]).otherwise(s["r"])
            done = F.when(both, F.array(s["r"], s["x"])).when(whole(s["r"]), F.array(s["r"])).otherwise(F.array(s["x"]))
            return F.struct(F.concat(acc["done"], done).alias("done"), rest.alias("rest"))

        traded = _let(F.struct(up.alias("up"), down.alias("down")), lambda m: _let(moved(m), lambda d: _let(settled(d), parted)))
        first = F.struct(acc["done"].alias("done"), x.alias("rest"))
        return F.when(r.isNull(), first).otherwise(traded)

    none = F.filter(items, lambda _: F.lit(False))
    return F.aggregate(items, F.struct(none.alias("done"), F.get(none, F.lit(0)).alias("rest")), trade)


def _snap(p: Column) -> Column:
    return _let(p, lambda q: F.when(q < EPSILON, F.lit(0.0)).when(q > 1 - EPSILON, F.lit(1.0)).otherwise(q))


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken, p), one row for each row of ``df``.

    ``copies`` of a document go into the mix, ``taken`` words in all; ``h`` tells rows of one id apart
    by their text, and rows that are equal in all of these by nothing.
    """
    docs = cut(df.select(df[id_col].alias("doc_id"), df[source].alias("source"), words(df[text]).alias("size"),
                         F.xxhash64(df[id_col], df[source], df[text]).alias("h")))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    goal = cut(targets(sizes))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    chunks = F.greatest(F.ceil(F.col("n_docs") / CHUNK), F.lit(1))
    placed = (join_on(docs, goal, ["source"]).withColumn("rate", rate)
              .withColumn("base", F.floor(F.col("rate") + EPSILON).cast("long"))
              .withColumn("p", _snap(F.col("rate") - F.col("base")))
              .withColumn("chunk", F.pmod(F.xxhash64("h", F.lit(seed)), chunks)))
    item = F.struct("h", "doc_id", "size", "base", "source_size", "target", "p")
    open_ = (F.col("size") > 0) & (F.col("p") > 0) & (F.col("p") < 1)
    whole = placed.filter(~open_).select("source", item.alias("item"))
    level = placed.filter(open_).select("source", "chunk", item.alias("item"))
    widest = goal.agg(F.max("n_docs")).first()[0] or 0
    n_chunks, done, depth = max(-(-widest // CHUNK), 1), [whole], 0
    while True:
        folded = cut(level.groupBy("source", "chunk").agg(F.sort_array(F.collect_list("item")).alias("items"))
                     .select("source", "chunk", _fold(F.col("items"), seed, depth).alias("f")))
        done.append(folded.select("source", F.explode("f.done").alias("item")))
        level = folded.filter("f.rest is not null").select("source", F.floor(F.col("chunk") / CHUNK).alias("chunk"), F.col("f.rest").alias("item"))
        if n_chunks == 1:
            break
        n_chunks, depth = -(-n_chunks // CHUNK), depth + 1
    # one fractional document may be left in a source: it is drawn by its own probability
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(-1), "item.h"), F.lit(1 << 52)) / float(1 << 52)
    done.append(level.select("source", F.col("item").withField("p", F.when(u < F.col("item.p"), F.lit(1.0)).otherwise(F.lit(0.0))).alias("item")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = F.col("item.base") + F.when(F.col("item.size") > 0, F.col("item.p").cast("long")).otherwise(F.lit(0))
    return out.select("item.doc_id", "item.size", "source", "item.source_size", "item.target", copies.cast("long").alias("copies"),
                      (copies * F.col("item.size")).cast("long").alias("taken"), F.col("item.h").alias("h"))
