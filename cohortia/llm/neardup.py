"""Near duplicates by MinHash with tensored banding, verified on full shingle sets.

``collections`` small collections of ``rows`` minhashes are computed; each pair of them forms the key
of one table, so c(c-1)/2 tables need only c * rows minhashes. Two texts meet in a table when both
collections agree. With 10 collections of 2, a pair of similarity 0.85 is missed with probability
7e-5, one of 0.9 with 3e-6.

Texts of equal sets are one class first. In every table key with several classes all meet the
smallest one (a star); links are confirmed on full sets. Classes that are then still outside the
star's component meet the classes of other components of that key, in blocks. Before that, shingles that
only one of the classes left has are counted: a class is as similar to any other as the rest of its
set allows at most, so most edited copies that are linked with nothing are known to be so without being
compared, and a group of many near copies costs about its size. No link between different sets that met in
a table is left out.

Defined results: letters A-Z are lower-cased; under ``k`` words the whole sequence is the only
shingle; NULL texts and texts without words have an empty set and are linked with nothing; each row is
judged by its own text, and rows of one id are one node, linked if any of their texts is; rows with a NULL id
get the component of the texts they match, else NULL; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm import words as W
from cohortia.llm.components import components
from cohortia.session import cut

#: Classes of one key that a task sees at once when components are compared.
BLOCK = 256
#: Chance that the minhash bound may miss a pair right at the similarity.
RARE = 4e-5


@dataclass(frozen=True)
class Banding:
    k: int = 5
    percent: int = 85
    collections: int = 10
    rows: int = 2

    def salts(self) -> np.ndarray:
        return W.mix(np.arange(1, self.collections * self.rows + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))

    def least(self) -> int:
        """Minhashes that have to agree: a pair right at the similarity has fewer with probability below ``RARE``."""
        n, p, below = self.collections * self.rows, self.percent / 100, 0.0
        for k in range(n):
            below += comb(n, k) * p**k * (1 - p) ** (n - k)
            if below >= RARE:
                return k
        return n


def shingle_sets(texts: W.Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(digests, first index of each text and the total): sorted distinct shingles of each text."""
    w = W.Words(texts, lower=True)
    h = w.hashes()
    win, at = W.windows(h, w.doc, k)
    doc = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for j, i in enumerate(short):
            x = np.array([0x51], np.uint64)
            for at_word in range(w.first[i], w.first[i + 1]):  # fewer than k words
                x = W.mix(x + h[at_word:at_word + 1])
            whole[j] = x[0]
        win, doc = np.append(win, whole), np.append(doc, short)
    order = np.lexsort((win, doc))
    win, doc = win[order], doc[order]
    if len(win):
        new = np.ones(len(win), bool)
        new[1:] = (win[1:] != win[:-1]) | (doc[1:] != doc[:-1])
        win, doc = win[new], doc[new]
    return win, np.searchsorted(doc, np.arange(texts.n + 1))


def _signatures(df: DataFrame, id_col: str, text: str, b: Banding) -> DataFrame:
    """(doc_id, n, fp1, fp2, sig): set size, digest of the set, minhashes (NULL where empty)."""
    salts = b.salts()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in W.slices(batch.column(1)):
                win, at = shingle_sets(texts, b.k)
                n = np.diff(at)
                full = np.flatnonzero(n)
                fp = np.zeros((2, texts.n), np.uint64)
                sig = np.zeros((len(full), len(salts)), np.uint32)
                if len(full):
                    heads = at[full]
                    fp[0, full] = np.add.reduceat(W.mix(win), heads)
                    fp[1, full] = np.add.reduceat(W.mix(win ^ np.uint64(0x5DEECE66D)), heads)
                    for i, s in enumerate(salts):
                        x = (win ^ s) * np.uint64(0xFF51AFD7ED558CCD)
                        x ^= x >> np.uint64(32)
                        sig[:, i] = np.minimum.reduceat(x * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(32), heads)
                lists = np.zeros(texts.n + 1, np.int32)
                np.cumsum((n > 0) * len(salts), out=lists[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, texts.n), pa.array(n.astype(np.int64)), pa.array(fp[0].view(np.int64)),
                     pa.array(fp[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(lists), pa.array(sig.view(np.int32).ravel()))],
                    ["doc_id", "n", "fp1", "fp2", "sig"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("doc_id"), df[text].alias("text")).mapInArrow(
        run, f"doc_id {kind}, n long, fp1 long, fp2 long, sig array<int>")


def _sets(df: DataFrame, b: Banding) -> DataFrame:
    """(rep, items) with the sorted 64-bit shingles of (rep, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in W.slices(batch.column(1)):
                win, at = shingle_sets(texts, b.k)
                offs = pa.py_buffer((at * 8).astype(np.int32))
                items = pa.BinaryArray.from_buffers(pa.binary(), texts.n, [None, offs, pa.py_buffer(win)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, texts.n), items], ["rep", "items"])

    kind = df.schema["rep"].dataType.simpleString()
    return df.mapInArrow(run, f"rep {kind}, items binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, b: Banding) -> DataFrame:
    """Pairs (a, b) whose full sets have the asked similarity."""
    joined = (pairs.join(sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), "a")
              .join(sets.select(F.col("rep").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]), kind="stable")
                inter = int(np.count_nonzero(both[1:] == both[:-1]))
                ok[i] = 100 * inter >= b.percent * (len(p) + len(q) - inter)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def _cores(sets: DataFrame) -> DataFrame:
    """(rep, core): how many shingles of each class some other class among ``sets`` has too."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column(0).to_numpy()
            for i in range(batch.num_rows):
                items = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(np.full(len(items), reps[i]))], ["item", "rep"])

    kind = sets.schema["rep"].dataType.simpleString()
    shared = sets.mapInArrow(spread, f"item long, rep {kind}").groupBy("item").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    alone = shared.filter("rep = other").groupBy("rep").agg(F.count("*").alias("own"))
    size = sets.select("rep", (F.length("items") / 8).cast("long").alias("items"))
    return size.join(alone, "rep", "left").select("rep", (F.col("items") - F.coalesce("own", F.lit(0))).alias("core"))


def _outside(members: DataFrame, b: Banding) -> DataFrame:
    """Pairs of one key whose components differ and that may reach the similarity, in blocks.

    ``members``: key, table, rep, n, core, sig, comp and main (the component of the key's star). Only pairs
    with an end outside ``main`` are left to compare. A pair goes on if its set sizes and cores allow the
    similarity and ``Banding.least`` of the minhashes agree, and it does so once: in the table of the first two collections that agree.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rights"),
                                       F.ceil(F.count_if(F.col("comp") != F.col("main")) / BLOCK).cast("int").alias("lefts"))
    seated = members.join(sizes.filter("lefts > 0"), "key")
    seat = F.xxhash64("rep", "key")
    left = (seated.filter("comp != main").withColumn("i", F.pmod(seat, "lefts").cast("int"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rights") - 1))))
    right = (seated.withColumn("j", F.pmod(seat, "rights").cast("int"))
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))))
    right = right.toDF(*[f"r_{c}" for c in right.columns])
    kind = members.schema["rep"].dataType.simpleString()
    lim, least, tables = b.percent, b.least(), list(combinations(range(b.collections), 2))

    def pairs(key, lefts: pa.Table, rights: pa.Table) -> pa.Table:
        a, an, ac, ao = (lefts.column(c).to_numpy() for c in ("rep", "n", "comp", "core"))
        r, rn, rc, rm, ro = (rights.column(f"r_{c}").to_numpy() for c in ("rep", "n", "comp", "main", "core"))
        asig, rsig = (c.combine_chunks().flatten().to_numpy().reshape(len(c), -1)
                      for c in (lefts.column("sig"), rights.column("r_sig")))
        out = [np.zeros(0, a.dtype)], [np.zeros(0, a.dtype)]
        here = tables[lefts.column("table")[0].as_py()] if len(a) else None
        for i in range(len(a) if len(r) else 0):
            # two classes outside the star come up from both sides; one is enough
            most = np.minimum(ro, ao[i])
            ok = (rc != ac[i]) & ((rc == rm) | (r > a[i])) & (100 * most >= lim * (rn + an[i] - most))
            hit = np.flatnonzero(ok)
            same = rsig[hit] == asig[i]
            enough = same.sum(axis=1) >= least
            hit, agree = r[hit[enough]], same[enough].reshape(-1, b.collections, b.rows).all(axis=2)
            lead = agree.argmax(axis=1)
            agree[np.arange(len(hit)), lead] = False
            hit = hit[(lead == here[0]) & (agree.argmax(axis=1) == here[1])]
            out[0].append(np.minimum(hit, a[i]))
            out[1].append(np.maximum(hit, a[i]))
        return pa.table({"a": np.concatenate(out[0]), "b": np.concatenate(out[1])})

    return (left.groupBy("key", "i", "j").cogroup(right.groupBy("r_key", "r_i", "r_j"))
            .applyInArrow(pairs, f"a {kind}, b {kind}"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", banding: Banding | None = None) -> DataFrame:
    """One row per row of ``df``: its id (integer), n_shingles, component_id, kept."""
    b = banding or Banding()
    docs = cut(_signatures(df, id_col, text, b))
    full = docs.filter("n > 0")
    classes = cut(full.filter("doc_id is not null").groupBy("n", "fp1", "fp2")
                  .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    tables = list(combinations(range(b.collections), 2))
    band = [F.slice("sig", i * b.rows + 1, b.rows) for i in range(b.collections)]
    keys = cut(classes.select("rep", "n", F.posexplode(F.array(*[F.xxhash64(F.lit(i * b.collections + j), band[i], band[j])
                                                                  for i, j in tables])).alias("table", "key")))
    stars = cut(keys.groupBy("key").agg(F.min("rep").alias("star"), F.count("*").alias("size")).filter("size > 1"))
    met = cut(keys.join(stars, "key"))
    n_star = met.filter("rep = star").select("key", F.col("n").alias("star_n"))
    first = cut(met.filter("rep != star").join(n_star, "key")
                .filter(100 * F.least("n", "star_n") >= b.percent * F.greatest("n", "star_n"))
                .select(F.col("star").alias("a"), F.col("rep").alias("b")).distinct())
    wanted = met.select("rep").distinct()
    texts = df.select(df[id_col].alias("rep"), df[text].alias("text")).join(wanted, "rep")
    if _repeated(full):
        texts = texts.dropDuplicates(["rep", "text"])
    sets = cut(_sets(texts, b))
    links = cut(_confirmed(first, sets, b))
    comps = cut(components(links))
    placed = (met.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
              .withColumn("comp", F.coalesce("component", "rep")))
    home = placed.filter("rep = star").select("key", F.col("comp").alias("main"))
    open_keys = placed.join(home, "key").select("key", "table", "rep", "n", "comp", "main")
    split = open_keys.filter("comp != main").select("key").distinct()
    open_keys = cut(open_keys.join(split, "key", "left_semi"))
    cores = cut(_cores(sets.join(open_keys.select("rep").distinct(), "rep", "left_semi")).filter(F.col("core") > 0))
    members = cut(open_keys.join(cores, "rep").filter(100 * F.col("core") >= b.percent * F.col("n"))
                  .join(classes.select("rep", "n", "sig"), ["rep", "n"]))
    more = cut(_confirmed(_outside(members, b).join(first, ["a", "b"], "left_anti"), sets, b))
    final = components(links.unionByName(more))
    placed = (classes.join(final.withColumnRenamed("node", "rep"), "rep", "left")
              .select("n", "fp1", "fp2", F.coalesce("component", "rep").alias("component_id")))
    out = docs.join(placed, ["n", "fp1", "fp2"], "left")
    mine = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), mine.alias("component_id"),
                      F.coalesce(mine == F.col("doc_id"), mine.isNull()).alias("kept"))


def _repeated(docs: DataFrame) -> bool:
    """Whether an id stands on several rows."""
    return docs.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
