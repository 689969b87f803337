"""Frequent phrases and collocations by dynamic itemset counting.

Texts are dealt to shards once, and the shards are scanned in a cycle. All words count from the first scan.
After each scan, phrases of one more word whose both subphrases (without the last and without the first word) have
reached the threshold begin to be counted from the next shard on, beside those already counted; each
phrase is counted over one full cycle, wherever in it it began, so its count is exact. A phrase that ends
its cycle below the threshold is forgotten, one above it is a candidate; scanning ends when nothing
is left to count. So lengths interleave and most phrases are done in little more than one pass.

A scan counts in blocks of texts, as arrays, which phrases are active being looked up in two arrays (for words and
for phrases of two words, if three is the longest) of 2 ** `FILTER_BITS` bytes: at the hash of a phrase stands the step
from which on longer phrases may begin to count. These arrays are all that is broadcast, of a fixed size
whatever the corpus. A hash shared with an active phrase lets a few phrases in that need not be counted; it never
keeps one out and changes no count, as what was let in is counted over a full cycle as well. Block counts meet by
range of the phrase digest in a shuffle, as arrays, together with the counts of unfinished phrases of earlier scans; there
are as many ranges as the size of the texts asks for. What a scan shuffled and the unfinished counts before it are deleted
once its totals are written.

Phrases are keyed by 64-bit digests of their words and their group. A collocation's score is that of its weakest cut: floor(1000000
a * a / (l * r)) with the counts of the parts, in decimals of 38 digits.

Defined results: NULL and empty texts have no words; a NULL group is `und` (as is the name itself); repeated rows
count each; a table without candidates gives an empty result. Texts are read whole; nothing is capped but the
report of the first ``top`` phrases of each group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm import words as W
from cohortia.operators import ordered
from cohortia.session import cut, delete, ending_shuffles, scratch_path

SHARDS = 3
FILTER_BITS = 23
#: Words counted together, and bytes of text cut into words at once.
BLOCK_WORDS = 1_000_000
SLICE_BYTES = 1_000_000
#: Ranges whose rows a block sends at once.
SENT_RANGES = 32
#: Bytes of all texts to one range of phrase digests; the counts of a range meet in one task.
RANGE_BYTES = 4_000_000
NEVER = 255
#: Signs that end a piece (as bytes); words part at space and tab only.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_MARK = np.arange(256, dtype=np.uint8)
_MARK[list(ENDS)] = 0x0A


def group_salt(name: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=8).digest(), "little"))


def phrase_digest(words: list[np.ndarray], salt: np.ndarray) -> np.ndarray:
    """Digest of phrases whose first, second .. words are given, in their group."""
    out = W.mix(words[0]) if words else np.zeros(len(salt), np.uint64)
    for i, h in enumerate(words[1:], 1):
        out = W.mix(out + h + np.uint64(i + 1))
    return W.mix(out ^ salt)


def slot(digest: np.ndarray) -> np.ndarray:
    return (digest >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def distinct(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts the digests, where in it each different one begins)."""
    order = np.argsort(digest)
    s = digest[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = s[1:] != s[:-1]
    return order, np.flatnonzero(fresh)


def _gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after another."""
    ahead = np.cumsum(size) - size
    return buf[np.repeat(start - ahead, size) + np.arange(int(size.sum()))]


class Block:
    """Words of some texts with their piece and group."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.names: dict[str, int] = {}
        self.n = self.pieces = self.n_bytes = 0

    def add(self, texts: W.Texts, groups: list[str]) -> None:
        w = W.Words(W.Texts(_MARK[texts.buf], texts.offs), lower=True)
        ends = np.zeros(len(w.bytes) + 1, np.int64)
        np.cumsum(w.bytes == 0x0A, out=ends[1:])
        piece = ends[w.start] + w.doc + self.pieces
        code = np.array([self.names.setdefault(g, len(self.names)) for g in groups], np.int32)
        self.parts.append((w.hashes(), piece, code[w.doc], w.bytes, w.start + self.n_bytes, (w.end - w.start).astype(np.uint32)))
        self.n += len(w)
        self.pieces += int(ends[-1]) + texts.n
        self.n_bytes += len(w.bytes)

    def count(self, step: int, shards: int, active: dict[int, np.ndarray], longest: int, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts of the words (in the first cycle) and of all phrases that are in their cycle at this step, by range of the digest."""
        h, piece, code, letters, start, size = (np.concatenate([x[k] for x in self.parts]) for k in range(6))
        self.parts = []
        salts = np.array([group_salt(g) for g in self.names], np.uint64)
        salt = salts[code]
        if step < shards:
            names = [g.encode("utf-8", "replace") for g in self.names]
            text = np.frombuffer(b"".join(names), np.uint8)
            lengths = np.array([len(x) for x in names], np.int64)
            yield from _dealt(phrase_digest([], salts), np.arange(len(salts)), salts, np.zeros(len(salts), np.uint8), np.zeros((len(salts), 0), np.uint64),
                              np.bincount(code, minlength=len(salts)), edges, text, np.cumsum(lengths) - lengths, lengths)
            d = phrase_digest([h], salt)
            order, head = distinct(d)
            first = order[head]
            yield from _dealt(d[first], code[first], salts, np.zeros(len(first), np.uint8), h[first, None], np.diff(np.append(head, len(d))), edges,
                              letters, start[first], size[first])
        del letters, start, size
        since = active[1][slot(phrase_digest([h], salt))]
        for m in range(2, longest + 1):
            at = np.flatnonzero(piece[:len(piece) - m + 1] == piece[m - 1:]) if len(piece) >= m else np.zeros(0, np.int64)
            begin = np.maximum(since[at], since[at + 1])
            at, begin = at[begin != NEVER], begin[begin != NEVER]
            d = phrase_digest([h[at + i] for i in range(m)], salt[at])
            if m < longest:
                since = np.full(len(h), NEVER, np.uint8)
                since[at] = np.maximum(active[m][slot(d)], begin)
            here = np.flatnonzero((begin <= step) & (step < begin.astype(np.int64) + shards))
            at, begin, d = at[here], begin[here], d[here]
            order, head = distinct(d)
            first = order[head]
            n, d, begin, at = np.diff(np.append(head, len(d))), d[first], begin[first], at[first]
            yield from _dealt(d, code[at], salts, begin, np.stack([h[at + i] for i in range(m)], 1), n, edges)


#: One row holds the counts of phrases of ``m`` words in one range of the digest, as arrays, by group and step: digests of the
#: groups and how many phrases each has, step from which on a phrase counts, words, counts; for groups (m = 0) and words their
#: texts one after another, and sizes of these.
PACKED = "kind int, part int, m int, first long, salt binary, runs binary, since binary, words binary, n binary, sizes binary, text binary"
OPEN, DONE, REACHED = range(3)  # counting goes on; counted; places of the filter (as bits from byte ``first`` on)


def _dealt(digest: np.ndarray, group: np.ndarray, salts: np.ndarray, since: np.ndarray, words: np.ndarray, n: np.ndarray, edges: np.ndarray,
           text: np.ndarray | None = None, start: np.ndarray | None = None, size: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Counts of different phrases, cut at the ``edges`` of the ranges; groups are places in ``salts``."""
    if np.any(digest[1:] < digest[:-1]):
        order = np.argsort(digest)
        digest, group, since, words, n = (x[order] for x in (digest, group, since, words, n))
        if text is not None:
            start, size = start[order], size[order]
    cuts = [0, *np.searchsorted(digest, edges).tolist(), len(digest)]
    full = [(i, slice(a, z)) for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
    for k in range(0, len(full), SENT_RANGES):
        yield _batch([_packed(OPEN, i, group[x], salts, since[x], words[x], n[x], text, *(None if y is None else y[x] for y in (start, size)))
                      for i, x in full[k:k + SENT_RANGES]])


def _packed(kind: int, part: int, group: np.ndarray, salts: np.ndarray, since: np.ndarray, words: np.ndarray, n: np.ndarray,
            text: np.ndarray | None = None, start: np.ndarray | None = None, size: np.ndarray | None = None) -> tuple:
    order = np.argsort(since.astype(np.uint8), kind="stable")
    order = order[np.argsort(group[order].astype(np.min_scalar_type(len(salts))), kind="stable")]
    group, since, words, n = (x[order] for x in (group, since, words, n))
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    told = (None, None)
    if text is not None:
        start, size = start[order], size[order]
        told = (size.astype(np.uint32).tobytes(), _gather(text, start, size.astype(np.int64)).tobytes())
    return (kind, part, words.shape[1], 0, salts[group[head]].tobytes(), np.diff(np.append(head, len(group))).astype(np.uint32).tobytes(),
            since.astype(np.uint8).tobytes(), words.tobytes(), n.astype(np.int64).tobytes(), *told)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[f for f, _ in fields])


def word_columns(longest: int) -> list[str]:
    return [f"w{i + 1}" for i in range(longest)]


def _scan(step: int, shards: int, held, longest: int, edges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = {m: np.frombuffer(raw, np.uint8) for m, raw in held.value.items()}
        block = Block()
        for batch in batches:
            groups = batch.column(0)
            for first, texts in W.slices(batch.column(1), SLICE_BYTES):
                block.add(texts, groups.slice(first, texts.n).to_pylist())
                if block.n >= BLOCK_WORDS:
                    yield from block.count(step, shards, active, longest, edges)
                    block = Block()
        if block.n:
            yield from block.count(step, shards, active, longest, edges)
    return run


def _joined(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer() if len(x.as_buffer()) else b"", kind) for x in column])


def _meet(step: int, shards: int, least: int, longest: int):
    """Adds up the counts of one range. Past its cycle only what reached the threshold is kept."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        part, out = key[0].as_py(), []
        lengths = table.column("m").to_numpy()
        for m in np.unique(lengths).tolist():
            rows = table.take(np.flatnonzero(lengths == m))
            since, n = _joined(rows.column("since"), np.uint8), _joined(rows.column("n"), np.int64)
            salts, group = np.unique(_joined(rows.column("salt"), np.uint64), return_inverse=True)
            group = np.repeat(group.astype(np.int32), _joined(rows.column("runs"), np.uint32))
            words = _joined(rows.column("words"), np.uint64).reshape(len(n), m)
            d = phrase_digest([words[:, i] for i in range(m)], salts[group])
            order, head = distinct(d)
            total, first = np.add.reduceat(n[order], head), order[head]
            text = []
            if m < 2:
                size = _joined(rows.column("sizes"), np.uint32).astype(np.int64)
                text = [_joined(rows.column("text"), np.uint8), (np.cumsum(size) - size), size]
            ends = since[first].astype(np.int64) + shards - 1
            for kind, of in ((OPEN, ends > step), (DONE, (ends == step) & ((total >= least) | (m == 0)))):
                if of.any():
                    at = first[of]
                    out.append(_packed(kind, part, group[at], salts, since[at], words[at], total[of], *(text and [text[0], text[1][at], text[2][at]])))
            places = slot(d[first[total >= least]])
            if 1 <= m < longest and len(places):
                byte = int(places[0]) // 8
                bits = np.zeros(8 * (int(places[-1]) // 8 - byte + 1), np.uint8)
                bits[places - 8 * byte] = 1
                out.append((REACHED, part, m, byte, *[None] * 6, np.packbits(bits, bitorder="little").tobytes()))
        return pa.Table.from_batches([_batch(out)])
    return run


def _unpacked(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, m = np.frombuffer(r["n"], np.int64), r["m"]
                words = np.frombuffer(r["words"], np.int64).reshape(len(n), m)
                salt = np.repeat(np.frombuffer(r["salt"], np.int64), np.frombuffer(r["runs"], np.uint32))
                text = pa.nulls(len(n), pa.string())
                if r["text"] is not None:
                    offsets = np.append(0, np.cumsum(np.frombuffer(r["sizes"], np.uint32).astype(np.int64))).astype(np.int32)
                    text = pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(r["text"]))
                columns = [pa.array(salt), pa.array(np.full(len(n), m, np.int32))]
                columns += [pa.array(words[:, i]) if i < m else pa.nulls(len(n), pa.int64()) for i in range(longest)]
                yield pa.RecordBatch.from_arrays([*columns, text, pa.array(n)], names=["g", "m", *word_columns(longest), "word", "n"])
    return run


def _counted(docs: DataFrame, least: int, longest: int, shards: int, text_col: str, group_col: str) -> DataFrame:
    """As `frequent`, with the digest of the group as g; the row of a group's total has its name as word."""
    if longest < 1 or shards < 1 or 3 * shards + longest >= NEVER:
        raise ValueError("at least one word and one shard, and not too many steps")
    spark = docs.sparkSession
    folder = scratch_path(spark, "shards")
    (docs.filter(F.length(text_col) > 0).select(F.coalesce(F.col(group_col), F.lit("und")).alias("g"), F.col(text_col).alias("t"),
                                                 F.octet_length(text_col).alias("size"),
                                                 F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"))
     .write.partitionBy("shard").parquet(folder))
    texts = spark.read.schema("g string, t string, size int, shard int").parquet(folder)
    ranges = max(1, -(-int(texts.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0) // RANGE_BYTES))
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    active = {m: np.full(1 << FILTER_BITS, NEVER, np.uint8) for m in range(1, max(longest, 2))}
    carried, done, folders = None, None, [folder]
    step, horizon = 0, shards
    while step < horizon:
        held = spark.sparkContext.broadcast({m: a.tobytes() for m, a in active.items()})
        met = texts.filter(F.col("shard") == step % shards).select("g", "t").mapInArrow(_scan(step, shards, held, longest, edges), PACKED)
        met = met if carried is None else met.unionByName(carried)
        folders.append(scratch_path(spark, "totals"))
        with ending_shuffles(spark):
            met.groupBy("part").applyInArrow(_meet(step, shards, least, longest), PACKED).write.partitionBy("kind").parquet(folders[-1])
        held.unpersist()
        if carried is not None:
            delete(spark, f"{folders[-2]}/kind={OPEN}")
        totals = spark.read.schema(PACKED).parquet(folders[-1])
        carried = totals.filter(F.col("kind") == OPEN)
        ended = totals.filter(F.col("kind") == DONE)
        done = ended if done is None else done.unionByName(ended)
        # at most 2 ** FILTER_BITS bits for each length
        for r in totals.filter(F.col("kind") == REACHED).select("m", "first", "text").collect():
            bits = np.unpackbits(np.frombuffer(r["text"], np.uint8), bitorder="little").astype(bool)
            at = active[r["m"]][8 * r["first"]:8 * r["first"] + len(bits)]
            new = bits & (at == NEVER)
            if new.any():
                at[new] = step + 1
                horizon = max(horizon, step + 1 + shards)
        step += 1
    row = f"g long, m int, {', '.join(f'{w} long' for w in word_columns(longest))}, word string, n long"
    found = cut(done.drop("kind").mapInArrow(_unpacked(longest), row))
    for of in folders:
        delete(spark, of)
    return found


def frequent(docs: DataFrame, least: int = 10, longest: int = 3, shards: int = SHARDS, text_col: str = "text", group_col: str = "lang") -> DataFrame:
    """All phrases of up to ``longest`` words with a count of ``least`` or more, and each group's number of words.

    Columns: g (group), m (words; 0 for the group's total), w1 .. (digests of the words), word (of single words), n.
    """
    found = _counted(docs, least, longest, shards, text_col, group_col)
    names = found.filter("m = 0").select("g", F.col("word").alias("name"))
    return found.join(names, "g").select(F.col("name").alias("g"), "m", *word_columns(longest), F.when(F.col("m") == 1, F.col("word")).alias("word"), "n")


def _key(frame: DataFrame, names: list[str], value: str) -> DataFrame:
    """``frame`` (g, w1 .. wj, n) keyed by other word columns."""
    j = len(names)
    return frame.select("g", *[F.col(f"w{i + 1}").alias(names[i]) for i in range(j)], F.col("n").alias(value))


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, inside: int = 50, shards: int = SHARDS,
                 text_col: str = "text", group_col: str = "lang") -> DataFrame:
    """The ``top`` collocations of each group: lang, rank, phrase, a, l, r, n, score.

    A phrase is left out if it lies inside a longer one that has at least ``inside`` percent of its count.
    """
    found = _counted(docs, least, longest, shards, text_col, group_col)
    of = {m: found.filter(F.col("m") == m) for m in range(1, longest + 1)}
    group = found.filter("m = 0").select("g", F.col("word").alias("lang"), F.col("n").alias("n_words"))
    ranked = None
    for m in range(2, longest + 1):
        names = word_columns(m)
        c = of[m].select("g", *names, F.col("n").alias("a"))
        for i, w in enumerate(names):
            single = of[1].select("g", F.col("w1").alias(w), F.col("word").alias(f"t{i}"), F.col("n").alias(f"c{i}"))
            c = c.join(single, ["g", w])
        for k in range(2, m):  # parts of more than one word: the first k, the last k
            c = c.join(_key(of[k], names[:k], f"p{k}"), ["g", *names[:k]]).join(_key(of[k], names[m - k:], f"s{k}"), ["g", *names[m - k:]])
        wide = {x: F.col(x).cast("decimal(15,0)") for x in c.columns if x == "a" or x[0] in "cps" and x[1:].isdigit()}
        cuts = []
        for k in range(1, m):
            left, right = ("c0" if k == 1 else f"p{k}"), (f"c{m - 1}" if m - k == 1 else f"s{m - k}")
            score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide["a"] * wide["a"], wide[left] * wide[right])
            cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")))
        c = c.withColumn("cut", F.array_min(F.array(*cuts)))
        longer = None
        for big in range(m + 1, longest + 1):
            for i in range(big - m + 1):
                part = of[big].select("g", *[F.col(f"w{i + j + 1}").alias(names[j]) for j in range(m)], "n")
                longer = part if longer is None else longer.unionByName(part)
        if longer is not None:
            most = longer.groupBy("g", *names).agg(F.max("n").alias("longer"))
            c = c.join(most, ["g", *names], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
        c = c.select("g", F.concat_ws(" ", *[f"t{i}" for i in range(m)]).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
        ranked = c if ranked is None else ranked.unionByName(c)
    ranked = ranked.withColumns({"down": -F.col("score"), "rarer": -F.col("a")})
    ranked = ordered.running(ranked, ["g"], "down", {"rank": ("row_number", None)}, tie_break=["rarer", "phrase"]).filter(F.col("rank") <= top)
    return ranked.join(group, "g").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")
