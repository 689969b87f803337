"""Alignment of the tokens of two tokenizers over the same bytes.

Tokenizer A (a byte-level BPE) encodes a space and the text, tokenizer B (a piece model that adds
the space itself) the text. Byte offsets where tokens of both end are shared cuts; they part the text into
groups of tokens that cover the same bytes. Cuts are found by divide and conquer: an interval between
two cuts is probed from its middle outwards, each probe being a bisect of one token end among the ends of
the other side; at the nearest shared end the interval splits and both halves go on by themselves; an
interval without a shared end inside is a leaf group. All intervals of a block of texts take their next
step together as arrays, windows double after a miss, and what an interval has seen is never probed
again by its parts, so the probes of a text are about as many as its tokens whatever its shape.

A link is a pair of occurrences of an A and a B token that end together. Links are counted over the corpus by
pair of ids. Each block of texts sends its distinct pairs with their counts, and gets back the totals of
these pairs only, so no task and not the driver holds all pairs.

Encoding: wherever a space follows a solid sign (no white space), neither tokenizer has a token across
the place, so texts are cut there into units; each distinct unit is encoded once for each Python worker
(`CACHE_UNITS` of them, then the table begins anew).

Defined results: texts that are NULL or empty, or whose joined bytes by A or B differ from space and text, have
no tokens, links or groups. Repeated rows are aligned and counted each; a NULL id is kept; other columns
are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortia.llm import words as W
from cohortia.session import cut

#: Bytes of text aligned at once; a longer text is aligned alone.
BLOCK_BYTES = 1_500_000
CACHE_UNITS = 600_000
#: Units that are joined to one text of a tokenizer's call, and units of a call.
JOINED_UNITS = 400
CALL_UNITS = 20_000
#: Links of a block of rows whose distinct pairs are looked up together.
BLOCK_LINKS = 2_000_000
LISTS = ["ids_a", "ids_b", "cuts_a", "cuts_b"]
SPACE_MARK = "▁"


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. (size[0] of them), start[1], .."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + size, size)


class TokenBytes:
    """Bytes of each id of a vocabulary."""

    def __init__(self, entries: Sequence[bytes]):
        self.size = np.array([len(x) for x in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.start[ids], self.size[ids])]


def byte_alphabet() -> dict[str, int]:
    """Sign of each byte in byte-level vocabularies: printable Latin-1 stands for itself, others follow from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class ByteSide:
    """A byte-level BPE file of the tokenizers library; special tokens in texts are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        signs = byte_alphabet()
        entries = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            entries[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        self.bytes = TokenBytes(entries)
        self.splits = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceSide:
    """A piece model of the sentencepiece library, asked for the bytes of space and text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = TokenBytes([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)])
        self.space = model.piece_to_id(SPACE_MARK)
        # units are of use only if no piece goes on with a space after another sign
        self.splits = not any(a != SPACE_MARK and b == SPACE_MARK for p in pieces for a, b in zip(p, p[1:], strict=False))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """``texts`` begin with the space that the model adds."""
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [np.array(f if t != " " else [self.space], np.int32) for t, f in zip(texts, found, strict=True)]


class Units(W.Words):
    """Units of texts (each with a space before it): from a space after a solid sign to the next such space."""

    def __init__(self, texts: W.Texts, split: bool = True):
        self.texts, self.bytes = texts, texts.buf
        self._sums = None
        buf, n = texts.buf, len(texts.buf)
        solid = (buf > 0x20) & (buf < 0x7F)
        solid[1:] |= (buf[1:] >= 0x80) & (buf[:-1] >= 0xC3) & (buf[:-1] <= 0xDF)  # two bytes, no white space among them
        begin = np.zeros(n + 1, bool)
        if split:
            begin[1:n] = (buf[1:] == 0x20) & solid[:-1]
        begin[texts.offs] = True
        begin = begin[:n]
        self.start = np.flatnonzero(begin)
        self.end = np.append(self.start[1:], n)
        self.solid = solid[self.end - 1] if n else np.zeros(0, bool)
        self.first = np.searchsorted(self.start, texts.offs)
        self.count = np.diff(self.first)


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


@dataclass
class Side:
    """Ids of consecutive texts, where each text's ids begin, and the byte after each token."""

    ids: np.ndarray
    at: np.ndarray
    ends: np.ndarray


class Pair:
    """Both tokenizers with the units this process has met."""

    def __init__(self, path_a: str, path_b: str):
        self.sides = ByteSide(path_a), PieceSide(path_b)
        self.splits = all(s.splits for s in self.sides)
        self._clear()

    @staticmethod
    def of(path_a: str, path_b: str) -> Pair:
        """The pair of this process; it outlives a task when the worker does."""
        held = sys.modules.setdefault("_cohortia_pairs", types.ModuleType("_cohortia_pairs")).__dict__
        key = f"{path_a}\n{path_b}"
        if key not in held:
            held[key] = Pair(path_a, path_b)
        return held[key]

    def _clear(self) -> None:
        self.known, self.good = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.first = [np.zeros(0, np.int64) for _ in self.sides]
        self.size = [np.zeros(0, np.int64) for _ in self.sides]
        self.flat = [np.zeros(0, np.int32) for _ in self.sides]

    @staticmethod
    def _encode(side: ByteSide | PieceSide, found: list[str], solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, ids of each unit, whether its bytes come back)."""
        ids: list[np.ndarray | None] = [None] * len(found)
        runs = np.flatnonzero(solid)
        runs = [runs[i:i + JOINED_UNITS] for i in range(0, len(runs), JOINED_UNITS)]
        alone = list(np.flatnonzero(~solid))
        for run, got in zip(runs, side.encode(["".join([found[i] for i in run]) for run in runs]) if runs else [], strict=True):
            want = np.cumsum([len(found[i].encode()) for i in run])
            ends = np.cumsum(side.bytes.size[got])
            last = np.minimum(np.searchsorted(ends, want), max(len(ends) - 1, 0))
            if len(ends) and ends[-1] == want[-1] and (ends[last] == want).all():
                for i, part in zip(run, np.split(got, last[:-1] + 1), strict=True):
                    ids[i] = part
            else:  # something in it is not encoded as it stands
                alone += list(run)
        for i, got in zip(alone, side.encode([found[i] for i in alone]) if alone else [], strict=True):
            ids[i] = got
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        raw = [t.encode() for t in found]
        width = np.concatenate([[0], np.cumsum(side.bytes.size[flat])])[np.concatenate([[0], np.cumsum(size)])]
        if (np.diff(width) == [len(r) for r in raw]).all() and side.bytes.join(flat).tobytes() == b"".join(raw):
            return flat, size, np.ones(len(found), bool)
        joined = side.bytes.join(flat).tobytes()
        return flat, size, np.array([joined[s:e] == r for s, e, r in zip(width, width[1:], raw, strict=False)], bool)

    def _learn(self, units: Units, which: np.ndarray, digests: np.ndarray) -> None:
        found = [units.word(i) for i in which]
        good = np.ones(len(found), bool)
        known = np.concatenate([self.known, digests])
        order = np.argsort(known, kind="stable")
        for k, side in enumerate(self.sides):
            flat, size, fine = self._encode(side, found, units.solid[which])
            first = np.concatenate([self.first[k], len(self.flat[k]) + np.cumsum(size) - size])
            self.first[k], self.size[k] = first[order], np.concatenate([self.size[k], size])[order]
            self.flat[k] = np.concatenate([self.flat[k], flat])
            good &= fine
        self.known, self.good = known[order], np.concatenate([self.good, good])[order]

    def encode(self, texts: W.Texts) -> tuple[np.ndarray, list[Side]]:
        """(which texts have tokens, both sides); the bytes are those of space and text, of these texts only."""
        nonempty = np.diff(texts.offs) > 0
        spaced = W.Texts(np.insert(texts.buf, texts.offs[:-1], 0x20), texts.offs + np.arange(texts.n + 1))
        units = Units(spaced, self.splits)
        distinct, example, back = np.unique(units.hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != distinct
        if new.any():
            if len(self.known) + int(new.sum()) > CACHE_UNITS:
                self._clear()
                new[:] = True
            which, digests = example[new], distinct[new]
            for i in range(0, len(which), CALL_UNITS):
                self._learn(units, which[i:i + CALL_UNITS], digests[i:i + CALL_UNITS])
            at = np.searchsorted(self.known, distinct)
        at = at[back]
        bad = np.zeros(len(units.start) + 1, np.int64)
        np.cumsum(~self.good[at], out=bad[1:])
        ok = nonempty & (bad[units.first[1:]] == bad[units.first[:-1]])
        at = at[np.repeat(ok, units.count)]
        count = np.where(ok, units.count, 0)
        firsts = np.concatenate([[0], np.cumsum(count)])
        sides = []
        for k, side in enumerate(self.sides):
            size = self.size[k][at]
            ids = self.flat[k][ragged(self.first[k][at], size)]
            begin = np.concatenate([[0], np.cumsum(size)])
            sides.append(Side(ids, begin[firsts], np.cumsum(side.bytes.size[ids])))
        return ok, sides


def shared_cuts(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of ``a`` and ``b`` that end together, in order, by divide and conquer; the last tokens of a text always do."""
    some = np.diff(a.at) > 0
    first, last = a.at[:-1][some], a.at[1:][some] - 1
    cuts = [last]
    left, right = first, last  # ends [left, right) of each interval are yet to be probed
    low = high = (left + right) // 2  # what lies between them has been, in vain
    wide = np.ones(len(left), np.int64)
    while True:
        more = left < right
        left, right, low, high, wide = (x[more] for x in (left, right, low, high, wide))
        if not len(left):
            break
        down, up = np.maximum(left, low - wide), np.minimum(right, high + wide)
        below, above = low - down, up - high
        size = below + above
        seg = np.cumsum(size) - size
        pos = np.arange(int(size.sum())) - np.repeat(seg, size)
        under = pos < np.repeat(below, size)
        probe = np.where(under, np.repeat(down, size) + pos, np.repeat(high - below, size) + pos)
        end = a.ends[probe]
        hit = b.ends[np.searchsorted(b.ends, end)] == end
        near_low = np.maximum.reduceat(np.where(hit & under, probe, -1), seg)
        near_high = np.minimum.reduceat(np.where(hit & ~under, probe, len(a.ends)), seg)
        has_low, has_high = near_low >= 0, near_high < len(a.ends)
        cuts += [near_low[has_low], near_high[has_high]]
        split = has_low | has_high
        on = ~split & ((down > left) | (up < right))  # no shared end yet: look further out
        stop = np.where(has_low, near_low, down)[split]
        go = np.where(has_high, near_high + 1, up)[split]
        begin = np.concatenate([left[split], go])
        finish = np.concatenate([stop, right[split]])
        middle = (begin + finish) // 2
        left, right = np.concatenate([left[on], begin]), np.concatenate([right[on], finish])
        low, high = np.concatenate([down[on], middle]), np.concatenate([up[on], middle])
        wide = np.concatenate([wide[on] * 2, np.ones(len(middle), np.int64)])
    cut_a = np.sort(np.concatenate(cuts))
    return cut_a, np.searchsorted(b.ends, a.ends[cut_a])


def _lists(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)))


def _aligned(path_a: str, path_b: str, keep: Sequence[str]) -> Mapper:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(path_a, path_b)
        for batch in batches:
            for i, texts in W.slices(batch.column(batch.num_columns - 1), BLOCK_BYTES):
                _, (a, b) = pair.encode(texts)
                cut_a, cut_b = shared_cuts(a, b)
                at = np.searchsorted(cut_a, a.at)
                base_a, base_b = np.repeat(a.at[:-1], np.diff(at)), np.repeat(b.at[:-1], np.diff(at))
                columns = [c.slice(i, texts.n) for c in batch.columns[:-1]]
                columns += [_lists(a.ids, a.at), _lists(b.ids, b.at), _lists(cut_a + 1 - base_a, at), _lists(cut_b + 1 - base_b, at)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *LISTS])
    return run


def align(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Every row's ids by A and B and, for each shared cut, the number of its tokens of A and B before it."""
    out = ", ".join([*_types(docs, keep), *[f"{c} array<int>" for c in LISTS]])
    return docs.select(*keep, text_col).mapInArrow(_aligned(path_a, path_b, keep), out)


def _types(docs: DataFrame, keep: Sequence[str]) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, where each list begins and the total) of a list column."""
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[at[0]:at[-1]], at - at[0]


def group_texts(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, finish: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each text's bytes begin) of `a1,a2|b1;a3|b2,b3;`; cuts hold the tokens before them, ``finish`` the number of each text's last one."""
    n = len(a) + len(b)
    last_a, last_b = cut_a - 1, cut_b - 1
    group_a = np.repeat(np.arange(len(cut_a)), np.diff(cut_a, prepend=0))
    group_b = np.repeat(np.arange(len(cut_b)), np.diff(cut_b, prepend=0))
    place_a = np.arange(len(a)) + np.concatenate([[0], cut_b])[group_a]
    place_b = np.arange(len(b)) + cut_a[group_b]
    ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
    digits, size = _decimals(int(ids.max()) + 1 if n else 1)
    size = size[ids]
    total = np.concatenate([[0], np.cumsum(size + 1)])
    signs = digits[ids]
    signs[np.arange(n), size] = mark
    flat = signs[np.arange(signs.shape[1]) <= size[:, None]]
    return flat, np.concatenate([[0], total[place_b[last_b[finish]] + 1]])


_DECIMALS: list[tuple[np.ndarray, np.ndarray]] = []


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal signs of 0 .. n - 1 (and room for one more sign), and how many each has."""
    if not _DECIMALS or len(_DECIMALS[0][0]) < n:
        n = max(n, 60_000)
        text = np.char.mod("%d", np.arange(n)).astype(bytes)
        width = text.dtype.itemsize
        table = np.zeros((n, width + 1), np.uint8)
        table[:, :width] = text.view(np.uint8).reshape(n, width)
        _DECIMALS[:] = [(table, np.char.str_len(text).astype(np.int64))]
    return _DECIMALS[0]


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _summaries(batches: Iterator[pa.RecordBatch], keep: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """One row for each aligned row with its links as numbers of its block's pairs, and one row for each block with its pairs."""
    k, block = len(keep), TaskContext.get().partitionId() << 32
    held: list[tuple[list[pa.Array], np.ndarray, np.ndarray]] = []  # columns, links, where each row's links begin
    n_links = 0
    for batch in batches:
        (a, at_a), (b, at_b), (cut_a, at), (cut_b, _) = (_values(c) for c in batch.columns[k:])
        groups = np.diff(at)
        cut_a, cut_b = cut_a + np.repeat(at_a[:-1], groups), cut_b + np.repeat(at_b[:-1], groups)
        some = groups > 0
        flat, begin = group_texts(a, b, cut_a, cut_b, at[1:][some] - 1)
        digest = np.full(batch.num_rows, "", object)
        digest[some] = [hashlib.sha256(flat[s:e - 1]).hexdigest() for s, e in zip(begin, begin[1:], strict=False)]
        counts = [pa.array(x, pa.int64()) for x in (np.diff(at_a), np.diff(at_b), groups, groups)]
        held.append(([*batch.columns[:k], *counts, pa.array(digest, pa.string())], (a[cut_a - 1].astype(np.int64) << 32) | b[cut_b - 1], at))
        n_links += len(cut_a)
        if n_links >= BLOCK_LINKS:
            yield from _block(held, keep, block)
            held, n_links, block = [], 0, block + 1
    if held:
        yield from _block(held, keep, block)


def _block(held: list[tuple[list[pa.Array], np.ndarray, np.ndarray]], keep: Sequence[str], block: int) -> Iterator[pa.RecordBatch]:
    names = [*keep, *_COUNTS, "groups_sha256", "block", "links", "pairs", "n"]
    pairs, link, n = np.unique(np.concatenate([x for _, x, _ in held]), return_inverse=True, return_counts=True)
    first = 0
    for columns, links, at in held:
        raw = link[first:first + len(links)].astype(np.uint32).tobytes()
        first, rows = first + len(links), len(at) - 1
        own = pa.array([raw[4 * s:4 * e] for s, e in zip(at, at[1:], strict=False)], pa.binary())
        none = pa.nulls(rows, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(rows, block)), own, none, none], names=names)
    if len(pairs):
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (pairs, n)]
        blank = [pa.nulls(1, c.type) for c in held[0][0]]
        yield pa.RecordBatch.from_arrays([*blank, pa.array([block]), pa.nulls(1, pa.binary()), *lists], names=names)


def link_counts(pairs: DataFrame) -> DataFrame:
    """pair, count over the corpus, and whether no pair of its B id has more; from rows of (pair, n)."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    counts = cut(counts)
    best = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(best, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def link_strength(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Each row's number of tokens, groups and links, a digest of its groups, and how its links stand in the corpus."""
    aligned, kept = _aligned(path_a, path_b, keep), _types(docs, keep)
    middle = ", ".join([*kept, *[f"{c} long" for c in _COUNTS], "groups_sha256 string", "block long", "links binary", "pairs array<long>", "n array<long>"])
    told = cut(docs.select(*keep, text_col).mapInArrow(lambda batches: _summaries(aligned(batches), keep), middle))
    own = told.filter("pairs is null").drop("pairs", "n")
    met = told.filter("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "n")).alias("number", "x")).select("block", "number", F.col("x.pairs").alias("pair"), F.col("x.n").alias("n"))
    totals = met.join(link_counts(met), "pair").select(F.col("block").alias("of"), "number", "count", F.col("best").cast("int").alias("best"))

    def run(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs["number"].to_numpy())
        count, best = pairs["count"].to_numpy()[order], pairs["best"].to_numpy()[order].astype(np.int64)
        links = [np.frombuffer(x, np.uint32) for x in rows["links"].to_pylist()]
        at = np.cumsum([0, *map(len, links)])
        flat = np.concatenate([np.zeros(0, np.uint32), *links])
        sums = []
        for values in (best, count):
            run_sum = np.concatenate([[0], np.cumsum(values[flat])]) if len(flat) else np.zeros(1, np.int64)
            sums.append(pa.array(np.diff(run_sum[at]), pa.int64()))
        return pa.table([*[rows[c] for c in (*keep, *_COUNTS)], *sums, rows["groups_sha256"]], names=[*keep, *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    final = ", ".join([*kept, *[f"{c} long" for c in (*_COUNTS, "n_best", "count_sum")], "groups_sha256 string"])
    return own.groupBy("block").cogroup(totals.groupBy("of")).applyInArrow(run, final)
