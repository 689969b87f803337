"""Quality rules on whole texts, with repetition measured by suffix arrays.

All texts of a slice are sorted in one suffix array over word digests (texts never mix, as the first
rank is that of (text, word)). The depth of the innermost interval of longest common prefixes that
holds a suffix is the larger of its two neighbouring prefix lengths: the longest string beginning
there that is found again in the text. Spans of at least ``min_repeat`` words are united; a text
fails if they cover too much of it or the longest is too long.

Defined results: a NULL or empty text has no words, zero counts and fails; rows are judged one by
one, so repeated rows get equal answers; an empty table gives an empty result; further columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortia.llm import words as W

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50  # of words in 3-word windows found again
    min_repeat: int = 10  # words of a repeat that counts as covering
    max_covered_percent: int = 30
    max_longest: int = 100  # words


def suffix_array(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Suffixes in order of (text, words by digest), a text's end first; only ties are sorted again."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    ids = np.unique(h, return_inverse=True)[1].astype(np.int64)
    key = doc.astype(np.int64) * (ids.max() + 1) + ids
    order = np.argsort(key, kind="stable")
    last = np.searchsorted(doc, doc, "right")  # end of the suffix's text
    rank, tied = _ranks(key[order], order, np.zeros(n, np.int64), np.zeros(n, np.int64))
    order, k = order[tied], 1
    while len(order):
        follow = np.where(order + k < last[order], rank[np.minimum(order + k, n - 1)] + 1, 0)
        base = rank[order]
        by = np.lexsort((follow, base))
        order, base, follow = order[by], base[by], follow[by]
        rank, tied = _ranks(base * (n + 2) + follow, order, rank, base)
        order, k = order[tied], k * 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _ranks(keys: np.ndarray, order: np.ndarray, rank: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put the place of each group of equal (sorted) keys into ``rank``; which are still tied.

    ``base`` is the place at which the group they were in begins.
    """
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    head = np.repeat(at, np.diff(np.append(at, len(keys))))
    if not base.any():
        first = np.zeros(len(keys), np.int64)
    else:
        shift = np.ones(len(keys), bool)
        shift[1:] = base[1:] != base[:-1]
        starts = np.flatnonzero(shift)
        first = np.repeat(starts, np.diff(np.append(starts, len(keys))))
    rank[order] = base + head - first
    tied = ~new
    tied[:-1] |= ~new[1:]
    return rank, tied


def common_prefixes(sa: np.ndarray, h: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Words that neighbours in the suffix array share (entry i: of i-1 and i); 0 if under ``least``."""
    n = len(sa)
    out = np.zeros(n + 1, np.int64)
    if n < 2:
        return out
    sums = np.zeros(n + 1, np.uint64)
    base = np.uint64(0xD6E8FEB86659FD93)
    np.cumsum(h * W.powers(base, n), out=sums[1:])
    back = W.powers(np.uint64(pow(int(base), -1, 1 << 64)), n + 1)
    last = np.searchsorted(doc, doc, "right")

    def equal(a, b, k):
        ok = (a + k <= last[np.minimum(a, n - 1)]) & (b + k <= last[np.minimum(b, n - 1)]) & (a < n) & (b < n)
        a, b = np.where(ok, a, 0), np.where(ok, b, 0)
        e = np.minimum(a + k, n), np.minimum(b + k, n)
        return ok & ((sums[e[0]] - sums[a]) * back[a] == (sums[e[1]] - sums[b]) * back[b])

    rows = np.flatnonzero(doc[sa[1:]] == doc[sa[:-1]]) + 1
    rows = rows[equal(sa[rows - 1], sa[rows], least)]
    a, b, got = sa[rows - 1].copy(), sa[rows].copy(), np.zeros(len(rows), np.int64)
    # a step above any length down to 1, while the text of a row has room
    k = 1 << max(int(np.max(np.bincount(doc))).bit_length(), 1)
    while k:
        hit = equal(a + got, b + got, k) & (a + got < last[a]) & (b + got < last[b])
        got[hit] += k
        k >>= 1
    out[rows] = got
    return out


def repeats(h: np.ndarray, doc: np.ndarray, n_texts: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: words covered by repeats of ``least`` words or more, and its longest repeat."""
    n = len(h)
    cover, longest = np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
    if not n:
        return cover, longest
    sa = suffix_array(h, doc)
    lcp = common_prefixes(sa, h, doc, least)
    depth = np.maximum(lcp[:-1], lcp[1:])
    rows = np.flatnonzero(depth)
    np.maximum.at(longest, doc[sa[rows]], depth[rows])
    inside = W.covered(sa[rows], depth[rows], n)
    cover += np.bincount(doc[inside], minlength=n_texts)
    return cover, longest


def measure(texts: W.Texts, limits: Limits) -> dict[str, np.ndarray]:
    """All counts and both verdicts for the texts of a slice."""
    w = W.Words(texts)
    h = w.hashes()
    n = w.count.astype(np.int64)
    out = {"n_words": n,
           "word_chars": w.per_text(w.inside & ((texts.buf & 0xC0) != 0x80)),
           "n_symbols": w.per_text(_SYMBOLS[texts.buf])}
    breaks = np.flatnonzero(texts.buf == 10)
    begin = np.sort(np.concatenate([texts.offs[:-1], breaks + 1]), kind="stable")
    of = np.repeat(np.arange(texts.n), 1 + np.diff(np.searchsorted(breaks, texts.offs)))
    end = np.minimum(np.searchsorted(breaks, begin), len(breaks))
    end = np.minimum(np.append(breaks, len(texts.buf))[end], texts.offs[of + 1])
    full = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end, of = begin[full], end[full], of[full]
    key = W.mix(w.digest(begin, end) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.unique(key, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(of, minlength=texts.n) - np.bincount(of[first], minlength=texts.n)
    win, at = W.windows(h, w.doc, 3)
    again = at[W.repeated(win, w.doc[at])]
    out["n_repeat_words"] = np.bincount(w.doc[W.covered(again, 3, len(h))], minlength=texts.n)
    out["n_covered_words"], out["longest_repeat"] = repeats(h, w.doc, texts.n, limits.min_repeat)
    failed = (n < limits.min_words) | (100 * out["n_repeat_words"] > limits.max_repeat_percent * n)
    out["base_failed"] = failed
    out["kept"] = ~failed & (100 * out["n_covered_words"] <= limits.max_covered_percent * n) & (out["longest_repeat"] <= limits.max_longest)
    return out


def judge(df: DataFrame, text: str = "text", keep: list[str] | None = None, limits: Limits | None = None) -> DataFrame:
    """Columns ``keep`` of ``df`` with the measures and verdicts of each row's whole text.

    A kept column that bears the name of a measure is replaced by the measure.
    """
    limits = limits or Limits()
    names = [*_COUNTS, "base_failed", "kept"]
    keep = [c for c in (keep or []) if c not in names]
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in _COUNTS],
                           T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    source = df.select(df[text].alias("__text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in W.slices(batch.column(0)):
                got = measure(texts, limits)
                rows = batch.slice(first, texts.n)
                columns = [*rows.columns[1:], *[pa.array(got[c].astype(np.int64)) for c in _COUNTS],
                           pa.array(got["base_failed"]), pa.array(got["kept"])]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *names])

    return source.mapInArrow(run, schema)
