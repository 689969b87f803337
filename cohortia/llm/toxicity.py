"""Toxicity of whole texts after noisy-channel deobfuscation.

Words that look disguised (digits or signs among letters, drawn-out letters, letters spaced out) become a
character lattice: each sign may stand for the letters it is used for, a separator may fall away, a
repeated letter may be one. A Viterbi search over the lattice finds the likeliest letters under a
character trigram model of the corpus and the costs of the channel. The restored word is scored in place of
the disguised one; other words have one path only and are scored as they are.

The score is learnt from labelled rows of the training folds: features are a text's words and their
beginnings (so that inflected forms share evidence), kept if they go with the label often enough; a
text's evidence is its strongest feature and their sum, and a logistic curve over these is fitted with
each row's own counts left out.

Fixed bounds: at most ``MAX_ROWS`` labelled rows are used (those of smallest digest), and the
``MAX_FEATURES`` features of most evidence, which are sent to all tasks. The character model is counted over all texts.

Defined results: NULL and empty texts have no evidence and get the score of that; a row whose id is NULL
counts as the text '' for the split; several labels of an id count as toxic if any does; NULL labels
are left out; without any usable labels every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.llm import words as W
from cohortia.session import cut

MAX_ROWS = 60_000
MAX_FEATURES = 200_000
#: Toxic rows a feature needs (the row itself left out), and log-odds from which it counts.
LEAST_ROWS, LEAST_ODDS = 2, 1.5
#: Bytes of the beginnings of words that are features.
BEGINNINGS = (4, 5)

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "aeiou"}
SEPARATORS = frozenset(".-_*~'`^,;:/\\#+=")
#: Costs of the channel (natural log): a sign for a letter, one dropped, a letter said again, a sign that stays.
SUBSTITUTE, DROP, REPEAT, STAY = 0.7, 0.5, 0.4, 6.0
BEAM = 24
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_LETTER = np.zeros(256, bool)
_LETTER[[ord(c) for c in _LETTERS]] = True
_LETTER[0x80:] = True
_OPENING, _CLOSING = np.zeros(256, bool), np.zeros(256, bool)
_OPENING[[ord(c) for c in "0123456789@$|!("]] = True
_CLOSING[[ord(c) for c in "0123456789@$|"]] = True
_SYMBOL = np.full(256, 27, np.int64)  # letters 1-26, other bytes of words 27, edge 0
_SYMBOL[[ord(c) for c in _LETTERS]] = np.arange(1, 27)
_N = 28
_TAGS = (np.uint64(0), np.uint64(0x1B873593CC9E2D51), np.uint64(0x2545F4914F6CDD1D))


def trigrams(w: W.Words) -> np.ndarray:
    """Counts of symbol triples in words, their edges included."""
    n = len(w)
    size = w.end - w.start
    out = np.zeros(int(size.sum()) + 2 * n + 1, np.int64)
    begin = np.cumsum(size + 2) - (size + 2) + 1
    at = np.repeat(begin - w.start, size) + np.flatnonzero(w.inside)
    out[at] = _SYMBOL[w.bytes[w.inside]]
    return np.bincount((out[:-2] * _N + out[1:-1]) * _N + out[2:], minlength=_N**3) if len(out) > 2 else np.zeros(_N**3, np.int64)


def language(counts: np.ndarray) -> np.ndarray:
    """Cost (negative log) of a symbol after two others, mixed with pairs and singles."""
    c3 = counts.reshape(_N, _N, _N).astype(float)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 1) / (c1.sum() + _N)
    p2 = (c2 + 2 * p1) / (c2.sum(axis=1, keepdims=True) + 2)
    p3 = (c3 + 4 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 4)
    return -np.log(p3)


def restore(word: str, cost: np.ndarray) -> str:
    """The likeliest letters behind a disguised word (lower-cased)."""
    def symbol(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 27

    # state: the last two symbols, and the letter last written; value: cost and text
    beam: dict[tuple[int, int, str], tuple[float, str]] = {(0, 0, ""): (0.0, "")}
    for c in word:
        ways: list[tuple[str, float]] = [(c, 0.0)] if c.isalpha() else [(x, SUBSTITUTE) for x in LEET.get(c, "")]
        if not c.isalpha():
            ways.append((c, STAY))
        after: dict[tuple[int, int, str], tuple[float, str]] = {}

        def reach(state: tuple[int, int, str], value: tuple[float, str], after=after) -> None:
            if state not in after or value < after[state]:
                after[state] = value

        for (a, b, last), (so_far, text) in beam.items():
            for x, extra in ways:
                s = symbol(x)
                reach((b, s, x), (so_far + extra + float(cost[a, b, s]), text + x))
                if x == last:
                    reach((a, b, last), (so_far + extra + REPEAT, text))
            if c in SEPARATORS:
                reach((a, b, last), (so_far + DROP, text))
        beam = dict(sorted(after.items(), key=lambda kv: kv[1])[:BEAM])
    return min((so_far + float(cost[a, b, 0]), text) for (a, b, _), (so_far, text) in beam.items())[1]


class Tokens:
    """Words of a slice without signs at their ends, and those of them that look disguised."""

    def __init__(self, texts: W.Texts):
        w = self.words = W.Words(texts, lower=True)
        low = w.bytes
        letter = _LETTER[low]
        at = np.flatnonzero(letter & w.inside)
        a, z = np.searchsorted(at, w.start), np.searchsorted(at, w.end)
        self.full = z > a  # words with a letter
        self.start = np.where(self.full, np.append(at, 0)[np.minimum(a, len(at))], w.start)
        self.end = np.where(self.full, np.append(at, 0)[np.maximum(z - 1, 0)] + 1, w.start)
        # one sign that may be a letter, right before the first or after the last letter, belongs to the word
        if len(low):
            ahead = self.full & (self.start - w.start == 1) & _OPENING[low[w.start]]
            behind = self.full & (w.end - self.end == 1) & _CLOSING[low[w.end - 1]]
            self.start, self.end = self.start - ahead, self.end + behind
        signs = np.append(0, np.cumsum(~letter))
        self.mixed = self.full & (signs[self.end] > signs[self.start])
        drawn = np.zeros(len(low) + 1, bool)
        if len(low) > 2:
            drawn[2:-1] = letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & (low[2:] < 0x80)
        runs = np.append(0, np.cumsum(drawn))
        self.drawn = self.full & (self.end - self.start > 2) & (runs[self.end] > runs[np.minimum(self.start + 2, self.end)])
        single = (self.end - self.start == 1) & (low[np.minimum(self.start, max(len(low) - 1, 0))] < 0x80) & (w.end - w.start <= 2) if len(low) else self.full
        self.single = self.full & single

    def spaced(self) -> list[tuple[int, int]]:
        """(first, last + 1) of runs of three or more single letters in one text."""
        w, on = self.words, self.single
        if not on.any():
            return []
        link = on[1:] & on[:-1] & (w.doc[1:] == w.doc[:-1])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], link, [False]]).astype(np.int8)))
        return [(int(a), int(z) + 1) for a, z in zip(edge[::2], edge[1::2], strict=True) if z + 1 - a >= 3]


def features(texts: W.Texts, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature digests, text of each), each feature once for a text; disguised words are restored."""
    t = Tokens(texts)
    w = t.words
    hide = t.mixed | t.drawn
    docs: list[int] = []
    found: list[str] = []

    def shown(i: int) -> str:
        a, z = int(t.start[i]), int(t.end[i])
        return w.bytes[a:z].tobytes().decode("utf-8", "replace")

    for i in np.flatnonzero(hide):
        docs.append(int(w.doc[i]))
        found.append(restore(shown(i), cost))
    for a, z in t.spaced():
        docs.append(int(w.doc[a]))
        found.append(restore("".join(shown(i) for i in range(a, z)), cost))
        hide[a:z] = True
    plain = np.flatnonzero(t.full & ~hide)
    parts = [_digests(w, t.start[plain], t.end[plain], w.doc[plain])]
    if found:
        # restored texts are words of their own
        data = " ".join(found).encode()
        offs = np.append(0, np.cumsum([len(x.encode()) + 1 for x in found]))
        offs[-1] -= 1
        r = W.Words(W.Texts(np.frombuffer(data, np.uint8), offs))
        parts.append(_digests(r, r.start, r.end, np.array(docs)[r.doc]))
    f, d = (np.concatenate(x) for x in zip(*parts, strict=True))
    key = W.mix(f + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.unique(key, return_index=True)[1]
    f, d = f[first], d[first]
    order = np.argsort(d, kind="stable")
    return f[order], d[order]


def _digests(w: W.Words, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, docs = [w.digest(start, end)], [doc]
    for size, tag in zip(BEGINNINGS, _TAGS[1:], strict=True):
        long = end - start > size
        out.append(W.mix(w.digest(start[long], start[long] + size) ^ tag))
        docs.append(doc[long])
    return np.concatenate(out), np.concatenate(docs)


def odds(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """Log-odds of a feature; 0 where it is too rare or too weak."""
    w = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    return np.where((pos >= LEAST_ROWS) & (w >= LEAST_ODDS), w, 0.0)


def evidence(f: np.ndarray, d: np.ndarray, n_texts: int, model: tuple, label: np.ndarray | None = None) -> np.ndarray:
    """(1, strongest, log of sum) of each text; with ``label``, its own counts are left out."""
    known, pos, neg, n_pos, n_neg = model
    out = np.zeros((n_texts, 3))
    out[:, 0] = 1
    if len(known) and len(f):
        at = np.minimum(np.searchsorted(known, f), len(known) - 1)
        hit = known[at] == f
        at, d = at[hit], d[hit]
        p, n, np_, nn = pos[at].astype(float), neg[at].astype(float), n_pos, n_neg
        if label is not None:
            y = label[d]
            p, n, np_, nn = p - y, n - (1 - y), n_pos - y, n_neg - (1 - y)
        w = odds(p, n, np_, nn)
        np.maximum.at(out[:, 1], d, w)
        out[:, 2] = np.log1p(np.bincount(d, w, minlength=n_texts))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton fit with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return b


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def character_model(df: DataFrame, text: str) -> np.ndarray:
    """Trigram costs counted over all texts (one row of a fixed size for each task)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(_N**3, np.int64)
        for batch in batches:
            for _, texts in W.slices(batch.column(0)):
                sums += trigrams(W.Words(texts, lower=True))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["item", "n"])

    out = np.zeros(_N**3, np.int64)
    for r in df.select(df[text]).mapInArrow(count, "item int, n long").groupBy("item").agg(F.sum("n").alias("n")).collect():
        out[r.item] = r.n
    return language(out)


def fit(docs: DataFrame, labels: DataFrame, cost: np.ndarray, id_col: str, text: str, label: str) -> tuple[tuple, np.ndarray]:
    """(features with counts, weights of the curve) from labelled rows outside the held-out fold."""
    usable = (labels.select(labels[id_col].alias("id"), labels[label].cast("double").alias("y"))
              .filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
              .groupBy("id").agg(F.max("y").alias("y")))
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(MAX_ROWS)  # a documented bound, so it may be sent to all tasks
    rows = cut(docs.select(docs[id_col].alias("id"), docs[text].alias("text")).join(F.broadcast(chosen), "id").select("y", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in W.slices(batch.column(1), 4 * W.SLICE_BYTES):
                f, d = features(texts, cost)
                known, back = np.unique(f, return_inverse=True)
                own = y[first:first + texts.n][d]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(known.view(np.int64)), pa.array(np.bincount(back, own, len(known)).astype(np.int64)),
                     pa.array(np.bincount(back, 1 - own, len(known)).astype(np.int64))], ["f", "pos", "neg"])

    size = rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    n_pos, n_neg = float(size[0] or 0), float(size[1] or 0)
    if not n_pos or not n_neg:
        return (np.zeros(0, np.uint64), *[np.zeros(0)] * 2, n_pos, n_neg), np.array([-30.0, 0.0, 0.0])
    strength = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    summed = rows.mapInArrow(count, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    best = (summed.filter((F.col("pos") > LEAST_ROWS) & (strength >= LEAST_ODDS))
            .orderBy((F.col("pos") * strength).desc(), "f").limit(MAX_FEATURES).toPandas())
    known = best["f"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    model = known[order], best["pos"].to_numpy(np.int64)[order], best["neg"].to_numpy(np.int64)[order], n_pos, n_neg
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in W.slices(batch.column(1)):
                own = y[first:first + texts.n]
                x = evidence(*features(texts, cost), texts.n, sent.value, own)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(x[:, 1]), pa.array(x[:, 2])], ["y", "most", "sum"])

    seen = rows.mapInArrow(weigh, "y double, most double, sum double").toPandas()  # at most a row for each chosen label
    seen = seen.sort_values(["y", "most", "sum"])
    return model, logistic(np.column_stack([np.ones(len(seen)), seen["most"], seen["sum"]]), seen["y"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``."""
    cost = character_model(docs, text)
    model, curve = fit(docs, labels, cost, id_col, text, label)
    sent = docs.sparkSession.sparkContext.broadcast((model, curve, cost))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, curve, cost = sent.value
        for batch in batches:
            for first, texts in W.slices(batch.column(2)):
                x = evidence(*features(texts, cost), texts.n, model)
                p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
                rows = batch.slice(first, texts.n)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                                 ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(docs[id_col], held_out(docs[id_col]).alias("held_out"), docs[text])
            .mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int"))
