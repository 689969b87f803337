"""Token ids of whole texts by a public tokenizer.

For the word vocabulary (lower case, white space dropped, a suffix that ends each word) the ids of a
text are those of its units: runs of letters, single digits and runs of other signs never share a
token. So each distinct lower-cased unit is encoded once for each Python worker and looked up by its
digest afterwards. Words with an apostrophe, special tokens or letters beyond Latin-1 are units as a
whole and go through the full tokenizer. The table of a worker is bounded (`CACHE_UNITS`); when full
it begins anew.
"""

from __future__ import annotations

import sys
import types

import numpy as np

from cohortia.llm import words as W

#: Distinct units a Python worker keeps (about 30 bytes each).
CACHE_UNITS = 1_500_000

_LETTER, _DIGIT, _SIGN, _ODD = 1, 2, 3, 4
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[ord("a"):ord("z") + 1] = _LETTER
_CLASS[ord("0"):ord("9") + 1] = _DIGIT
_CLASS[0x80:] = _ODD
_CLASS[:0x21] = _ODD  # control characters; separators are never asked for
_CLASS[[0x27, 0x7F]] = _ODD


class Units(W.Words):
    """Pieces of ``texts`` whose ids follow from themselves alone; ``odd`` ones need the full tokenizer."""

    def __init__(self, texts: W.Texts):
        super().__init__(texts, lower=True)
        raw, low = texts.buf, self.bytes.copy()
        kind = _CLASS[low]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        lead = lead[(raw[lead + 1] >= 0x80) & (raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER  # letters of Latin-1
        upper = lead[raw[lead + 1] < 0x9F] + 1
        low[upper] += 0x20
        odd = kind == _ODD
        odd[:-1] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
        odd &= self.inside
        first = self.start
        bad = np.zeros(len(first), bool)
        bad[np.searchsorted(first, np.flatnonzero(odd), "right") - 1] = True
        for i in np.flatnonzero(bad):
            a, z = first[i], self.end[i]
            kind[a:z] = _ODD
            low[a:z] = raw[a:z]
        change = np.ones(len(raw), bool)
        change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        change[first] = True
        self.bytes = low
        self.start = np.flatnonzero(change & self.inside)
        after = np.append(change, True)[1:]
        after[:-1] |= ~self.inside[1:]
        self.end = np.flatnonzero(after & self.inside) + 1
        self.first = np.searchsorted(self.start, texts.offs)
        self.odd = kind[self.start] == _ODD


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes slices of texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None  # plain units are normal already
        suffix = self.plain.model.end_of_word_suffix
        if not suffix:
            raise ValueError("the vocabulary must mark the ends of words")
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab(False).items() if t.endswith(suffix)]] = True
        self.kind = np.uint16 if size <= 65536 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, self.kind)

    @staticmethod
    def of(path: str) -> WordEncoder:
        """The encoder of this process; it outlives a task when the worker does."""
        held = sys.modules.setdefault("_cohortia_encoders", types.ModuleType("_cohortia_encoders")).__dict__
        if path not in held:
            held[path] = WordEncoder(path)
        return held[path]

    def _new(self, found: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each unit): the plain ones, then the odd ones."""
        plain = [x for x, o in zip(found, odd, strict=True) if not o]
        got = self.plain.encode_batch_fast([" ".join(plain[i:i + 500]) for i in range(0, len(plain), 500)], add_special_tokens=False)
        rest = [self.tokenizer.encode(x, add_special_tokens=False).ids for x, o in zip(found, odd, strict=True) if o]
        flat = np.concatenate([np.zeros(0, self.kind), *[np.array(e.ids, self.kind) for e in got]])
        size = np.diff(np.flatnonzero(self.ends[flat]), prepend=-1)
        if len(size) != len(plain):
            raise ValueError("units and ids do not line up")
        return (np.concatenate([flat, *[np.array(x, self.kind) for x in rest]]),
                np.concatenate([size, np.array([len(x) for x in rest], size.dtype)]))

    def encode(self, texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, where each text's ids begin and the total)."""
        w = Units(texts)
        if not len(w):
            return np.zeros(0, np.uint32), np.zeros(texts.n + 1, np.int64)
        distinct, example, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
            new = self.known[at] != distinct
        if new.any():
            if len(self.known) + int(new.sum()) > CACHE_UNITS:
                self._clear()
                new[:] = True
            odd = w.odd[example[new]]
            flat, size = self._new([w.word(i) for i in example[new]], odd)
            fresh = distinct[new]
            known = np.concatenate([self.known, fresh[~odd], fresh[odd]])
            first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
            order = np.argsort(known, kind="stable")
            self.known, self.first = known[order], first[order]
            self.size = np.concatenate([self.size, size.astype(np.int32)])[order]
            self.flat = np.concatenate([self.flat, flat])
        at = np.searchsorted(self.known, distinct)
        first, size = self.first[at][back], self.size[at][back].astype(np.int64)
        begin = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=begin[1:])
        ids = self.flat[np.repeat(first - begin[:-1], size) + np.arange(begin[-1])].astype(np.uint32)
        return ids, begin[w.first]


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end`` appended to each text."""
    return np.insert(ids, at[1:], end), at + np.arange(len(at))
