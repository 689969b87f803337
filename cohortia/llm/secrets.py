"""Secrets in whole texts: three written patterns, and candidates confirmed by their structure.

Base patterns are reported as they match. The method then decodes candidates and reports only those
whose contents parse: signed tokens with a JSON header that names an algorithm (``jwt``), PEM blocks of
private keys (``pem``), and bare base64 or hex strings that hold a private key as nested DER lengths
or in the OpenSSH form, or base64 of a text with such a PEM block (``key``). Line ends of PEM bodies and
of bare base64 may be written as escapes, and PEM bodies may be string literals put together.

A text is looked at by regular expressions only if a vectorised pass over its bytes finds a run of
20 or more token characters, or if it has one of the key words; no match can lie outside such texts.

Defined results: NULL and empty texts have no spans; spans are in code points, end exclusive; rows
are scanned one by one, repeated ones alike; empty tables give empty results; other columns pass as
asked for by ``keep``.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortia.llm import words as W

#: Order of kinds where spans begin at the same place.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key")
#: Of them, those of the base.
BASE = KINDS[:3]

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "private key")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are matched whole, so this equals filtering longer runs by length
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)")
_PEM = re.compile(r"""-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s\\"'`.,]+)-----END \1-----""")
#: In PEM bodies: escaped line ends, quotes between parts of a literal, white space.
_BETWEEN = re.compile(r"""\\+(?:[nrt]|u000[9aAdD])|["'`][\s+.,\\]*["'`]|[\s"'`,\\]""")
_ESCAPED = re.compile(r"\\+u00(2[bBfF]|3[dD])")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
_WRAP = re.compile(r"[ \t]*(?:\r?\n|(?:\\+r)?\\+n)[ \t]*(?=[A-Za-z0-9+/_=-])")
_RUN = re.compile(r"[A-Za-z0-9+/_-]*")
_PAD = re.compile(r"={0,2}")
_PEM_64 = base64.b64encode(b"-----BEGIN ").decode()[:14]
_LEAST_CHARS = 40
_HEXKEY = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{2}){32,}(?![0-9A-Za-z])")
_TOKEN = np.zeros(256, bool)
_TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_LEAST_RUN = 20
_OPENSSH = b"openssh-key-v1\0"


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first, end of contents) of the DER element at ``at`` if its length fits."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size == 0x80 or size > 0x84:
        return None
    if size > 0x80:
        n = size & 0x7F
        if at + n > end:
            return None
        size, at = int.from_bytes(data[at:at + n], "big"), at + n
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        e = _element(data, at, end)
        if e is None:
            return None
        out.append(e)
        at = e[2]
    return out


def private_der(data: bytes) -> bool:
    """Whether ``data`` is exactly one DER private key (PKCS#1, PKCS#8, encrypted or not, or SEC1) with lengths that nest."""
    top = _element(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _children(data, top[1], top[2])
    if parts and [p[0] for p in parts] == [0x30, 0x04]:  # a method with parameters (a plain digest has none), contents
        method = _children(data, parts[0][1], parts[0][2])
        return (bool(method) and [e[0] for e in method] == [0x06, 0x30] and _children(data, method[1][1], method[1][2]) is not None
                and parts[1][2] - parts[1][1] >= 8)
    if not parts or len(parts) < 3 and not (len(parts) == 2 and parts[1][0] == 0x04):
        return False
    version = parts[0]
    if version[0] != 0x02 or version[2] - version[1] != 1:
        return False
    tags = [p[0] for p in parts]
    if all(t == 0x02 for t in tags) and len(tags) in (6, 9):
        return True
    if tags[1] == 0x30 and tags[2] == 0x04:
        inner = _children(data, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06
    return tags[1] == 0x04 and data[version[1]] == 1 and parts[1][2] - parts[1][1] >= 16


def private_ssh(data: bytes) -> bool:
    """Whether ``data`` holds an OpenSSH private key: its mark, then strings whose lengths fit."""
    if not data.startswith(_OPENSSH):
        return False
    at = len(_OPENSSH)
    for _ in range(3):  # cipher, key derivation, its options
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at:at + 4], "big")
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at:at + 4], "big") <= 16


def _decoded(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(segment: str) -> dict | None:
    data = _decoded(segment)
    try:
        got = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _pem(t: str) -> Iterator[re.Match]:
    """PEM blocks of private keys whose contents parse."""
    for m in _PEM.finditer(t) if "-----BEGIN" in t else ():
        body = _ESCAPED.sub(lambda e: chr(int(e[1], 16)), m[2])
        data = _decoded(_BETWEEN.sub("", body))
        if data and (private_der(data) or private_ssh(data)):
            yield m


def _stretch(t: str, at: int, most: int | None = None) -> tuple[str, list[tuple[int, int]]]:
    """base64 characters from ``at`` on over line ends (``most`` at most), and where they stand line by line."""
    runs, chars = [], 0
    while most is None or chars < most:
        end = _RUN.match(t, at).end()
        if most is not None:
            end = min(end, at + most - chars)
        if end == at:
            break
        runs.append((at, end))
        chars += end - at
        wrap = _WRAP.match(t, end)
        if wrap is None:
            break
        at = wrap.end()
    return "".join(t[a:z] for a, z in runs), runs


def _closed(t: str, end: int) -> int | None:
    """End of base64 that ends at ``end``, its padding included; None if more characters follow there."""
    if _RUN.match(t, end).end() > end:
        return None
    pad = _PAD.match(t, end).end()
    wrap = _WRAP.match(t, end) if pad == end else None
    if wrap and t.startswith("=", wrap.end()):
        pad = _PAD.match(t, wrap.end()).end()
    return pad


def _bare(t: str, at: int) -> int | None:
    """End of the base64 at ``at``, on one or several lines, if it holds a private key."""
    head = _decoded(t[at:at + 20])
    if not head:
        return None
    if head[0] == 0x30:
        # the outer length tells how many characters belong to it
        n = head[1] & 0x7F if head[1] > 0x80 else 0
        if head[1] == 0x80 or n > 4 or head[2 + n] not in (0x02, 0x30):
            return None
        size = 2 + n + (int.from_bytes(head[2:2 + n], "big") if n else head[1])
        most = -(-8 * size // 6)
        chars, runs = _stretch(t, at, most)
        data = _decoded(chars) if len(chars) == most >= _LEAST_CHARS else None
        return _closed(t, runs[-1][1]) if data and private_der(data) else None
    if head.startswith(_OPENSSH[:15]):
        chars, runs = _stretch(t, at)
        # no outer length: lines are as wide as the first, but for the last one
        wide = runs[0][1] - runs[0][0]
        last = next((i for i, (a, z) in enumerate(runs) if z - a != wide), len(runs) - 1)
        last -= last > 0 and runs[last][1] - runs[last][0] > wide
        for i in (last, last - 1):
            data = _decoded("".join(t[a:z] for a, z in runs[:i + 1])) if i >= 0 else None
            if data and private_ssh(data) and sum(z - a for a, z in runs[:i + 1]) >= _LEAST_CHARS:
                return _closed(t, runs[i][1])
        return None
    if t.startswith(_PEM_64, at):
        chars, runs = _stretch(t, at)
        chars = chars.replace("-", "+").replace("_", "/")
        text = base64.b64decode(chars[:len(chars) // 4 * 4]) + (_decoded(chars[len(chars) // 4 * 4:]) or b"")
        found = [m.end() for m in _pem(text.decode("latin-1"))]
        if not found:
            return None
        left = -(-8 * found[-1] // 6)
        for a, z in runs:
            left -= z - a
            if left <= 0:
                return _closed(t, z)
    return None


def _confirmed(t: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _JWT.finditer(t):
        head = _object(m[1])
        if head and isinstance(head.get("alg"), str) and _object(m[2]) is not None:
            out.append(("jwt", m.start(), m.end()))
    out += [("pem", m.start(), m.end()) for m in _pem(t)]
    done = 0
    for m in _BASE64.finditer(t):
        a = m.start()
        if a and t[a - 1] == "\\" and t[a] in "nrt":
            a += 1  # the letter of an escape
        end = _bare(t, a) if a >= done and t[a] in "MbL" else None
        if end is not None:
            out.append(("key", a, end))
            done = end
    for m in _HEXKEY.finditer(t):
        data = bytes.fromhex(m[0])
        if data[0] in (0x30, 0x6F) and (private_der(data) or private_ssh(data)):
            out.append(("key", m.start(), m.end()))
    return out


def find(t: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, by start and kind."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(t) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(t)]
    out += _confirmed(t)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _suspects(texts: W.Texts) -> np.ndarray:
    """Texts with a run of token characters long enough for any pattern but ``assign``."""
    on = _TOKEN[texts.buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    long = last - first >= _LEAST_RUN
    out = np.zeros(texts.n, bool)
    # a run may go on over the end of a text: too many suspects do no harm
    for a, z in zip(first[long], last[long], strict=True):
        out[np.searchsorted(texts.offs, a, "right") - 1:np.searchsorted(texts.offs, z, "left")] = True
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` and ``spans`` (kind, start, end) of each row's whole text; ``text`` may be kept."""
    keep = [c for c in (keep or []) if c != "spans"]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in W.slices(batch.column(0)):
                suspect = _suspects(texts)
                lower = W.LOWER[texts.buf].tobytes()
                marks = [w.encode() for w in _WORDS if w.encode() in lower]
                kinds, starts, ends, offs = [], [], [], [0]
                for i in range(texts.n):
                    a, z = int(texts.offs[i]), int(texts.offs[i + 1])
                    if suspect[i] or any(lower.find(m, a, z) >= 0 for m in marks):
                        for kind, start, end in find(texts.text(i)):
                            kinds.append(kind)
                            starts.append(start)
                            ends.append(end)
                    offs.append(len(kinds))
                items = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()),
                                                    pa.array(ends, pa.int64())], ["kind", "start", "end"])
                spans = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), items)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, texts.n).columns[1:], spans], [*keep, "spans"])

    return df.select(df[text].alias("__text"), *keep).mapInArrow(run, schema)


def joined(spans) -> F.Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_spans(spans="spans") -> F.Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE))


def redact(text, spans, mark: str = "[SECRET]") -> F.Column:
    """``text`` with every stretch that spans cover replaced by ``mark`` (once where spans touch)."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    text = F.coalesce(text, F.lit(""))

    def step(acc, s):
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        new = (s["start"] > acc["at"]) | (acc["at"] == 0)
        return F.struct(F.when(new, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
                        F.greatest(acc["at"], s["end"]).alias("at"))

    done = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return F.aggregate(spans, start, step, done)
