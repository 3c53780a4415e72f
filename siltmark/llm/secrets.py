"""Secrets in texts: fixed forms, and runs of characters whose sliding entropy is high.

A candidate is a long run of token characters. A window slides over it; the counts of its
characters are updated by the one that enters and the one that leaves, and so is the sum
that Shannon entropy needs. What is high depends on the class of the run (hexadecimal,
mixed letters and digits), since its alphabet bounds the entropy. An allow-list suppresses
runs that are random by design but public.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import buffers, tidy

KINDS = ("assign", "access", "hex", "entropy")
N_BASE = 3
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Shortest candidate, and width of the sliding window.
CANDIDATE, WIDTH = 20, 20
#: Bits a character, by class of the candidate, from which a window counts.
BITS = {"hex": 3.0, "mixed": 3.6}
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
SHOWN = ("example", "sample", "dummy", "placeholder", "xxxx", "0123456789", "abcdefgh")
WORDS = re.compile(r"[A-Za-z_/=+-]*")  # words, paths, rulers
NUMBERS = re.compile(r"[0-9_/=+-]*")  # numbers, dates, card numbers
_SEPARATORS, _PART = re.compile(r"[-_/+=]+"), re.compile(r"([A-Za-z]*+)[0-9]{0,4}")


def _slug(s: str) -> bool:
    """Parts that end in three lower-case letters and up to four digits, divided by separators; the last may be any letters."""
    *parts, last = _SEPARATORS.split(s)
    found = [_PART.fullmatch(p) for p in parts]
    return bool(parts) and all(m and len(m[1]) > 2 and m[1][-3:].islower() for m in found) and _PART.fullmatch(last) is not None


def allowed(s: str) -> bool:
    """Whether a run is random by design but public, or no random run. Linear in its length."""
    low = s.lower()
    return any(w in low for w in SHOWN) or any(p.fullmatch(s) for p in (UUID, WORDS, NUMBERS)) or _slug(s)


_TOKEN_BYTE = np.zeros(256, bool)
_TOKEN_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True


def class_of(s: str) -> str | None:
    """hex, mixed (at least two of lower case, upper case and digits, a digit among them), or None: never a secret by entropy."""
    if not any(c.isdigit() for c in s):
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    return "mixed" if re.search("[A-Za-z]", s) else None


def high_windows(s: str, bits: float, width: int = WIDTH) -> list[tuple[int, int]]:
    """Unions of the windows of s with that many bits a character; each step updates two counts."""
    n = min(width, len(s))
    log = [0.0] + [k * math.log2(k) for k in range(1, n + 2)]
    count: dict[str, int] = {}
    total, out = 0.0, []
    for i, c in enumerate(s):
        k = count.get(c, 0)
        count[c] = k + 1
        total += log[k + 1] - log[k]
        if i >= n:
            gone = s[i - n]
            k = count[gone]
            count[gone] = k - 1
            total += log[k - 1] - log[k]
        if i >= n - 1 and math.log2(n) - total / n >= bits - 1e-9:
            a, b = i - n + 1, i + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def find_in(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, sorted. Added spans don't overlap base spans."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS) or not text.isascii():
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    # ends of the base spans so far, by start: a window overlaps one if the largest end before its own end is after its start
    starts, ends = [x for x, _, _ in sorted(out)], []
    for _, _, y in sorted(out):
        ends.append(max(y, ends[-1]) if ends else y)
    for m in TOKEN.finditer(text):
        kind = class_of(m[0])
        if kind and not allowed(m[0]):
            for a, b in high_windows(m[0], BITS[kind]):
                a, b = a + m.start(), b + m.start()
                before = bisect_left(starts, b)
                if not before or ends[before - 1] <= a:
                    out.append((a, 3, b))
    return sorted(out)


RESULT = T.StructType([T.StructField("secrets", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])))])


def _may_hold(column: pa.Array) -> np.ndarray:
    """Rows with a run of CANDIDATE token bytes; every hexadecimal or access match has one."""
    data, at = buffers(column)
    out = np.zeros(len(column), bool)
    if len(column) and at[-1] > at[0]:
        inside = np.zeros(at[-1] - at[0] + 2, np.int8)
        inside[1:-1] = _TOKEN_BYTE[data[at[0] : at[-1]]]
        edge = np.flatnonzero(np.diff(inside))
        a, b = edge[::2], edge[1::2]
        a = a[b - a >= CANDIDATE]  # a run may go on in the next text; that costs a look only
        b = edge[1::2][edge[1::2] - edge[::2] >= CANDIDATE]
        if len(a):
            first = np.searchsorted(at - at[0], a, "right") - 1
            last = np.searchsorted(at - at[0], b - 1, "right") - 1
            for f, l in zip(first, last, strict=True):
                out[f : l + 1] = True
    return out


def _batch(batch: pa.RecordBatch, index: int, keep: list[str], into: str) -> Iterator[pa.RecordBatch]:
    column = batch.column(index)
    spans: list[list[dict]] = []
    step = 512
    for a in range(0, len(column), step):
        part = column.slice(a, step)
        for may, value in zip(_may_hold(part), part, strict=True):
            text = value.as_py() or ""
            if may or _keyword(text):
                spans.append([{"start": s, "rank": k, "end": e, "kind": KINDS[k]} for s, k, e in find_in(text)])
            else:
                spans.append([])
    kept = [batch.column(k) for k in range(len(keep))]
    yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string())])))], [*keep, into])


def _keyword(text: str) -> bool:
    low = text.lower()
    return any(k in low for k in KEYWORDS)


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, into: str = "secrets") -> DataFrame:
    """Adds an array of spans (start, rank, end, kind), ordered by start, then kind as listed.

    Offsets count code points; end is exclusive. A null or empty text has no spans. Repeated
    rows each get theirs; a column named like the result is replaced. keep: columns to carry
    (default: all).
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]
    columns = keep if text in keep else [*keep, text]
    source = docs.select(*[f"`{c}`" for c in columns])
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField(into, RESULT[0].dataType)])
    index = columns.index(text)

    @tidy
    def run(batches):
        for batch in batches:
            yield from _batch(batch, index, keep, into)

    return source.mapInArrow(run, schema)
