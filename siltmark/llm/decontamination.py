"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds all benchmark items. A document's words are streamed through it; after
each word the automaton knows the longest run of words ending there that occurs in an
item. Where that run reaches the window length, its words are hit.

Most words need no streaming: a run of words can only match where every two neighbours are
neighbours in some item, too. Hashes of neighbours are looked up for a whole block of texts
at once, and only runs that are long enough are streamed, as words. A false positive of the
hashes costs time; there are no false negatives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import written
from .words import Words, tidy, words_of

#: Words of a window.
WINDOW = 10
#: Words that one automaton holds at most: about 1 kB of memory for each. More items are divided over several.
AUTOMATON_WORDS = 100_000
_BITS = 20


class SuffixAutomaton:
    """Of several word sequences. After ``feed``, state and length describe the longest match that ends at the word."""

    def __init__(self, items: list[list[bytes]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[tuple[int, int, int]] = []
        for k, words in enumerate(items):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                ends.append((last, k, i + 1))
        holders: dict[int, set[int]] = {}
        whole: dict[int, set[int]] = {}
        for state, k, n in ends:
            holders.setdefault(state, set()).add(k)
            if n == len(items[k]) < window:
                whole.setdefault(state, set()).add(k)
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        for s in reversed(order):
            if self.len[self.link[s]] >= window and s in holders:
                holders.setdefault(self.link[s], set()).update(holders[s])
        #: by state: the state that holds its suffix of window words
        self.anchor = list(range(len(self.len)))
        #: by state: (words, items) of the short items that end in it
        self.short: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * len(self.len)
        for s in order:
            if self.len[self.link[s]] >= window:
                self.anchor[s] = self.anchor[self.link[s]]
            self.short[s] = self.short[self.link[s]] + (((self.len[s], frozenset(whole[s])),) if s in whole else ())
        self.holders = {s: frozenset(v) for s, v in holders.items() if self.len[s] >= window}

    def _add(self, length: int, next_: dict, link: int) -> int:
        self.len.append(length)
        self.next.append(next_)
        self.link.append(link)
        return len(self.len) - 1

    def _clone(self, p: int, w: bytes, q: int) -> int:
        c = self._add(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, w, q)
        new = self._add(self.len[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, w, q)
        return new

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, frozenset[int]]]:
        """(first, last, items) of the windows that occur, by the word that ends them."""
        state = length = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            if length >= self.window:
                yield i - self.window + 1, i, self.holders[self.anchor[state]]
            for n, items in self.short[state]:
                if length >= n:
                    yield i - n + 1, i, items


class Detector:
    """An automaton, and tables of hashes of the words and neighbours that may belong to a window."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int = WINDOW):
        self.ids = ids
        items: list[list[bytes]] = [[] for _ in texts]
        self.pair = np.zeros(1 << _BITS, bool)
        self.alone = np.zeros(1 << _BITS, bool)
        self.any_alone, self.pairs = False, window
        for block in words_of(pa.array(texts, pa.string())):
            hashes = self._pairs(block.hash)
            for k in range(len(block.first) - 1):
                a, b = block.first[k], block.first[k + 1]
                items[block.row + k] = [block.word(i) for i in range(a, b)]
                if b - a == 1:
                    self.alone[block.hash[a] >> np.uint64(64 - _BITS)] = self.any_alone = True
                elif b - a > 1:
                    self.pair[hashes[a : b - 1]] = True
                    self.pairs = min(self.pairs, int(b - a))
        self.pairs -= 1  # neighbours in the shortest window
        self.automaton = SuffixAutomaton(items, window)

    @staticmethod
    def _pairs(h: np.ndarray) -> np.ndarray:
        mix = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        return (mix * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - _BITS)

    def runs(self, words: Words) -> list[tuple[int, int, int]]:
        """(text, first word, last word) of all runs in which a window can occur."""
        near = self.pair[self._pairs(words.hash)] if len(words.hash) > 1 else np.zeros(0, bool)
        begins = words.first[1:-1]
        near[begins[(begins > 0) & (begins <= len(near))] - 1] = False
        edge = np.flatnonzero(np.diff(np.concatenate([[0], near.view(np.int8), [0]])))
        a, b = edge[::2], edge[1::2]
        long = b - a >= self.pairs
        found = list(zip(a[long].tolist(), b[long].tolist(), strict=True))
        if self.any_alone:
            found += [(int(k), int(k)) for k in np.flatnonzero(self.alone[words.hash >> np.uint64(64 - _BITS)])]
        text = np.searchsorted(words.first, [a for a, _ in found], "right") - 1
        return [(int(t), a, b) for t, (a, b) in zip(text, found, strict=True)]

    def hits(self, words: Words) -> dict[int, tuple[set[int], set[str | None]]]:
        """By text of the block: hit words (counted in the block) and items."""
        out: dict[int, tuple[set[int], set[str | None]]] = {}
        for text, a, b in self.runs(words):
            for first, last, items in self.automaton.stream([words.word(k) for k in range(a, b + 1)]):
                hit, names = out.setdefault(text, (set(), set()))
                hit.update(range(a + first, a + last + 1))
                names.update(self.ids[k] for k in items)
        return out


def _spans(hit: set[int]) -> list[tuple[int, int]]:
    """Runs of consecutive words."""
    k = np.array(sorted(hit))
    cut = np.flatnonzero(np.diff(k) > 1) + 1
    return [(int(p[0]), int(p[-1])) for p in np.split(k, cut)]


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("coverage", T.DoubleType()),
    ]
)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None, clean: bool = False, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """Adds n_words, n_hit, items (sorted as strings), items_sha256 and coverage (n_hit / n_words) to each row.

    clean: the text loses its hit spans, from the first hit word to the last of each run,
    before it is returned; keep must hold it then. A null or empty text has no words. Items
    without words never occur; items of equal text are each found. Repeated rows each get
    a row. Columns of docs named as a result are replaced. An item without an id is found as
    null, which has no part in items_sha256. The benchmark is divided by hash into automata of
    about automaton_words words. Each automaton but the last is a pass whose finds are
    written before the next.
    """
    spark = docs.sparkSession
    made = [f.name for f in RESULT]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made and c != "__hit"]
    items = benchmark.select(benchmark[item].cast("string").alias("id"), benchmark[item_text].alias("t")).where("t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") / 2 + 1), F.lit(0.0))).first()[0]
    passes = max(1, -(-int(size) // automaton_words))
    columns = keep if text in keep else [*keep, text]
    found = T.StructType([T.StructField("__hit", T.ArrayType(T.LongType())), T.StructField("__items", T.ArrayType(T.StringType()))])
    out = docs.select(*columns)
    for n in range(passes):
        # the driver holds the items of one pass at a time
        chunk = sorted(items.where(F.pmod(F.xxhash64("id", "t"), F.lit(passes)) == n).collect(), key=lambda r: (r[0] or "", r[1]))
        shared = spark.sparkContext.broadcast(([r[0] for r in chunk], [r[1] for r in chunk]))
        last = n == passes - 1
        schema = T.StructType([*[out.schema[c] for c in (keep if last else columns)], *(RESULT if last else found)])
        names = [f.name for f in schema]

        @tidy
        def run(batches, shared=shared, last=last, names=names, columns=columns):
            detector = Detector(*shared.value, window)
            for batch in batches:
                yield from _scan_batch(batch, detector, text, columns, names, last, clean)

        out = out.mapInArrow(run, schema)
        if not last:
            out = written(out, "decontamination")
    return out


def _scan_batch(batch: pa.RecordBatch, detector: Detector, text: str, columns: list[str], names: list[str], last: bool, clean: bool) -> Iterator[pa.RecordBatch]:
    column = batch.column(columns.index(text))
    before = [batch.column(k).to_pylist() for k in (len(columns), len(columns) + 1)] if batch.num_columns > len(columns) else None
    n_words, n_hit, items, texts = [], [], [], {}
    hits: list[list[int]] = []
    for block in words_of(column):
        own = detector.hits(block)
        count = np.diff(block.first)
        n_words.append(count)
        for t in range(len(count)):
            row = block.row + t
            hit, names_ = own.get(t, ((), ()))
            base = int(block.first[t])
            hit = {k - base for k in hit}
            names_ = set(names_)
            if before:
                hit.update(before[0][row] or ())
                names_.update(before[1][row] or ())
            hits.append(sorted(hit) if not last else [])
            n_hit.append(len(hit))
            items.append(sorted(names_, key=lambda x: (x is None, x or "")))
            if last and clean and hit:
                raw, parts, done = column[row].as_py().encode(), [], 0
                for a, b in _spans(hit):
                    s, e = (int(x - block.text_at[t]) for x in (block.start[base + a], block.end[base + b]))
                    parts.append(raw[done:s])
                    done = e
                texts[row] = b"".join([*parts, raw[done:]]).decode()
    if texts:
        values = column.to_pylist()
        for row, value in texts.items():
            values[row] = value
        column = pa.array(values, column.type)
    of = {c: batch.column(k) for k, c in enumerate(columns)} | {text: column}
    total = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
    if last:
        hit = np.array(n_hit, np.int64)
        of |= {
            "n_words": pa.array(total.astype(np.int64)),
            "n_hit": pa.array(hit),
            "items": pa.array(items, pa.list_(pa.string())),
            "items_sha256": pa.array([hashlib.sha256(",".join(k for k in x if k is not None).encode()).hexdigest() for x in items], pa.string()),
            "coverage": pa.array(hit / np.maximum(total, 1)),
        }
    else:
        of |= {"__hit": pa.array(hits, pa.list_(pa.int64())), "__items": pa.array(items, pa.list_(pa.string()))}
    yield pa.RecordBatch.from_arrays([of[c] for c in names], names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, text: str = "text", **options) -> DataFrame:
    """docs with the same columns: hit spans are cut out, and documents covered by more than max_coverage are left out."""
    names = [f"__in{k}" for k in range(len(docs.columns))]
    out = scan(docs.toDF(*names), benchmark, text=names[docs.columns.index(text)], clean=True, **options).where(f"coverage <= {max_coverage}")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
