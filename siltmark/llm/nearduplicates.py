"""Near-duplicates by improved consistent weighted sampling over tf-idf shingles.

Texts become weighted sets of five-word shingles: the weight is the shingle's count times
an idf between 1 and 2, from the number of texts that hold the shingle in the whole corpus.
Frequencies are exact: chunks of texts send each of their distinct shingle hashes once to the
task of its range, which adds up the counts and returns those over 1 (see Exchange).
A text's similarity to any other is at most the weight of its shingles that another row has, as
a part of its whole weight. Texts for which that is below the threshold can have no link, and
only the others are signed, banded and compared.

Improved consistent weighted sampling gives signatures whose rows agree with the
probability of the weighted Jaccard similarity. Rows are banded; texts that share a band
are candidates, and a pair is linked if its weighted Jaccard similarity, computed from the
texts, is at least the threshold. Classes are the connected components of links.

Equal texts are one node. In a bucket (texts that share a band) each is first compared with
one leader, the text that meets most others in all its buckets; that joins a bucket of
copies at a cost linear in its size. Texts that stay outside the bucket's largest class are
then compared with the bucket's texts of other classes. In buckets of more than PARTNERS
texts, shared weights bound what a pair can reach: shingles that no second text of these
buckets has don't count, the others are divided into GROUPS by hash, and with s the sum of
the smaller of the two shared weights by group, the similarity is at most s / (w1 + w2 - s).
Pairs that can't reach the threshold are left out, and so are texts that can't with any other.
The bound is exact, so no candidates are lost, and texts that only share a common passage, or
are far copies of one text, don't meet in pairs. Pairs of one class aren't compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import discard, written
from .words import BLOCK, Words, block_ends, buffers, mixed, release, shingle_hashes, tidy, words_of

SHINGLE = 5
THRESHOLD = 0.8
#: Bands and their rows. A pair at the threshold shares none with probability (1 - 0.8 ** 4) ** 16 = 0.0002.
BANDS, ROWS = 16, 4
#: Pairs of which a smaller part of signature rows agrees aren't verified; at 0.8 that is a chance of one in a million.
AGREE = 0.55
#: Texts of a bucket up to which pairs aren't bounded by shared weights first.
PARTNERS = 32
#: Groups of shingles whose shared weights are compared.
GROUPS = 48
#: Members of a large bucket in one block, about.
BLOCK_NODES = 512
#: Shingles and texts of a chunk of an Exchange, about, and shingles of a range.
CHUNK_SHINGLES, CHUNK_TEXTS, RANGE_SHINGLES = 1 << 20, 50_000, 1 << 19
#: Entries of the tables of random variates, for each row of the signature.
_POOL_BITS = 14
#: Ids that are broadcast at most where copies are left out.
BROADCAST_IDS = 500_000


def ordered(h: np.ndarray, high: np.ndarray | None = None) -> np.ndarray:
    """Order by (high, h); high is sorted. Packed keys are sorted first, which is several times faster than lexsort."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    place, top = max(1, (n - 1).bit_length()), 0 if high is None else int(high[-1]).bit_length()
    if place + top < 40:
        key = h >> np.uint64(top + place)
        key <<= np.uint64(place)
        if top:
            key |= high.astype(np.uint64) << np.uint64(64 - top)
        key |= np.arange(n, dtype=np.uint64)
        key.sort()
        key &= np.uint64((1 << place) - 1)
        order = key.view(np.int64)
        y = h[order]
        odd = y[1:] < y[:-1]
        if not (odd if high is None else odd & (high[order[1:]] == high[order[:-1]])).any():
            return order
    return np.argsort(h) if high is None else np.lexsort((h, high))


def weighted_shingles(block: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a block's texts, their counts, and where each text's begin (with the end)."""
    h, of = shingle_hashes(block, SHINGLE)
    texts = len(block.first) - 1
    if not len(h):
        return h, np.zeros(0), np.zeros(texts + 1, np.int64)
    order = ordered(h, of)
    h, of = h[order], of[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(of[at], np.arange(texts + 1))


def distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """(node, text): each text once."""
    return docs.select(F.xxhash64(text).alias("node"), F.col(text).alias("text")).where("text is not null").groupBy("node").agg(F.first("text").alias("text"))


def looked_up(h: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n of each hash, 1 for those that hashes (sorted) doesn't have."""
    if not len(hashes):
        return np.ones(len(h), np.int64)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[at] == h, n[at], 1)


def _packed(x: np.ndarray) -> bytes:
    """Bytes of whole numbers, all first bytes first: of sorted hashes these cost next to nothing when compressed."""
    raw = np.ascontiguousarray(x.astype(x.dtype.newbyteorder(">")).view(np.uint8).reshape(-1, x.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def _unpacked(raw: bytes, kind=np.uint64) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind.newbyteorder(">")).ravel().astype(kind)


class Exchange:
    """Counts in how many rows each shingle occurs, and gives the counts over 1 back to the texts.

    A chunk is some texts of one task. Its distinct shingle hashes, sorted, are divided into
    ranges; each range is a row with the hashes, the text of each in the chunk (or MANY), its
    count in that text and the number of the chunk's rows that have it. So even a shingle that
    every row has is sent once a chunk. The task of a range adds up the rows and returns the
    entries with more than one. Lists of the texts of MANY go by the chunk's own row, and both
    meet by chunk. rows and size: of the table, its rows and bytes of text.
    """

    MANY = (1 << 32) - 1
    FIELDS = ("h", "of", "c", "n", "nodes", "totals", "mh", "mof", "mc")

    def __init__(self, rows: int, size: int, threshold: float):
        self.rows, self.threshold = rows, threshold
        #: bits of a hash that tell its range
        self.bits = max(0, (size // 7 // RANGE_SHINGLES).bit_length())

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("range", T.LongType()), T.StructField("chunk", T.LongType()), *[T.StructField(f, T.BinaryType()) for f in self.FIELDS]])

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        whole, raw = pa.int64(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(list(x), whole if k < 2 else raw) for k, x in enumerate(zip(*rows, strict=True))], ["range", "chunk", *self.FIELDS])

    @tidy
    def ask(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (node, text)."""
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 28
        at = 0
        seen: dict[int, int] = {}
        copies: list[int] = []
        hashes: list[np.ndarray] = []
        of: list[np.ndarray] = []
        held = 0
        for b in batches:
            node = b.column(0).to_pylist()
            texts = b.column(1)
            # some MB at a time, so that a chunk can end between them
            for a, end in block_ends(buffers(texts)[1], 4 * BLOCK):
                fresh = []
                for i in range(a, end):
                    k = seen.setdefault(node[i], len(seen))
                    if k == len(copies):
                        copies.append(1)
                        fresh.append(i)
                    else:
                        copies[k] += 1
                first = len(seen) - len(fresh)
                for block in words_of(texts.take(pa.array(fresh, pa.int64()))):
                    h, text = shingle_hashes(block, SHINGLE)
                    hashes.append(h)
                    of.append((text + (first + block.row)).astype(np.uint32))
                    held += len(h)
                if held >= CHUNK_SHINGLES or len(seen) > CHUNK_TEXTS:
                    yield from self._chunk(base + at, seen, copies, hashes, of)
                    at, seen, copies, hashes, of, held = at + 1, {}, [], [], [], 0
                    release()
        if seen:
            yield from self._chunk(base + at, seen, copies, hashes, of)

    def _chunk(self, chunk: int, seen: dict[int, int], copies: list[int], hashes: list[np.ndarray], of: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        of = np.concatenate(of) if of else np.zeros(0, np.uint32)
        rows_of = np.array(copies)
        totals = np.bincount(of, minlength=len(copies))
        order = ordered(h)
        h, of = h[order], of[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.append(at, len(h)))
        each, text, c = h[at], of[at], np.ones(len(at), np.int64)
        n = rows_of[text] if len(at) else np.zeros(0, np.int64)
        # entries that occur several times, in one text or in several
        several = size > 1
        inside = np.repeat(several, size)
        mh, mof = h[inside], of[inside]
        by = np.lexsort((mof, mh))
        mh, mof = mh[by], mof[by]
        new = np.flatnonzero(np.concatenate([[True], (mh[1:] != mh[:-1]) | (mof[1:] != mof[:-1])])) if len(mh) else np.zeros(0, np.int64)
        mc = np.diff(np.append(new, len(mh)))
        mh, mof = mh[new], mof[new]
        group = np.flatnonzero(np.concatenate([[True], mh[1:] != mh[:-1]])) if len(mh) else np.zeros(0, np.int64)
        if len(group):
            texts = np.diff(np.append(group, len(mh)))
            n[several] = np.add.reduceat(rows_of[mof], group)
            c[several] = np.where(texts == 1, mc[group], 1)
            text[several] = np.where(texts == 1, mof[group], self.MANY)
            many = np.repeat(texts > 1, texts)
            mh, mof, mc = mh[many], mof[many], mc[many]
        cut = np.searchsorted(each, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)) if self.bits else np.zeros(1, np.int64)
        cut = np.append(cut, len(each))
        out = [(chunk % (1 << self.bits), chunk, None, None, None, None, _packed(np.array(list(seen), np.int64)), _packed(totals.astype(np.uint32)), _packed(mh), _packed(mof), _packed(mc.astype(np.uint32)))]
        for r in np.flatnonzero(np.diff(cut)).tolist():
            x = slice(cut[r], cut[r + 1])
            out.append((r, chunk, _packed(each[x]), _packed(text[x]), _packed(c[x].astype(np.uint32)), _packed(n[x].astype(np.uint32)), None, None, None, None, None))
        for k in range(0, len(out), 64):
            yield self._batch(out[k : k + 64])

    def count(self, table: pa.Table) -> pa.Table:
        """Of one range: the entries that several rows have, with the number of rows as n; rows of chunks as they are."""
        rows = table.to_pylist()
        asks = [r for r in rows if r["h"] is not None]
        out = [tuple(r.values()) for r in rows if r["h"] is None]
        hashes = [_unpacked(r["h"]) for r in asks]
        if asks:
            h = np.concatenate(hashes)
            n = np.concatenate([_unpacked(r["n"], np.uint32) for r in asks])
            order = ordered(h)
            at = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
            total = np.empty(len(h), np.uint32)
            total[order] = np.repeat(np.add.reduceat(n[order], at), np.diff(np.append(at, len(h))))
            done = 0
            for r, x in zip(asks, hashes, strict=True):
                own = total[done : done + len(x)]
                done += len(x)
                keep = own > 1
                if keep.any():
                    of, c = _unpacked(r["of"], np.uint32), _unpacked(r["c"], np.uint32)
                    out.append((r["range"], r["chunk"], _packed(x[keep]), _packed(of[keep]), _packed(c[keep]), _packed(own[keep]), None, None, None, None, None))
        release()
        return pa.Table.from_batches([self._batch(out)]) if out else table.slice(0, 0)

    def answer(self, table: pa.Table) -> pa.Table:
        """Of one chunk: (node, dh, dn) of its texts that can be similar to another, with the hashes that several rows have, sorted, and their numbers of rows."""
        rows = table.to_pylist()
        own = next(r for r in rows if r["nodes"] is not None)
        got = [r for r in rows if r["h"] is not None]
        node, totals = _unpacked(own["nodes"], np.int64), _unpacked(own["totals"], np.uint32).astype(np.int64)
        kinds = {"h": np.uint64, "of": np.uint32, "c": np.uint32, "n": np.uint32}
        h, of, c, n = (np.concatenate([*[_unpacked(r[k], kind) for r in got], np.zeros(0, kind)]) for k, kind in kinds.items())
        of, c, n = (x.astype(np.int64) for x in (of, c, n))
        many = of == self.MANY
        mh = _unpacked(own["mh"])
        if len(mh):
            # ranges come in any order
            by = np.argsort(h[many], kind="stable")
            at = np.searchsorted(h[many][by], mh)
            h, n = np.concatenate([h[~many], mh]), np.concatenate([n[~many], n[many][by][at]])
            of = np.concatenate([of[~many], _unpacked(own["mof"], np.uint32).astype(np.int64)])
            c = np.concatenate([c[~many], _unpacked(own["mc"], np.uint32).astype(np.int64)])
        weight = np.bincount(of, weights=c * idf_of(n, self.rows), minlength=len(node))
        alone = (totals - np.bincount(of, weights=c, minlength=len(node))) * idf_of(np.ones(1), self.rows)[0]
        able = (weight > 0) & (weight >= (self.threshold - 1e-6) * (weight + alone))
        keep = able[of] if len(of) else np.zeros(0, bool)
        h, n, of = h[keep], n[keep], of[keep]
        order = np.lexsort((h, of))
        h, n, of = h[order], n[order], of[order]
        which = np.flatnonzero(able)
        at = pa.array(np.append(np.searchsorted(of, which), len(of)).astype(np.int32))
        return pa.table({"node": pa.array(node[which]), "dh": pa.ListArray.from_arrays(at, pa.array(h.view(np.int64))), "dn": pa.ListArray.from_arrays(at, pa.array(n))})

    def run(self, docs: DataFrame, text: str) -> DataFrame:
        """(node, dh, dn) of the texts that can be similar to another; a text that several chunks have comes several times."""
        asked = docs.select(F.xxhash64(text).alias("node"), F.col(text).cast("string").alias("text")).where("text is not null").mapInArrow(self.ask, self.schema)
        counted = asked.groupBy("range").applyInArrow(lambda t: self.count(t), self.schema)
        return counted.groupBy("chunk").applyInArrow(lambda t: self.answer(t), "node long, dh array<long>, dn array<long>")


def idf_of(frequencies: np.ndarray, documents: int) -> np.ndarray:
    """1 for a shingle of all texts to 2 for one of a single text, by the logarithm."""
    n = max(documents, 2)
    return 1 + np.log(n / np.clip(frequencies, 1, n)) / np.log(n)


class Sampler:
    """Improved consistent weighted sampling: for a shingle and a row, gamma variates r and c and a uniform b are drawn from tables by the shingle's hash."""

    def __init__(self, rows: int = BANDS * ROWS, bands: int = BANDS):
        rng = np.random.default_rng(20)
        n = 1 << _POOL_BITS
        self.rows, self.bands = rows, bands
        self.multiplier = rng.integers(1 << 62, size=rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.r = rng.gamma(2, 1, (rows, n)).astype(np.float32)
        self.c = np.log(rng.gamma(2, 1, (rows, n))).astype(np.float32)
        self.b = rng.random((rows, n)).astype(np.float32)

    def sign(self, h: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Signatures (uint32) of the texts that have shingles, in order."""
        size = np.diff(at)
        start = at[:-1][size > 0]
        size = size[size > 0]
        out = np.zeros((len(start), self.rows), np.uint32)
        if not len(start):
            return out
        s = np.log(weights).astype(np.float32)
        for k in range(self.rows):
            place = (h * self.multiplier[k]) >> np.uint64(64 - _POOL_BITS)
            r, b = self.r[k][place], self.b[k][place]
            t = np.floor(s / r + b)
            a = self.c[k][place] - r * (t - b) - r
            least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, start), size))
            # of equal values the smallest hash counts: shingles are in order
            least = least[np.searchsorted(least, start)]
            out[:, k] = mixed(h[least] + t[least].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band."""
        out = np.zeros((len(signatures), self.bands), np.uint64)
        rows = self.rows // self.bands
        for j in range(self.bands):
            k = np.full(len(signatures), j + 1, np.uint64)
            for i in range(j * rows, (j + 1) * rows):
                k = mixed(k * np.uint64(0x100000001B3) + signatures[:, i])
            out[:, j] = k
        return out.view(np.int64)


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of sorted hashes."""
    _, a, b = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = float(np.minimum(wa[a], wb[b]).sum())
    every = float(wa.sum() + wb.sum()) - both
    return both / every if every > 0 else 0.0


def _known_sets(column: pa.Array, dh: pa.Array, dn: pa.Array, documents: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts with their shingles' hashes, weights, and where each text's begin; dh and dn are those of an Exchange."""
    for block in words_of(column):
        h, count, at = weighted_shingles(block)
        n = np.ones(len(h), np.int64)
        for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            d = dh[block.row + i]
            if d.is_valid:
                n[a:b] = looked_up(h[a:b], np.asarray(d.values).view(np.uint64), np.asarray(dn[block.row + i].values))
        yield block, h, count * idf_of(n, documents), at


def _weighted(column: pa.Array, dh: pa.Array, dn: pa.Array, documents: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(h[a:b], w[a:b]) for _, h, w, at in _known_sets(column, dh, dn, documents) for a, b in zip(at[:-1], at[1:], strict=True)]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of links (a, b): root is the smallest node that can be reached.

    Alternating large-star and small-star steps; each halves the length of chains, about.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        edges = written(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


class _Search:
    def __init__(self, docs: DataFrame, text: str, threshold: float):
        self.threshold = threshold
        self.n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()
        n = self.n
        common = written(Exchange(n, size, threshold).run(docs, text), "common")
        rows = docs.select(F.xxhash64(text).alias("node"), F.col(text).alias("text"))
        held = rows.join(self._hint(common.select("node").distinct()), "node", "left_semi")
        each = common.groupBy("node").agg(F.first("dh").alias("dh"), F.first("dn").alias("dn"))
        self.texts = written(distinct_texts(held, "text").join(each, "node").select("node", "text", "dh", "dn"), "texts")
        discard(common)
        sampler = docs.sparkSession.sparkContext.broadcast(Sampler())

        @tidy
        def sign(batches):
            for batch in batches:
                node = np.asarray(batch.column(0))
                for block, h, w, at in _known_sets(*batch.columns[1:], n):
                    signature = sampler.value.sign(h, w, at)
                    has = block.row + np.flatnonzero(np.diff(at) > 0)
                    keys = sampler.value.keys(signature)
                    if len(has):
                        width = BANDS * ROWS
                        yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.FixedSizeBinaryArray.from_buffers(pa.binary(width * 4), len(has), [None, pa.py_buffer(np.ascontiguousarray(signature))]).cast(pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))], ["node", "signature", "bands"])

        schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("signature", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
        self.nodes = written(self.texts.mapInArrow(sign, schema), "signatures")
        self.links: DataFrame | None = None
        self.classes: DataFrame | None = None

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b) of nodes those that are similar."""
        width = BANDS * ROWS

        @tidy
        def agree(batches):
            for b in batches:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(-1, width) for k in (2, 3))
                keep = np.flatnonzero((x == y).mean(axis=1) >= AGREE)
                yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(keep)) for k in (0, 1)], ["a", "b"])

        pair = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
        sides = [self.nodes.select(F.col("node").alias(s), F.col("signature").alias(f"s{s}")) for s in ("a", "b")]
        likely = written(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sa", "sb").mapInArrow(agree, pair), "likely")
        texts = written(self.texts_of(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "texts")
        ends = [texts.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("text", "dh", "dn")]) for s in ("a", "b")]
        joined = likely.join(ends[0], "a").join(ends[1], "b").select("a", "b", *[f"{c}_{s}" for s in ("a", "b") for c in ("text", "dh", "dn")])
        n, threshold = self.n, self.threshold

        @tidy
        def compare(batches):
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    left, right = _weighted(*part.columns[2:5], n), _weighted(*part.columns[5:8], n)
                    keep = [i for i, (x, y) in enumerate(zip(left, right, strict=True)) if similarity(*x, *y) >= threshold - 1e-9]
                    yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], ["a", "b"])

        return joined.mapInArrow(compare, pair)

    def texts_of(self, ids: DataFrame) -> DataFrame:
        """(node, text, dh, dn) of some nodes."""
        return self.texts.join(self._hint(ids), "node", "left_semi")

    @staticmethod
    def _hint(ids: DataFrame) -> DataFrame:
        """Broadcast up to BROADCAST_IDS rows, of 8 bytes each."""
        ids = written(ids, "ids")
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def link(self, pairs: DataFrame) -> None:
        """Verifies pairs and brings the classes up to date."""
        found = written(self.verified(pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), "found")
        self.links = found if self.links is None else self.links.unionByName(found)
        self.classes = components(self.links)

    def classed(self, members: DataFrame) -> DataFrame:
        """members (key, node, ...) with their class."""
        return members.join(self.classes, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")

    def crowded(self) -> DataFrame:
        """(key, node, n): members of the bands that several nodes share."""
        members = self.nodes.select(F.explode("bands").alias("key"), "node")
        n = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return written(members.join(n, "key"), "buckets")

    def mixed_buckets(self, members: DataFrame) -> DataFrame:
        """Members of buckets with several classes: their class, and the bucket's largest class as top."""
        of = self.classed(members)
        by = of.groupBy("key", "class").agg(F.count(F.lit(1)).alias("c"))
        top = by.groupBy("key").agg(F.max_by("class", F.struct("c", "class")).alias("top"), F.count(F.lit(1)).alias("classes")).where("classes > 1").drop("classes")
        return written(of.join(top, "key"), "mixed")

    def shared_weights(self, ids: DataFrame) -> DataFrame:
        """(node, w, s, g): a node's whole weight, that of its shingles that another of these nodes has, and this by group."""
        n = self.n

        @tidy
        def shingles(batches):
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    sets = _weighted(*part.columns[1:], n)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h.view(np.int64) for h, _ in sets], pa.list_(pa.int64())), pa.array([w for _, w in sets], pa.list_(pa.float64()))], ["node", "h", "w"])

        schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("h", T.ArrayType(T.LongType())), T.StructField("w", T.ArrayType(T.DoubleType()))])
        sets = written(self.texts_of(ids).mapInArrow(shingles, schema), "shingles")
        flat = sets.select("node", F.inline(F.arrays_zip("h", "w")))
        several = flat.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
        by = flat.join(several, "h", "left_semi").groupBy("node", F.pmod("h", F.lit(GROUPS)).cast("int").alias("k")).agg(F.sum("w").alias("w"))
        # at most GROUPS entries for a node
        s = by.groupBy("node").agg(F.sum("w").alias("s"), F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("m"))
        g = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)))
        w = sets.select("node", F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("w"))
        return written(w.join(s.select("node", "s", g.alias("g")), "node").select("node", "w", "s", "g"), "weights")

    @staticmethod
    def pairs_of(members: DataFrame) -> DataFrame:
        """Of each bucket: its members outside the largest class with its members of other classes."""
        asks = members.where(F.col("class") != F.col("top")).select(F.col("key").alias("ka"), F.col("node").alias("a"), F.col("class").alias("ca"))
        rows = members.select("key", F.col("node").alias("b"), F.col("class").alias("cb"))
        return asks.join(rows, (F.col("ka") == F.col("key")) & (F.col("ca") != F.col("cb"))).select("a", "b")

    def bounded_pairs(self, members: DataFrame) -> DataFrame:
        """The same, of pairs that can reach the threshold, each in the bucket of the first band that it shares.

        A bucket's members are packed in blocks of about BLOCK_NODES; blocks of those that
        ask meet blocks of all members, and a task compares a pair of blocks at a time.
        """
        t = self.threshold - 1e-9
        blocks = members.withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK_NODES).cast("long")))
        packed = F.collect_list(F.struct("node", "class", "w", "s", "g", "bands"))
        asks = blocks.where(F.col("class") != F.col("top")).groupBy("key", "block").agg(packed.alias("x")).select("key", "x")
        rows = blocks.groupBy("key", "block").agg(packed.alias("y")).select("key", "y")

        def unpacked(column) -> tuple[np.ndarray, ...]:
            v = column.flatten()
            n = len(v)
            g, bands = (v.field(k).flatten() for k in ("g", "bands"))
            return *(np.asarray(v.field(k)) for k in ("node", "class", "w", "s")), np.asarray(g).reshape(n, -1), np.asarray(bands).reshape(n, -1)

        @tidy
        def compare(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    key = batch.column(0)[i].as_py()
                    (na, ca, wa, sa, ga, ba), (nb, cb, wb, sb, gb, bb) = (unpacked(batch.column(k).slice(i, 1)) for k in (1, 2))
                    every = wa[:, None] + wb[None]
                    least = np.minimum(sa[:, None], sb[None])
                    x, y = np.nonzero((ca[:, None] != cb[None]) & (least >= t * (every - least)))
                    found = []
                    for part in np.array_split(np.arange(len(x)), max(1, len(x) // 20_000)):
                        p, q = x[part], y[part]
                        same = ba[p] == bb[q]
                        mine = ba[p, same.argmax(axis=1)] == key
                        p, q = p[mine], q[mine]
                        total = np.minimum(ga[p], gb[q]).sum(axis=1)
                        can = total >= t * (wa[p] + wb[q] - total)
                        found.append((na[p[can]], nb[q[can]]))
                    a, b = (np.concatenate(z) for z in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        return asks.join(rows, "key").select("key", "x", "y").mapInArrow(compare, "a long, b long")

    def run(self) -> DataFrame:
        """(node, root) of all nodes with a link."""
        members = self.crowded()
        met = members.groupBy("node").agg(F.sum("n").alias("met"))
        leader = members.join(met, "node").groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("a"))
        self.link(members.join(leader, "key").select("a", F.col("node").alias("b")))
        mixed_ = self.mixed_buckets(members)
        if mixed_.isEmpty():
            return self.classes
        pairs = self.pairs_of(mixed_.where(F.col("n") <= PARTNERS))
        large = mixed_.where(F.col("n") > PARTNERS)
        if not large.isEmpty():
            weights = self.shared_weights(large.select("node").distinct())
            t = self.threshold - 1e-9
            able = large.join(weights.where(F.col("s") >= t * F.col("w")), "node")
            able = able.join(self.nodes.select("node", "bands"), "node")
            pairs = pairs.unionByName(self.bounded_pairs(able))
        self.link(pairs)
        return self.classes


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, class_id, kept) for each row: the class's smallest key, and whether it is that of the row.

    Texts of fewer than five words, but some, are one shingle. Texts without words are
    copies of equal texts only, and so are nulls of each other. Repeated rows are copies;
    each has kept as their key says. A null key is the largest. Other columns are ignored.
    An empty table gives an empty result. Texts are told apart by a 64-bit hash: of n different
    texts about n * n / 2 ** 65 pairs share one. docs is read several times, so it should be a
    table or a result whose rows come out the same, and in the same order, each time.
    """
    rows, classes = _classes(docs, text, key, threshold)
    return rows.join(classes, ["node", "none"]).select(F.col("key").alias(key), "class_id", F.col("key").eqNullSafe(F.col("class_id")).alias("kept"))


def _classes(docs: DataFrame, text: str, key: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows (key, node, none), and for each node (node, none): class_id and of the texts with this key the one that is kept, as keeper."""
    rows = written(docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("node"), F.col(text).isNull().alias("none")), "near-rows")
    search = _Search(docs, text, threshold)
    roots = search.run()
    least = rows.groupBy("node", "none").agg(F.min("key").alias("own"))
    rooted = least.join(roots.withColumn("none", F.lit(False)), ["node", "none"], "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("own").isNull(), "own", "node")).alias("f")
    by = rooted.groupBy("root", "none").agg(F.min("own").alias("class_id"), first).select("root", "none", "class_id", F.col("f.node").alias("keeper"))
    return rows, written(by.join(rooted.select("node", "none", "root"), ["root", "none"]).select("node", "none", "class_id", "keeper"), "near-classes")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without all near-duplicates but one of each class, that of the smallest key.

    Of repeated rows of that key, one stays, and of several texts of it in the class one; null keys are
    the largest. Rows to drop are told by key and text.
    """
    rows, classes = _classes(docs, text, key, threshold)
    found = written(rows.join(classes, ["node", "none"]).select("key", "node", "none", (F.col("key").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("keeper"))).alias("kept")), "near-found")
    if found.count() != found.select("key", "node", "none").distinct().count():
        docs = docs.dropDuplicates([key, text])
    gone = found.where(~F.col("kept")).select(F.col("key").alias("__gone"), F.col("node").alias("__node"), F.col("none").alias("__none")).distinct()
    gone = written(gone, "near-gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    same = F.col(key).eqNullSafe(F.col("__gone")) & (F.xxhash64(text) == F.col("__node")) & (F.col(text).isNull() == F.col("__none"))
    return docs.join(gone, same, "left_anti")
