"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words, hashed, and its shapes: three-grams of character classes (lower,
upper, digit, white space, each punctuation mark), which tell prose from shouting, tables and
mark-up, and counts of repeated words. Weighted by tf-idf, words and shapes each to a fixed part
of the length, they are projected on the leading singular vectors of a bounded sample of
labelled texts. The sample's vectors are broadcast; for every document
the cosine to each of them is computed, in blocks, and the most similar vote with weights
by similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Words, tidy, words_of

#: Labelled texts that vote, at most.
SAMPLE = 3000
#: Terms of shapes and of words, the part of words in a vector's squared length, latent dimensions, neighbours that vote.
SHAPES, WORDS, WORD_PART, DIMENSIONS, NEIGHBOURS = 4096, 4096, 0.3, 64, 25
TERMS = SHAPES + WORDS
#: Documents of one block of cosines.
BLOCK_ROWS = 256
PREDICTED_FROM = 0.3

_CLASSES = 32
_CLASS = np.full(256, 3, np.uint64)
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 4
_CLASS[[32, 9, 11, 12, 13]] = 5
_CLASS[10] = 6
for _k, _c in enumerate(b".,;:!?'\"-()[]{}|#*%&$@/\\_=+<>~^`"):
    _CLASS[_c] = 7 + _k % (_CLASSES - 7)
#: The last terms of shapes count words equal to the one before, to the one before that, to any before, and others.
_WORD_TERMS = 8


def term_counts(block: Words) -> np.ndarray:
    """Counts of terms, a row for each text of the block."""
    texts = len(block.text_at) - 1
    out = np.zeros((texts, TERMS), np.float32)
    c = _CLASS[block.raw]
    text = np.repeat(np.arange(texts), np.diff(block.text_at))
    if len(c) > 2:
        gram = ((c[:-2] * np.uint64(_CLASSES) + c[1:-1]) * np.uint64(_CLASSES) + c[2:]) * np.uint64(0x9E3779B97F4A7C15)
        term = ((gram >> np.uint64(32)) % np.uint64(SHAPES - _WORD_TERMS)).astype(np.int64)
        same = text[:-2] == text[2:]
        flat = text[:-2][same] * TERMS + term[same]
        out += np.bincount(flat, minlength=texts * TERMS).reshape(texts, TERMS)
    h, of = block.hash, block.text_of()
    if len(h):
        for k in (1, 2):
            if len(h) > k:
                again = (h[k:] == h[:-k]) & (of[k:] == of[:-k])
                out[:, SHAPES - k] = np.bincount(of[k:][again], minlength=texts)
        _, first = np.unique(h + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
        fresh = np.zeros(len(h), bool)
        fresh[first] = True
        out[:, SHAPES - 3] = np.bincount(of[~fresh], minlength=texts)
        out[:, SHAPES - 4] = np.bincount(of[fresh], minlength=texts)
        word = SHAPES + (h % np.uint64(WORDS)).astype(np.int64)
        out += np.bincount(of * TERMS + word, minlength=texts * TERMS).reshape(texts, TERMS)
    return out


def _blocks(column: pa.Array):
    """Term counts of the rows of a column, in blocks of at most BLOCK_ROWS rows."""
    for a in range(0, max(len(column), 0), BLOCK_ROWS):
        for block in words_of(column.slice(a, BLOCK_ROWS)):
            yield term_counts(block)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log frequencies relative to the text's length, times idf; shapes and words have their parts of the unit length."""
    out = np.empty(counts.shape, np.float32)
    for of, part in ((slice(0, SHAPES), 1 - WORD_PART), (slice(SHAPES, TERMS), WORD_PART)):
        c = counts[:, of]
        x = np.log1p(c * (1000.0 / np.maximum(c.sum(axis=1, keepdims=True), 1))).astype(np.float32) * idf[of]
        out[:, of] = x * (part**0.5 / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9))
    return out


class Model:
    """idf, the projection, and the sample's latent vectors and labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS):
        self.labels = labels.astype(np.float32)
        n = len(counts)
        self.idf = (np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
        x = weighted(counts, self.idf)
        rng = np.random.default_rng(0)
        k = min(dimensions, n, TERMS)
        y = x @ rng.standard_normal((TERMS, min(k + 16, n, TERMS))).astype(np.float32)
        for _ in range(4):
            y = np.linalg.qr(x @ (x.T @ np.linalg.qr(y)[0]))[0]
        self.axes = np.linalg.svd(y.T @ x, full_matrices=False)[2][:k].T.astype(np.float32)
        self.vectors = self._unit(x @ self.axes)
        self.prior = float(self.labels.mean()) if n else 0.5

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Mean label of the nearest, weighted by similarity, with one vote of the prior."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosine = self._unit(weighted(counts, self.idf) @ self.axes) @ self.vectors.T
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        near.sort(axis=1)
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** 8
        return np.clip((np.sum(weight * self.labels[near], axis=1) + self.prior) / (weight.sum(axis=1) + 1), 0.0, 1.0)


def held_out(key: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of at most ``sample`` labelled rows, chosen by a hash; held-out rows and null labels don't count.

    Labels are chosen by their ids' hash, equal rows of labels once. Of the documents that have these ids, equal
    ones once, the first ``sample`` by a hash of id and text vote; one with several labels votes with each.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("__key"), F.col(label).cast("double").alias("__label"))
    picked = usable.distinct().orderBy(F.xxhash64("__key", F.lit("quality")), "__key", "__label").limit(sample)
    rows = docs.join(F.broadcast(picked), docs[key] == picked["__key"]).select("__key", "__label", F.col(text).alias("__text"))
    by = F.xxhash64("__key", "__text", F.lit("quality")).alias("__hash")
    rows = rows.groupBy("__key", "__label", by).agg(F.first("__text").alias("__text")).orderBy("__hash", "__key", "__label").limit(sample).drop("__hash")

    def terms(batches):
        for batch in batches:
            found = [(k := np.flatnonzero(row), row[k]) for counts in _blocks(batch.column(2)) for row in counts]
            of, n = pa.array([k for k, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), of, n], ["key", "label", "term", "count"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("label", T.DoubleType()), T.StructField("term", T.ArrayType(T.IntegerType())), T.StructField("count", T.ArrayType(T.FloatType()))])
    got = rows.mapInArrow(terms, schema).toArrow().sort_by([("key", "ascending"), ("label", "ascending")])
    counts = np.zeros((got.num_rows, TERMS), np.float32)
    row = 0
    for batch in got.to_batches():
        for t, c in zip(batch.column(2), batch.column(3), strict=True):
            counts[row, t.values.to_numpy()] = c.values.to_numpy()
            row += 1
    return Model(counts, np.array(got.column("label").to_pylist(), np.float64))


RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score_quality(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, predicted_from: float = PREDICTED_FROM) -> DataFrame:
    """Adds score (0 to 1, the likelihood of label 1) and predicted (1 from predicted_from on).

    A null or empty text has no terms; it is as near to all the sample and gets the prior.
    Repeated rows each get a row; columns named as a result are replaced. Without any
    labelled row all scores are 0.5.
    """
    made = RESULT.names
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    columns = keep if text in keep else [*keep, text]
    source = docs.select(*[f"`{c}`" for c in columns])
    schema = T.StructType([*[source.schema[c] for c in keep], *RESULT])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    index = columns.index(text)

    @tidy
    def run(batches):
        for batch in batches:
            scores = [shared.value.score(c) for c in _blocks(batch.column(index))]
            score = np.concatenate(scores) if scores else np.zeros(0)
            kept = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score, pa.float64()), pa.array((score >= predicted_from).astype(np.int32))], [*keep, *made])

    return source.mapInArrow(run, schema)
