"""Texts to ids of a SentencePiece model and back, each distinct marked word segmented once.

A model whose pieces don't cross whitespace markers segments the stretches between markers
independently: a stretch is a run of markers and what follows up to the next. Its distinct
stretches, not its occurrences, are segmented, and ids are joined back by position:

* `chunk_table` counts stretches over all texts, and segments the most frequent ones once, in Spark
  (at most TABLE_ROWS of them, each of at most TABLE_CHARS characters, so the table's size is bounded);
* `encode` looks stretches up in that table. A stretch that isn't there is segmented once by the task that
  meets it and kept in a table of the task's own, which starts anew when it holds OWN_ROWS.

No text and no occurrence is shuffled. Null texts are empty and have no ids. Every row of the input gives one
row, repeated or not; columns named `ids` or `decoded` in the input are replaced by the result's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import discard, written
from .words import block_ends, buffers, tidy

MARKER = "▁"
TABLE_ROWS = 1 << 17
TABLE_CHARS = 64
OWN_ROWS = 1 << 18
#: A task reports stretches that it meets so often, of each COUNT_ROWS distinct ones. The table only saves work, so the rest may stay out of it.
COUNT_LEAST = 4
COUNT_ROWS = 1 << 18
#: Characters of a text worked on at once, up to the next marker.
SLICE = 1 << 20

_STRETCH = re.compile(" +[^ ]*")
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


@dataclass(frozen=True)
class Model:
    """A model file's bytes. Models that this method doesn't hold for are an error."""

    proto: bytes

    @staticmethod
    def read(path: str) -> Model:
        """Of a file on the driver; executors get its bytes."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            proto = f.read()
        spec = pb.ModelProto.FromString(proto)
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep texts as they are and mark words in front are supported")
        if any(p.type == _USER or MARKER in p.piece.lstrip(MARKER) for p in spec.pieces if p.type != _CONTROL):
            raise ValueError("pieces of this model cross whitespace markers")
        return Model(proto)

    def processor(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.proto)

    def piece_bytes(self) -> list[bytes | None]:
        """What each id adds to a text; null where the library's rules for special ids are needed."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        pieces = pb.ModelProto.FromString(self.proto).pieces
        plain = {_NORMAL: lambda p: p.replace(MARKER, " ").encode(), _BYTE: lambda p: bytes([int(p[3:5], 16)])}
        return [plain[p.type](p.piece) if p.type in plain else None for p in pieces]


def stretches(text: str) -> Iterator[list[str]]:
    """The stretches of a text in order, a slice of it at a time; markers are spaces."""
    if not text:
        return
    text = " " + text.replace(MARKER, " ")
    at = 0
    while at < len(text):
        # a slice ends before a space that follows another character
        end = at + SLICE
        while end < len(text) and not (text[end] == " " and text[end - 1] != " "):
            end = text.find(" ", end + 1)
            if end < 0:
                end = len(text)
        yield _STRETCH.findall(text, at, min(end, len(text)))
        at = end


def _packed(sp, new: list[str]) -> list[bytes]:
    """Ids of stretches as little-endian int32. The library puts the first marker before a text itself."""
    return [np.asarray(ids, "<i4").tobytes() for ids in sp.encode([s[1:] for s in new], num_threads=1)] if new else []


class _Table(dict):
    """Packed ids by stretch; one that is missing is segmented when it is asked for."""

    def __init__(self, sp, own: int):
        super().__init__()
        self.sp, self.own, self.new = sp, own, 0

    def __missing__(self, stretch: str) -> bytes:
        # a stretch of one marker has an id of its own: the library takes it as an empty text
        out = np.asarray(self.sp.encode(stretch[1:]) if len(stretch) > 1 else [self.sp.piece_to_id(MARKER)], "<i4").tobytes()
        if self.new < self.own:
            self[stretch] = out
            self.new += 1
        return out


def _text_blocks(column: pa.Array) -> Iterator[list[str | None]]:
    _, at = buffers(column)
    for a, b in block_ends(at, 4 << 20):
        yield column.slice(a, b - a).to_pylist()


def _only(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col(f"`{text}`").cast("string").alias("text"))


def chunk_table(docs: DataFrame, model: Model, text: str = "text") -> dict[str, bytes]:
    """Packed ids of the most frequent stretches of all texts, at most TABLE_ROWS."""

    @tidy
    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def found() -> pa.RecordBatch:
            often = {s: n for s, n in seen.items() if n >= COUNT_LEAST and len(s) <= TABLE_CHARS}
            seen.clear()
            return pa.record_batch([pa.array(list(often), pa.string()), pa.array(list(often.values()), pa.int64())], ["stretch", "n"])

        for batch in batches:
            for block in _text_blocks(batch.column(0)):
                for t in block:
                    for part in stretches(t or ""):
                        seen.update(part)
                        if len(seen) > COUNT_ROWS:
                            yield found()
        yield found()

    @tidy
    def segmented(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = model.processor()
        for batch in batches:
            new = [s for s in batch.column(0).to_pylist() if len(s) > 1]
            yield pa.record_batch([pa.array(new, pa.string()), pa.array(_packed(sp, new), pa.binary())], ["stretch", "ids"])

    of = written(_only(docs, text).mapInArrow(counts, "stretch string, n long").groupBy("stretch").agg(F.sum("n").alias("n")), "stretches")
    # counts by their number of bits: a few dozen rows
    sizes = sorted(of.groupBy(F.length(F.bin("n")).alias("bits")).count().collect(), key=lambda r: -r["bits"])
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > TABLE_ROWS:
            break
        least = 1 << (r["bits"] - 1)
    if least is None:
        discard(of)
        return {}
    rows = of.where(F.col("n") >= least).select("stretch").mapInArrow(segmented, "stretch string, ids binary").toArrow()
    discard(of)
    return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))


def encode(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, table: dict[str, bytes] | None = None) -> DataFrame:
    """docs' columns (or those in keep, without the text) with `ids`, an array of int in the text's order: what the library's encode gives."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(chunk_table(docs, model, text) if table is None else table)
    kept = [c for c in (docs.columns if keep is None else keep) if c != "ids"]
    # columns of the input may have any names
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(model.processor(), OWN_ROWS)
        table.update(known.value)
        for batch in batches:
            column, a = batch.column(batch.num_columns - 1), 0
            for block in _text_blocks(column):
                if table.new >= OWN_ROWS:
                    table.clear()
                    table.update(known.value)
                    table.new = 0
                ids = [b"".join([b"".join(map(table.__getitem__, part)) for part in stretches(t or "")]) for t in block]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) >> 2 for x in ids], out=offsets[1:])
                flat = np.frombuffer(b"".join(ids), "<i4")
                of = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, len(block)) for c in batch.columns[:-1]), of], names=[f"k{i}" for i in range(len(kept))] + ["ids"])
                a += len(block)

    out = rows.mapInArrow(run, schema)
    return out.toDF(*kept, "ids")


def decode(rows: DataFrame, model: Model, ids: str = "ids") -> DataFrame:
    """rows with `decoded`, the text of their ids: what the library's decode gives. A null list is an empty one; an id that isn't in the model is an error."""
    kept = [c for c in rows.columns if c != "decoded"]
    inner = rows.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)])
    at = kept.index(ids)
    schema = T.StructType([*inner.schema.fields, T.StructField("decoded", T.StringType(), False)])

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, pieces = model.processor(), model.piece_bytes()
        # ids as bytes, and where they end
        size = np.array([-1 if p is None else len(p) for p in pieces])
        start = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
        data = np.frombuffer(b"".join(p or b"" for p in pieces), np.uint8)

        def text_of(x: np.ndarray) -> str:
            if not len(x):
                return ""
            n = size[x]
            if n.min() >= 0:
                ends = np.cumsum(n)
                # byte by byte: the place of the piece's first byte, and the way into the piece
                out = data[np.repeat(start[x] - (ends - n), n) + np.arange(ends[-1])].tobytes()
                try:
                    return out.decode()[out[:1] == b" " :]
                except UnicodeDecodeError:
                    pass  # bytes that are no characters: the library puts others in their place
            return sp.decode(x.tolist())

        for batch in batches:
            lists = batch.column(at)
            count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(count)])
            for a, b in block_ends(ends, 1 << 20):
                part = lists.slice(a, b - a)
                texts = [text_of(part[k].values.to_numpy(zero_copy_only=False)) if part[k].is_valid else "" for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return inner.mapInArrow(run, schema).toDF(*kept, "decoded")
