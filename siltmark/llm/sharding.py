"""Sharding by minimax contiguous partition of atomic groups.

Rows with equal text are one atomic group. Groups are ordered by the 64-bit hash
of their text, and the ordered sequence is cut into contiguous shards so that the
largest shard is as small as that order allows. The smallest feasible capacity is
binary-searched with a greedy check.

The driver never sees groups. It holds a sketch: the order is divided into at most
``CELLS`` hash ranges, each with its size and whether it is one group. A greedy check
that cuts only between cells proves a capacity feasible; one that may cut anywhere
inside a divisible cell proves it infeasible. While the two disagree, the cells that
the disputed cuts can fall into, and only those, are divided further. The result is
the exact optimum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import discard, written
from .words import tidy

#: Cells of the sketch, and so rows that the driver collects at once.
CELLS = 1 << 16
#: Pairs of shard and task whose first slots are broadcast at most (24 bytes each).
BROADCAST_ROWS = 1_000_000
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


@dataclass
class Sketch:
    """Cells in order: lowest and highest hash, size in bytes."""

    low: np.ndarray
    high: np.ndarray
    size: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.size)])

    @property
    def atomic(self) -> np.ndarray:
        return self.low == self.high


def certain_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Greedy cuts (cell positions) at known boundaries; None if they don't reach the end."""
    at, cuts = 0, []
    for _ in range(shards):
        nxt = int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1
        if nxt == at and at < len(ends) - 1:
            return None
        at = nxt
        cuts.append(at)
    return cuts if at == len(ends) - 1 else None


def reach(ends: np.ndarray, atomic: np.ndarray, capacity: int, shards: int, hopeful: bool) -> list[int]:
    """Bytes that the first k shards can hold, for each k: at known boundaries or, if hopeful, cutting inside divisible cells too."""
    at, out = 0, []
    for _ in range(shards):
        goal = at + capacity
        cell = int(np.searchsorted(ends, goal, "right")) - 1
        if cell >= len(atomic):
            at = int(ends[-1])
        elif hopeful and not atomic[cell]:
            at = goal
        else:
            at = max(at, int(ends[cell]))
        out.append(at)
    return out


def _least(feasible, low: int, high: int) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def disputed(sketch: Sketch, shards: int) -> tuple[int, np.ndarray]:
    """The least capacity known to be feasible, and a mask of the cells that must be divided to know the least of all."""
    ends, atomic = sketch.ends, sketch.atomic
    total = int(ends[-1])
    low = max(-(-total // shards), int(sketch.size[atomic].max(initial=1)))
    sure = _least(lambda c: certain_cuts(ends, c, shards) is not None, low, max(low, total))
    hoped = _least(lambda c: reach(ends, atomic, c, shards, True)[-1] >= total, low, sure)
    mask = np.zeros(len(atomic), bool)
    if hoped < sure:
        for a, b in zip(reach(ends, atomic, hoped, shards, False), reach(ends, atomic, sure, shards, True), strict=True):
            first = int(np.searchsorted(ends, a, "right")) - 1
            last = int(np.searchsorted(ends, b, "right")) - 1
            mask[max(first, 0) : last + 1] = True
        # what must be divided stays in at most one range for each cut: indivisible cells between are read again
    return sure, mask


def even_cuts(sketch: Sketch, capacity: int, shards: int) -> list[int]:
    """Cuts at known boundaries, none over the capacity, as near to equal sizes as that allows."""
    ends = sketch.ends
    last = len(ends) - 1
    latest = certain_cuts(ends, capacity, shards)
    earliest, at = [], last
    for _ in range(shards):
        earliest.append(at)
        at = int(np.searchsorted(ends, ends[at] - capacity, "left"))
    earliest.reverse()
    at, cuts = 0, []
    for k in range(shards):
        goal = ends[at] + (ends[-1] - ends[at]) / (shards - k)
        near = int(np.searchsorted(ends, goal, "left"))
        near = near - 1 if near > at + 1 and (near > last or goal - ends[near - 1] < ends[near] - goal) else near
        most = int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1
        at = max(at, min(max(near, earliest[k]), most, latest[k] if k == shards - 1 else last))
        cuts.append(at)
    return cuts


def _sketch(sized: DataFrame, key: Column) -> Sketch:
    rows = sized.groupBy(key.alias("cell")).agg(F.min("__h").alias("low"), F.max("__h").alias("high"), F.sum("__size").alias("size")).drop("cell").collect()
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return Sketch(a[:, 0], a[:, 1], a[:, 2])


def plan(sized: DataFrame, shards: int, cells: int = CELLS) -> tuple[list[int], int, list[int]]:
    """Over columns __h and __size: the highest hash of each shard that holds rows, the capacity, and those shards' numbers."""
    shift = 64 - (cells.bit_length() - 1)
    sketch = _sketch(sized, F.shiftright("__h", shift))
    if not len(sketch.size):
        return [], 0, []
    while True:
        capacity, mask = disputed(sketch, shards)
        if not (mask & ~sketch.atomic).any() or shift == 0:
            break
        step = min(shift, max(1, (cells // max(1, int(mask.sum()))).bit_length() - 1))
        shift -= step
        runs = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).reshape(-1, 2)
        wanted = F.lit(False)
        for a, b in runs:
            wanted = wanted | F.col("__h").between(int(sketch.low[a]), int(sketch.high[b - 1]))
        finer = _sketch(sized.where(wanted), F.shiftright("__h", shift))
        inside = np.zeros(len(mask), bool)
        for a, b in runs:
            inside[a:b] = True
        parts = [np.concatenate([getattr(sketch, k)[~inside], getattr(finer, k)]) for k in ("low", "high", "size")]
        order = np.argsort(parts[0], kind="stable")
        sketch = Sketch(*(p[order] for p in parts))
    cuts = even_cuts(sketch, capacity, shards)
    bounds, numbers, before = [], [], 0
    for k, at in enumerate(cuts):
        if at > before:
            bounds.append(int(sketch.high[at - 1]))
            numbers.append(k)
        before = at
    return bounds, capacity, numbers


def shard_documents(docs: DataFrame, shards: int = 40, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds size (UTF-8 bytes of the text and ROW_BYTES), text_crc32, shard and slot to the rows.

    Rows of equal text share a shard. Slots run from 0 without gaps in each shard: a task numbers its
    own rows of each shard as they pass, and starts after the rows that tasks before it have there, so
    that rows are neither shuffled nor sorted. A null text counts as no bytes and is a group of its own;
    repeated rows are kept, each with a slot. An empty table gives an empty result. keep: columns to
    carry (default: all); columns of the input named as a result are replaced. Two texts that share a
    64-bit hash are held together as well. Fewer groups than shards leave shards empty. docs is read
    twice, so it should be a table or a result that comes out the same each time.
    """
    made = ("size", "text_crc32", "shard", "slot")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    sized = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.xxhash64(F.col(text)).alias("__h"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("__size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    narrow = written(sized.select("__h", "__size"), "sharding")
    bounds, _, numbers = plan(narrow, shards)
    discard(narrow)
    if bounds:
        index = F.lit(0)
        for b in bounds[:-1]:
            index = index + (F.col("__h") > F.lit(b)).cast("int")
        number = F.element_at(F.array(*[F.lit(n) for n in numbers]), index + 1)
    else:
        number = F.lit(0)
    placed = sized.select(*[F.col(f"`{c}`") for c in kept], F.col("__size").alias("size"), "text_crc32", number.alias("shard"))
    schema = T.StructType([*placed.schema, T.StructField("__part", T.LongType()), T.StructField("__place", T.LongType())])

    @tidy
    def numbered(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(shards, np.int64)
        for b in batches:
            shard = np.asarray(b.column(b.num_columns - 1))
            order = np.argsort(shard, kind="stable")
            n = np.bincount(shard, minlength=shards)
            place = np.empty(len(shard), np.int64)
            place[order] = np.arange(len(shard)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(seen, n)
            seen += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(shard), part)), pa.array(place)], schema.names)

    rows = written(placed.mapInArrow(numbered, schema), "sharded")
    before = rows.groupBy(F.col("shard").alias("__shard"), F.col("__part").alias("__task")).agg(F.count(F.lit(1)).alias("__n"))
    # one row for each shard and task
    before = before.select("__shard", "__task", (F.sum("__n").over(Window.partitionBy("__shard").orderBy("__task")) - F.col("__n")).alias("__before"))
    before = written(before, "sharding-before")
    if before.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    joined = rows.join(before, (F.col("shard") == F.col("__shard")) & (F.col("__part") == F.col("__task")))
    return joined.select(*[F.col(f"`{c}`") for c in kept], "size", "text_crc32", "shard", (F.col("__before") + F.col("__place")).alias("slot"))
