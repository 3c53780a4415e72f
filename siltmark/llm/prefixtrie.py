"""The trie of conversations' shared beginnings: a node for each distinct sequence of first turns.

1. Turns become pairs of 64-bit hashes of (role, text) and a count of words; texts are never shuffled. They are sorted by
   ranges of (conversation, order), so one long conversation may lie in many partitions.
2. Each partition numbers its turns and hashes their beginnings: the sum of a turn's hash times a base to the power of its
   place, in two lanes, which can be carried on from partition to partition. What partitions carry is a row each.
3. Each partition emits a partial trie: one row for each of its nodes, with members, their least id, and the sorted ids of
   those that end there, as a packed list. Partial tries are merged by node in a tree of FAN each, sums by sums.
4. Only nodes with several members need a rollup: below any other there is one chain. Sums of subtrees go up by doubled
   steps, so a trie of depth d takes log2(d) rounds, whether or not it branches.

Nodes are told apart by 128 bits and their depth. The lists of a node's ends are joined in one task, but streamed: the
hash of a list can't be made in parts, and no list is held as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import discard, written
from .words import tidy

WORD = r"[^\x20\x09-\x0D]+"
#: Odd bases of the two lanes (any odd numbers do).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
FAN = 64
#: Turns that a partial trie is made of at most, and bytes of a piece of a list.
LOCAL = 1 << 18
PIECE = 1 << 20


def hashed_turns(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, o1, o2, o3, ta, tb, words) of turns: null role and text are empty, a null conversation has none.

    Turns are ordered by `order`, null first; those of one place by role and then by a hash of the text, so that
    reruns agree; equal rows are turns of their own.
    """
    r, t = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    lanes = F.xxhash64(r, t), F.xxhash64(F.lit(7), t, r)
    kept = turns.where(F.col(f"`{conv}`").isNotNull())
    return kept.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{order}`").cast("long").alias("o1"), r.alias("o2"), lanes[0].alias("ta"), lanes[1].alias("tb"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("words"))


def _powers(base: int, n: int) -> np.ndarray:
    """base to the power of 0 to n - 1, modulo 2^64."""
    out = np.ones(max(n, 1), np.uint64)
    filled, step = 1, base
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(step)
        filled, step = filled + more, step * step % (1 << 64)
    return out


_PLACED = "pid int, conv long, place long, ta long, tb long, pa long, pb long, words long, last boolean"


@tidy
def _place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of a sorted partition with their place in it and the hash of the beginning up to them, from 0 for each conversation."""
    pid = TaskContext.get().partitionId()
    conv_now, count = None, 0
    sums = [np.uint64(0), np.uint64(0)]
    waiting: list[pa.Array] | None = None

    def done(columns: list[pa.Array], after: int | None) -> pa.RecordBatch:
        conv = columns[0].to_numpy()
        last = np.append(conv[1:] != conv[:-1], after is None or after != conv[-1])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), pid, np.int32)), *columns, pa.array(last)], names=_NAMES)

    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        hashes = [batch.column(k).to_numpy().view(np.uint64) for k in (1, 2)]
        n = len(conv)
        start = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
        carried = conv[0] == conv_now
        size = np.diff(np.append(start, n))
        base = np.zeros(len(start), np.int64)
        base[0] = count if carried else 0
        place = np.arange(n) - np.repeat(start, size) + np.repeat(base, size)
        out = []
        for k in range(2):
            # powers of places in the batch, then of where the batch's first conversation stands
            local = place - np.repeat(base, size)
            power = _powers(BASES[k], int(local.max()) + 1)[local]
            power[: size[0]] *= np.uint64(pow(BASES[k], int(base[0]), 1 << 64))
            total = np.cumsum(hashes[k] * power, dtype=np.uint64)
            before = np.append(np.zeros(1, np.uint64), total)[start]
            prefix = total - np.repeat(before, size)
            if carried:
                prefix[: size[0]] += sums[k]
            sums[k] = prefix[-1]
            out.append(prefix.view(np.int64))
        count = int(place[-1]) + 1
        conv_now = conv[-1]
        if waiting is not None:
            yield done(waiting, conv[0])
        waiting = [batch.column(0), pa.array(place), batch.column(1), batch.column(2), *map(pa.array, out), batch.column(3)]
    if waiting is not None:
        yield done(waiting, None)


_NAMES = [f.split(" ")[0] for f in _PLACED.split(", ")]


def placed(rows: DataFrame, order: list[str | Column]) -> tuple[DataFrame, dict[int, tuple]]:
    """rows (conv, ta, tb, words and what order needs) with places and hashes within each partition, and what partitions carry.

    The second is {partition: (place, lane a, lane b, whether the last conversation goes on)}, a row for each partition in which a
    conversation goes on from or to another; the first conversation of such a partition begins at `place`.
    """
    count = max(rows.sparkSession._jsparkSession.sessionState().conf().numShufflePartitions(), 1)
    ranged = rows.repartitionByRange(count, F.col("conv"), *order).sortWithinPartitions(F.col("conv"), *order)
    of = written(ranged.select("conv", "ta", "tb", "words").mapInArrow(_place, _PLACED), "placed")
    # first and last conversation of every partition, and where the last one has come to
    one = F.struct("conv", "place", "pa", "pb")
    ends = of.groupBy("pid").agg(F.min("conv").alias("first"), F.max(one).alias("end")).select("pid", "first", "end.*").orderBy("pid").collect()
    carry: dict[int, list] = {}
    place, lanes, conv = 0, [0, 0], None
    pid = None
    for r in ends:
        if r["first"] == conv:
            carry[r["pid"]] = [place, *lanes, False]
            carry.setdefault(pid, [0, 0, 0, False])[3] = True
        else:
            place, lanes = 0, [0, 0]
        if r["conv"] != r["first"]:
            place, lanes = 0, [0, 0]
        lanes = [(x + y * pow(b, place, 1 << 64)) % (1 << 64) for x, y, b in zip(lanes, (r["pa"], r["pb"]), BASES, strict=True)]
        place += r["place"] + 1
        pid, conv = r["pid"], r["conv"]
    return of, {k: tuple(v) for k, v in carry.items()}


def numbered(turns: DataFrame) -> DataFrame:
    """Rows of hashed_turns with `at`, their place in the conversation from 0."""
    of, carry = placed(turns, ["o1", "o2", "ta", "tb"])
    starts = {k: v[0] for k, v in carry.items() if v[0]}
    if not starts:
        return of.select("conv", F.col("place").alias("at"), "ta", "tb", "words")
    spark = turns.sparkSession
    first = of.groupBy("pid").agg(F.min("conv").alias("conv"))
    begins = first.join(F.broadcast(spark.createDataFrame(list(starts.items()), "pid int, start long")), "pid")
    out = of.join(F.broadcast(begins), ["pid", "conv"], "left")
    return out.select("conv", (F.col("place") + F.coalesce("start", F.lit(0))).alias("at"), "ta", "tb", "words")


_PARTIAL = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("depth", "a", "b", "up_a", "up_b", "words", "n_convs", "conv", "n_ends")]
    + [T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("ends", T.BinaryType())]
)


def _partial(carry: dict[int, tuple], opening: dict[int, int], ending: dict[int, int]):
    """A task: partial tries of placed rows. A row is a node, or a piece of a node's list of ends (with n_convs null)."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def local(pid: int, c: dict[str, np.ndarray], opens: int | None) -> Iterator[pa.RecordBatch]:
            conv, place = c["conv"], c["place"].copy()
            lanes = [c["pa"].view(np.uint64).copy(), c["pb"].view(np.uint64).copy()]
            last = c["last"].copy()
            start, sa, sb, goes_on = carry.get(pid, (0, 0, 0, False))
            if start and opens is not None:
                mine = conv == opens
                for k, s in enumerate((sa, sb)):
                    lanes[k][mine] = lanes[k][mine] * np.uint64(pow(BASES[k], start, 1 << 64)) + np.uint64(s)
                place[mine] += start
            if goes_on:
                last &= conv != ending[pid]
            ups = []
            for k in range(2):
                ups.append(lanes[k] - c["ta" if k == 0 else "tb"].view(np.uint64) * _powers_at(BASES[k], place))
            # rows by node: depth and both lanes
            order = np.lexsort((conv, lanes[1], lanes[0], place))
            d, a, b, v = place[order], lanes[0][order], lanes[1][order], conv[order]
            new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            size = np.diff(np.append(new, len(d)))
            ended = last[order]
            n_ends = np.add.reduceat(ended.astype(np.int64), new)
            nodes = [d[new], a[new].view(np.int64), b[new].view(np.int64), ups[0][order][new].view(np.int64), ups[1][order][new].view(np.int64), c["words"][order][new], size, np.minimum.reduceat(v, new), n_ends]
            nulls = len(new)
            yield pa.RecordBatch.from_arrays([*map(pa.array, nodes), pa.array(np.full(nulls, part, np.int32)), pa.nulls(nulls, pa.int64()), pa.nulls(nulls, pa.binary())], names=_PARTIAL.names)
            # nodes in which conversations end, each with pieces of its sorted ids
            rows: list[tuple] = []
            held = 0
            for k in np.flatnonzero(n_ends):
                ids = v[new[k] : new[k] + size[k]][ended[new[k] : new[k] + size[k]]]
                for x in range(0, len(ids), PIECE >> 3):
                    piece = ids[x : x + (PIECE >> 3)]
                    rows.append((d[new[k]], a[new[k]].view(np.int64), b[new[k]].view(np.int64), piece[0], piece.tobytes()))
                    held += len(piece)
                if held > LOCAL or len(rows) > 50_000:
                    yield pieces(rows)
                    rows, held = [], 0
            if rows:
                yield pieces(rows)

        def pieces(rows: list[tuple]) -> pa.RecordBatch:
            d, a, b, first, ends = zip(*rows, strict=True)
            n = len(rows)
            columns = [pa.array(np.array(x, np.int64)) for x in (d, a, b)] + [pa.nulls(n, pa.int64())] * 6
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, part, np.int32)), pa.array(np.array(first, np.int64)), pa.array(ends, pa.binary())], names=_PARTIAL.names)

        names = ["conv", "place", "ta", "tb", "pa", "pb", "words", "last"]
        for batch in batches:
            pids = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.append(True, pids[1:] != pids[:-1])) if len(pids) else []
            for x, y in zip(cuts, [*cuts[1:], len(pids)], strict=True):
                for z in range(x, y, LOCAL):
                    end = min(y, z + LOCAL)
                    c = {n: batch.column(k + 1).slice(z, end - z).to_numpy(zero_copy_only=False) for k, n in enumerate(names)}
                    yield from local(int(pids[x]), c, opening.get(int(pids[x])))

    return run


def _powers_at(base: int, place: np.ndarray) -> np.ndarray:
    """base to the powers in place, by the bits of the exponent: places may be far apart."""
    out, step, e = np.ones(len(place), np.uint64), base, place.astype(np.uint64)
    while e.any():
        odd = (e & np.uint64(1)).astype(bool)
        out[odd] *= np.uint64(step)
        e, step = e >> np.uint64(1), step * step % (1 << 64)
    return out


_SHA = "depth long, a long, b long, ends_sha256 string"


@tidy
def _list_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids in order, from pieces that come in order."""
    now, digest, out = None, None, []

    def closed() -> None:
        if now is not None:
            out.append((*now, digest.hexdigest()))

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["depth", "a", "b", "ends_sha256"])

    for batch in batches:
        for d, a, b, ends in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            text = ",".join(map(str, np.frombuffer(ends, np.int64).tolist())).encode()
            if (d, a, b) == now:
                digest.update(b"," + text)
            else:
                closed()
                now, digest = (d, a, b), hashlib.sha256(text)
        if len(out) > 10_000:
            yield rows()
            out.clear()
    closed()
    if out:
        yield rows()


_NODE = ["depth", "a", "b"]


def _merged(partial: DataFrame, parts: int) -> DataFrame:
    """Partial tries merged in a tree: FAN tasks' rows of a node into one, until one is left."""
    sums = [F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.min("words").alias("words"), F.sum("n_convs").alias("n_convs"), F.min("conv").alias("conv"), F.sum("n_ends").alias("n_ends")]
    of = partial
    while True:
        parts = -(-parts // FAN)
        keys = _NODE if parts <= 1 else [*_NODE, F.floor(F.col("part") / FAN).cast("int").alias("part")]
        of = of.groupBy(*keys).agg(*sums)
        if parts <= 1:
            return of


def _rolled_up(shared: DataFrame, deepest: int) -> DataFrame:
    """Sums of leaves and saved over subtrees, by doubled steps: after k rounds a node's sums hold those less than 2^k below."""
    at, up = ["depth", "a", "b"], ["to_depth", "to_a", "to_b"]
    of, reach = shared, 1
    while reach <= deepest:
        sums = of.where(F.col("to_depth") >= 0).groupBy(*up).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("add"))
        sums = sums.toDF(*at, "more", "add")
        jump = of.select(*[F.col(c).alias(u) for c, u in zip(at, up, strict=True)], *[F.col(u).alias(f"next_{u}") for u in up])
        new = of.join(sums, at, "left").join(jump, up, "left")
        new = written(
            new.select(*at, *[F.col(f"next_{u}").alias(u) for u in up], (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("add", F.lit(0))).alias("saved")),
            "rollup",
        )
        discard(of)
        of, reach = new, reach * 2
    return of


def trie(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """Nodes of conversations' rows (conv, ta, tb, words), sorted by order within a conversation.

    Each conversation has a row of its own for the root (hashes and words 0, first in order), so one without turns is a member of it.
    """
    of, carry = placed(rows, order)
    opening, ending = {}, {}
    if carry:
        for r in of.groupBy("pid").agg(F.min("conv").alias("x"), F.max("conv").alias("y")).where(F.col("pid").isin(*carry)).collect():
            opening[r["pid"]], ending[r["pid"]] = r["x"], r["y"]
    made = written(of.mapInArrow(_partial(carry, opening, ending), _PARTIAL), "partial-tries")
    discard(of)
    parts = made.where("n_convs is not null").agg(F.max("part")).first()[0]
    nodes = written(_merged(made.where("n_convs is not null"), (parts or 0) + 1), "nodes")

    single = F.col("n_convs") == 1
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"))
    children = children.agg(F.count("*").alias("n_children"), F.count_if(single).alias("alone"))
    shared = nodes.where(~single).join(children, _NODE, "left").select(*nodes.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("alone", F.lit(0)).alias("alone"))
    shared = written(shared, "shared")
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    leaves = (F.col("alone") + (F.col("n_children") == 0).cast("long")).alias("leaves")
    start = shared.select(*_NODE, (F.col("depth") - 1).alias("to_depth"), F.col("up_a").alias("to_a"), F.col("up_b").alias("to_b"), leaves, saved)
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    totals = _rolled_up(start, deepest)

    pieces = made.where("n_convs is null").join(shared.where("n_ends > 0").select(*_NODE), _NODE, "left_semi")
    lists = pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").select(*_NODE, "ends").mapInArrow(_list_hashes, _SHA)
    known = shared.join(totals.select(*_NODE, "leaves", F.col("saved").alias("saved_tokens")), _NODE).join(lists, _NODE, "left")
    known = known.select(*_NODE, "up_a", "up_b", "conv", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    alone = nodes.where(single).select(
        *_NODE, "up_a", "up_b", "conv", "n_convs", (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.sha2(F.when(F.col("n_ends") > 0, F.col("conv").cast("string")).otherwise("").cast("binary"), 256).alias("ends_sha256"),
    )
    # the least member of a parent: one without others has a parent with others, or its own conversation's
    parents = shared.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv").alias("above"))
    out = known.unionByName(alone).join(parents, ["depth", "up_a", "up_b"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("above", F.when(single, F.col("conv")))).alias("parent_conv_id")
    node, up = (F.concat(F.lpad(F.hex(x), 16, "0"), F.lpad(F.hex(y), 16, "0")) for x, y in (("a", "b"), ("up_a", "up_b")))
    return out.select(
        node.alias("node"), F.when(F.col("depth") > 0, up).alias("parent"), F.col("conv").alias("conv_id"), "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )


def prefix_trie(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each distinct sequence of first d turns (role, text) of conversations, from the root (d = 0).

    node, parent: names of the node and the one above (null for the root); conv_id: its smallest member, whose turn `depth` is the
    node's last; parent_conv_id; n_convs: members; n_children; n_leaves: nodes without children in its subtree, itself
    included; saved_tokens: of its subtree's nodes, members beyond the first times words of the last text; ends_sha256: of the
    sorted ids that end there, comma-joined. Null roles and texts are empty; rows of a null conversation take no part; turns of one
    place, and repeated rows, follow hashed_turns. Of an empty table there is no node, not even the root. Other columns have no part.
    """
    rows = hashed_turns(turns, conv, order, role, text)
    return trie(_with_roots(rows.select("conv", F.lit(1).alias("o0"), "o1", "o2", "ta", "tb", "words"), rows.select("conv").distinct()), ["o0", "o1", "o2", "ta", "tb"])


def _with_roots(rows: DataFrame, convs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    roots = {"ta": zero, "tb": zero, "words": zero, "o0": F.lit(0)}
    return rows.unionByName(convs.select("conv", *[v.alias(k) for k, v in roots.items()]), allowMissingColumns=True)


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Nodes of conversations that are rebuilt to share beginnings: c has the first h turns of c - c % every, and its own after its first h.

    h is the unsigned crc32 of c in decimals, modulo most. A conversation that is absent lends no turns.
    """
    at = written(numbered(hashed_turns(turns)), "numbered")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    own = at.where(F.col("at") >= h).select("conv", F.lit(2).alias("o0"), F.col("at").alias("o1"), "ta", "tb", "words")
    convs = at.where("at = 0").select("conv")
    # at most `every` conversations (twice for 0, whose ids have either sign) take from one
    lent = at.where((F.col("conv") % every == 0) & (F.col("at") < most)).select(F.col("conv").alias("of"), F.col("at").alias("o1"), "ta", "tb", "words")
    taken = convs.select("conv", (F.col("conv") - F.col("conv") % every).alias("of"), h.alias("h")).join(lent, "of").where(F.col("o1") < F.col("h"))
    rows = own.unionByName(taken.select("conv", F.lit(1).alias("o0"), "o1", "ta", "tb", "words"))
    return trie(_with_roots(rows, convs), ["o0", "o1"])
