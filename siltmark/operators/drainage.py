"""Routes out of depressions: the path to an outlet whose highest cell is lowest, filled along or cut through.

1. Steepest descent gives each cell its basin, the depression it drains to, by doubled pointers.
2. Where two basins touch, the lowest pair of touching cells is their pass; a cell at the edge of the table (one of its
   eight neighbours is missing) is a pass to the outside. Basins and passes are a graph much smaller than the grid.
3. A spanning forest of lowest passes holds, for every basin, the path outside whose highest pass is lowest. Each basin
   chooses its lowest pass and is merged with its neighbour, in rounds that at least halve their number; when LOCAL
   passes or fewer are left, one process finishes.
4. A tour of each tree, ranked by doubled pointers, tells which way each pass is crossed on the way out.
5. In each basin the path from its depression to the pass it leaves by is turned around. All cells then lead outside, and
   the breached surface is the lowest that any cell upstream needs, by doubled pointers again.

No step holds the grid, a basin or a path in one task; rounds are logarithms of paths' lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import _RING, KEY, _z, flow_direction, neighbourhood
from .rounds import release, settled

#: Passes that one process orders and joins.
LOCAL = 200_000
#: What a cut falls by from cell to cell, so that it has a direction.
FALL = 1e-6

#: Half of the neighbours, so that each pair of cells is met once.
_HALF = [(0, 1), (1, -1), (1, 0), (1, 1)]


def _cell(row: Column | str = "row", col: Column | str = "col") -> Column:
    row, col = (F.col(x) if isinstance(x, str) else x for x in (row, col))
    return F.struct(row.cast("long").alias("row"), col.cast("long").alias("col"))


def doubled(pointers: DataFrame, node: str = "node", to: str = "to") -> DataFrame:
    """(node, to): pointers followed to their end; a node that points to itself is an end. Rounds are the logarithm of the longest path."""
    of = settled(pointers.select(F.col(node).alias("node"), F.col(to).alias("to")))
    while True:
        on = of.select(F.col("node").alias("to"), F.col("to").alias("on"))
        of = settled(of.join(on, "to").select("node", F.col("on").alias("to"), (F.col("on") != F.col("to")).alias("moved")), of)
        if of.where("moved").isEmpty():
            return of.select("node", "to")


def basins(cells: DataFrame, value: str = "value") -> DataFrame:
    """(cell, z, to, basin, edge): each cell with the cell it falls to (itself in a depression), the depression at the end, and whether it is at the edge. Cells without a value take no part."""
    around = neighbourhood(cells, value)
    edge = F.greatest(*[_z(a, b).isNull() for a, b in _RING])
    at = around.select(_cell().alias("cell"), _z(0, 0).alias("z"), edge.alias("edge"))
    down = flow_direction(cells, value).select(_cell().alias("cell"), F.coalesce(F.when(F.col("to_row").isNotNull(), _cell("to_row", "to_col")), _cell()).alias("to"))
    base = settled(at.join(down, "cell"))
    ends = doubled(base, "cell", "to")
    out = settled(base.join(ends.select(F.col("node").alias("cell"), F.col("to").alias("basin")), "cell"), base)
    return out


def passes(at: DataFrame) -> DataFrame:
    """(a, b, level, u, v): of each two basins that touch the lowest pair of cells, u in a and v in b; b is null for the outside. Ties go to the first cells."""
    half = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _HALF])).alias("o")
    here = at.select("cell", "z", "basin", half).select("cell", "z", "basin", _cell(F.col("cell.row") + F.col("o.a"), F.col("cell.col") + F.col("o.b")).alias("next"))
    there = at.select(F.col("cell").alias("next"), F.col("z").alias("z2"), F.col("basin").alias("basin2"))
    level = F.greatest("z", "z2").alias("level")
    met = here.join(there, "next").where(F.col("basin") != F.col("basin2"))
    first = F.col("basin") < F.col("basin2")
    pairs = met.select(level, F.when(first, F.col("basin")).otherwise(F.col("basin2")).alias("a"), F.when(first, F.col("basin2")).otherwise(F.col("basin")).alias("b"), F.when(first, F.col("cell")).otherwise(F.col("next")).alias("u"), F.when(first, F.col("next")).otherwise(F.col("cell")).alias("v"))
    none = F.lit(None).cast(at.schema["basin"].dataType)
    out = at.where("edge").select(F.col("z").alias("level"), F.col("basin").alias("a"), none.alias("b"), F.col("cell").alias("u"), none.alias("v"))
    best = F.min(F.struct("level", "u", "v")).alias("p")
    return pairs.unionByName(out).groupBy("a", "b").agg(best).select("a", "b", "p.level", "p.u", "p.v")


def spanning_forest(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """The passes (a, b, level, u, v) of the forest in which every basin's path outside has the lowest highest pass.

    Passes are in the order (level, u, v), in which no two are equal, so the forest is the same however it is found.
    """
    # ends of a pass among merged basins; a null is the outside, which merges with whatever reaches it first
    of = settled(edges.select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct("level", "u", "v", "a", "b").alias("e")))
    taken: DataFrame | None = None
    while of.count() > local:
        ends = of.select(F.col("x").alias("n"), F.col("y").alias("m"), "e").unionByName(of.where("y is not null").select(F.col("y").alias("n"), F.col("x").alias("m"), "e"))
        lowest = settled(ends.groupBy("n").agg(F.min(F.struct("e", "m")).alias("low")).select("n", "low.m", "low.e"))
        # of two that choose the same pass the smaller stays; one that chooses the outside stays as a part of it
        back = lowest.select(F.col("n").alias("m"), F.col("m").alias("back"), F.col("e").alias("e2"))
        stays = F.col("m").isNull() | (F.coalesce((F.col("e") == F.col("e2")) & (F.col("n") < F.col("m")), F.lit(False)))
        roots = doubled(lowest.join(back, "m", "left").select("n", F.when(stays, F.col("n")).otherwise(F.col("m")).alias("to")), "n", "to")
        outside = lowest.where("m is null").select(F.col("n").alias("to"), F.lit(True).alias("out"))
        label = settled(roots.join(outside, "to", "left").select(F.col("node").alias("n"), F.when(F.col("out"), F.lit(None)).otherwise(F.col("to")).alias("to"), F.coalesce("out", F.lit(False)).alias("out")))
        chosen = lowest.select("e").distinct()
        taken = settled(chosen if taken is None else taken.unionByName(chosen), *([] if taken is None else [taken]))
        left, right = (label.select(F.col("n").alias(c), F.col("to").alias(f"{c}2"), F.col("out").alias(f"{c}out")) for c in ("x", "y"))
        moved = of.join(left, "x").join(right, "y", "left")
        a, b = F.when(~F.col("xout"), F.col("x2")), F.when(F.col("yout") == F.lit(False), F.col("y2"))
        kept = moved.select(F.coalesce(a, b).alias("x"), F.when(a.isNotNull(), b).alias("y"), "e").where(F.col("x").isNotNull() & ~F.col("x").eqNullSafe(F.col("y")))
        # of several passes between the same two only the lowest can be chosen
        swap = F.col("y").isNotNull() & (F.col("y") < F.col("x"))
        kept = kept.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"), "e")
        of = settled(kept.groupBy("x", "y").agg(F.min("e").alias("e")), of)
        release(lowest, roots, label)
    rest = _joined(of)
    release(of)
    return rest if taken is None else rest.unionByName(taken.select("e.a", "e.b", "e.level", "e.u", "e.v"))


def _joined(of: DataFrame) -> DataFrame:
    """The forest of at most LOCAL passes, lowest first, by sets of merged basins."""
    above: dict = {}

    def top(n):
        while (up := above.get(n, n)) != n:
            above[n] = above.get(up, up)
            n = up
        return n

    chosen = []
    for r in of.orderBy("e").collect():
        x, y = top(r["x"]), top(r["y"])
        if x != y:
            # the outside (None) stays at the top
            above[y if x is None else x] = x if x is None else y
            chosen.append(r["e"])
    schema = of.schema["e"].dataType
    return of.sparkSession.createDataFrame(chosen, schema).select("a", "b", "level", "u", "v")


def ways_out(forest: DataFrame) -> DataFrame:
    """(basin, onward, level, leaves, enters): of each basin the one it drains into (null: the outside), the pass's level, and the cells on this side and the other."""
    roots = forest.where("b is null").select(F.col("a").alias("basin"), F.col("b").alias("onward"), "level", F.col("u").alias("leaves"), F.col("v").alias("enters"))
    inner = forest.where("b is not null")
    arcs = settled(inner.select(F.col("a").alias("x"), F.col("b").alias("y"), "level", "u", "v").unionByName(inner.select(F.col("b").alias("x"), F.col("a").alias("y"), "level", F.col("v").alias("u"), F.col("u").alias("v"))))
    # the tour goes on from (x, y) to y's neighbour after x, the first after the last; at the root it ends after the last
    order = Window.partitionBy("x").orderBy("y")
    ahead = arcs.select(F.col("x").alias("y"), F.col("y").alias("x"), F.lead("y").over(order).alias("next"), F.first("y").over(order).alias("first"))
    is_root = roots.select(F.col("basin").alias("y"), F.lit(True).alias("root"))
    nxt = arcs.select("x", "y").join(ahead, ["x", "y"]).join(is_root, "y", "left")
    to = F.coalesce("next", F.when(F.col("root").isNull(), F.col("first")))
    arc = F.struct("x", "y")
    of = settled(nxt.select(arc.alias("arc"), F.when(to.isNotNull(), F.struct(F.col("y").alias("x"), to.alias("y"))).alias("to"), F.lit(1).cast("long").alias("left")))
    while not of.where("to is not null").isEmpty():
        on = of.select(F.col("arc").alias("to"), F.col("to").alias("on"), F.col("left").alias("more"))
        of = settled(of.join(on, "to", "left").select("arc", F.col("on").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), of)
    there, back = of.select("arc.x", "arc.y", "left"), of.select(F.col("arc.y").alias("x"), F.col("arc.x").alias("y"), F.col("left").alias("back"))
    # of the two arcs of a pass the later one leads towards the root
    up = arcs.join(there.join(back, ["x", "y"]).where(F.col("left") < F.col("back")).select("x", "y"), ["x", "y"])
    return settled(roots.unionByName(up.select(F.col("x").alias("basin"), F.col("y").alias("onward"), "level", F.col("u").alias("leaves"), F.col("v").alias("enters"))), arcs, of)


def filled_surface(cells: DataFrame, value: str = "value", local: int = LOCAL) -> DataFrame:
    """(row, col, filled): each cell raised to the level at which water from it gets outside: the least, over paths to the edge, of the path's highest cell."""
    at = basins(cells, value)
    ways = ways_out(spanning_forest(passes(at), local))
    # the highest pass on the way out, by doubled pointers
    of = settled(ways.select("basin", F.col("onward").alias("to"), "level"))
    while not of.where("to is not null").isEmpty():
        on = of.select(F.col("basin").alias("to"), F.col("to").alias("on"), F.col("level").alias("more"))
        of = settled(of.join(on, "to", "left").select("basin", F.col("on").alias("to"), F.greatest("level", "more").alias("level")), of)
    return at.join(of.select("basin", "level"), "basin").select("cell.row", "cell.col", F.greatest("z", "level").alias("filled"))


def routes(cells: DataFrame, value: str = "value", local: int = LOCAL) -> DataFrame:
    """(cell, z, to): for each cell the next on its way outside, null where it leaves the table. Cells fall as they did, but for those between a depression and the pass it leaves by."""
    at = basins(cells, value)
    ways = ways_out(spanning_forest(passes(at), local))
    # cells on the path from where a basin is left down to its depression, that from now on lead the other way
    jumps = [settled(at.select(F.col("cell").alias("node"), "to"))]
    while True:
        on = jumps[-1].select(F.col("node").alias("to"), F.col("to").alias("on"))
        jumps.append(settled(jumps[-1].join(on, "to").select("node", F.col("on").alias("to"))))
        # all at their ends: a jump changes nothing more
        if jumps[-1].alias("p").join(jumps[-2].alias("q"), "node").where("p.to != q.to").isEmpty():
            break
    on_path = ways.select(F.col("leaves").alias("node"))
    for jump in reversed(jumps):
        on_path = settled(on_path.unionByName(on_path.join(jump, "node").select(F.col("to").alias("node"))).distinct(), on_path)
    release(*jumps)
    falls = at.select(F.col("cell").alias("node"), "to")
    turned = on_path.join(falls, "node").where(F.col("node") != F.col("to")).select(F.col("to").alias("cell"), F.col("node").alias("back"))
    leaving = ways.select(F.col("leaves").alias("cell"), F.col("enters").alias("over"), F.lit(True).alias("leaves"))
    new = at.join(turned, "cell", "left").join(leaving, "cell", "left")
    to = F.when(F.col("leaves"), F.col("over")).otherwise(F.coalesce("back", "to"))
    return settled(new.select("cell", "z", to.alias("to")), at, on_path, ways)


def breached_surface(cells: DataFrame, value: str = "value", fall: float = FALL, local: int = LOCAL) -> DataFrame:
    """(row, col, breached, to_row, to_col): depressions cut through along the path outside whose highest cell is lowest, and where each cell leads (null: outside).

    A cell is as low as the lowest upstream less `fall` for each step from there, so every cell but those that lead outside has a
    lower neighbour, flats included; cells that already fall by more are as they were. However long, a cut is made.
    """
    route = routes(cells, value, local)
    of = settled(route.select("cell", "to", F.col("z").alias("low")))
    step = 1
    while not of.where("to is not null").isEmpty():
        come = of.where("to is not null").groupBy(F.col("to").alias("cell")).agg((F.min("low") - fall * step).alias("come"))
        on = of.select(F.col("cell").alias("to"), F.col("to").alias("on"))
        far = of.join(come, "cell", "left").join(on, "to", "left")
        of, step = settled(far.select("cell", F.col("on").alias("to"), F.least("low", "come").alias("low")), of), step * 2
    return route.join(of.select("cell", "low"), "cell").select("cell.row", "cell.col", F.col("low").alias("breached"), F.col("to.row").alias("to_row"), F.col("to.col").alias("to_col"))
