"""Operators on cell tables (row, col, value).

Neighbourhoods are made by scattering each cell to the cells it counts for and grouping by
target: one shuffle with partial aggregation, whatever the number of cells. Moving sums are
separable range windows along rows, then columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.projection import UTM_14, System, with_changed
from .rounds import settled
from .running import count_below, cuts_of, quantiles

KEY = ["row", "col"]


def neighbourhood(cells: DataFrame, value: str = "value", reach: int = 1) -> DataFrame:
    """(row, col, n, around): for each cell its present neighbours as a map from 'dr,dc' to value."""
    offsets = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]
    scattered = cells.where(F.col(value).isNotNull()).select("row", "col", F.col(value).cast("double").alias("v"), F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets])).alias("o"))
    at = scattered.select((F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), "o", "v")
    picks = [F.max(F.when((F.col("o.dr") == a) & (F.col("o.dc") == b), F.col("v"))).alias(_name(a, b)) for a, b in offsets]
    return at.groupBy(*KEY).agg(*picks).where(F.col(_name(0, 0)).isNotNull())


def _name(a: int, b: int) -> str:
    return f"z_{a + 9}_{b + 9}"


def _z(a: int, b: int) -> Column:
    return F.col(_name(a, b))


_RING = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def ruggedness(cells: DataFrame, value: str = "value") -> DataFrame:
    """tri: root of the summed squares of differences to the eight neighbours; tpi: centre minus their mean. Cells without all eight are null."""
    whole = sum((_z(a, b) * 0 for a, b in _RING), F.lit(0.0))  # null if any is
    squares = sum((F.pow(_z(a, b) - _z(0, 0), F.lit(2)) for a, b in _RING), whole)
    mean = sum((_z(a, b) for a, b in _RING), whole) / 8.0
    return neighbourhood(cells, value).select(*KEY, F.sqrt(squares).alias("tri"), (_z(0, 0) - mean).alias("tpi"))


def slope_curvature(cells: DataFrame, size: float, value: str = "value") -> DataFrame:
    """slope in degrees by weighted differences of a 3 x 3 window, and curvature from the four direct neighbours (times -100). Edge cells are null."""
    dx = ((_z(-1, 1) + 2 * _z(0, 1) + _z(1, 1)) - (_z(-1, -1) + 2 * _z(0, -1) + _z(1, -1))) / (8 * size)
    dy = ((_z(1, -1) + 2 * _z(1, 0) + _z(1, 1)) - (_z(-1, -1) + 2 * _z(-1, 0) + _z(-1, 1))) / (8 * size)
    d = ((_z(0, -1) + _z(0, 1)) / 2 - _z(0, 0)) / (size * size)
    e = ((_z(-1, 0) + _z(1, 0)) / 2 - _z(0, 0)) / (size * size)
    return neighbourhood(cells, value).select(*KEY, F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope"), (-2 * (d + e) * 100).alias("curvature"))


def focal_density(cells: DataFrame, radius: int, size: float, value: str = "value") -> DataFrame:
    """Sum of value in the square window of 2 radius + 1 cells, over its area; outside the table counts as 0."""
    along = Window.partitionBy("row").orderBy("col").rangeBetween(-radius, radius)
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-radius, radius)
    area = ((2 * radius + 1) * size) ** 2
    rows = cells.withColumn("__along", F.sum(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).over(along))
    return rows.select(*KEY, (F.sum("__along").over(down) / area).alias("density"))


def resample_nearest(cells: DataFrame, factor: int, value: str = "value") -> DataFrame:
    """Coarser by a factor: the value of the cell at the coarse cell's centre (the lower right of the middle four if even)."""
    middle = factor // 2
    inside = (F.pmod("row", F.lit(factor)) == middle) & (F.pmod("col", F.lit(factor)) == middle)
    return cells.where(inside).select(F.floor(F.col("row") / factor).cast("long").alias("row"), F.floor(F.col("col") / factor).cast("long").alias("col"), value)


def resample_mean(cells: DataFrame, factor: int, value: str = "value") -> DataFrame:
    """Coarser by a factor: the mean of the cells present."""
    return cells.groupBy(F.floor(F.col("row") / factor).cast("long").alias("row"), F.floor(F.col("col") / factor).cast("long").alias("col")).agg(F.avg(value).alias(value))


def resample_bilinear(cells: DataFrame, targets: DataFrame, value: str = "value") -> DataFrame:
    """Values at fractional places (y, x) of targets, in cells, by the four cells around; present ones share the weight."""
    corners = F.array(*[F.struct((F.floor("y") + a).cast("long").alias("row"), (F.floor("x") + b).cast("long").alias("col"), ((F.abs(F.lit(1 - a) - (F.col("y") - F.floor("y")))) * (F.abs(F.lit(1 - b) - (F.col("x") - F.floor("x"))))).alias("w")) for a in (0, 1) for b in (0, 1)])
    spread = targets.select("y", "x", F.inline(corners))
    joined = spread.join(cells.select(*KEY, F.col(value).cast("double").alias("v")), KEY).where("w > 0 and v is not null")
    return joined.groupBy("y", "x").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias(value))


@dataclass(frozen=True)
class Frame:
    """Where a table's cells lie: the corner of cell (0, 0), the size of cells, rows counted upwards, and the coordinate system."""

    x0: float
    y0: float
    size: float
    system: System = UTM_14

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return (col + 0.5) * self.size + self.x0, (row + 0.5) * self.size + self.y0


def frame_cells(spark: SparkSession, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """(row, col) of all cells from the first to before the second of rows and cols."""
    width = cols[1] - cols[0]
    return spark.range(max(rows[1] - rows[0], 0) * max(width, 0)).select((F.floor(F.col("id") / max(width, 1)) + rows[0]).cast("long").alias("row"), (F.col("id") % max(width, 1) + cols[0]).alias("col"))


def warp(cells: DataFrame, source: Frame, targets: DataFrame, target: Frame, value: str = "value", method: str = "bilinear") -> DataFrame:
    """(row, col, value) of target cells: each looks where its centre lies among the source's cells, in the source's system.

    "nearest" takes the cell that holds the centre; "bilinear" the four centres around it, of which those present share the weight. Target cells without
    any are left out. So values are moved by joins on cells, whatever the systems.
    """
    x, y = target.centre(F.col("row"), F.col("col"))
    centres = targets.select(F.col("row").cast("long").alias("to_row"), F.col("col").cast("long").alias("to_col"), x.alias("x"), y.alias("y"))
    moved = with_changed(centres, "x", "y", target.system, source.system)
    at = moved.select("to_row", "to_col", ((F.col("x") - source.x0) / source.size).alias("x"), ((F.col("y") - source.y0) / source.size).alias("y"))
    held = cells.where(F.col(value).isNotNull()).select(*[F.col(k).cast("long").alias(k) for k in KEY], F.col(value).cast("double").alias("v"))
    if method == "nearest":
        found = at.select("to_row", "to_col", F.floor("y").cast("long").alias("row"), F.floor("x").cast("long").alias("col")).join(held, KEY)
        return found.select(F.col("to_row").alias("row"), F.col("to_col").alias("col"), F.col("v").alias(value))
    if method != "bilinear":
        raise ValueError(method)
    # in units of centres
    x, y = F.col("x") - 0.5, F.col("y") - 0.5
    corners = F.array(*[F.struct((F.floor(y) + a).cast("long").alias("row"), (F.floor(x) + b).cast("long").alias("col"), (F.abs(1 - a - (y - F.floor(y))) * F.abs(1 - b - (x - F.floor(x)))).alias("w")) for a in (0, 1) for b in (0, 1)])
    joined = at.select("to_row", "to_col", F.inline(corners)).where("w > 0").join(held, KEY)
    return joined.groupBy(F.col("to_row"), F.col("to_col")).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias(value)).select(F.col("to_row").alias("row"), F.col("to_col").alias("col"), value)


def lookup(points: DataFrame, cells: DataFrame, x: str, y: str, size: float, columns: list[str]) -> DataFrame:
    """Each point with the layers of its cell; null outside, and in_bounds."""
    at = points.withColumn("__row", F.floor(F.col(y) / size).cast("long")).withColumn("__col", F.floor(F.col(x) / size).cast("long"))
    layer = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), *columns)
    return at.join(layer, (F.col("__row") == F.col("__r")) & (F.col("__col") == F.col("__c")), "left").withColumn("in_bounds", F.col("__r").isNotNull()).drop("__row", "__col", "__r", "__c")


def stack(layers: dict[str, DataFrame]) -> DataFrame:
    """One row for each cell that all layers have, a column for each layer. One shuffle: the layers are stacked by union and grouped."""
    long = None
    for name, cells in layers.items():
        part = cells.select(*KEY, F.lit(name).alias("layer"), F.col("value").cast("double").alias("value"))
        long = part if long is None else long.unionByName(part)
    wide = long.groupBy(*KEY).pivot("layer", list(layers)).agg(F.max("value"))
    return wide.dropna(subset=list(layers))


def classify(cells: DataFrame, value: str, edges: Column) -> Column:
    """Class of value by array of edges: the last edge at or under it, within 0 .. classes - 1."""
    k = F.size(F.filter(edges, lambda e: e <= F.col(value))) - 1
    return F.greatest(F.lit(0), F.least(k, F.size(edges) - 2)).cast("long")


def quantile_classes(cells: DataFrame, value: str = "value", classes: int = 5) -> DataFrame:
    """(class, low, high, n) by exact linear quantiles."""
    edges = F.broadcast(quantiles(cells, value, [k / classes for k in range(classes + 1)], into="edges"))
    put = cells.where(F.col(value).isNotNull()).crossJoin(edges).withColumn("class", classify(cells, value, F.col("edges")))
    n = put.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.first("edges").alias("e"))
    return n.select("class", F.get("e", F.col("class").cast("int")).alias("low"), F.get("e", (F.col("class") + 1).cast("int")).alias("high"), "n")


def distance_to_source(cells: DataFrame, is_source: str, size: float = 1.0) -> DataFrame:
    """Exact Euclidean distance of each cell to the nearest source cell; null if there is none.

    Two passes: within each column the nearest source above and below by running windows,
    then along each row the lower envelope of the parabolas, a row in a task.
    """
    up = Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("col").orderBy("row").rowsBetween(0, Window.unboundedFollowing)
    source = cells.where(F.col(is_source)).select(*KEY).distinct()
    bounds = F.broadcast(cells.agg(F.min("row").alias("__a"), F.max("row").alias("__b")))
    # every row counts for a source's column, whether or not the table has the cell
    lines = source.select("col").distinct().crossJoin(bounds).select("col", F.explode(F.sequence("__a", "__b")).alias("row"))
    marked = lines.join(source.withColumn("mark", F.col("row")), KEY, "left")
    near = F.least(F.col("row") - F.last("mark", ignorenulls=True).over(up), F.first("mark", ignorenulls=True).over(down) - F.col("row"))
    steps = marked.select(*KEY, near.cast("double").alias("g"), F.lit(False).alias("asked"))
    first = steps.unionByName(cells.select(*KEY, F.lit(None).cast("double").alias("g"), F.lit(True).alias("asked")))

    def envelope(row: pd.DataFrame) -> pd.DataFrame:
        asked = row[row["asked"]]
        has = row[row["g"].notna()].sort_values("col")
        if has.empty:
            return asked.assign(distance=np.nan)[["row", "col", "distance"]]
        c, h = has["col"].to_numpy(float), has["g"].to_numpy(float) ** 2
        keep, bound = [0], [-np.inf]
        for i in range(1, len(c)):
            while True:
                j = keep[-1]
                s = ((h[i] + c[i] ** 2) - (h[j] + c[j] ** 2)) / (2 * (c[i] - c[j]))
                if s > bound[-1]:
                    break
                keep.pop()
                bound.pop()
            keep.append(i)
            bound.append(s)
        at = asked["col"].to_numpy(float)
        best = np.array(keep)[np.searchsorted(np.array(bound), at, "right") - 1]
        return asked.assign(distance=np.sqrt((at - c[best]) ** 2 + h[best]))[["row", "col", "distance"]]

    types = dict(cells.dtypes)
    out = first.groupBy("row").applyInPandas(envelope, f"row {types['row']}, col {types['col']}, distance double")
    return out.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance") * size))


def connected_components(cells: DataFrame, least: int = 1) -> DataFrame:
    """(row, col, component, n) of flagged cells that join side by side, components of at least ``least`` cells.

    Cells of a run along a row are one node; runs that touch in the next row are linked,
    and labels spread by repeated joins with pointer jumping until none changes.
    """
    along = Window.partitionBy("row").orderBy("col")
    breaks = F.sum((F.coalesce(F.col("col") - F.lag("col").over(along), F.lit(2)) > 1).cast("int")).over(along)
    runs = cells.select(*KEY).distinct().withColumn("run", breaks)
    nodes = runs.groupBy("row", "run").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    nodes = settled(nodes.withColumn("id", F.struct("row", "a")))
    low = nodes.select(F.col("id").alias("u"), (F.col("row") + 1).alias("r"), F.col("a").alias("a1"), F.col("b").alias("b1"))
    touch = low.join(nodes, (F.col("r") == F.col("row")) & (F.col("a1") <= F.col("b")) & (F.col("a") <= F.col("b1"))).select("u", F.col("id").alias("v"))
    edges = settled(touch.unionByName(touch.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    label = settled(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = edges.join(label.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("label").alias("m"))
        stepped = settled(label.join(near, F.col("id") == F.col("u"), "left").select("id", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("was")))
        jump = stepped.select(F.col("id").alias("label"), F.col("label").alias("far"))
        label = settled(stepped.join(jump, "label").select("id", F.col("far").alias("label"), (F.col("far") != F.col("was")).alias("moved")), label, stepped)
        if label.where("moved").isEmpty():
            label = label.drop("moved")
            break
    put = runs.join(nodes.select("row", "run", "id"), ["row", "run"]).join(label, "id")
    n = put.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return put.join(n, "label").select(*KEY, F.concat_ws("_", "label.row", "label.a").alias("component"), "n")


#: Steps of flow: east, south-east, south, south-west, west, north-west, north, north-east.
_STEPS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def flow_direction(cells: DataFrame, value: str = "value") -> DataFrame:
    """(row, col, to_row, to_col): the neighbour of the steepest descent, diagonals over root two; null where none is lower. Ties go to the first of the fixed order of steps."""
    drop = F.array(*[F.struct(((_z(0, 0) - _z(a, b)) / (2**0.5 if a and b else 1.0)).alias("drop"), F.lit(-i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(_STEPS)])
    best = F.array_max(F.filter(drop, lambda s: s["drop"] > 0))
    return neighbourhood(cells, value).withColumn("s", best).select(*KEY, (F.col("row") + F.col("s.a")).alias("to_row"), (F.col("col") + F.col("s.b")).alias("to_col"))


def flow_accumulation(cells: DataFrame, value: str = "value", directions: DataFrame | None = None, most_rounds: int = 62) -> DataFrame:
    """(row, col, accumulation): cells that drain through each, itself included.

    Pointers double: after round k a cell knows its 2**k-th cell downstream and how many cells
    lie less than 2**k steps upstream; what the cells 2**k steps up know is added. So the
    rounds are the logarithm of the longest path. Depressions keep what flows in: cut through them
    first, and give the surface, or its directions (row, col, to_row, to_col).
    """
    of = flow_direction(cells, value) if directions is None else directions.select(*KEY, "to_row", "to_col")
    at = settled(of.withColumn("n", F.lit(1).cast("long")))
    for _ in range(most_rounds):
        if at.where("to_row is not null").isEmpty():
            return at.select(*KEY, F.col("n").alias("accumulation"))
        arrived = at.where("to_row is not null").groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.sum("n").alias("more"))
        onward = at.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("r2"), F.col("to_col").alias("c2"))
        far = at.join(onward, ["to_row", "to_col"], "left").select(*KEY, F.col("r2").alias("to_row"), F.col("c2").alias("to_col"), "n")
        at = settled(far.join(arrived, KEY, "left").select(*KEY, "to_row", "to_col", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), at)
    raise ValueError("directions lead in a circle")


def height_above_stream(cells: DataFrame, is_stream: str, value: str = "value", most_rounds: int = 62) -> DataFrame:
    """Height of each cell above the first stream cell downstream; null if none is reached. Pointers double each round."""
    to = flow_direction(cells, value).join(cells.select(*KEY, is_stream), KEY)
    point = settled(to.select(*KEY, F.when(F.col(is_stream) | F.col("to_row").isNull(), F.col("row")).otherwise(F.col("to_row")).alias("pr"), F.when(F.col(is_stream) | F.col("to_col").isNull(), F.col("col")).otherwise(F.col("to_col")).alias("pc"), F.lit(True).alias("moved")))
    for _ in range(most_rounds):
        nxt = point.select(F.col("row").alias("pr"), F.col("col").alias("pc"), F.col("pr").alias("qr"), F.col("pc").alias("qc"))
        moved = (F.col("qr") != F.col("pr")) | (F.col("qc") != F.col("pc"))
        point = settled(point.join(nxt, ["pr", "pc"]).select(*KEY, F.col("qr").alias("pr"), F.col("qc").alias("pc"), moved.alias("moved")), point)
        if point.where("moved").isEmpty():
            break
    else:
        raise ValueError("directions lead in a circle")
    low = cells.select(F.col("row").alias("pr"), F.col("col").alias("pc"), F.col(value).alias("__low"), F.col(is_stream).alias("__s"))
    out = point.join(low, ["pr", "pc"]).join(cells.select(*KEY, value), KEY)
    return out.select(*KEY, F.when(F.col("__s"), F.col(value) - F.col("__low")).alias("hand"))


def burn_lines(segments: DataFrame, size: float) -> DataFrame:
    """Cells that segments (x0, y0, x1, y1) pass through, by steps of at most half a cell; distinct."""
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))) / (size / 2)).cast("int"))
    steps = segments.withColumn("__n", n).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n"))))
    f = F.col("__k") / F.col("__n")
    x, y = F.col("x0") + (F.col("x1") - F.col("x0")) * f, F.col("y0") + (F.col("y1") - F.col("y0")) * f
    return steps.select(F.floor(y / size).cast("long").alias("row"), F.floor(x / size).cast("long").alias("col")).distinct()


def near_segments(cells: DataFrame, segments: DataFrame, size: float, reach: float) -> DataFrame:
    """Cells whose centre is within reach of a segment (x0, y0, x1, y1); distinct.

    Segments are spread over the tiles of side ``reach`` that their bounding box, widened by
    reach, touches; cells meet the segments of their tile only.
    """
    low, high = lambda a, b: F.floor((F.least(a, b) - reach) / reach), lambda a, b: F.floor((F.greatest(a, b) + reach) / reach)
    wide = segments.withColumn("tx", F.explode(F.sequence(low("x0", "x1"), high("x0", "x1")))).withColumn("ty", F.explode(F.sequence(low("y0", "y1"), high("y0", "y1"))))
    x, y = (F.col("col") + 0.5) * size, (F.col("row") + 0.5) * size
    placed = cells.select(*KEY, x.alias("x"), y.alias("y")).withColumn("tx", F.floor(F.col("x") / reach)).withColumn("ty", F.floor(F.col("y") / reach))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t = F.coalesce(F.try_divide((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    d2 = F.pow(F.col("x") - F.col("x0") - t * dx, F.lit(2)) + F.pow(F.col("y") - F.col("y0") - t * dy, F.lit(2))
    return placed.join(wide, ["tx", "ty"]).where(d2 <= reach * reach).select(*KEY).distinct()


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a ring (array of structs x, y, first not repeated), by crossings of a ray; strictly, but for points on an edge, which may fall either way."""
    n = F.size(ring)

    def crossing(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        straddles = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"])
        return (straddles & (x < at)).cast("int")

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(crossing(i), F.lit(0))), F.lit(0), lambda s, c: s + c) % 2 == 1


def assign_zones(cells: DataFrame, zones: DataFrame, zone: str, ring: str, size: float, tile: float) -> DataFrame:
    """Cells with the zone whose ring holds their centre; the latest zone in order overwrites.

    Zones are spread over the tiles that their bounding boxes touch, and cells meet the zones of
    their tile only, so the join is by equality of tiles.
    """
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    tiles = zones.select(
        zone,
        ring,
        F.explode(F.sequence(F.floor(F.array_min(xs) / tile), F.floor(F.array_max(xs) / tile))).alias("tx"),
        F.sequence(F.floor(F.array_min(ys) / tile), F.floor(F.array_max(ys) / tile)).alias("tys"),
    ).select(zone, ring, "tx", F.explode("tys").alias("ty"))
    x, y = (F.col("col") + 0.5) * size, (F.col("row") + 0.5) * size
    placed = cells.withColumn("tx", F.floor(x / tile)).withColumn("ty", F.floor(y / tile))
    met = placed.join(tiles, ["tx", "ty"]).where(in_polygon(x, y, F.col(ring)))
    return met.groupBy(*[c for c in cells.columns]).agg(F.max(zone).alias(zone))


#: Cells of equal numbers of values that breaks lie between, where a layer has more distinct values.
CELLS = 4096


def weighted_breaks(n: np.ndarray, total: np.ndarray, squares: np.ndarray, classes: int) -> tuple[list[int], float]:
    """Where contiguous classes of ordered groups (rows, sum and sum of squares) begin, so that the squares within classes are least, and these. By the dynamic programme over ends of classes."""
    n, s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (n, total, squares))
    size = len(n) - 1
    classes = min(classes, size)
    best = np.full(size + 1, np.inf)
    best[0], came = 0.0, []
    for _ in range(classes):
        new, cut = np.full(size + 1, np.inf), np.zeros(size + 1, int)
        for b in range(1, size + 1):
            within = q[b] - q[:b] - (s[b] - s[:b]) ** 2 / (n[b] - n[:b])
            cost = best[:b] + np.maximum(within, 0.0)
            cut[b] = int(np.argmin(cost))
            new[b] = cost[cut[b]]
        best = new
        came.append(cut)
    starts, b = [], size
    for cut in reversed(came):
        b = int(cut[b])
        starts.append(b)
    return starts[::-1], float(best[size])


def natural_breaks(cells: DataFrame, value: str = "value", classes: int = 5, most: int = CELLS) -> tuple[list[float], float]:
    """Edges of classes of least squares within, and by how much the squares may be over the least.

    Of up to ``most`` distinct values the edges are exact. Of more, a hash sample cuts the values into about so many ranges, which are
    counted and summed in Spark, and breaks lie between ranges only; only these sums reach the driver. The bound: what
    lies within ranges, and for each break the rows of the widest range times its width and the breadth of all values, twice. Fewer distinct values than classes give
    fewer classes. Nulls don't count.
    """
    known = cells.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    each = known.groupBy("v").agg(F.count("*").alias("c"))
    # no more than needed to tell
    distinct = each.limit(most + 1).count()
    if not distinct:
        return [], 0.0
    if distinct <= most:
        groups = each.select("c", (F.col("c") * F.col("v")).alias("s"), (F.col("c") * F.col("v") * F.col("v")).alias("q"), F.col("v").alias("low"), F.col("v").alias("high"))
    else:
        cuts = cuts_of(known, "v", most)
        at = count_below(F.col("cuts"), F.col("v"), or_equal=True)
        put = known.crossJoin(F.broadcast(known.sparkSession.createDataFrame([(cuts,)], "cuts array<double>")))
        groups = put.groupBy(at.alias("cell")).agg(F.count("*").alias("c"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.min("v").alias("low"), F.max("v").alias("high")).drop("cell")
    rows = groups.orderBy("low").collect()
    n, s, q, low, high = (np.array([float(r[k]) for r in rows]) for k in ("c", "s", "q", "low", "high"))
    # about the middle, so that squares don't cancel
    mid = float(s.sum() / n.sum())
    starts, _ = weighted_breaks(n, s - n * mid, q - 2 * mid * s + n * mid * mid, classes)
    inside = float(np.maximum(q - s * s / n, 0.0).sum()) if distinct > most else 0.0
    moved = (len(starts) - 1) * float((n * (high - low)).max()) * 2 * float(high[-1] - low[0])
    return [float(low[0]), *(float(high[b - 1]) for b in starts[1:]), float(high[-1])], inside + moved


def natural_classes(cells: DataFrame, value: str = "value", classes: int = 5, most: int = CELLS) -> DataFrame:
    """(class, low, high, n) by natural breaks; a value that is an edge is in the class above it."""
    edges, _ = natural_breaks(cells, value, classes, most)
    edge = F.array(*[F.lit(e) for e in edges]) if edges else F.array().cast("array<double>")
    put = cells.where(F.col(value).isNotNull()).select(classify(cells, value, edge).alias("class"))
    n = put.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return n.select("class", F.get(edge, F.col("class").cast("int")).alias("low"), F.get(edge, (F.col("class") + 1).cast("int")).alias("high"), "n")


#: Names of five classes, lowest first (fixed values).
CLASS_LABELS = ("Very Low", "Low", "Moderate", "High", "Very High")


def classed_map(cells: DataFrame, value: str = "value", classes: int = 5, method: str = "quantile", labels: tuple[str, ...] | None = None) -> DataFrame:
    """(class, label, low, high, n) of a layer by "quantile" or "natural_breaks"."""
    if method not in ("quantile", "natural_breaks"):
        raise ValueError(method)
    found = quantile_classes(cells, value, classes) if method == "quantile" else natural_classes(cells, value, classes)
    labels = labels or (CLASS_LABELS if classes == len(CLASS_LABELS) else tuple(f"Class {k + 1}" for k in range(classes)))
    return found.select("class", F.get(F.array(*[F.lit(x) for x in labels]), F.col("class").cast("int")).alias("label"), "low", "high", "n")
