"""Grids, zones and lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import comparisons, drainage, fitting, grid, rounds, surfaces, trees, zonal
from .registry import CELLS, cells, query, rounded, table

_N8 = " ".join(f"LEFT JOIN c n{i} ON n{i}.\"row\" = c.\"row\" + {a} AND n{i}.col = c.col + {b}" for i, (a, b) in enumerate([(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]))


@query(f"""WITH {CELLS} SELECT c."row", c.col, round(sqrt({' + '.join(f'pow(n{i}.value - c.value, 2)' for i in range(8))}), 6) AS tri, round(c.value - ({' + '.join(f'n{i}.value' for i in range(8))}) / 8, 6) AS tpi FROM c {_N8}""")
def terrain_ruggedness(spark, d):
    return rounded(grid.ruggedness(cells(spark, d)))


@query(f"""WITH {CELLS}, g AS (SELECT c."row", c.col, ((n2.value + 2 * n4.value + n7.value) - (n0.value + 2 * n3.value + n5.value)) / 80 AS dx, ((n5.value + 2 * n6.value + n7.value) - (n0.value + 2 * n1.value + n2.value)) / 80 AS dy,
((n3.value + n4.value) / 2 - c.value) / 100 AS d, ((n1.value + n6.value) / 2 - c.value) / 100 AS e FROM c {_N8})
SELECT "row", col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope, round(-2 * (d + e) * 100, 6) AS curvature FROM g""")
def slope_curvature(spark, d):
    return rounded(grid.slope_curvature(cells(spark, d), 10.0))


@query(f"""WITH {CELLS}, a AS (SELECT *, sum(value) OVER (PARTITION BY "row" ORDER BY col RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM c)
SELECT "row", col, round(sum(s) OVER (PARTITION BY col ORDER BY "row" RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 4900, 6) AS density FROM a""")
def focal_density(spark, d):
    return rounded(grid.focal_density(cells(spark, d), 3, 10.0))


@query(f"""WITH {CELLS} SELECT "row" // 3 AS "row", col // 3 AS col, value FROM c WHERE "row" % 3 = 1 AND col % 3 = 1""")
def resample_nearest(spark, d):
    return grid.resample_nearest(cells(spark, d), 3)


@query(f"""WITH {CELLS} SELECT "row" // 3 AS "row", col // 3 AS col, round(avg(value), 6) AS value FROM c GROUP BY ALL""")
def resample_mean(spark, d):
    return rounded(grid.resample_mean(cells(spark, d), 3))


@query(f"""WITH {CELLS}, t AS (SELECT DISTINCT (event_id % 480) / 10.0 + 0.25 AS y, (event_id % 370) / 10.0 + 0.75 AS x FROM events), k AS (SELECT t.y, t.x, c.value, (1 - abs(c."row" - t.y)) * (1 - abs(c.col - t.x)) AS w FROM t JOIN c ON c."row" BETWEEN floor(t.y) AND floor(t.y) + 1 AND c.col BETWEEN floor(t.x) AND floor(t.x) + 1)
SELECT CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x, round(sum(w * value) / sum(w), 6) AS value FROM k WHERE w > 0 GROUP BY ALL""")
def resample_bilinear(spark, d):
    t = table(spark, d, "events").select(((F.col("event_id") % 480) / 10.0 + 0.25).alias("y"), ((F.col("event_id") % 370) / 10.0 + 0.75).alias("x")).distinct()
    return rounded(grid.resample_bilinear(cells(spark, d), t))


@query(f"""WITH {CELLS} SELECT event_id, c.value AS layer, c.value IS NOT NULL AS in_bounds FROM (SELECT event_id, CAST(floor(user_id / 2.0) AS BIGINT) AS r, CAST(floor(value / 2.0) AS BIGINT) AS k FROM events) e LEFT JOIN c ON c."row" = e.r AND c.col = e.k""")
def point_lookup(spark, d):
    p = table(spark, d, "events").select("event_id", F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    return grid.lookup(p, cells(spark, d).withColumnRenamed("value", "layer"), "x", "y", 2.0, ["layer"]).select("event_id", "layer", "in_bounds")


@query(f"""WITH {CELLS}, b AS (SELECT "row", col, value * 2 AS value FROM c WHERE col % 4 <> 0) SELECT c."row", c.col, c.value AS a, round(b.value, 6) AS b FROM c JOIN b USING ("row", col)""")
def layer_stack(spark, d):
    c = cells(spark, d)
    return rounded(grid.stack({"a": c, "b": c.where("col % 4 <> 0").withColumn("value", F.col("value") * 2)}))


@query(f"""WITH {CELLS}, e AS (SELECT quantile_cont(value, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM c), k AS (SELECT greatest(0, least(len(list_filter(e, lambda x: x <= value)) - 1, 4)) AS class, e FROM c, e)
SELECT CAST(class AS BIGINT) AS class, round(e[class + 1], 6) AS low, round(e[class + 2], 6) AS high, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY ALL""")
def classed_map(spark, d):
    return rounded(grid.quantile_classes(cells(spark, d)))


@query(f"""WITH RECURSIVE {CELLS}, v AS (SELECT CAST(floor(value / 5) AS DOUBLE) AS v, count(*) AS c FROM c GROUP BY 1), g AS (SELECT row_number() OVER (ORDER BY v) AS i, v, c, sum(c) OVER (ORDER BY v) AS n, sum(c * v) OVER (ORDER BY v) AS s, sum(c * v * v) OVER (ORDER BY v) AS q FROM v),
z AS (SELECT * FROM g UNION ALL SELECT 0, NULL, 0, 0, 0, 0), w AS (SELECT a.i AS a, b.i AS b, (b.q - a.q) - pow(b.s - a.s, 2) / (b.n - a.n) AS e FROM z a JOIN z b ON a.i < b.i),
d(k, b, e, cuts) AS (SELECT 1, b, e, [0] FROM w WHERE a = 0 UNION ALL SELECT * FROM (SELECT d.k + 1, w.b, min(d.e + w.e), arg_min(list_append(d.cuts, w.a), d.e + w.e) FROM d JOIN w ON w.a = d.b WHERE d.k < 4 GROUP BY d.k, w.b)),
t AS (SELECT cuts FROM d WHERE k = 4 AND b = (SELECT max(i) FROM g)), e AS (SELECT list_concat([(SELECT min(v) FROM g)], list((SELECT v FROM g WHERE i = x) ORDER BY x), [(SELECT max(v) FROM g)]) AS e FROM (SELECT unnest(cuts) AS x FROM t) WHERE x > 0)
SELECT CAST(greatest(0, least(len(list_filter(e, lambda x: x <= floor(value / 5))) - 1, 3)) AS BIGINT) AS class, e[class + 1] AS low, e[class + 2] AS high, CAST(count(*) AS BIGINT) AS n FROM c, e GROUP BY ALL""")
def natural_classes(spark, d):
    """Four classes of least squares within, over every value."""
    return grid.classed_map(cells(spark, d).withColumn("value", F.floor(F.col("value") / 5).cast("double")), classes=4, method="natural_breaks").drop("label")


@query(f"""WITH {CELLS}, s AS (SELECT * FROM c WHERE ("row" * 31 + col * 17) % 97 = 0) SELECT c."row", c.col, round(min(sqrt(pow(c."row" - s."row", 2) + pow(c.col - s.col, 2))) * 10, 6) AS distance FROM c, s GROUP BY ALL""")
def distance_transform(spark, d):
    c = cells(spark, d).withColumn("s", (F.col("row") * 31 + F.col("col") * 17) % 97 == 0)
    return rounded(grid.distance_to_source(c, "s", 10.0))


@query(f"""WITH RECURSIVE {CELLS}, f AS (SELECT "row" AS r, col AS k, CAST("row" * 1000 + col AS BIGINT) AS id FROM c WHERE ("row" * 7 + col * 13 + ("row" * col) % 11) % 5 < 2),
w(id, r, k) AS (SELECT id, r, k FROM f UNION SELECT w.id, f.r, f.k FROM w JOIN f ON abs(f.r - w.r) + abs(f.k - w.k) = 1), l AS (SELECT r, k, min(id) AS id FROM w GROUP BY ALL), n AS (SELECT id, count(*) AS n FROM l GROUP BY id)
SELECT r AS "row", k AS col, CAST(n AS BIGINT) AS n FROM l JOIN n USING (id) WHERE n >= 3""")
def connected_components(spark, d):
    c = cells(spark, d).where((F.col("row") * 7 + F.col("col") * 13 + (F.col("row") * F.col("col")) % 11) % 5 < 2)
    return grid.connected_components(c, 3).select("row", "col", "n")


def _dem(spark, d):
    """A tilted surface with what events add to it."""
    return cells(spark, d).select("row", "col", (F.col("row") * 3.0 + F.col("col") * 2.0 + F.pmod(F.col("row") * F.col("col"), F.lit(5))).alias("value"))


_DEM = CELLS + ", z AS (SELECT \"row\" AS r, col AS k, \"row\" * 3.0 + col * 2.0 + (\"row\" * col) % 5 AS v FROM c)"
_D8 = """o AS (SELECT * FROM (VALUES (0,0,1),(1,1,1),(2,1,0),(3,1,-1),(4,0,-1),(5,-1,-1),(6,-1,0),(7,-1,1)) t(i, a, b)),
dir AS (SELECT z.r, z.k, n.r AS tr, n.k AS tk FROM z, o, z n WHERE n.r = z.r + o.a AND n.k = z.k + o.b AND n.v < z.v QUALIFY row_number() OVER (PARTITION BY z.r, z.k ORDER BY (z.v - n.v) / (CASE WHEN o.a <> 0 AND o.b <> 0 THEN sqrt(2.0) ELSE 1 END) DESC, o.i) = 1)"""


@query(f"""WITH {_DEM}, {_D8} SELECT z.r AS "row", z.k AS col, tr AS to_row, tk AS to_col FROM z LEFT JOIN dir ON dir.r = z.r AND dir.k = z.k""")
def flow_direction(spark, d):
    return grid.flow_direction(_dem(spark, d))


@query(f"""WITH RECURSIVE {_DEM}, {_D8}, w(r, k) AS (SELECT r, k FROM z UNION ALL SELECT dir.tr, dir.tk FROM w JOIN dir ON dir.r = w.r AND dir.k = w.k) SELECT r AS "row", k AS col, CAST(count(*) AS BIGINT) AS accumulation FROM w GROUP BY ALL""")
def flow_accumulation(spark, d):
    return grid.flow_accumulation(_dem(spark, d))


_EDGE = """n AS (SELECT c."row" AS r, c.col AS k, c.value AS v, (SELECT count(*) FROM c m WHERE abs(m."row" - c."row") <= 1 AND abs(m.col - c.col) <= 1) AS around FROM c)"""


@query(f"""WITH RECURSIVE {CELLS}, {_EDGE}, f(r, k, level) USING KEY (r, k) AS (
SELECT r, k, v FROM n WHERE around < 9
UNION SELECT r, k, min(level) FROM (SELECT n.r, n.k, greatest(n.v, f.level) AS level FROM f JOIN n ON abs(n.r - f.r) <= 1 AND abs(n.k - f.k) <= 1 LEFT JOIN recurring.f g ON g.r = n.r AND g.k = n.k WHERE g.level IS NULL OR greatest(n.v, f.level) < g.level) GROUP BY r, k)
SELECT r AS "row", k AS col, level AS filled FROM f""")
def filled_surface(spark, d):
    return drainage.filled_surface(cells(spark, d))


@query()
def breached_surface(spark, d):
    return rounded(drainage.breached_surface(cells(spark, d)), 9)


@query(f"""WITH {CELLS}, {_EDGE}, p AS (SELECT n.*, n.around = 9 AND NOT EXISTS (SELECT 1 FROM n m WHERE abs(m.r - n.r) <= 1 AND abs(m.k - n.k) <= 1 AND m.v < n.v) AS pit FROM n)
SELECT CAST(count(*) AS BIGINT) AS cells, CAST(count_if(pit) AS BIGINT) AS pits, CAST(0 AS BIGINT) AS pits_left, CAST(count(*) AS BIGINT) AS drained, CAST(0 AS BIGINT) AS raised FROM p""")
def routed_accumulation(spark, d):
    """Cells, depressions before and after cutting, cells that drain outside by steepest descent over the cut surface, and cells that it raises."""
    c = cells(spark, d)
    cut = drainage.breached_surface(c)
    surface = cut.select("row", "col", F.col("breached").alias("value"))
    flows = grid.flow_direction(surface)
    runs = grid.flow_accumulation(surface)

    def pits(of, directions):
        inner = drainage.basins(of).where("not edge").select(F.col("cell.row").alias("row"), F.col("cell.col").alias("col"))
        return inner.join(directions.where("to_row is null"), ["row", "col"]).agg(F.count("*").alias("n"))

    before, after = pits(c, grid.flow_direction(c)).select(F.col("n").alias("pits")), pits(surface, flows).select(F.col("n").alias("pits_left"))
    drained = runs.join(flows.where("to_row is null"), ["row", "col"]).agg(F.sum("accumulation").alias("drained"))
    both = c.join(surface.withColumnRenamed("value", "cut"), ["row", "col"]).agg(F.count("*").alias("cells"), F.count_if(F.col("cut") > F.col("value")).alias("raised"))
    return both.crossJoin(before).crossJoin(after).crossJoin(drained).select("cells", "pits", "pits_left", "drained", "raised")


@query(f"""WITH RECURSIVE {_DEM}, {_D8}, w(r0, k0, r, k) AS (SELECT r, k, r, k FROM z UNION ALL SELECT w.r0, w.k0, dir.tr, dir.tk FROM w JOIN dir ON dir.r = w.r AND dir.k = w.k WHERE (w.r + w.k) % 9 <> 0), s AS (SELECT r0, k0, r, k FROM w WHERE (r + k) % 9 = 0)
SELECT z.r AS "row", z.k AS col, round(CAST(z.v - y.v AS DOUBLE), 6) AS hand FROM z LEFT JOIN s ON s.r0 = z.r AND s.k0 = z.k LEFT JOIN z y ON y.r = s.r AND y.k = s.k""")
def height_above_stream(spark, d):
    return rounded(grid.height_above_stream(_dem(spark, d).withColumn("s", (F.col("row") + F.col("col")) % 9 == 0), "s"))


@query("""WITH f AS (SELECT event_id, user_id + 1 AS acc, radians(value / 20) AS s FROM events) SELECT event_id, round(ln(acc * 100 / greatest(tan(s), 1e-4)), 6) AS twi, round(acc * 100 * tan(s), 6) AS spi, round(log10(acc), 6) AS log_acc, round(ln(1 + acc * 100 * tan(s)), 6) AS log_spi FROM f WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, NULL, NULL, round(log10(user_id + 1), 6), NULL FROM events WHERE event_id % 3 = 0""")
def flow_derivatives(spark, d):
    acc, s = F.col("user_id") + 1, F.when(F.col("event_id") % 3 != 0, F.radians(F.col("value") / 20))
    f = table(spark, d, "events").select("event_id", acc.alias("acc"), s.alias("s"))
    spi = scalars.spi(F.col("acc"), F.col("s"))
    return rounded(f.select("event_id", scalars.twi(F.col("acc"), F.col("s")).alias("twi"), spi.alias("spi"), scalars.modelled("flow_accumulation", F.col("acc")).alias("log_acc"), scalars.modelled("spi", spi).alias("log_spi")))


_CN = " UNION ALL ".join(f"SELECT {c} AS cover, {i + 1} AS soil, {v}.0 AS cn" for c, values in scalars.CURVE_NUMBERS.items() for i, v in enumerate(values))
_OPEN = " UNION ALL ".join(f"SELECT {i + 1} AS soil, {v}.0 AS cn" for i, v in enumerate(scalars.OPEN_SPACE))


@query(f"""WITH t AS ({_CN}), o AS ({_OPEN}), p AS (SELECT p_partkey, [11, 21, 22, 24, 31, 41, 52, 71, 82, 90, 95, 99][p_size % 12 + 1] AS cover, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 4 + 1 END AS soil, CAST(floor(p_retailprice) AS BIGINT) % 100 AS imp FROM part)
SELECT p_partkey, round(CAST(CASE WHEN p.cover = 11 THEN 100 WHEN p.cover IN (21, 22, 23, 24) THEN o.cn * (1 - imp / 100.0) + 98 * imp / 100.0 ELSE t.cn END AS DOUBLE), 6) AS curve_number FROM p LEFT JOIN t ON t.cover = p.cover AND t.soil = p.soil LEFT JOIN o ON o.soil = p.soil""")
def curve_number(spark, d):
    p = table(spark, d, "part")
    covers = F.array(*[F.lit(c) for c in (11, 21, 22, 24, 31, 41, 52, 71, 82, 90, 95, 99)])
    soil = F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 4 + 1)
    imp = F.pmod(F.floor("p_retailprice"), F.lit(100))
    return rounded(p.select("p_partkey", scalars.curve_number(F.get(covers, (F.col("p_size") % 12).cast("int")), soil, imp).alias("curve_number")))


@query("SELECT c_nationkey AS zone, CAST(count(c_acctbal) AS BIGINT) AS n, round(CASE WHEN count(c_acctbal) >= 50 THEN avg(c_acctbal) END, 6) AS mean FROM customer GROUP BY c_nationkey")
def zonal_mean(spark, d):
    return rounded(zonal.zonal_mean(table(spark, d, "customer").select(F.col("c_nationkey").alias("zone"), "c_acctbal"), "zone", "c_acctbal"))


@query("""SELECT c_nationkey AS zone, CAST(count(c_acctbal) AS BIGINT) AS n, CAST(count(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_acctbal END) AS BIGINT) AS n_taken,
round(CASE WHEN count(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_acctbal END) >= 20 THEN avg(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_acctbal END) END, 6) AS mean_taken,
round(CASE WHEN count(c_acctbal) >= 20 THEN sum(c_acctbal * (c_custkey % 11)) / nullif(sum(c_custkey % 11), 0) END, 6) AS weighted_mean FROM customer GROUP BY c_nationkey""")
def zonal_weighted(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("zone"), "c_acctbal", "c_mktsegment", (F.col("c_custkey") % 11).alias("w"))
    return rounded(zonal.zonal_weighted(c, "zone", "c_acctbal", F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "w", 20))


_ZONES = "z AS (SELECT c_nationkey AS zone, avg(c_acctbal) AS susc, CAST(count(*) AS DOUBLE) AS n, CAST(sum(c_custkey) AS DOUBLE) / 1000 AS income FROM customer GROUP BY c_nationkey)"


def _zones(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("zone")).agg(F.avg("c_acctbal").alias("susc"), F.count(F.lit(1)).cast("double").alias("n"), (F.sum("c_custkey").cast("double") / 1000).alias("income"))


@query(f"""WITH {_ZONES}, e AS (SELECT quantile_cont(income, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM z), k AS (SELECT greatest(0, len(list_filter(e, lambda x: x < income)) - 1) AS bin, susc FROM z, e)
SELECT CAST(bin AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(susc), 6) AS mean, round(quantile_cont(susc, 0.25), 6) AS q25, round(quantile_cont(susc, 0.75), 6) AS q75 FROM k GROUP BY bin""")
def income_quintiles(spark, d):
    return rounded(zonal.quantile_groups(_zones(spark, d), "income", "susc"))


@query(f"""WITH {_ZONES} SELECT zone, round(((susc - avg(susc) OVER ()) / stddev_samp(susc) OVER () + (n - avg(n) OVER ()) / stddev_samp(n) OVER () + (income - avg(income) OVER ()) / stddev_samp(income) OVER ()) / 3, 6) AS vulnerability FROM z""")
def composite_index(spark, d):
    return rounded(zonal.index_of(_zones(spark, d), ["susc", "n", "income"], "vulnerability").select("zone", "vulnerability"))


@query(f"""WITH {CELLS}, g AS (SELECT n_nationkey AS zone, (n_nationkey % 5) * 10.3 + 1.23 AS x0, (n_nationkey // 5) * 9.7 + 0.73 AS y0 FROM nation) SELECT c."row", c.col, CAST(max(zone) AS BIGINT) AS zone FROM c JOIN g ON col + 0.5 > x0 AND col + 0.5 < x0 + 9 AND "row" + 0.5 > y0 AND "row" + 0.5 < y0 + 11 GROUP BY ALL""")
def polygon_cells(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("zone"), ((F.col("n_nationkey") % 5) * 10.3 + 1.23).alias("x0"), (F.floor(F.col("n_nationkey") / 5) * 9.7 + 0.73).alias("y0"))
    ring = F.array(*[F.struct((F.col("x0") + a).alias("x"), (F.col("y0") + b).alias("y")) for a, b in ((0.0, 0.0), (9.0, 0.0), (9.0, 11.0), (0.0, 11.0))])
    zones = n.select("zone", ring.alias("ring"))
    return grid.assign_zones(cells(spark, d).select("row", "col"), zones, "zone", "ring", 1.0, 10.0)


@query("""WITH s AS (SELECT value AS x0, CAST(user_id AS DOUBLE) AS y0, value + event_id % 5 AS x1, CAST(user_id + event_id % 3 AS DOUBLE) AS y1 FROM events),
n AS (SELECT *, CAST(greatest(1, ceil(greatest(abs(x1 - x0), abs(y1 - y0)) / 0.5)) AS INTEGER) AS n FROM s), k AS (SELECT *, unnest(range(0, n + 1)) AS k FROM n)
SELECT DISTINCT CAST(floor(y0 + (y1 - y0) * (k / CAST(n AS DOUBLE))) AS BIGINT) AS "row", CAST(floor(x0 + (x1 - x0) * (k / CAST(n AS DOUBLE))) AS BIGINT) AS col FROM k""")
def burned_lines(spark, d):
    e = table(spark, d, "events").select(F.col("value").alias("x0"), F.col("user_id").cast("double").alias("y0"), (F.col("value") + F.col("event_id") % 5).alias("x1"), (F.col("user_id") + F.col("event_id") % 3).cast("double").alias("y1"))
    return grid.burn_lines(e, 1.0)


@query(f"""WITH {CELLS}, g AS (SELECT n_nationkey * 2.03 AS x0, (n_nationkey * 7) % 50 + 0.01 AS y0, n_nationkey * 2.03 + n_nationkey % 4 AS x1, (n_nationkey * 7) % 50 + 0.01 + n_nationkey % 3 AS y1 FROM nation),
k AS (SELECT "row", col, col + 0.5 AS x, "row" + 0.5 AS y, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy FROM c, g), t AS (SELECT *, greatest(0, least(1, coalesce(((x - x0) * dx + (y - y0) * dy) / nullif(dx * dx + dy * dy, 0), 0))) AS t FROM k)
SELECT DISTINCT "row", col FROM t WHERE pow(x - x0 - t * dx, 2) + pow(y - y0 - t * dy, 2) <= 2.25""")
def line_buffer_mask(spark, d):
    n = F.col("n_nationkey")
    x0, y0 = (n * 2.03).cast("double"), ((n * 7) % 50 + 0.01).cast("double")
    g = table(spark, d, "nation").select(x0.alias("x0"), y0.alias("y0"), (x0 + n % 4).alias("x1"), (y0 + n % 3).alias("y1"))
    return grid.near_segments(cells(spark, d), g, 1.0, 1.5)


_ZONES = """z AS (SELECT n_nationkey AS id, n_nationkey % 5 * 10.0 AS x, n_nationkey // 5 * 10.0 AS y, CASE n_nationkey % 3 WHEN 0 THEN 'AE' WHEN 1 THEN 'X' ELSE 'D' END AS zone, CASE WHEN n_nationkey % 2 = 0 THEN '0.2 pct annual chance' END AS subtype FROM nation),
k AS (SELECT c.*, CASE WHEN zone = 'AE' THEN 2 WHEN zone = 'X' AND subtype IS NOT NULL THEN 1 END AS kind FROM c LEFT JOIN z ON c.col + 0.5 BETWEEN x AND x + 8 AND c."row" + 0.5 BETWEEN y AND y + 8)"""
_SHARES = """CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) END, 6) AS iou, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS hit_rate, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS "precision", round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) WHEN tp + fn > 0 AND tp + fp > 0 THEN NULL END, 6) AS f1"""


def _counts(p: str, r: str) -> str:
    return f"CAST(count_if(({p}) AND ({r})) AS DOUBLE) AS tp, CAST(count_if(({p}) AND NOT ({r})) AS DOUBLE) AS fp, CAST(count_if(NOT ({p}) AND ({r})) AS DOUBLE) AS fn, CAST(count_if(NOT ({p}) AND NOT ({r})) AS DOUBLE) AS tn"


@query(f"""WITH {CELLS}, {_ZONES}, m AS (SELECT 'sfha_1pct' AS mask, {_counts("value >= 60", "coalesce(kind, 0) = 2")} FROM k UNION ALL SELECT 'zone_x_0_2pct', {_counts("value >= 60", "coalesce(kind, 0) > 0")} FROM k)
SELECT mask, 'ok' AS status, 60.0::DOUBLE AS threshold, {_SHARES} FROM m""")
def zone_comparison(spark, d):
    """A surface against zones that are squares by nation."""
    n = table(spark, d, "nation")
    x, y = F.col("n_nationkey") % 5 * 10.0, F.floor(F.col("n_nationkey") / 5) * 10.0
    ring = F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0, 0), (8, 0), (8, 8), (0, 8))])
    third = F.col("n_nationkey") % 3
    zones = n.select(F.when(third == 0, "AE").when(third == 1, "X").otherwise("D").alias("zone"), F.when(F.col("n_nationkey") % 2 == 0, "0.2 pct annual chance").alias("subtype"), ring.alias("ring"))
    return rounded(comparisons.zone_comparison(cells(spark, d), "value", 60.0, zones, 1.0, 25.0, subtype="subtype"))


@query(f"""WITH {CELLS}, m AS (SELECT 'low' AS mask, {_counts("value >= 60", '"row" % 3 = 0')} FROM c UNION ALL SELECT 'major', {_counts("value >= 60", '"row" % 3 = 0 AND col % 2 = 0')} FROM c)
SELECT mask, 'ok' AS status, 60.0::DOUBLE AS threshold, {_SHARES} FROM m UNION ALL SELECT 'near', 'missing', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""")
def category_comparison(spark, d):
    c = cells(spark, d)
    low = c.where(F.col("row") % 3 == 0)
    return rounded(comparisons.category_comparison(c, "value", 60.0, {"low": low, "near": None, "major": low.where(F.col("col") % 2 == 0)}))


@query(f"""WITH RECURSIVE {CELLS}, i AS (SELECT "row" AS r, col AS k, value, -5.0 - ("row" * 5 + col * 3) % 17 AS a, -5.0 - ("row" * 5 + col * 3) % 17 - ("row" * 7 + col * 13 + ("row" * col) % 11) % 5 AS b FROM c WHERE col % 10 <> 9), f AS (SELECT r * 1000 + k AS id, r, k FROM i WHERE b - a < -2),
w(id, r, k) AS (SELECT id, r, k FROM f UNION SELECT w.id, f.r, f.k FROM w JOIN f ON abs(f.r - w.r) + abs(f.k - w.k) = 1), l AS (SELECT r, k, min(id) AS id FROM w GROUP BY ALL), n AS (SELECT id FROM l GROUP BY id HAVING count(*) >= 5),
m AS (SELECT i.*, l.id IS NOT NULL AND a >= -17 AS flooded FROM i LEFT JOIN (SELECT l.* FROM l SEMI JOIN n USING (id)) l USING (r, k)), t AS (SELECT 'radar_change' AS mask, {_counts("value >= 60", "flooded")} FROM m)
SELECT mask, 'ok' AS status, 60.0::DOUBLE AS threshold, {_SHARES} FROM t""")
def change_comparison(spark, d):
    """A surface against what two images tell, of which one lacks columns."""
    c = cells(spark, d)
    a = -5.0 - (F.col("row") * 5 + F.col("col") * 3) % 17
    before = c.select("row", "col", a.alias("value"))
    after = c.where("col % 10 <> 9").select("row", "col", (a - (F.col("row") * 7 + F.col("col") * 13 + (F.col("row") * F.col("col")) % 11) % 5).alias("value"))
    return rounded(comparisons.change_comparison(c, "value", 60.0, before, after))


@query(f"""WITH {CELLS} SELECT m AS model, CAST(count(*) AS BIGINT) AS cells, CAST(count(DISTINCT ("row" // 16, col // 16)) AS BIGINT) AS tiles, CAST(count(DISTINCT ("row" // 16, col // 16)) AS BIGINT) AS first_run, CAST(0 AS BIGINT) AS second_run, CAST(CASE WHEN m = 'presence_background' THEN count(DISTINCT ("row" // 16, col // 16)) ELSE 0 END AS BIGINT) AS after_refit, true AS agrees
FROM c, (VALUES ('presence_background'), ('boosted_leaf_wise')) x(m) GROUP BY m""")
def model_surfaces(spark, d):
    """A grid scored by two models; tiles scored again in a second run, and when one model was fitted anew; whether points and surface agree."""
    c = cells(spark, d).select("row", "col", "value", (F.col("row") * 3 % 50).alias("a"), (F.col("row") * 50 + F.col("col")).alias("id"), ((F.col("value") > 70) | (F.col("col") % 11 == 0)).cast("int").alias("y")).persist()
    path = f"{rounds.shared_dir(spark)}/surfaces-{uuid.uuid4().hex}"
    models = {"presence_background": fitting.fit_all(c, "y", {"f": fitting.Fit(("value", "a"))})["f"]}
    models |= {n: m for (_, n), m in trees.fit_trees(c, "y", ["value", "a"], "id", {"boosted_leaf_wise": trees.replace(trees.RECIPES["boosted_leaf_wise"], trees=50)}).items()}
    first, second = surfaces.score_surfaces(c, models, path, 16), surfaces.score_surfaces(c, models, path, 16)
    agrees = {r["model"]: r["agrees"] for r in surfaces.assert_agreement(c, "y", models, path).collect()}
    sizes = {n: surfaces.surface(spark, path, n, m).count() for n, m in models.items()}
    anew = models | {"presence_background": fitting.fit_all(c, "y", {"f": fitting.Fit(("value", "a"), beta=4.0, classes="L")})["f"]}
    third = surfaces.score_surfaces(c, anew, path, 16)
    return spark.createDataFrame([(n, sizes[n], first[n][1], first[n][0], second[n][0], third[n][0], agrees[n]) for n in models], "model string, cells long, tiles long, first_run long, second_run long, after_refit long, agrees boolean")
