"""Study protocols over the driver's tables: events are points, their kinds and users are layers and groups."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.projection import STATE_PLANE, STATE_PLANE_FEET, US_FOOT, UTM_14, _E2, A
from ..operators import comparisons, grid, protocols
from ..sources import shapes, surveys
from .association import _FOLDS, _fold_values
from .registry import CELLS, cells, query, rounded, table

_STUDY = "p AS (SELECT event_id AS key, value AS x, CAST(user_id AS DOUBLE) AS y, event_id % 3 AS fold, event_type AS kind, CAST(event_id % 9 = 0 OR (event_id % 17 > 13 AND value > 20) AS INT) AS presence, event_id % 17 AS a, user_id % 23 AS b FROM events)"
_LAYERS = ["a", "b", "x"]
_FEET, _METRES = grid.Frame(1300000.0, 100000.0, 1000.0, STATE_PLANE_FEET), grid.Frame(581000.0, 4271500.0, 500.0)


def _study(spark, d):
    e = table(spark, d, "events")
    presence = ((F.col("event_id") % 9 == 0) | ((F.col("event_id") % 17 > 13) & (F.col("value") > 20))).cast("int")
    return e.select(
        F.col("event_id").alias("key"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), (F.col("event_id") % 3).alias("fold"),
        F.col("event_type").alias("kind"), presence.alias("presence"), (F.col("event_id") % 17).alias("a"), (F.col("user_id") % 23).alias("b"),
    )


def _halves(rows):
    return rows.where("key % 10 < 7"), rows.where("key % 10 >= 7")


def _projection_sql() -> str:
    n, f, r0 = STATE_PLANE.constants
    e2, e4, e6, e8, ep = _E2, _E2**2, _E2**3, _E2**4, _E2 / (1 - _E2)
    lat = f"chi + {e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360} * sin(2 * chi) + {7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520} * sin(4 * chi) + {7 * e6 / 120 + 81 * e8 / 1120} * sin(6 * chi) + {4279 * e8 / 161280:.20f} * sin(8 * chi)"
    arc = f"{A} * ({1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256} * lat - {3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024} * sin(2 * lat) + {15 * e4 / 256 + 45 * e6 / 1024} * sin(4 * lat) - {35 * e6 / 3072} * sin(6 * lat))"
    x = "aa + (1 - t + c) * pow(aa, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * pow(aa, 5) / 120"
    y = "pow(aa, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * pow(aa, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * pow(aa, 6) / 720"
    return f"""WITH q AS (SELECT event_id AS key, CAST(1300000 + value * 1000 AS DOUBLE) * CAST({US_FOOT!r} AS DOUBLE) - {STATE_PLANE.x0} AS dx, {r0!r}::DOUBLE - CAST(user_id * 500 AS DOUBLE) * {US_FOOT!r}::DOUBLE AS dy FROM events),
g AS (SELECT key, pi() / 2 - 2 * atan(pow(sqrt(dx * dx + dy * dy) / {f!r}::DOUBLE, {1 / n!r}::DOUBLE)) AS chi, atan2(dx, dy) / {n!r}::DOUBLE + radians({STATE_PLANE.longitude}) AS lon FROM q), l AS (SELECT key, lon, {lat} AS lat FROM g),
m AS (SELECT key, lat, {A} / sqrt(1 - {e2!r}::DOUBLE * sin(lat) * sin(lat)) AS nn, pow(tan(lat), 2) AS t, {ep!r}::DOUBLE * cos(lat) * cos(lat) AS c, (lon - radians({UTM_14.longitude})) * cos(lat) AS aa, {ep!r}::DOUBLE AS ep, {arc} AS arc FROM l)
SELECT key, round({UTM_14.scale} * nn * ({x}) + {UTM_14.x0}, 3) AS x, round({UTM_14.scale} * (arc + nn * tan(lat) * ({y})) + {UTM_14.y0}, 3) AS y FROM m"""


def _shapes_sql() -> str:
    """The same change of coordinates, of suppliers."""
    return _projection_sql().replace("event_id AS key", "CAST(s_suppkey AS BIGINT) AS key").replace("value * 1000", "s_acctbal * 10").replace("user_id * 500", "s_nationkey * 20000").replace("FROM events", "FROM supplier")


@query(_shapes_sql())
def point_shapes(spark, d):
    """Suppliers as point shapefiles, one for each nation, read back by index and brought to the grid."""
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", (1300000 + F.col("s_acctbal") * 10).alias("x"), (F.col("s_nationkey") * 20000).alias("y"))
    found = shapes.read_points(shapes.packed(s, "s_nationkey", "s_suppkey", "x", "y"), "all", STATE_PLANE_FEET)
    return found.select(F.col("attributes")["ID"].cast("long").alias("key"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def _combined_sql() -> str:
    shape, text = _shapes_sql(), _projection_sql()
    return f"""SELECT 'file_level_HW' AS provenance, CAST(count(*) AS BIGINT) AS n, round(avg(x), 3) AS x, round(avg(y), 3) AS y FROM ({shape}) UNION ALL SELECT CASE WHEN key % 3 = 0 THEN 'point_level_EOW' ELSE 'point_level_HW' END, CAST(count(*) AS BIGINT), round(avg(x), 3), round(avg(y), 3) FROM ({text}) WHERE y < 4290000 GROUP BY ALL"""


@query(_combined_sql())
def combined_points(spark, d):
    """Marks of text logs and of point files in one table, by provenance."""
    e = table(spark, d, "events").select(F.col("event_id"), (1300000 + F.col("value") * 1000).alias("easting_ft"), (F.col("user_id") * 500).alias("northing_ft"))
    text = protocols.survey_points(e).where("y < 4290000").select(F.col("event_id").cast("string").alias("pt_id"), "northing_ft", "easting_ft", F.lit(None).cast("double").alias("elevation_ft"), F.lit("HW").alias("description"), F.when(F.col("event_id") % 3 == 0, "EOW").otherwise("HW").alias("type"), F.lit("e").alias("event"), F.lit("f").alias("source_file"), "x", "y")
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", (1300000 + F.col("s_acctbal") * 10).alias("x"), (F.col("s_nationkey") * 20000).alias("y"))
    files = shapes.read_points(shapes.packed(s, "s_nationkey", "s_suppkey", "x", "y"), "all", STATE_PLANE_FEET)
    both = surveys.combined_points(text, files).withColumns({"x": F.round("x", 3), "y": F.round("y", 3)})
    return rounded(both.groupBy("provenance").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")), 3)


@query()
def dated_sources(spark, d):
    """A model of the distance to the nearest source, with all sources and with those dated early enough."""
    c = cells(spark, d)
    rows = c.select("row", "col", ((F.col("value") > 75) | (F.col("col") % 9 == 4) & (F.col("row") % 4 < 3)).cast("int").alias("y"), (F.col("row") % 3 == 0).alias("is_test"))
    sources = table(spark, d, "events").where("value > 40").select((F.col("user_id") % 50).alias("row"), (F.floor(F.col("event_id") / 9) * 9 % 50).cast("long").alias("col"), (1990 + F.col("event_id") % 40).alias("built"))
    return rounded(comparisons.dated_sources_check(c, rows, sources, "built", 2007, "y", "is_test"))


def _warp_sql() -> str:
    n, f, r0 = STATE_PLANE.constants
    e2, e4, e6, ep = _E2, _E2**2, _E2**3, _E2 / (1 - _E2)
    e, root = math.sqrt(_E2), math.sqrt(1 - _E2)
    g = (1 - root) / (1 + root)
    num = lambda v: f"{v!r}::DOUBLE"
    foot = f"mu + {num(3 * g / 2 - 27 * g**3 / 32)} * sin(2 * mu) + {num(21 * g**2 / 16 - 55 * g**4 / 32)} * sin(4 * mu) + {num(151 * g**3 / 96)} * sin(6 * mu) + {num(1097 * g**4 / 512)} * sin(8 * mu)"
    up = f"d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - {num(9 * ep)}) * pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - {num(252 * ep)} - 3 * c * c) * pow(d, 6) / 720"
    along = f"d - (1 + 2 * t + c) * pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + {num(8 * ep)} + 24 * t * t) * pow(d, 5) / 120"
    return f"""WITH {CELLS}, t0 AS (SELECT r, k, (k + 0.5) * 500 + 581000 AS x, (r + 0.5) * 500 + 4271500 AS y FROM range(0, 40) a(r), range(0, 40) b(k)),
t1 AS (SELECT *, CAST(y AS DOUBLE) / {UTM_14.scale} / {num(A * (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256))} AS mu FROM t0), t2 AS (SELECT *, {foot} AS foot FROM t1),
t3 AS (SELECT *, 1 - {num(e2)} * sin(foot) * sin(foot) AS w, pow(tan(foot), 2) AS t, {num(ep)} * cos(foot) * cos(foot) AS c FROM t2), t4 AS (SELECT *, {A} / sqrt(w) AS nn, {num(A * (1 - e2))} / (w * sqrt(w)) AS rr FROM t3),
t5 AS (SELECT *, (CAST(x AS DOUBLE) - {UTM_14.x0}) / (nn * {UTM_14.scale}) AS d FROM t4), t6 AS (SELECT r, k, foot - nn * tan(foot) / rr * ({up}) AS lat, radians({UTM_14.longitude}) + ({along}) / cos(foot) AS lon FROM t5),
t7 AS (SELECT *, {num(f)} * pow(tan(pi() / 4 - lat / 2) / pow((1 - {num(e)} * sin(lat)) / (1 + {num(e)} * sin(lat)), {num(e / 2)}), {num(n)}) AS rho, {num(n)} * (lon - radians({STATE_PLANE.longitude})) AS th FROM t6),
t8 AS (SELECT r, k, (({STATE_PLANE.x0} + rho * sin(th)) / {num(US_FOOT)} - 1300000) / 1000 - 0.5 AS fx, (({num(r0)} - rho * cos(th)) / {num(US_FOOT)} - 100000) / 1000 - 0.5 AS fy FROM t7)"""


@query(_warp_sql() + """ SELECT r AS "row", k AS col, round(sum((1 - abs(c."row" - fy)) * (1 - abs(c.col - fx)) * value) / sum((1 - abs(c."row" - fy)) * (1 - abs(c.col - fx))), 5) AS value FROM t8 JOIN c ON c."row" BETWEEN floor(fy) AND floor(fy) + 1 AND c.col BETWEEN floor(fx) AND floor(fx) + 1 GROUP BY ALL""")
def reprojected_bilinear(spark, d):
    """A grid in feet of the state plane on the cells of another in metres of the transverse Mercator zone."""
    return rounded(grid.warp(cells(spark, d), _FEET, grid.frame_cells(spark, (0, 40), (0, 40)), _METRES), 5)


@query(_warp_sql() + """ SELECT r AS "row", k AS col, value FROM t8 JOIN c ON c."row" = CAST(floor(fy + 0.5) AS BIGINT) AND c.col = CAST(floor(fx + 0.5) AS BIGINT)""")
def reprojected_nearest(spark, d):
    return grid.warp(cells(spark, d), _FEET, grid.frame_cells(spark, (0, 40), (0, 40)), _METRES, method="nearest")


@query(_projection_sql())
def projected_points(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("key"), (1300000 + F.col("value") * 1000).alias("easting_ft"), (F.col("user_id") * 500).alias("northing_ft"))
    return protocols.survey_points(e).select("key", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"""WITH {_STUDY}, b AS (SELECT unnest([0.0, 0.5, 1.0, 2.0])::DOUBLE AS buffer), n AS (SELECT fold, count(*) AS n FROM p GROUP BY fold),
g AS (SELECT b.buffer, t.fold, count(DISTINCT r.key) AS gone FROM p t JOIN p r ON t.presence = 1 AND r.fold <> t.fold AND r.x BETWEEN t.x - 2.1 AND t.x + 2.1 AND r.y BETWEEN t.y - 2.1 AND t.y + 2.1 JOIN b ON b.buffer > 0 AND (r.x - t.x) * (r.x - t.x) + (r.y - t.y) * (r.y - t.y) <= b.buffer * b.buffer GROUP BY ALL)
SELECT b.buffer, n.fold, CAST(n.n AS BIGINT) AS n_test, CAST((SELECT count(*) FROM p) - n.n - coalesce(g.gone, 0) AS BIGINT) AS n_train FROM b CROSS JOIN n LEFT JOIN g ON g.buffer = b.buffer AND g.fold = n.fold""")
def buffered_sizes(spark, d):
    return protocols.buffered_sizes(_study(spark, d), "fold", "key", "x", "y", "presence", (0.0, 0.5, 1.0, 2.0))


@query()
def buffered_folds(spark, d):
    return rounded(protocols.buffered_folds(_study(spark, d), "fold", "key", "x", "y", "presence", _LAYERS, (0.0, 0.5, 1.0, 2.0)))


@query()
def nested_tuning(spark, d):
    """The whole grid of 15 settings within each of three folds, in shared scans."""
    return rounded(protocols.nested_tuning(_study(spark, d), "fold", "key", "presence", _LAYERS))


@query()
def conditional_importance(spark, d):
    return rounded(protocols.conditional_importance(*_halves(_study(spark, d)), "presence", _LAYERS, "a", ["x"]))


@query(f"""WITH {_STUDY}, l AS (SELECT presence, 'b' AS confounder, a AS x, b AS y FROM p UNION ALL SELECT presence, 'x', a, x FROM p),
r AS (SELECT presence, confounder, rank() OVER (PARTITION BY presence, confounder ORDER BY x) + (count(*) OVER (PARTITION BY presence, confounder, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY presence, confounder ORDER BY y) + (count(*) OVER (PARTITION BY presence, confounder, y) - 1) / 2.0 AS ry FROM l)
SELECT presence, confounder, CAST(count(*) AS BIGINT) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY ALL""")
def confounder_ranks(spark, d):
    return rounded(protocols.confounder_ranks(_study(spark, d), "presence", "a", ["b", "x"]).select("presence", "confounder", "n", "rho"))


@query()
def single_predictors(spark, d):
    return rounded(protocols.single_predictors(*_halves(_study(spark, d)), "presence", _LAYERS, {"a+x": ["a", "x"]}))


@query()
def stratum_refit(spark, d):
    return rounded(protocols.stratum_refit("outside", *_halves(_study(spark, d)), F.col("b") > 5, "presence", _LAYERS))


@query()
def pooled_groups_arm(spark, d):
    return rounded(protocols.pooled_groups_arm(_study(spark, d), "kind", "presence", _LAYERS, 4))


@query()
def matched_refit(spark, d):
    return rounded(protocols.matched_refit(*_halves(_study(spark, d)), "presence", _LAYERS, "x", "key", 2000))


@query()
def matched_importances(spark, d):
    return rounded(protocols.matched_importances(*_halves(_study(spark, d)), "presence", _LAYERS, "x", "key", 2000))


@query()
def coarse_arm(spark, d):
    rows = _study(spark, d).withColumns({"r": F.col("key") % 331, "c": F.col("key") % 13})
    return rounded(protocols.coarse_arm(rows, "r", "c", 2, "presence", ["x", "y"], "key"))


@query(f"""WITH {_STUDY} SELECT CAST(floor(a / 3.0) AS BIGINT) AS a, CAST(floor(b / 3.0) AS BIGINT) AS b, max(presence) AS presence, round(avg(x), 6) AS x FROM p GROUP BY 1, 2""")
def coarse_rows(spark, d):
    return rounded(protocols.coarse_rows(_study(spark, d), "a", "b", 3, "presence", ["x"]))


@query()
def models_by_fold(spark, d):
    """All six models without each of three folds."""
    return rounded(protocols.models_by_fold(_study(spark, d), "fold", "key", "presence", _LAYERS))


@query(f"""WITH {_FOLDS}, x AS (SELECT fold, max(CASE WHEN model = '1-URGENT' THEN v END) - max(CASE WHEN model = '5-LOW' THEN v END) AS diff FROM g GROUP BY fold), s AS (SELECT count(diff) AS k, avg(diff) AS m, stddev_samp(diff) AS sd FROM x WHERE diff IS NOT NULL),
t AS (SELECT *, m / sqrt((1.0 / k + 27.0 / 250.0) * sd * sd) AS t FROM s), p AS (SELECT *, 1 - 2 * (3.0 / 8) * (abs(t) / sqrt(1 + t * t / 4)) * (1 - (t * t / (1 + t * t / 4)) / 12) AS p FROM t)
SELECT CAST(k AS BIGINT) AS k, round(m, 6) AS mean_diff, round(sd, 6) AS sd_diff, round(m / sd, 6) AS cohens_d, round(t, 6) AS t, round(p, 6) AS p, round(m - 2.7764451051977987 * sd / sqrt(k), 4) AS low, round(m + 2.7764451051977987 * sd / sqrt(k), 4) AS high, CASE WHEN p < 0.05 THEN 'real_difference' ELSE 'within_noise' END AS verdict FROM p""")
def paired_significance(spark, d):
    out = protocols.paired_significance(_fold_values(spark, d), "fold", "model", "v", "1-URGENT", "5-LOW", 250.0, 27.0)
    return rounded(out).withColumns({c: F.round(c, 4) for c in ("low", "high")})


@query(f"""WITH {_FOLDS}, r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY v DESC) + (count(*) OVER (PARTITION BY fold, v) - 1) / 2.0 AS rk FROM g), s AS (SELECT model, sum(rk) AS total FROM r GROUP BY model),
q AS (SELECT CAST(count(DISTINCT fold) AS DOUBLE) AS n, CAST(count(DISTINCT model) AS DOUBLE) AS k FROM g), e AS (SELECT coalesce(sum(pow(c, 3) - c), 0) AS ties FROM (SELECT fold, v, count(*) AS c FROM g GROUP BY ALL)),
chi AS (SELECT (12.0 / (n * k * (k + 1)) * (SELECT sum(total * total) FROM s) - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS chi2 FROM q, e),
x AS (SELECT a.model AS a, b.model AS b, a.v - b.v AS diff FROM g a JOIN g b ON a.fold = b.fold AND a.model < b.model), m AS (SELECT a, b, count(*) AS k, avg(diff) AS mean_diff, stddev_samp(diff) AS sd FROM x GROUP BY ALL),
t AS (SELECT *, mean_diff / sqrt((1.0 / k + 27.0 / 250.0) * sd * sd) AS t FROM m),
p AS (SELECT *, 1 - 2 * (3.0 / 8) * (abs(t) / sqrt(1 + t * t / 4)) * (1 - (t * t / (1 + t * t / 4)) / 12) AS p FROM t), h AS (SELECT *, (10 - row_number() OVER (ORDER BY p, a, b) + 1) * p AS up FROM p)
SELECT a, b, CAST(k AS BIGINT) AS k, round(mean_diff, 6) AS mean_diff, round(t, 6) AS t, round(p, 6) AS p, round(least(1, max(up) OVER (ORDER BY p, a, b)), 6) AS p_holm, round(chi2, 6) AS chi2, round(exp(-chi2 / 2) * (1 + chi2 / 2), 6) AS p_chi2 FROM h, chi""")
def omnibus_comparison(spark, d):
    return rounded(protocols.omnibus(_fold_values(spark, d), "fold", "model", "v", 250.0, 27.0))


def _association_sql() -> str:
    tables = {("l_linestatus", "l_returnflag"): "l_returnflag", ("l_returnflag", "l_linestatus"): "l_linestatus"}
    edges = "(SELECT list_distinct(quantile_cont(l_quantity, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) e FROM lineitem)"
    for a in ("l_linestatus", "l_returnflag"):
        tables[a, "l_quantity"] = "greatest(0, len(list_filter(e, lambda x: x < l_quantity)) - 1)"
    parts = []
    for (a, b), of in tables.items():
        parts.append(f"""SELECT '{a}' AS a, '{b}' AS b, CAST(n AS BIGINT) AS n, round(n * (s - 1), 5) AS chi2, round(sqrt((s - 1) / (least(na, nb) - 1)), 6) AS v FROM (SELECT sum(o) n, count(DISTINCT a) na, count(DISTINCT b) nb, sum(o * o / (CAST(r AS DOUBLE) * c)) s FROM (SELECT *, sum(o) OVER (PARTITION BY a) r, sum(o) OVER (PARTITION BY b) c FROM (SELECT a, b, count(*) o FROM (SELECT {a} AS a, {of} AS b FROM lineitem, {edges}) GROUP BY ALL)))""")
    return " UNION ALL ".join(parts)


@query(_association_sql())
def association_report(spark, d):
    out = protocols.association_report(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"])
    return out.select("a", "b", "n", F.round("chi2", 5).alias("chi2"), F.round("v", 6).alias("v"))


@query("SELECT 'l_tax' AS name, CAST(count(l_tax) AS BIGINT) AS n, round(avg(l_tax), 6) AS mean, round(stddev_samp(l_tax), 6) AS sd, min(l_tax) AS least, max(l_tax) AS most FROM lineitem UNION ALL SELECT 'l_quantity', count(l_quantity), round(avg(l_quantity), 6), round(stddev_samp(l_quantity), 6), min(l_quantity), max(l_quantity) FROM lineitem")
def replicate_summary(spark, d):
    return rounded(protocols.over_replicates(table(spark, d, "lineitem"), ["l_tax", "l_quantity"]))


@query("""WITH z AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'AE' WHEN 1 THEN 'X' WHEN 2 THEN 'A99' ELSE 'D' END AS zone, CASE WHEN p_partkey % 3 = 0 THEN '0.2 pct annual' WHEN p_partkey % 3 = 1 THEN p_type END AS subtype FROM part)
SELECT p_partkey, CASE WHEN zone IN ('AE', 'A99') THEN 'sfha' WHEN zone = 'X' AND coalesce(contains(upper(subtype), '0.2 PCT'), false) THEN 'shaded_x' END AS zone FROM z""")
def flood_zones(spark, d):
    p = table(spark, d, "part")
    size, third = F.col("p_size") % 4, F.col("p_partkey") % 3
    zone = F.when(size == 0, "AE").when(size == 1, "X").when(size == 2, "A99").otherwise("D")
    return p.select("p_partkey", protocols.flood_zone(zone, F.when(third == 0, "0.2 pct annual").when(third == 1, F.col("p_type"))).alias("zone"))


@query(f"""WITH {CELLS}, t AS (SELECT 'low' AS label, 10.0::DOUBLE AS threshold UNION ALL SELECT 'high', 60.0), k AS (SELECT label, threshold, CAST(count_if(value >= threshold AND "row" % 3 = 0) AS DOUBLE) tp, CAST(count_if(value >= threshold AND "row" % 3 <> 0) AS DOUBLE) fp, CAST(count_if(value < threshold AND "row" % 3 = 0) AS DOUBLE) fn, CAST(count_if(value < threshold AND "row" % 3 <> 0) AS DOUBLE) tn FROM c, t GROUP BY ALL)
SELECT label, threshold, CAST(tp AS BIGINT) tp, CAST(fp AS BIGINT) fp, CAST(fn AS BIGINT) fn, CAST(tn AS BIGINT) tn, round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) END, 6) AS iou, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS hit_rate, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS "precision", round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM k""")
def overlap_sweep(spark, d):
    c = cells(spark, d).withColumn("reference", F.col("row") % 3 == 0)
    return rounded(protocols.overlap_sweep(c, "value", "reference", {"low": 10.0, "high": 60.0}))


@query("""WITH s AS (SELECT c_nationkey AS zone, CASE WHEN count(*) >= 50 THEN avg(c_acctbal) END AS m FROM customer GROUP BY ALL), u AS (SELECT s_nationkey AS zone, CASE WHEN count(*) >= 50 THEN avg(s_acctbal) END AS m FROM supplier GROUP BY ALL)
SELECT n_nationkey AS zone, n_name AS name, round(s.m, 6) AS susc_mean, round(u.m, 6) AS density_mean, r_name FROM nation LEFT JOIN s ON s.zone = n_nationkey LEFT JOIN u ON u.zone = n_nationkey LEFT JOIN (SELECT n_nationkey AS z, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) r ON r.z = n_nationkey WHERE s.m IS NOT NULL""")
def zone_table(spark, d):
    n = table(spark, d, "nation")
    rasters = {"susc": table(spark, d, "customer").select(F.col("c_nationkey").alias("zone"), F.col("c_acctbal").alias("value")), "density": table(spark, d, "supplier").select(F.col("s_nationkey").alias("zone"), F.col("s_acctbal").alias("value"))}
    attributes = n.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("zone"), "r_name")
    return rounded(protocols.zone_table(n.select(F.col("n_nationkey").alias("zone"), F.col("n_name").alias("name")), rasters, "zone", attributes, "susc_mean"))


@query("""SELECT n_name AS predictor, n_regionkey AS source, round(e.effect, 6) AS effect, CASE WHEN n_regionkey = 0 THEN 'kept' WHEN n_regionkey = 1 THEN 'dropped: vif' WHEN n_regionkey = 2 THEN 'dropped: screening' ELSE 'not screened' END AS status
FROM nation LEFT JOIN (SELECT c_nationkey, avg(c_acctbal) AS effect FROM customer GROUP BY ALL) e ON c_nationkey = n_nationkey""")
def predictor_table(spark, d):
    n = table(spark, d, "nation")
    mean = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("effect"))
    effects = n.join(mean, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("predictor"), "effect")
    region = F.col("n_regionkey")
    screened = n.where(region < 3).select(F.col("n_name").alias("predictor"), (region == 0).alias("kept"), F.when(region == 1, "vif").alias("stage"))
    return rounded(protocols.predictor_table(n.select(F.col("n_name").alias("predictor"), region.alias("source")), effects, screened))


@query()
def encoding_comparison(spark, d):
    """A forest and boosted trees, depth-wise and leaf-wise, with category codes as numbers and as columns."""
    return rounded(protocols.encoding_comparison(_study(spark, d).withColumn("is_test", F.col("key") % 10 >= 7), "key", "presence", ["x"], ["a"], "is_test"))
