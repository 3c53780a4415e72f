"""Screening statistics, corrected significance, spatial autocorrelation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import disclosures, running, stats, zonal
from ..operators.rounds import settled
from .registry import SCORES, query, rounded, scores, table

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]))
def pearson_pairs(spark, d):
    return rounded(stats.correlations(table(spark, d, "lineitem"), _NUM))


@query("""WITH r AS (SELECT corr(l_quantity, l_extendedprice) a, corr(l_quantity, l_discount) b, corr(l_extendedprice, l_discount) c FROM lineitem), m AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r)
SELECT 'l_quantity' AS predictor, round((1 - c * c) / det, 6) AS vif FROM m UNION ALL SELECT 'l_extendedprice', round((1 - b * b) / det, 6) FROM m UNION ALL SELECT 'l_discount', round((1 - a * a) / det, 6) FROM m""")
def variance_inflation(spark, d):
    names = _NUM[:3]
    vif = stats.variance_inflation(stats.correlation_matrix(table(spark, d, "lineitem"), names))
    return rounded(spark.createDataFrame([(n, float(v)) for n, v in zip(names, vif, strict=True)], "predictor string, vif double"))


@query("""SELECT * FROM (VALUES ('l_quantity', true, NULL), ('l_extendedprice', false, 'pearson'), ('l_discount', true, NULL), ('l_tax', true, NULL)) t(predictor, kept, stage) WHERE (SELECT abs(corr(l_quantity, l_extendedprice)) >= 0.8 FROM lineitem)
UNION ALL SELECT predictor, true, NULL FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax')) t(predictor) WHERE (SELECT abs(corr(l_quantity, l_extendedprice)) < 0.8 FROM lineitem)""")
def screening(spark, d):
    kept, dropped = stats.screen(table(spark, d, "lineitem"), _NUM, prefer={frozenset(("l_quantity", "l_extendedprice")): "l_extendedprice"})
    return spark.createDataFrame([(n, n in kept, dropped.get(n)) for n in _NUM], "predictor string, kept boolean, stage string")


@query("""WITH t AS (SELECT o_orderstatus a, o_orderpriority b, count(*) o FROM orders GROUP BY ALL), m AS (SELECT *, sum(o) OVER (PARTITION BY a) r, sum(o) OVER (PARTITION BY b) c FROM t),
s AS (SELECT sum(o) n, count(DISTINCT a) na, count(DISTINCT b) nb, sum(o * o / (CAST(r AS DOUBLE) * c)) s FROM m)
SELECT CAST(n AS BIGINT) AS n, CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, round(n * (s - 1), 6) AS chi2, round(sqrt(n * (s - 1) / (n * (least(na, nb) - 1))), 6) AS v FROM s""")
def cramers_v(spark, d):
    return rounded(stats.cramers_v(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"))


@query("""WITH b AS (SELECT l_returnflag a, greatest(0, len(list_filter(e, lambda x: x < l_quantity)) - 1) b FROM lineitem, (SELECT list_distinct(quantile_cont(l_quantity, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) e FROM lineitem)),
t AS (SELECT a, b, count(*) o FROM b GROUP BY ALL), m AS (SELECT *, sum(o) OVER (PARTITION BY a) r, sum(o) OVER (PARTITION BY b) c FROM t), s AS (SELECT sum(o) n, count(DISTINCT a) na, count(DISTINCT b) nb, sum(o * o / (CAST(r AS DOUBLE) * c)) s FROM m)
SELECT CAST(n AS BIGINT) AS n, CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, round(n * (s - 1), 5) AS chi2, round(sqrt((s - 1) / (least(na, nb) - 1)), 6) AS v FROM s""")
def cramers_v_binned(spark, d):
    from ..operators.sampling import bin_right, quantile_edges

    li = table(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    put = li.crossJoin(F.broadcast(quantile_edges(li, "l_quantity", 10))).select("l_returnflag", bin_right(F.col("edges"), F.col("l_quantity")).alias("bin"))
    return stats.cramers_v(put, "l_returnflag", "bin").select("n", "n_a", "n_b", F.round("chi2", 5).alias("chi2"), F.round("v", 6).alias("v"))


_LONG = """x AS (SELECT 'quantity' AS layer, l_quantity AS v, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS g FROM lineitem UNION ALL SELECT 'discount', l_discount, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END FROM lineitem UNION ALL SELECT 'tax', l_tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END FROM lineitem),
r AS (SELECT *, rank() OVER (PARTITION BY layer ORDER BY v) + (count(*) OVER (PARTITION BY layer, v) - 1) / 2.0 AS rk FROM x),
a AS (SELECT layer, CAST(sum(g) AS DOUBLE) n1, CAST(count(*) - sum(g) AS DOUBLE) n0, sum(CASE WHEN g = 1 THEN rk END) r1 FROM r GROUP BY layer),
t AS (SELECT layer, sum(pow(n, 3) - n) ties FROM (SELECT layer, v, count(*) n FROM x GROUP BY ALL) GROUP BY layer),
u AS (SELECT layer, n1, n0, r1 - n1 * (n1 + 1) / 2 AS u, ties FROM a JOIN t USING (layer))"""


@query(f"""WITH {_LONG} SELECT layer, CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, round(u, 3) AS u, round(2 * u / (n1 * n0) - 1, 6) AS r,
round(greatest(abs(u - n1 * n0 / 2) - 0.5, 0) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))), 6) AS z, CASE WHEN 2 * u / (n1 * n0) - 1 > 0 THEN 'higher' ELSE 'lower' END AS direction FROM u""")
def rank_biserial(spark, d):
    li = table(spark, d, "lineitem")
    layers = F.array(*[F.struct(F.lit(n).alias("layer"), F.col(c).alias("v")) for n, c in (("quantity", "l_quantity"), ("discount", "l_discount"), ("tax", "l_tax"))])
    long = li.select((F.col("l_returnflag") == "R").cast("int").alias("g"), F.inline(layers))
    return rounded(stats.mann_whitney(long, "v", "g", ["layer"]))


@query()
def bivariate_bonferroni(spark, d):
    p = stats.with_tails(rank_biserial(spark, d), "z", "z").withColumn("all", F.lit(1))
    return rounded(stats.adjusted_p(p, "p", ["all"], "layer").select("layer", "r", "z", "p", "p_bonferroni", (F.col("p_bonferroni") < 0.05).alias("significant")))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT CAST(count(*) AS BIGINT) AS n, round(corr(a, b), 6) AS rho FROM r""")
def spearman(spark, d):
    return rounded(stats.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


_P = "p AS (SELECT n_regionkey AS family, n_name AS test, (n_nationkey * 37 % 101 + 1) / 1000.0 AS p FROM nation)"


@query(f"""WITH {_P}, k AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, test) AS k FROM p)
SELECT family, test, round(CAST(p AS DOUBLE), 6) AS p, round(least(1.0, CAST(max((m - k + 1) * p) OVER (PARTITION BY family ORDER BY p, test ROWS UNBOUNDED PRECEDING) AS DOUBLE)), 6) AS p_holm,
round(least(1.0, min(CAST(p AS DOUBLE) * m / k) OVER (PARTITION BY family ORDER BY p, test ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_bh, round(least(1.0, CAST(p * m AS DOUBLE)), 6) AS p_bonferroni FROM k""")
def adjusted_p_values(spark, d):
    p = table(spark, d, "nation").select(F.col("n_regionkey").alias("family"), F.col("n_name").alias("test"), ((F.col("n_nationkey") * 37 % 101 + 1) / 1000.0).alias("p"))
    return rounded(stats.adjusted_p(p, "p", ["family"], "test"))


@query(f"""WITH {SCORES}, m AS (SELECT 'length' AS model, doc_id, y_true, y_score, 1500.0 AS t FROM s UNION ALL SELECT 'short', doc_id, y_true, -y_score, -4000.0 FROM s UNION ALL SELECT 'toxic', doc_id, y_true, 1.0 - toxic, 0.5 FROM s),
r AS (SELECT model, doc_id, CASE WHEN y_score >= t THEN 1 ELSE 0 END = y_true AS ok FROM m),
k AS (SELECT a.model AS model_a, b.model AS model_b, count_if(a.ok AND NOT b.ok) AS b, count_if(NOT a.ok AND b.ok) AS c FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.model < b.model GROUP BY ALL)
SELECT model_a, model_b, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, round(pow(abs(b - c) - 1, 2) / nullif(b + c, 0), 6) AS chi2 FROM k""")
def mcnemar_pairs(spark, d):
    s = scores(spark, d)
    models = F.array(
        F.struct(F.lit("length").alias("model"), F.col("y_score").alias("score"), F.lit(1500.0).alias("t")),
        F.struct(F.lit("short").alias("model"), (-F.col("y_score")).alias("score"), F.lit(-4000.0).alias("t")),
        F.struct(F.lit("toxic").alias("model"), (1.0 - F.col("toxic")).alias("score"), F.lit(0.5).alias("t")),
    )
    long = s.select("doc_id", "y_true", F.inline(models))
    return rounded(stats.mcnemar(long, "model", "doc_id", "y_true", "score", "t"))


_FOLDS = "f AS (SELECT l_shipmode AS model, 0 AS fold, 0.0 AS v FROM (SELECT NULL AS l_shipmode) WHERE false), g AS (SELECT o_orderpriority AS model, c_mktsegment AS fold, round(avg(o_totalprice), 0) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


@query(f"""WITH {_FOLDS}, r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY v DESC) + (count(*) OVER (PARTITION BY fold, v) - 1) / 2.0 AS rk FROM g) SELECT model, round(avg(rk), 6) AS mean_rank FROM r GROUP BY model""")
def mean_ranks(spark, d):
    return rounded(stats.friedman(_fold_values(spark, d), "fold", "model", "v")[0])


def _fold_values(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_orderpriority").alias("model"), F.col("c_mktsegment").alias("fold")).agg(F.round(F.avg("o_totalprice"), 0).alias("v"))


@query(f"""WITH {_FOLDS}, r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY v DESC) + (count(*) OVER (PARTITION BY fold, v) - 1) / 2.0 AS rk FROM g), t AS (SELECT model, sum(rk) AS total FROM r GROUP BY model),
q AS (SELECT CAST(count(DISTINCT fold) AS DOUBLE) AS n, CAST(count(DISTINCT model) AS DOUBLE) AS k FROM g), e AS (SELECT coalesce(sum(pow(c, 3) - c), 0) AS ties FROM (SELECT fold, v, count(*) AS c FROM g GROUP BY ALL))
SELECT CAST(n AS BIGINT) AS folds, CAST(k AS BIGINT) AS models, round((12.0 / (n * k * (k + 1)) * (SELECT sum(total * total) FROM t) - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))), 6) AS chi2 FROM q, e""")
def friedman_test(spark, d):
    return rounded(stats.friedman(_fold_values(spark, d), "fold", "model", "v")[1])


@query(f"""WITH {_FOLDS}, x AS (SELECT fold, max(CASE WHEN model LIKE '1%' THEN v END) - max(CASE WHEN model LIKE '5%' THEN v END) AS diff FROM g GROUP BY fold), s AS (SELECT count(diff) AS k, avg(diff) AS m, stddev_samp(diff) AS sd FROM x)
SELECT CAST(k AS BIGINT) AS k, round(m, 6) AS mean_diff, round(sd, 6) AS sd_diff, round(m / sqrt((1.0 / k + 27.0 / 250.0) * sd * sd), 6) AS t, round(m / sd, 6) AS cohens_d FROM s""")
def corrected_resampled_t(spark, d):
    g = _fold_values(spark, d)
    diff = g.groupBy("fold").agg((F.max(F.when(F.col("model").startswith("1"), F.col("v"))) - F.max(F.when(F.col("model").startswith("5"), F.col("v")))).alias("diff"))
    return rounded(stats.corrected_t(diff, "diff", 250.0, 27.0))


_PTS = "p AS (SELECT event_id AS id, value AS x, CAST(user_id AS DOUBLE) AS y, CAST(event_id % 17 AS DOUBLE) AS z FROM events)"


def _points(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), (F.col("event_id") % 17).cast("double").alias("z"))


@query(f"""WITH {_PTS} SELECT a.id AS i, b.id AS j, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS d FROM p a JOIN p b ON a.id <> b.id AND b.x BETWEEN a.x - 3 AND a.x + 3 AND b.y BETWEEN a.y - 3 AND a.y + 3 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 9
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.id) <= 8""")
def k_nearest(spark, d):
    return rounded(stats.neighbours(_points(spark, d), "id", "x", "y", 8, 3.0).select("i", "j", "d"))


@query("""WITH p AS (SELECT CAST(s_suppkey AS BIGINT) AS id, s_acctbal AS x, CAST(s_nationkey * 40 AS DOUBLE) AS y FROM supplier), n AS (SELECT a.id AS i, b.id AS j, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM p a JOIN p b ON a.id <> b.id)
SELECT i, j, round(d, 6) AS d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS n FROM n QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 8""")
def nearest_anywhere(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 40).cast("double").alias("y"))
    return rounded(stats.nearest(s, "id", "x", "y", 8, 200.0).withColumn("n", F.col("n").cast("long")))


@query(f"""WITH {_PTS}, n AS (SELECT a.id AS i, b.id AS j FROM p a JOIN p b ON a.id <> b.id AND b.x BETWEEN a.x - 3 AND a.x + 3 AND b.y BETWEEN a.y - 3 AND a.y + 3 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 9
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.id) <= 8), z AS (SELECT id, z - avg(z) OVER () AS z FROM p), l AS (SELECT i, avg(z) AS lag FROM n JOIN z ON j = id GROUP BY i)
SELECT CAST((SELECT count(*) FROM z) AS BIGINT) AS n, round((SELECT count(*) FROM z) * sum(z * lag) / (count(*) * (SELECT sum(z * z) FROM z)), 6) AS morans_i FROM z JOIN l ON id = i""")
def morans_i(spark, d):
    p = _points(spark, d)
    return rounded(stats.morans_i(p, stats.neighbours(p, "id", "x", "y", 8, 3.0), "id", "z"))


@query()
def morans_significance(spark, d):
    """Moran's I of eight neighbours and how often 999 permutations reach it, of values that follow their place, and of others."""
    p = _points(spark, d).withColumn("near", F.floor(F.col("x") / 8) + F.floor(F.col("y") / 8))
    links = settled(stats.neighbours(p, "id", "x", "y", 8, 3.0).select("i", "j"))
    parts = [stats.permutation_p(p, links, "id", c, near="y").select(F.lit(c).alias("value"), "n", "links", "morans_i", "expected", "p", "verdict") for c in ("z", "near")]
    return rounded(parts[0].unionByName(parts[1]))


@query(f"""WITH {_PTS}, z AS (SELECT *, z - avg(z) OVER () AS c FROM p), k AS (SELECT CAST(ceil(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 0.5) AS BIGINT) AS band, a.c * b.c AS m FROM z a JOIN z b ON a.id <> b.id AND b.x BETWEEN a.x - 3.1 AND a.x + 3.1 AND b.y BETWEEN a.y - 3.1 AND a.y + 3.1 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 3 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) > 0)
SELECT band, CAST(count(*) AS BIGINT) AS pairs, round(CASE WHEN count(*) >= 30 THEN avg(m) / (SELECT var_pop(z) FROM p) END, 6) AS morans_i FROM k GROUP BY band""")
def residual_correlogram(spark, d):
    return rounded(stats.correlogram(_points(spark, d), "id", "x", "y", "z", 0.5, 3.0))


@query(f"""WITH {_PTS}, t AS (SELECT id, x, y, id % 5 AS fold FROM p), n AS (SELECT a.id, a.fold, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM t a JOIN t b ON a.fold <> b.fold AND b.x BETWEEN a.x - 4 AND a.x + 4 AND b.y BETWEEN a.y - 4 AND a.y + 4 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 16 GROUP BY ALL)
SELECT fold, round(min(d), 6) AS nearest, round(median(d), 6) AS middle, round(max(d), 6) AS farthest, CAST(count_if(d > 0.5) AS BIGINT) AS beyond_buffer FROM n GROUP BY fold""")
def fold_geometry(spark, d):
    p = _points(spark, d).withColumn("fold", F.col("id") % 5)
    least = settled(stats.nearest_of_others(p, "x", "y", "fold", 4.0))
    middle = running.quantiles(least, "d", [0.5], ["fold"], rows="n").select("fold", F.get("quantiles", F.lit(0)).alias("middle"))
    ends = least.groupBy("fold").agg(F.min("d").alias("nearest"), F.max("d").alias("farthest"), F.sum(F.when(F.col("d") > 0.5, F.col("n")).otherwise(0)).alias("beyond_buffer"))
    return rounded(ends.join(middle, "fold").select("fold", "nearest", "middle", "farthest", "beyond_buffer"))


@query(f"""WITH {_PTS}, t AS (SELECT * FROM p WHERE id % 5 = 0), r AS (SELECT * FROM p WHERE id % 5 <> 0) SELECT r.id FROM r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.x BETWEEN r.x - 0.5 AND r.x + 0.5 AND t.y BETWEEN r.y - 0.5 AND r.y + 0.5 AND pow(t.x - r.x, 2) + pow(t.y - r.y, 2) <= 0.25)""")
def buffer_exclusion(spark, d):
    p = _points(spark, d)
    train, test = p.where("id % 5 <> 0"), p.where("id % 5 = 0")
    near = stats.pairs_within(stats.points(train, "id", "x", "y"), stats.points(test, "id", "x", "y"), 0.5).select(F.col("i").alias("id")).distinct()
    return train.select("id").join(near, "id", "left_anti")


@query("""WITH v AS (SELECT c_mktsegment AS model, n_name AS layer, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), r AS (SELECT layer, rank() OVER (PARTITION BY model ORDER BY v DESC) AS rk, greatest(v, 0) / sum(greatest(v, 0)) OVER (PARTITION BY model) AS share, v - min(v) OVER (PARTITION BY model) AS over FROM v)
SELECT layer, round(avg(rk), 6) AS mean_rank, round(avg(share), 6) AS mean_share, round(avg(over), 6) AS mean_over FROM r GROUP BY layer""".replace(" AS over ", " AS dlt ").replace("avg(over)", "avg(dlt)"))
def importance_comparison(spark, d):
    from pyspark.sql import Window

    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    v = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_mktsegment").alias("model"), F.col("n_name").alias("layer")).agg(F.avg("c_acctbal").alias("v"))
    w = Window.partitionBy("model")
    kept = F.greatest(F.coalesce("v", F.lit(0.0)), F.lit(0.0))
    r = v.select("layer", F.rank().over(w.orderBy(F.desc("v"))).alias("rk"), F.try_divide(kept, F.sum(kept).over(w)).alias("share"), (F.col("v") - F.min("v").over(w)).alias("dlt"))
    return rounded(r.groupBy("layer").agg(F.avg("rk").alias("mean_rank"), F.avg("share").alias("mean_share"), F.avg("dlt").alias("mean_over")))


@query("""WITH a AS (SELECT n_name AS layer, avg(c_acctbal) AS gain FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), b AS (SELECT n_name AS layer, avg(s_acctbal) AS boot FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT coalesce(a.layer, b.layer) AS layer, round(gain, 6) AS gain, round(boot, 6) AS boot, a.layer IS NOT NULL AND b.layer IS NOT NULL AS complete FROM a FULL JOIN b ON a.layer = b.layer""")
def importance_merge(spark, d):
    n = F.broadcast(table(spark, d, "nation"))
    a = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("layer")).agg(F.avg("c_acctbal").alias("gain"))
    b = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("layer")).agg(F.avg("s_acctbal").alias("boot"))
    return rounded(a.join(b, "layer", "full").select("layer", "gain", "boot", (F.col("gain").isNotNull() & F.col("boot").isNotNull()).alias("complete")))


@query("""WITH z AS (SELECT n_nationkey, n_regionkey, avg(c_acctbal) AS susc, count(*) AS n, avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
l AS (SELECT 'n' AS variable, susc, CAST(n AS DOUBLE) AS x FROM z UNION ALL SELECT 'share', susc, share FROM z UNION ALL SELECT 'region', susc, n_regionkey FROM z),
r AS (SELECT variable, rank() OVER (PARTITION BY variable ORDER BY susc) + (count(*) OVER (PARTITION BY variable, susc) - 1) / 2.0 AS a, rank() OVER (PARTITION BY variable ORDER BY x) + (count(*) OVER (PARTITION BY variable, x) - 1) / 2.0 AS b FROM l)
SELECT variable, CAST(count(*) AS BIGINT) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY variable""")
def rank_correlations(spark, d):
    return rounded(zonal.rank_correlations(_zones(spark, d), "susc", {"n": "size", "share": "market", "region": "place"}).select("variable", "n", "rho"))


def _zones(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", F.col("n_regionkey").alias("region")).agg(F.avg("c_acctbal").alias("susc"), F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("c_mktsegment") == "BUILDING", 1.0).otherwise(0.0)).alias("share"))


@query()
def corrected_correlations(spark, d):
    return rounded(zonal.corrected_correlations(_zones(spark, d), "susc", {"n": "a", "share": "a", "region": "b"}))


@query("""WITH s AS (SELECT count(c_acctbal) AS n FROM customer) SELECT i AS "index", c AS indicator, CAST(s.s AS INT) AS sign, CAST(CASE WHEN c = 'c_acctbal' THEN n ELSE 0 END AS BIGINT) AS known, c = 'c_acctbal' AS used, CASE c WHEN 'c_acctbal' THEN NULL WHEN 'none' THEN 'known for no row' ELSE 'not in the table' END AS reason
FROM s AS t(n), (VALUES ('wealth', 'c_acctbal', 1), ('wealth', 'c_income', 1), ('need', 'c_acctbal', -1), ('need', 'none', 1)) s(i, c, s)""")
def index_composition(spark, d):
    c = table(spark, d, "customer").withColumn("none", F.lit(None).cast("double"))
    return disclosures.index_composition(c, {"wealth": {"c_acctbal": 1, "c_income": 1}, "need": {"c_acctbal": -1, "none": 1}})


@query("""WITH z AS (SELECT c_nationkey, avg(CAST(c_mktsegment = 'BUILDING' AS INT)) AS building FROM customer GROUP BY ALL), n AS (SELECT count_if(building >= 0.2) AS flagged, count(building) AS known FROM z)
SELECT CAST(flagged AS BIGINT) AS flagged, CAST(known AS BIGINT) AS known, 0.2::DOUBLE AS threshold, concat(flagged, ' of ', known, ' zones have a share of building of at least 20%; their incomes and tenures say less about hardship. Nothing is corrected for it.') AS note FROM n""")
def confound_note(spark, d):
    z = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg((F.col("c_mktsegment") == "BUILDING").cast("int")).alias("building"))
    return disclosures.confound_note(z, "building", 0.2)


@query("""WITH s AS (SELECT count(*) AS replicates, avg(l_discount) AS mean, min(l_discount) AS least, max(l_discount) AS most FROM lineitem WHERE l_returnflag = 'R')
SELECT 'R' AS layer, CAST(replicates AS BIGINT) AS replicates, round(mean, 6) AS mean, least, most, concat('The outcome is partly a function of R by construction: mean coefficient ', format('{:.3f}', mean), ' over ', replicates, ' fits (', format('{:.3f}', least), ' to ', format('{:.3f}', most), '). A correlation with it is no independent evidence.') AS note FROM s""")
def coupling_note(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("feature"), F.col("l_discount").alias("lambda"))
    return rounded(disclosures.coupling_note(li, "R"))


@query("""WITH x AS (SELECT l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t FROM lineitem), r AS (SELECT 'd' AS a, 'p' AS b, corr(d, p) AS r FROM x UNION ALL SELECT 'd', 'q', corr(d, q) FROM x UNION ALL SELECT 'd', 't', corr(d, t) FROM x UNION ALL SELECT 'p', 'q', corr(p, q) FROM x UNION ALL SELECT 'p', 't', corr(p, t) FROM x UNION ALL SELECT 'q', 't', corr(q, t) FROM x),
b AS (SELECT a, b, r FROM r UNION ALL SELECT b, a, r FROM r), o AS (SELECT a AS layer, arg_min(b, (-abs(r), b)) AS partner, arg_min(r, (-abs(r), b)) AS r FROM b WHERE a IN ('p', 't') AND b NOT IN ('p', 't') GROUP BY a)
SELECT layer, CASE layer WHEN 'p' THEN 'pearson' ELSE 'vif' END AS stage, partner, round(r, 6) AS r, CASE layer WHEN 'p' THEN concat('pairwise correlation (r = ', format('{:.3f}', r), ' with ', partner, ', which is kept)') ELSE concat('variance inflation (r = ', format('{:.3f}', r), ' with ', partner, ', under the limit of pairs)') END AS reason FROM o""")
def screening_reasons(spark, d):
    names = {"d": "l_discount", "p": "l_extendedprice", "q": "l_quantity", "t": "l_tax"}
    x = table(spark, d, "lineitem").select(*[F.col(c).alias(n) for n, c in names.items()])
    dropped = spark.createDataFrame([("p", "pearson"), ("t", "vif")], "layer string, stage string")
    return rounded(disclosures.screening_reasons(dropped, stats.correlations(x, list(names))))
