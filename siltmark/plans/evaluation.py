"""Scores against labels; masks against masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.running import quantiles
from .registry import CELLS, SCORES, cells, query, rounded, scores, table

_RANKED = "r AS (SELECT *, rank() OVER (ORDER BY y_score) + (count(*) OVER (PARTITION BY y_score) - 1) / 2.0 AS rk FROM s)"


@query(f"""WITH {SCORES}, {_RANKED}
SELECT CAST(sum(y_true) AS BIGINT) AS n_pos, CAST(count(*) - sum(y_true) AS BIGINT) AS n_neg,
  round((sum(CASE WHEN y_true = 1 THEN rk END) - sum(y_true) * (sum(y_true) + 1) / 2.0) / (sum(y_true) * (count(*) - sum(y_true))), 6) AS auc FROM r""")
def auc_rank(spark, d):
    return rounded(metrics.auc(scores(spark, d)))


@query(f"""WITH {SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY y_score) + (count(*) OVER (PARTITION BY lang, y_score) - 1) / 2.0 AS rk FROM s)
SELECT lang, CAST(sum(y_true) AS BIGINT) AS n_pos, CAST(count(*) - sum(y_true) AS BIGINT) AS n_neg,
  round((sum(CASE WHEN y_true = 1 THEN rk END) - sum(y_true) * (sum(y_true) + 1) / 2.0) / nullif(sum(y_true) * (count(*) - sum(y_true)), 0), 6) AS auc FROM r GROUP BY lang""")
def auc_by_fold(spark, d):
    return rounded(metrics.auc(scores(spark, d), within=["lang"]))


_DERIVED = """CAST(tp AS BIGINT) tp, CAST(tn AS BIGINT) tn, CAST(fp AS BIGINT) fp, CAST(fn AS BIGINT) fn,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS sensitivity, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision",
  round(coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0) - 1, 6) AS tss,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round(coalesce(2 * (tp * tn - fp * fn) / nullif((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn), 0), 0), 6) AS kappa,
  round(coalesce(2 * (tp * tn - fp * fn) / nullif((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn), 0), 0), 6) AS hss,
  round((tp + fp) / (tp + tn + fp + fn), 6) AS pred_frac"""


def _counts(threshold: str, group: str = "", source: str = "s") -> str:
    return f"""SELECT {group} CAST(count_if(y_true = 1 AND y_score >= {threshold}) AS DOUBLE) tp, CAST(count_if(y_true = 0 AND y_score < {threshold}) AS DOUBLE) tn,
  CAST(count_if(y_true = 0 AND y_score >= {threshold}) AS DOUBLE) fp, CAST(count_if(y_true = 1 AND y_score < {threshold}) AS DOUBLE) fn FROM {source}"""


@query(f"WITH {SCORES}, k AS ({_counts('1500', 'lang,')} GROUP BY lang) SELECT lang, {_DERIVED} FROM k")
def threshold_metrics(spark, d):
    return rounded(metrics.threshold_metrics(scores(spark, d), 1500.0, within=["lang"]))


_ROC = """p AS (SELECT y_score AS t, count_if(y_true = 1) AS pos, count_if(y_true = 0) AS neg FROM s GROUP BY y_score),
q AS (SELECT t, sum(pos) OVER w / (SELECT CAST(sum(pos) AS DOUBLE) FROM p) - sum(neg) OVER w / (SELECT CAST(sum(neg) AS DOUBLE) FROM p) AS j FROM p WINDOW w AS (ORDER BY t DESC)),
best AS (SELECT t AS threshold, j FROM q ORDER BY round(j, 9) DESC, t DESC LIMIT 1)"""


@query(f"WITH {SCORES}, {_ROC} SELECT threshold, round(j, 6) AS tss FROM best")
def youden_threshold(spark, d):
    return rounded(metrics.youden_threshold(scores(spark, d)))


@query(f"""WITH {SCORES}, p AS (SELECT y_score AS t, count_if(y_true = 1) AS pos, count_if(y_true = 0) AS neg FROM s GROUP BY y_score)
SELECT t AS threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, CAST((SELECT sum(pos) FROM p) AS BIGINT) AS n_pos, CAST((SELECT sum(neg) FROM p) AS BIGINT) AS n_neg
FROM p WINDOW w AS (ORDER BY t DESC)""")
def roc_points(spark, d):
    return metrics.roc_points(scores(spark, d))


@query(f"""WITH {SCORES}, p AS (SELECT y_score AS t, count(*) AS n, sum(y_true) AS pos FROM s GROUP BY y_score),
q AS (SELECT pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM p WINDOW w AS (ORDER BY t DESC)),
a AS (SELECT sum(pos * cp / CAST(cn AS DOUBLE)) / sum(pos) AS ap FROM q),
b AS (SELECT avg(pow(y_score / 200000.0 - y_true, 2)) AS brier FROM s)
SELECT round(ap, 6) AS average_precision, round(brier, 6) AS brier FROM a, b""")
def imbalance_metrics(spark, d):
    s = scores(spark, d)
    loss = s.agg(metrics.brier(F.col("y_true"), F.col("y_score") / 200000.0).alias("brier"))
    return rounded(metrics.average_precision(s).crossJoin(loss))


@query(f"""WITH {SCORES}, t AS (SELECT CAST(k * 250 AS DOUBLE) AS t FROM range(0, 41) r(k))
SELECT t, round(count_if(y_true = 1 AND y_score >= t) / CAST(count_if(y_true = 1) AS DOUBLE), 6) AS success_rate, round(count_if(y_true = 0 AND y_score >= t) / CAST(count_if(y_true = 0) AS DOUBLE), 6) AS area_rate FROM s, t GROUP BY t""")
def success_prediction_rate(spark, d):
    t = spark.range(41).select((F.col("id") * 250).cast("double").alias("t"))
    return rounded(metrics.rates_at(scores(spark, d).withColumn("p", F.col("y_true") == 1), t, "y_score", "p"))


@query(f"""WITH {SCORES}, k AS (SELECT 1500.0 AS threshold UNION ALL SELECT 3000.0 UNION ALL SELECT 6000.0),
m AS (SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(count_if(y_true = 1 AND y_score >= threshold) AS DOUBLE) tp, CAST(count_if(y_true = 0 AND y_score < threshold) AS DOUBLE) tn,
  CAST(count_if(y_true = 0 AND y_score >= threshold) AS DOUBLE) fp, CAST(count_if(y_true = 1 AND y_score < threshold) AS DOUBLE) fn FROM s, k GROUP BY threshold)
SELECT threshold, {_DERIVED} FROM m""")
def threshold_sweep(spark, d):
    rows = scores(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (1500.0, 3000.0, 6000.0)])))
    return rounded(metrics.threshold_metrics(rows, F.col("threshold"), within=["threshold"]))


@query(f"""WITH {SCORES}, {_ROC}, th AS (SELECT 'maxss' AS label, threshold FROM best UNION ALL SELECT 'p10', quantile_cont(y_score, 0.1) FROM s WHERE y_true = 1),
m AS (SELECT label, threshold, CAST(count_if(y_true = 1 AND y_score >= threshold) AS DOUBLE) tp, CAST(count_if(y_true = 0 AND y_score < threshold) AS DOUBLE) tn,
  CAST(count_if(y_true = 0 AND y_score >= threshold) AS DOUBLE) fp, CAST(count_if(y_true = 1 AND y_score < threshold) AS DOUBLE) fn FROM s, th GROUP BY ALL)
SELECT label, round(threshold, 6) AS threshold, {_DERIVED} FROM m""")
def internal_validation_table(spark, d):
    s = scores(spark, d)
    best = metrics.youden_threshold(s).select(F.lit("maxss").alias("label"), "threshold")
    p10 = quantiles(s.where("y_true = 1"), "y_score", [0.1]).select(F.lit("p10").alias("label"), F.col("quantiles")[0].alias("threshold"))
    rows = s.crossJoin(F.broadcast(best.unionByName(p10)))
    return rounded(metrics.threshold_metrics(rows, F.col("threshold"), within=["label", "threshold"]))


@query(f"""WITH {CELLS}, m AS (SELECT (value > 0) AS p, ("row" % 3 = 0) AS r, (col % 7 <> 0) AS v FROM (SELECT "row", col, value - (SELECT avg(value) FROM c) AS value FROM c)),
k AS (SELECT CAST(count_if(p AND r) AS DOUBLE) tp, CAST(count_if(p AND NOT r) AS DOUBLE) fp, CAST(count_if(NOT p AND r) AS DOUBLE) fn, CAST(count_if(NOT p AND NOT r) AS DOUBLE) tn FROM m WHERE v)
SELECT CAST(tp AS BIGINT) tp, CAST(fp AS BIGINT) fp, CAST(fn AS BIGINT) fn, CAST(tn AS BIGINT) tn, round(tp / (tp + fp + fn), 6) AS iou, round(tp / (tp + fn), 6) AS hit_rate, round(tp / (tp + fp), 6) AS "precision", round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM k""")
def mask_overlap(spark, d):
    c = cells(spark, d)
    mean = F.broadcast(c.agg(F.avg("value").alias("mean")))
    m = c.crossJoin(mean).select((F.col("value") - F.col("mean") > 0).alias("p"), (F.col("row") % 3 == 0).alias("r"), (F.col("col") % 7 != 0).alias("v"))
    return rounded(metrics.overlap(m, "p", "r", "v"))


@query(f"""WITH {SCORES} SELECT round(count_if(y_score >= 3000 AND y_true = 0) / CAST(count_if(y_true = 0) AS DOUBLE), 6) AS area_fraction, CAST(count_if(y_score >= 3000 AND y_true = 1) AS BIGINT) AS hits, CAST(count_if(y_true = 1) AS BIGINT) AS points,
round(count_if(y_score >= 3000 AND y_true = 1) / CAST(count_if(y_true = 1) AS DOUBLE), 6) AS captured,
round((count_if(y_score >= 3000 AND y_true = 1) / CAST(count_if(y_true = 1) AS DOUBLE)) / (count_if(y_score >= 3000 AND y_true = 0) / CAST(count_if(y_true = 0) AS DOUBLE)), 6) AS capture_per_area FROM s""")
def capture_vs_area(spark, d):
    m = scores(spark, d).select((F.col("y_score") >= 3000).alias("m"), (F.col("y_true") == 1).alias("p"))
    return rounded(metrics.capture(m, "m", "p"))


@query("""WITH q AS (SELECT k, quantile_cont(l_extendedprice, 1 - (1 + k * 98.0 / 39) / 100.0) AS threshold FROM lineitem, range(0, 40) r(k) GROUP BY k)
SELECT CAST(k AS BIGINT) AS k, round(threshold, 4) AS threshold, round((SELECT count_if(l_extendedprice >= threshold) / CAST(count(*) AS DOUBLE) FROM lineitem), 6) AS area FROM q""".replace("quantile_cont(l_extendedprice, 1 - (1 + k * 98.0 / 39) / 100.0) AS threshold FROM lineitem, range(0, 40) r(k) GROUP BY k", "list_extract(qs, CAST(k AS INTEGER) + 1) AS threshold FROM (SELECT quantile_cont(l_extendedprice, [" + ", ".join(repr(1 - (1 + k * 98.0 / 39) / 100.0) for k in range(40)) + "]) AS qs FROM lineitem), range(0, 40) r(k)"))
def quantile_sweep(spark, d):
    li = table(spark, d, "lineitem").select("l_extendedprice")
    qs = [1 - (1 + k * 98.0 / 39) / 100.0 for k in range(40)]
    cuts = quantiles(li, "l_extendedprice", qs).select(F.posexplode("quantiles").alias("k", "t"))
    rates = metrics.rates_at(li.withColumn("p", F.lit(False)), cuts.select("t"), "l_extendedprice", "p")
    return cuts.join(rates, "t").select(F.col("k").cast("long").alias("k"), F.round("t", 4).alias("threshold"), F.round("area_rate", 6).alias("area"))


@query()
def bootstrap_auc(spark, d):
    from ..operators.stats import bootstrap_auc as bootstrap

    return rounded(bootstrap(scores(spark, d), "y_true", "y_score", ["lang"], replicates=200))
