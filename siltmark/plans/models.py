"""Model scoring and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arms, fitting, metrics, model, protocols, trees
from ..operators.sampling import holdout_split
from .registry import query, rounded, table
from .sampling import draw_sql

_MODEL = model.Additive(linear={"l_quantity": (1.5, 1.0, 50.0), "l_tax": (-0.5, 0.0, 0.08)}, quadratic={"l_quantity": (-0.75, 1.0, 2500.0)}, categorical={"l_linenumber": {1.0: 0.25, 3.0: -0.5}})
_LAYERS = ["l_quantity", "l_tax", "l_linenumber", "l_discount"]
_C = """c AS (SELECT l_orderkey, l_linenumber, 1.5 * least(greatest((l_quantity - 1) / 49, 0), 1) - 0.75 * least(greatest((l_quantity * l_quantity - 1) / 2499, 0), 1) AS a, -0.5 * least(greatest(l_tax / 0.08, 0), 1) AS b, CASE l_linenumber WHEN 1 THEN 0.25 WHEN 3 THEN -0.5 ELSE 0.0 END AS e FROM lineitem)"""


@query(f"WITH {_C} SELECT l_orderkey, l_linenumber, round(CAST(a - avg(a) OVER () AS DOUBLE), 6) AS phi_l_quantity, round(CAST(b - avg(b) OVER () AS DOUBLE), 6) AS phi_l_tax, round(CAST(e - avg(e) OVER () AS DOUBLE), 6) AS phi_l_linenumber, 0.0::DOUBLE AS phi_l_discount FROM c")
def exact_attributions(spark, d):
    out = model.attributions(table(spark, d, "lineitem"), _MODEL, _LAYERS)
    return rounded(out.select("l_orderkey", "l_linenumber", *[f"phi_{c}" for c in _LAYERS]))


@query(f"""WITH {_C}, m AS (SELECT avg(abs(a - ma)) AS a, avg(abs(b - mb)) AS b, avg(abs(e - me)) AS e FROM (SELECT a, b, e, avg(a) OVER () ma, avg(b) OVER () mb, avg(e) OVER () me FROM c))
SELECT 'l_quantity' AS layer, round(CAST(a AS DOUBLE), 6) AS mean_abs, round(CAST(a / (a + b + e) AS DOUBLE), 6) AS share FROM m UNION ALL SELECT 'l_tax', round(CAST(b AS DOUBLE), 6), round(CAST(b / (a + b + e) AS DOUBLE), 6) FROM m UNION ALL SELECT 'l_linenumber', round(CAST(e AS DOUBLE), 6), round(CAST(e / (a + b + e) AS DOUBLE), 6) FROM m""")
def attribution_importance(spark, d):
    layers = ["l_quantity", "l_tax", "l_linenumber"]
    phi = model.attributions(table(spark, d, "lineitem"), _MODEL, layers)
    row = phi.agg(*[F.avg(F.abs(F.col(f"phi_{c}"))).alias(c) for c in layers])
    total = sum((F.col(c) for c in layers), F.lit(0.0))
    return rounded(row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).alias("mean_abs"), F.try_divide(F.col(c), total).alias("share")) for c in layers]))))


@query(f"""WITH {_C}, e AS (SELECT l_orderkey, l_linenumber, CAST(a + b + e AS DOUBLE) AS eta FROM c), z AS (SELECT max(eta) AS top FROM e), s AS (SELECT top, sum(exp(eta - top)) AS z, ln(sum(exp(eta - top))) - sum(exp(eta - top) * (eta - top)) / sum(exp(eta - top)) AS h FROM e, z GROUP BY top)
SELECT l_orderkey, l_linenumber, round(1 - exp(-exp(h) * exp(eta - top) / z), 6) AS suitability FROM e, s""")
def cloglog_output(spark, d):
    out = model.output(table(spark, d, "lineitem"), _MODEL.predictor(), "cloglog")
    return rounded(out.select("l_orderkey", "l_linenumber", "suitability"))


@query(f"""WITH m AS (SELECT avg(l_quantity) AS q, avg(l_tax) AS t FROM lineitem), g AS (SELECT 1 + k * 49.0 / 20 AS x FROM range(0, 21) r(k))
SELECT round(CAST(x AS DOUBLE), 6) AS x, round(CAST(1.5 * least(greatest((x - 1) / 49, 0), 1) - 0.75 * least(greatest((x * x - 1) / 2499, 0), 1) - 0.5 * least(greatest(t / 0.08, 0), 1) AS DOUBLE), 6) AS eta FROM g, m""")
def response_curve(spark, d):
    only = model.Additive(linear=_MODEL.linear, quadratic=_MODEL.quadratic)
    means = table(spark, d, "lineitem").agg(F.avg("l_quantity").alias("l_quantity"), F.avg("l_tax").alias("l_tax"))
    return rounded(model.response_curve(only, means, "l_quantity", 1.0, 50.0, 20))


_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _labelled(spark, d):
    li = table(spark, d, "lineitem").withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    y = ((F.col("l_quantity") > 30) & (F.col("l_discount") < 0.06) | (F.col("key") % 23 == 0)).cast("int")
    return li.withColumn("presence", y)


def _training(spark, d):
    return holdout_split(_labelled(spark, d), "key")


@query()
def presence_background_fit(spark, d):
    rows = _training(spark, d)
    layers = ["l_quantity", "l_discount", "l_tax"]
    fitted = model.fit_presence_background(rows.where("not is_test"), "presence", layers, iterations=30)
    scored = rows.where("is_test").withColumn("eta", fitted.predictor(layers))
    return rounded(metrics.auc(scored, "presence", "eta"))


def _keyed(spark, d):
    """Rows with a key of their own (that of lineitem repeats) and a held-out part."""
    rows = _labelled(spark, d)
    return rows.withColumn("id", F.xxhash64(*rows.columns)).select("id", "presence", *_FEATURES, "l_linenumber", (F.col("key") % 10 >= 7).alias("is_test"))


@query()
def comparator_metrics(spark, d):
    """The presence-background model, logistic regression and four ensembles of 500 trees, each with its own best threshold."""
    return rounded(protocols.comparator_table(_keyed(spark, d), "id", "presence", _FEATURES, "is_test"))


@query()
def tree_attributions(spark, d):
    """Exact attributions of the held-out rows by the boosted ensembles: mean size, sign, share and direction by layer."""
    rows = _keyed(spark, d)
    boosted = {n: r for n, r in trees.RECIPES.items() if r.boosted}
    made = trees.fit_trees(rows, "presence", _FEATURES, "id", boosted, {"train": ~F.col("is_test")})
    phi = trees.attributions(rows.where("is_test"), {n: m for (_, n), m in made.items()}, "id")
    return rounded(trees.attribution_summary(phi.persist()))


@query("""WITH m AS (SELECT avg(CAST(o_orderstatus = 'F' AS DOUBLE)) AS mean FROM orders), r AS (SELECT o_orderkey, o_orderpriority, CAST(o_orderstatus = 'F' AS DOUBLE) AS y FROM orders)
SELECT o_orderkey, round((coalesce(sum(y) OVER w, 0) + mean) / (coalesce(count(*) OVER w, 0) + 1), 6) AS statistic FROM r, m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY """ + draw_sql("o_orderkey") + """ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def ordered_statistics(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return rounded(trees.ordered_statistics(o, "o_orderpriority", "y", "o_orderkey").select("o_orderkey", "statistic"))


@query()
def permutation_importance(spark, d):
    rows = _training(spark, d)
    layers = ["l_quantity", "l_discount", "l_tax"]
    fitted = model.fit_comparator(rows.where("not is_test"), "presence", layers, model.comparators()["logistic_regression"])
    return rounded(model.permutation_importance(fitted, rows.where("is_test").select("key", "presence", *layers), "presence", layers, "key"))


@query()
def jackknife_gains(spark, d):
    """AUC with all layers, without each, and with each alone."""
    rows = _training(spark, d)
    return rounded(arms.jackknife(rows.where("not is_test"), rows.where("is_test"), "presence", ["l_quantity", "l_discount", "l_tax"]))


@query("""WITH t AS (SELECT *, l_orderkey * 10 + l_linenumber AS key FROM lineitem), h AS (SELECT *, CAST((l_quantity > 30 AND l_discount < 0.06) OR key % 23 = 0 AS INT) AS presence FROM t WHERE key % 10 < 7),
a AS (SELECT 'grid|' || b || '|' || c AS arm, 'all' AS part FROM (VALUES ('0.25'), ('0.5'), ('1.0'), ('2.0'), ('4.0')) x(b), (VALUES ('L'), ('Q'), ('LQ')) y(c) UNION ALL SELECT 'fold|' || f, f FROM (VALUES ('A'), ('N'), ('R')) z(f))
SELECT a.arm, CAST(count(*) AS BIGINT) AS n, CAST(sum(presence) AS BIGINT) AS presences, true AS converged, true AS optimal FROM a JOIN h ON part = 'all' OR l_returnflag <> part GROUP BY a.arm""")
def fitted_arms(spark, d):
    """Every setting of the grid and a fit without each group, in the same scans: rows that train, and whether the gradient at the coefficients is that of an optimum."""
    rows = _labelled(spark, d).where("key % 10 < 7").select("presence", "l_returnflag", *_FEATURES).persist()
    sets = {"all": F.lit(True)} | {f: F.col("l_returnflag") != f for f in "ANR"}
    fits = {f"grid|{b}|{c}": fitting.Fit(tuple(_FEATURES), "all", b, c) for b, c in arms.grid_of((0.25, 0.5, 1.0, 2.0, 4.0), ("L", "Q", "LQ"))}
    fits |= {f"fold|{f}": fitting.Fit(tuple(_FEATURES), f) for f in "ANR"}
    models = fitting.fit_all(rows, "presence", fits, sets)
    found = fitting.gradients(rows, "presence", {n: (m, _FEATURES, sets[fits[n].rows]) for n, m in models.items()})
    done = spark.createDataFrame([(n, m.fitted["converged"]) for n, m in models.items()], "arm string, converged boolean")
    return found.join(done, "arm").select("arm", "n", "presences", "converged", (F.col("worst") < 0.02).alias("optimal"))


@query()
def aicc_grid(spark, d):
    rows = _training(spark, d).where("not is_test").select("presence", *_FEATURES)
    return rounded(arms.aicc_grid(rows, "presence", _FEATURES))


@query()
def leave_one_group_out(spark, d):
    rows = _training(spark, d)
    rows = rows.withColumn("key", F.xxhash64(*rows.columns)).select("key", "presence", "l_returnflag", *_FEATURES)
    return rounded(arms.fold_aucs(rows, "l_returnflag", "presence", _FEATURES, "key"))


@query()
def ablation_groups(spark, d):
    rows = _training(spark, d).select("is_test", "presence", *_FEATURES)
    groups = {"size": ["l_quantity"], "price": ["l_discount", "l_tax"]}
    return rounded(arms.ablation(rows.where("not is_test"), rows.where("is_test"), "presence", groups))


@query()
def masked_background_arm(spark, d):
    rows = _training(spark, d).select("is_test", "presence", "l_linenumber", *_FEATURES)
    mask = rows.where("l_linenumber <= 3").select("l_linenumber").distinct()
    return rounded(arms.masked_arm("first_lines", rows.where("not is_test"), rows.where("is_test"), mask, ["l_linenumber"], "presence", _FEATURES))


@query("""WITH a AS (SELECT o_orderpriority AS arm, round(avg(o_totalprice), 2) AS auc FROM orders GROUP BY ALL) SELECT arm, auc, round(auc - (SELECT auc FROM a WHERE arm = '1-URGENT'), 2) AS delta FROM a""")
def sensitivity_summary(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(F.round(F.avg("o_totalprice"), 2).alias("auc"))
    return rounded(arms.against_baseline(a, baseline="1-URGENT"), 2)
