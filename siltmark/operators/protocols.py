"""Study protocols: buffered and nested validation, nested models, single predictors, models by fold, refits of sensitivity arms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.projection import STATE_PLANE_FEET, UTM_14, with_changed
from . import metrics, model, stats, trees
from .arms import TRAIN, _on_test, aicc_table, against_baseline, folds_of, grid_of, run_arms, train_and_test
from .fitting import ROWS, Fit, counted, fit_all, scored
from .grid import connected_components
from .sampling import holdout_split, matched_background, top_groups
from .zonal import zonal_mean

#: Zones of the one-percent flood (fixed values).
FLOOD_ZONES = ("A", "AE", "AH", "AO", "VE", "A99", "AR")


def _values(rows: DataFrame, column: str, most: int = 1000) -> list:
    found = [r[0] for r in rows.select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"over {most} values of {column}")
    return found


def _around(others: DataFrame, x: str, y: str, reach: float, *carried: str) -> DataFrame:
    """others as __x, __y (and carried columns with two underscores), in each of the nine cells around their own."""
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("o")
    q = others.select(F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), *[F.col(c).alias(f"__{c}") for c in carried], near)
    return q.select("*", (F.floor(F.col("__x") / reach) + F.col("o.a")).alias("__cx"), (F.floor(F.col("__y") / reach) + F.col("o.b")).alias("__cy")).drop("o")


def _within(x: str, y: str, reach: float) -> Column:
    cell = (F.floor(F.col(x) / reach) == F.col("__cx")) & (F.floor(F.col(y) / reach) == F.col("__cy"))
    dx, dy = F.col(x) - F.col("__x"), F.col(y) - F.col("__y")
    return cell & (dx * dx + dy * dy <= reach * reach)


def beyond(rows: DataFrame, others: DataFrame, x: str, y: str, reach: float) -> DataFrame:
    """The rows that have none of the others within reach. Others are met by cells of that size."""
    if reach <= 0:
        return rows
    return rows.join(_around(others, x, y, reach), _within(x, y, reach), "left_anti")


def buffered_sizes(rows: DataFrame, fold: str, key: str, x: str, y: str, presence: str, buffers: Iterable[float] = (0.0, 500.0, 1000.0, 2000.0)) -> DataFrame:
    """(buffer, fold, n_test, n_train): rows left to train on when those within a buffer of the fold's presences are left out. All folds at once."""
    n = rows.groupBy(F.col(fold).alias("fold")).agg(F.count(F.lit(1)).alias("n_test"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    out = None
    for b in buffers:
        base = n.crossJoin(F.broadcast(total))
        if b > 0:
            met = rows.join(_around(rows.where(F.col(presence) == 1), x, y, b, fold), _within(x, y, b) & (F.col(fold) != F.col(f"__{fold}")))
            gone = met.groupBy(F.col(f"__{fold}").alias("of")).agg(F.count_distinct(key).alias("gone"))
            base = base.join(gone, F.col("fold") == F.col("of"), "left")
        else:
            base = base.withColumn("gone", F.lit(0).cast("long"))
        part = base.select(F.lit(float(b)).alias("buffer"), "fold", "n_test", (F.col("total") - F.col("n_test") - F.coalesce("gone", F.lit(0))).alias("n_train"))
        out = part if out is None else out.unionByName(part)
    return out


def distances_to_folds(rows: DataFrame, fold: str, key: str, x: str, y: str, presence: str, folds: list, reach: float) -> DataFrame:
    """rows with __d0, __d1, ..: the distance to the nearest presence of each fold, where it is within reach. One search for all folds."""
    if reach <= 0:
        return rows.withColumns({f"__d{k}": F.lit(None).cast("double") for k in range(len(folds))})
    near = rows.join(_around(rows.where(F.col(presence) == 1), x, y, reach, fold), _within(x, y, reach))
    d = F.sqrt(F.pow(F.col(x) - F.col("__x"), F.lit(2)) + F.pow(F.col(y) - F.col("__y"), F.lit(2)))
    least = near.groupBy(key).agg(*[F.min(F.when(F.col(f"__{fold}") == F.lit(v), d)).alias(f"__d{k}") for k, v in enumerate(folds)])
    return rows.join(least, key, "left")


def buffered_folds(rows: DataFrame, fold: str, key: str, x: str, y: str, presence: str, layers: list[str], buffers: Iterable[float] = (0.0, 500.0, 1000.0, 2000.0), least: int = 40, **options) -> DataFrame:
    """(buffer, folds, skipped, mean, sd): for each buffer and fold a fit on the rows beyond it. Folds with fewer presences than ``least`` to train on are skipped.

    All fits share their scans. Keys must be distinct.
    """
    buffers = [float(b) for b in buffers]
    rows = rows.persist()
    folds = [v for v, _ in folds_of(rows, fold, key)]
    wide = distances_to_folds(rows, fold, key, x, y, presence, folds, max([0.0, *buffers])).persist()
    away = {(b, k): (F.col(fold) != F.lit(v)) & (F.lit(True) if b <= 0 else F.coalesce(F.col(f"__d{k}") > b, F.lit(True))) for b in buffers for k, v in enumerate(folds)}
    here = F.col(presence) == 1
    left = wide.agg(*[F.count_if(here & c).alias(f"n{i}") for i, c in enumerate(away.values())]).first()
    kept = {bk: c for i, (bk, c) in enumerate(away.items()) if left[i] >= least}
    fits = {f"{b}|{k}": Fit(tuple(layers), f"{b}|{k}") for b, k in kept}
    auc = run_arms(wide, presence, fits, {f"{b}|{k}": c for (b, k), c in kept.items()}, {f"{b}|{k}": (f"{b}|{k}", F.col(fold) == F.lit(folds[k])) for b, k in kept}, **options)[1] if kept else {}
    rows.unpersist()
    done = rows.sparkSession.createDataFrame([(b, str(v), auc.get(f"{b}|{k}")) for b in buffers for k, v in enumerate(folds)], "buffer double, fold string, auc double")
    return done.groupBy("buffer").agg(F.count("auc").alias("folds"), F.count_if(F.col("auc").isNull()).alias("skipped"), F.avg("auc").alias("mean"), F.coalesce(F.stddev_samp("auc"), F.lit(0.0)).alias("sd"))


def nested_tuning(rows: DataFrame, fold: str, key: str, presence: str, layers: list[str], betas: Iterable[float] = (0.25, 0.5, 1.0, 2.0, 4.0), classes: Iterable[str] = ("L", "Q", "LQ"), **options) -> DataFrame:
    """(fold, beta, classes, aicc, auc): the grid is fitted within the other folds' rows, and the best of it scores the fold.

    Every setting of every fold is fitted in the same scans; the best one is that of the least criterion, of equal ones the first in the grid.
    """
    betas, classes = list(betas), list(classes)
    rows = rows.persist()
    try:
        inside = {str(v): F.col(fold) == F.lit(v) for v, _ in folds_of(rows, fold, key)}
        table, models = aicc_table(rows, presence, layers, {v: ~c for v, c in inside.items()}, betas, classes, **options)
        place = {s: k for k, s in enumerate(grid_of(betas, classes))}
        best: dict[str, tuple] = {}
        for r in table.collect():
            mine = (r["aicc"], place[r["beta"], r["classes"]], r["beta"], r["classes"])
            best[r["set"]] = min(best.get(r["set"], mine), mine)
        found = scored(rows, presence, {v: (models[v, *best[v][2:]], layers, inside[v]) for v in inside})
        auc = {r["arm"]: r["auc"] for r in found.collect()}
    finally:
        rows.unpersist()
    return rows.sparkSession.createDataFrame([(v, best[v][2], best[v][3], float(best[v][0]), auc[v]) for v in inside], "fold string, beta double, classes string, aicc double, auc double")


def conditional_importance(train: DataFrame, test: DataFrame, presence: str, layers: list[str], focal: str, confounders: list[str], **options) -> DataFrame:
    """(arm, against, auc, increment) of nested models: what the focal layer adds to its confounders, they to it, and what leaving it out costs."""
    arms = {"confounders": confounders, "focal": [focal], "confounders+focal": [*confounders, focal], "full": layers, "full-focal": [c for c in layers if c != focal]}
    pairs = [("confounders+focal", "confounders"), ("confounders+focal", "focal"), ("full", "full-focal")]
    auc = _on_test(train, test, presence, arms, **options)
    rows = [(n, None, auc[n], None) for n in arms] + [(a, b, auc[a], None if None in (auc[a], auc[b]) else auc[a] - auc[b]) for a, b in pairs]
    return train.sparkSession.createDataFrame(rows, "arm string, against string, auc double, increment double")


def confounder_ranks(rows: DataFrame, presence: str, focal: str, confounders: list[str]) -> DataFrame:
    """(presence, confounder, n, rho): rank correlation of the focal layer with each confounder, at presences and elsewhere."""
    long = rows.select(F.col(presence).alias("presence"), F.col(focal).cast("double").alias("x"), F.inline(F.array(*[F.struct(F.lit(c).alias("confounder"), F.col(c).cast("double").alias("y")) for c in confounders])))
    return stats.spearman(long, "x", "y", ["presence", "confounder"])


def single_predictors(train: DataFrame, test: DataFrame, presence: str, layers: list[str], combinations: dict[str, list[str]] | None = None, **options) -> DataFrame:
    """(arm, layers, auc, delta, pct_of_full): each layer alone and each combination, against all."""
    arms = {"baseline": layers} | {c: [c] for c in layers} | (combinations or {})
    auc = _on_test(train, test, presence, arms, **options)
    table = against_baseline(train.sparkSession.createDataFrame([(n, len(u), auc[n]) for n, u in arms.items()], "arm string, layers int, auc double"))
    return table.withColumn("pct_of_full", 100 * F.try_divide(F.col("auc"), F.col("auc") - F.col("delta")))


def stratum_refit(name: str, train: DataFrame, test: DataFrame, inside: Column, presence: str, layers: list[str], **options) -> DataFrame:
    """(arm, n_train, n_test, auc, whole_auc): a fit on the stratum's rows, and the fit on all, scored on the stratum."""
    marked = [d.withColumn("__inside", F.coalesce(inside, F.lit(False))) for d in (train, test)]
    both = train_and_test(*marked, [presence, *layers, "__inside"]).persist()
    sets = {"stratum": F.col(TRAIN) & F.col("__inside"), "train": F.col(TRAIN)}
    where = ~F.col(TRAIN) & F.col("__inside")
    n = both.agg(F.count_if(sets["stratum"]), F.count_if(where)).first()
    _, auc = run_arms(both, presence, {s: Fit(tuple(layers), s) for s in sets}, sets, {s: (s, where) for s in sets}, **options)
    return train.sparkSession.createDataFrame([(name, n[0], n[1], auc["stratum"], auc["train"])], "arm string, n_train long, n_test long, auc double, whole_auc double")


def pooled_groups_arm(rows: DataFrame, group: str, presence: str, layers: list[str], n: int = 4, **options) -> DataFrame:
    """(arm, n_train, n_test, auc): trained on the presences of the n most frequent groups, scored on those of the others; background rows train and score."""
    top = F.broadcast(top_groups(rows.where(F.col(presence) == 1), group, n).select(group).withColumn("__top", F.lit(True)))
    marked = rows.join(top, group, "left").withColumn("__top", F.coalesce("__top", F.lit(False))).persist()
    background = F.col(presence) == 0
    train, test = background | ((F.col(presence) == 1) & F.col("__top")), background | ((F.col(presence) == 1) & ~F.col("__top"))
    sizes = marked.agg(F.count_if(train), F.count_if(test)).first()
    _, auc = run_arms(marked, presence, {"pooled_groups": Fit(tuple(layers), "top")}, {"top": train}, {"pooled_groups": ("pooled_groups", test)}, **options)
    return rows.sparkSession.createDataFrame([("pooled_groups", *sizes, auc["pooled_groups"])], "arm string, n_train long, n_test long, auc double")


def coarse_rows(rows: DataFrame, row: str, col: str, factor: int, presence: str, layers: list[str]) -> DataFrame:
    """Cells of a grid coarser by factor: the layers' means; a presence where any cell has one."""
    return rows.groupBy(F.floor(F.col(row) / factor).alias(row), F.floor(F.col(col) / factor).alias(col)).agg(F.max(presence).alias(presence), *[F.avg(c).alias(c) for c in layers])


def matched_refit(train: DataFrame, test: DataFrame, presence: str, layers: list[str], value: str, key: str, n: int, bins: int = 10, **options) -> DataFrame:
    """(arm, auc, delta): the fit on all background against the one on background matched to the presences' distribution of a value."""
    rows, models, auc = _matched(train, test, presence, layers, value, key, n, bins, **options)
    rows.unpersist()
    return against_baseline(train.sparkSession.createDataFrame([(a, auc[a]) for a in ("baseline", "matched")], "arm string, auc double"))


def _matched(train: DataFrame, test: DataFrame, presence: str, layers: list[str], value: str, key: str, n: int, bins: int, **options):
    own, background = train.where(F.col(presence) == 1), train.where(F.col(presence) == 0)
    matched = matched_background(own, background, value, key, n, bins).select(key).distinct().withColumn("__matched", F.lit(True))
    both = train_and_test(train, test, [presence, key, *layers]).join(matched, key, "left").withColumn("__matched", F.coalesce("__matched", F.lit(False))).persist()
    sets = {"baseline": F.col(TRAIN), "matched": F.col(TRAIN) & ((F.col(presence) == 1) | F.col("__matched"))}
    models, auc = run_arms(both, presence, {s: Fit(tuple(layers), s) for s in sets}, sets, {s: (s, ~F.col(TRAIN)) for s in sets}, **options)
    return both.persist(), models, auc


def matched_importances(train: DataFrame, test: DataFrame, presence: str, layers: list[str], value: str, key: str, n: int, bins: int = 10, seed: int = 42, **options) -> DataFrame:
    """(layer, baseline, matched, change, baseline_rank, matched_rank): the AUC each layer costs when it is dealt anew among the test rows, in both fits.

    Ranks are 1 for the most important. Every permuted copy of the test rows is scored by both fits in one scan.
    """
    rows, models, auc = _matched(train, test, presence, layers, value, key, n, bins, **options)
    held = rows.where(~F.col(TRAIN))
    out = None
    for i, c in enumerate(layers):
        part = model.permuted(held, c, key, seed + i).withColumn("__layer", F.lit(c))
        out = part if out is None else out.unionByName(part)
    arms = {f"{a}|{c}": (m, layers, F.col("__layer") == c) for a, m in models.items() for c in layers}
    lost = {r["arm"]: auc[r["arm"].split("|")[0]] - r["auc"] for r in scored(out, presence, arms).collect() if r["auc"] is not None}
    rows.unpersist()

    def rank(a: str, c: str) -> int:
        return 1 + sum(lost.get(f"{a}|{o}", 0.0) > lost.get(f"{a}|{c}", 0.0) for o in layers)

    table = [(c, lost.get(f"baseline|{c}"), lost.get(f"matched|{c}"), rank("baseline", c), rank("matched", c)) for c in layers]
    done = train.sparkSession.createDataFrame(table, "layer string, baseline double, matched double, baseline_rank int, matched_rank int")
    return done.withColumn("change", F.col("matched") - F.col("baseline"))


def coarse_arm(rows: DataFrame, row: str, col: str, factor: int, presence: str, layers: list[str], key: str, fraction: float = 0.3, seed: int = 42, **options) -> DataFrame:
    """(arm, n_train, n_test, auc, delta): fitted and scored on the grid as it is, and on one coarser by factor, each with its own held-out cells."""
    coarse = coarse_rows(rows, row, col, factor, presence, layers)
    parts = []
    for name, of in (("baseline", rows.withColumn("__cell", F.col(key).cast("string"))), (f"coarse_{factor}", coarse.withColumn("__cell", F.concat_ws("_", row, col)))):
        split = holdout_split(of.select("__cell", presence, *[F.col(c).cast("double").alias(c) for c in layers]), "__cell", fraction, seed)
        parts.append(split.select(F.lit(name).alias("__grid"), presence, *layers, "is_test"))
    both = parts[0].unionByName(parts[1]).persist()
    names = ["baseline", f"coarse_{factor}"]
    sets = {a: (F.col("__grid") == a) & ~F.col("is_test") for a in names}
    tests = {a: (F.col("__grid") == a) & F.col("is_test") for a in names}
    n = both.agg(*[F.count_if(c) for a in names for c in (sets[a], tests[a])]).first()
    _, auc = run_arms(both, presence, {a: Fit(tuple(layers), a) for a in names}, sets, {a: (a, tests[a]) for a in names}, **options)
    done = [(a, n[2 * k], n[2 * k + 1], auc[a]) for k, a in enumerate(names)]
    return against_baseline(rows.sparkSession.createDataFrame(done, "arm string, n_train long, n_test long, auc double"))


#: Names of the models that aren't trees.
PRESENCE_BACKGROUND, LOGISTIC = "presence_background", "logistic_regression"


def scored_models(rows: DataFrame, key: str, presence: str, layers: list[str], train: dict[str, Column], score: dict[str, Column], categorical: Iterable[str] = (), recipes: dict | None = None, estimators: dict | None = None, seed: int = 42) -> DataFrame:
    """(set, model, key, y, y_score): every model fitted on each row set of train, over the rows that score names for the set.

    The presence-background model and all tree ensembles are fitted for all sets together, the estimators of
    pyspark.ml set by set. Scores of the presence-background model are its linear predictor. rows are kept while models are fitted.
    """
    recipes = trees.RECIPES if recipes is None else recipes
    estimators = {LOGISTIC: model.comparators()[LOGISTIC]} if estimators is None else estimators
    categorical = list(categorical)
    rows = rows.persist()
    fits = fit_all(rows, presence, {s: Fit(tuple(layers), s) for s in train}, train, categorical)
    eta = F.array(*[F.struct(F.lit(s).alias("set"), F.when(score[s], m.predictor(layers)).alias("y_score")) for s, m in fits.items()])
    out = rows.select(F.col(key).alias("key"), F.col(presence).alias("y"), F.inline(eta)).where("y_score is not null").select("set", F.lit(PRESENCE_BACKGROUND).alias("model"), "key", "y", "y_score")
    if recipes:
        made = trees.fit_trees(rows, presence, layers, key, recipes, train, categorical, seed=seed)
        found = trees.scores(rows.select(F.col(key).alias("key"), F.col(presence).alias("y"), *layers, *[c.alias(f"__s{k}") for k, c in enumerate(score.values())]), {f"{s}|{n}": m for (s, n), m in made.items()}, {f"{s}|{n}": F.col(f"__s{list(score).index(s)}") for s, n in made})
        of = F.split("model", r"\|")
        out = out.unionByName(found.where("y_score is not null").select(of[0].alias("set"), of[1].alias("model"), "key", "y", "y_score"))
    for name, estimator in (estimators or {}).items():
        for s in train:
            fitted = model.fit_comparator(rows.where(train[s]).select(key, presence, *layers), presence, layers, estimator)
            one = model.probability(fitted, rows.where(score[s]).select(F.col(key).alias("key"), F.col(presence).alias("y"), *layers))
            out = out.unionByName(one.select(F.lit(s).alias("set"), F.lit(name).alias("model"), "key", "y", "y_score"))
    return out


def comparator_table(rows: DataFrame, key: str, presence: str, layers: list[str], is_test: str, **options) -> DataFrame:
    """(model, n_pos, n_neg, auc, threshold, counts and metrics) on the test rows, with the threshold that is best on the training rows."""
    test = F.col(is_test)
    both = scored_models(rows, key, presence, layers, {"train": ~test}, {"train": F.lit(True)}, **options)
    both = both.join(rows.select(F.col(key).alias("key"), test.alias("__test")), "key").persist()
    threshold = metrics.youden_threshold(both.where("not __test"), "y", "y_score", ["model"]).select("model", "threshold")
    held = both.where("__test")
    flagged = metrics.threshold_metrics(held.join(F.broadcast(threshold), "model"), F.col("threshold"), "y", "y_score", ["model", "threshold"])
    return metrics.auc(held, "y", "y_score", ["model"]).join(flagged, "model")


def models_by_fold(rows: DataFrame, fold: str, key: str, presence: str, layers: list[str], **options) -> DataFrame:
    """(fold, model, n_test, auc): every model, fitted without each fold and scored on it. All folds' trees and presence-background fits are made together."""
    found = folds_of(rows, fold, key)
    inside = {str(v): F.col(fold) == F.lit(v) for v, _ in found}
    of = scored_models(rows, key, presence, layers, {v: ~c for v, c in inside.items()}, inside, **options)
    sizes = rows.sparkSession.createDataFrame([(str(v), n) for v, n in found], "set string, n_test long")
    return metrics.auc(of, "y", "y_score", ["set", "model"]).join(sizes, "set").select(F.col("set").alias("fold"), "model", "n_test", "auc")


def paired_significance(values: DataFrame, fold: str, model_: str, value: str, a: str, b: str, n_train: float, n_test: float, level: float = 0.05) -> DataFrame:
    """(k, mean_diff, sd_diff, cohens_d, t, p, low, high, verdict) of two models' paired values by fold.

    The test is corrected for training rows that folds share; low and high are the plain interval of the mean, which isn't, for
    comparison. Folds that lack one of the two have no part.
    """
    one = values.groupBy(fold).agg(F.max(F.when(F.col(model_) == a, F.col(value))).alias("__a"), F.max(F.when(F.col(model_) == b, F.col(value))).alias("__b"))
    t = stats.corrected_t(one.select((F.col("__a") - F.col("__b")).alias("diff")).where("diff is not null"), "diff", n_train, n_test).withColumn("__df", F.col("k") - 1)
    tested = stats.with_tails(t, "t", "t", "__df", "p")
    half = stats.with_quantiles(tested, 1 - level / 2, "__df", "__q").withColumn("__half", F.col("__q") * F.col("sd_diff") / F.sqrt("k"))
    verdict = F.when(F.col("p") < level, "real_difference").otherwise("within_noise").alias("verdict")
    return half.select("k", "mean_diff", "sd_diff", "cohens_d", "t", "p", (F.col("mean_diff") - F.col("__half")).alias("low"), (F.col("mean_diff") + F.col("__half")).alias("high"), verdict)


def omnibus(values: DataFrame, fold: str, model_: str, value: str, n_train: float, n_test: float) -> DataFrame:
    """(a, b, k, mean_diff, t, p, p_holm, chi2, p_chi2): Friedman's test over folds, and corrected t-tests of all pairs of models with Holm's p."""
    chi2 = stats.friedman(values, fold, model_, value)[1].withColumn("__df", F.col("models") - 1)
    chi2 = stats.with_tails(chi2, "chi2", "chi2", "__df", "p_chi2").select("chi2", "p_chi2")
    one, two = (values.select(F.col(fold).alias("fold"), F.col(model_).alias(m), F.col(value).alias(f"v{m}")) for m in ("a", "b"))
    diff = one.join(two, "fold").where("a < b").select("a", "b", (F.col("va") - F.col("vb")).alias("diff"))
    t = stats.corrected_t(diff, "diff", n_train, n_test, ["a", "b"]).withColumn("__df", F.col("k") - 1)
    pairs = stats.with_tails(t, "t", "t", "__df", "p").withColumn("__family", F.lit(1)).withColumn("__key", F.concat_ws("|", "a", "b"))
    adjusted = stats.adjusted_p(pairs, "p", ["__family"], "__key")
    return adjusted.crossJoin(F.broadcast(chi2)).select("a", "b", "k", "mean_diff", "t", "p", "p_holm", "chi2", "p_chi2")


def association_report(df: DataFrame, categorical: list[str], others: list[str], bins: int = 10) -> DataFrame:
    """(a, b, n, chi2, v): Cramer's V of each categorical column with every other; those that aren't categorical by quantile bins."""
    from .sampling import bin_right, quantile_edges

    out = None
    for a in sorted(categorical):
        for b in [c for c in [*sorted(categorical), *others] if c != a]:
            rows = df.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
            if b not in categorical:
                rows = rows.crossJoin(F.broadcast(quantile_edges(rows, "b", bins))).select("a", bin_right(F.col("edges"), F.col("b")).alias("b"))
            one = stats.cramers_v(rows, "a", "b").select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "chi2", "v")
            out = one if out is None else out.unionByName(one)
    return out


def over_replicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, mean, sd, least, most) of columns of a replicate table; the deviation of one replicate is 0."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])))
    return long.groupBy("name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"), F.min("v").alias("least"), F.max("v").alias("most"))


def flood_zone(zone: Column, subtype: Column | None = None) -> Column:
    """'sfha' for the zones of the one-percent flood, 'shaded_x' for zone X whose subtype tells of 0.2 percent, else null."""
    shaded = F.lit(False) if subtype is None else F.coalesce(F.contains(F.upper(subtype), F.lit("0.2 PCT")), F.lit(False))
    return F.when(zone.isin(*FLOOD_ZONES), "sfha").when((zone == "X") & shaded, "shaded_x")


def overlap_sweep(cells: DataFrame, value: str, reference: str, thresholds: dict[str, float], valid: str | None = None) -> DataFrame:
    """(label, threshold, counts and overlap): a raster at several thresholds against a mask."""
    ladder = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(float(t)).alias("threshold")) for k, t in thresholds.items()]))
    rows = cells.select("*", ladder.alias("__t")).select("*", "__t.*").withColumn("__flag", F.col(value) >= F.col("threshold"))
    return metrics.overlap(rows, "__flag", reference, valid, ["label", "threshold"])


def detected_mask(cells: DataFrame, value: str, most: float, least: int) -> DataFrame:
    """Cells (row, col) of value under a threshold that belong to a connected part of at least so many cells."""
    return connected_components(cells.where(F.col(value) < most).select("row", "col"), least)


def zone_table(zones: DataFrame, cells: dict[str, DataFrame], zone: str, attributes: DataFrame | None = None, needed: str | None = None, least: int = 50) -> DataFrame:
    """Zones with the mean of each raster's cells (columns zone, value) as <name>_mean, and their attributes; zones without the needed mean go."""
    out = zones
    for name, c in cells.items():
        out = out.join(zonal_mean(c, zone, "value", least).select(zone, F.col("mean").alias(f"{name}_mean")), zone, "left")
    if attributes is not None:
        out = out.join(attributes, zone, "left")
    return out.dropna(subset=[needed]) if needed else out


def predictor_table(catalogue: DataFrame, effects: DataFrame, screened: DataFrame, name: str = "predictor") -> DataFrame:
    """The catalogue with effects, and a status: kept, dropped with the stage, or not screened. screened: (name, kept, stage)."""
    status = F.when(F.col("kept"), "kept").when(~F.col("kept"), F.concat(F.lit("dropped: "), F.coalesce("stage", F.lit("screening")))).otherwise("not screened")
    return catalogue.join(effects, name, "left").join(screened, name, "left").withColumn("status", status).drop("kept", "stage")


def survey_points(rows: DataFrame, easting: str = "easting_ft", northing: str = "northing_ft", bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Adds x and y of the grid to rows in feet of the state plane; rows without coordinates go, and those out of bounds (x0, y0, x1, y1)."""
    out = with_changed(rows.dropna(subset=[easting, northing]), easting, northing, STATE_PLANE_FEET, UTM_14)
    return out.where(F.col("x").between(bounds[0], bounds[2]) & F.col("y").between(bounds[1], bounds[3])) if bounds else out


def encoding_comparison(rows: DataFrame, key: str, label: str, layers: list[str], categorical: list[str], is_test: str, recipes: dict | None = None, seed: int = 42) -> DataFrame:
    """(model, ordinal, nominal, delta): AUC on the test rows with category codes as numbers, and with a column for each category of the training rows.

    By default the forest and the boosted trees that split codes by thresholds; those with ordered statistics see categories as such.
    """
    recipes = {n: r for n, r in trees.RECIPES.items() if not r.ordered} if recipes is None else recipes
    test = F.col(is_test)
    base = rows.select(*dict.fromkeys([key, label, *layers, *categorical, is_test])).persist()
    codes = {c: _values(base.where(~test), c) for c in categorical}
    wide = {f"__{c}_{i}": (F.col(c) == F.lit(v)).cast("double") for c in categorical for i, v in enumerate(codes[c])}
    of = base.withColumns(wide)
    kinds = {"ordinal": [*layers, *categorical], "nominal": [*layers, *wide]}
    models = {f"{kind}|{n}": m for kind, own in kinds.items() for (_, n), m in trees.fit_trees(of, label, own, key, recipes, {"train": ~test}, seed=seed).items()}
    held = counted(base.where(test), {c: F.col(c) for c in dict.fromkeys([label, *layers, *categorical])})
    auc = metrics.auc(trees.scores(held.withColumns(wide), models, keep=[label, ROWS]), label, "y_score", ["model"], ROWS).collect()
    held.unpersist()
    base.unpersist()
    found = {tuple(r["model"].split("|")): r["auc"] for r in auc}
    table = rows.sparkSession.createDataFrame([(n, found.get(("ordinal", n)), found.get(("nominal", n))) for n in recipes], "model string, ordinal double, nominal double")
    return table.withColumn("delta", F.col("nominal") - F.col("ordinal"))
