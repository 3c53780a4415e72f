"""Arms of a study: tuning grids, folds, ablations and sensitivity, each a model fit and a metric.

All fits of a study share the scans of its rows (fitting.fit_all), and so do all scores: what is run grows
with the passes that the slowest fit needs, not with the number of arms.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import aicc
from . import guards
from .fitting import ROWS, Fit, counted, fit_all, likelihoods, scored
from .model import Additive

TRAIN = "__train"


def run_arms(rows: DataFrame, presence: str, fits: dict[str, Fit], sets: dict[str, Column] | None, tests: dict[str, tuple[str, Column | None]], **options) -> tuple[dict[str, Additive], dict[str, float | None]]:
    """The fitted models, and the AUC of each test: a fit's name and the rows it scores. Equal rows are counted once for all of it."""
    layers = sorted({c for f in fits.values() for c in f.layers})
    inside = {f"__set{k}": F.coalesce(c, F.lit(False)) for k, c in enumerate((sets or {}).values())}
    asked = {f"__test{k}": F.coalesce(F.lit(True) if where is None else where, F.lit(False)) for k, (_, where) in enumerate(tests.values())}
    of = counted(rows, {"__y": F.col(f"`{presence}`")} | {c: F.col(f"`{c}`") for c in layers} | inside | asked)
    try:
        models = fit_all(of, "__y", fits, {s: F.col(c) for s, c in zip(sets or {}, inside, strict=True)}, rows=ROWS, **options)
        found = scored(of, "__y", {t: (models[f], fits[f].layers, F.col(c)) for (t, (f, _)), c in zip(tests.items(), asked, strict=True)}, rows=ROWS)
        return models, {r["arm"]: r["auc"] for r in found.collect()}
    finally:
        of.unpersist()


def train_and_test(train: DataFrame, test: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Both in one table, told apart by TRAIN."""
    columns = [F.col(f"`{c}`") for c in dict.fromkeys(columns)]
    return train.select(*columns, F.lit(True).alias(TRAIN)).unionByName(test.select(*columns, F.lit(False).alias(TRAIN)))


def _on_test(train: DataFrame, test: DataFrame, presence: str, arms: dict[str, list[str]], **options) -> dict[str, float | None]:
    """The AUC on test of a fit on train with each arm's layers."""
    both = train_and_test(train, test, [presence, *(c for used in arms.values() for c in used)])
    fits = {n: Fit(tuple(used), "train", **{k: options[k] for k in ("beta", "classes") if k in options}) for n, used in arms.items()}
    rest = {k: v for k, v in options.items() if k not in ("beta", "classes")}
    return run_arms(both, presence, fits, {"train": F.col(TRAIN)}, {n: (n, ~F.col(TRAIN)) for n in arms}, **rest)[1]


def grid_of(betas: Iterable[float], classes: Iterable[str]) -> list[tuple[float, str]]:
    classes = list(classes)
    return [(float(b), c) for b in betas for c in classes]


def _criteria(spark, done: list[tuple]) -> DataFrame:
    table = spark.createDataFrame(done, "set string, beta double, classes string, k int, n long, ll double")
    return table.withColumn("aicc", aicc(F.col("ll"), F.col("k"), F.col("n")))


def aicc_table(rows: DataFrame, presence: str, layers: list[str], sets: dict[str, Column], betas: Iterable[float], classes: Iterable[str], iterations: int = 50, **options) -> tuple[DataFrame, dict[tuple, Additive]]:
    """(set, beta, classes, k, n, ll, aicc) of every setting on every row set, and the models. The likelihood is of the raw output, normalised over the set's rows, at its presences."""
    fits = {f"{s}|{b}|{c}": Fit(tuple(layers), s, b, c) for s in sets for b, c in grid_of(betas, classes)}
    inside = {s: f"__set{k}" for k, s in enumerate(sets)}
    of = counted(rows, {"__y": F.col(presence)} | {c: F.col(c) for c in layers} | {inside[s]: F.coalesce(c, F.lit(False)) for s, c in sets.items()})
    try:
        models = fit_all(of, "__y", fits, {s: F.col(c) for s, c in inside.items()}, iterations=iterations, rows=ROWS, **options)
        ll = likelihoods(of, "__y", {n: (m, layers, F.col(inside[fits[n].rows])) for n, m in models.items()}, ROWS)
    finally:
        of.unpersist()
    done = []
    for n, m in models.items():
        k = sum(abs(t[0]) > 1e-9 for t in (*m.linear.values(), *m.quadratic.values())) + sum(len(t) for t in m.categorical.values())
        done.append((fits[n].rows, fits[n].beta, fits[n].classes, k, *ll[n]))
    return _criteria(rows.sparkSession, done), {(f.rows, f.beta, f.classes): models[n] for n, f in fits.items()}


def aicc_grid(rows: DataFrame, presence: str, layers: list[str], betas: Iterable[float] = (0.25, 0.5, 1.0, 2.0, 4.0), classes: Iterable[str] = ("L", "Q", "LQ"), iterations: int = 50) -> DataFrame:
    """(beta, classes, k, n, aicc, delta), best first, fitted on all rows."""
    scored_, _ = aicc_table(rows, presence, layers, {"all": F.lit(True)}, betas, classes, iterations)
    least = F.broadcast(scored_.agg(F.min("aicc").alias("least")))
    return scored_.crossJoin(least).select("beta", "classes", "k", "n", "aicc", (F.col("aicc") - F.col("least")).alias("delta")).orderBy("aicc")


def folds_of(rows: DataFrame, fold: str, key: str, folds: int = 1000) -> list[tuple]:
    """(fold, rows) in order; at most ``folds``, and no key in two of them."""
    found = [(r[0], r[1]) for r in rows.groupBy(F.col(fold).alias("fold")).count().orderBy("fold").limit(folds + 1).collect()]
    if len(found) > folds:
        raise ValueError(f"over {folds} folds")
    if not (both := rows.groupBy(key).agg(F.min(fold).alias("a"), F.max(fold).alias("b")).where("a <> b")).isEmpty():
        raise guards.GuardError(f"{both.count()} rows are in training and test")
    return found


def fold_aucs(rows: DataFrame, fold: str, presence: str, layers: list[str], key: str, folds: int = 1000, **options) -> DataFrame:
    """(fold, n_train, n_test, auc): for each fold a fit on the rows of the others. At most ``folds`` folds."""
    found = folds_of(rows, fold, key, folds)
    total = sum(n for _, n in found)
    inside = {str(v): F.col(fold) == F.lit(v) for v, _ in found}
    fits = {v: Fit(tuple(layers), v, **{k: options[k] for k in ("beta", "classes") if k in options}) for v in inside}
    rest = {k: v for k, v in options.items() if k not in ("beta", "classes")}
    _, auc = run_arms(rows, presence, fits, {v: ~c for v, c in inside.items()}, {v: (v, c) for v, c in inside.items()}, **rest)
    return rows.sparkSession.createDataFrame([(str(v), total - n, n, auc[str(v)]) for v, n in found], "fold string, n_train long, n_test long, auc double")


def summary_of_folds(aucs: DataFrame, ddof: int = 1) -> DataFrame:
    """Mean, deviation and row-weighted mean over folds."""
    sd = F.stddev_samp("auc") if ddof else F.stddev_pop("auc")
    return aucs.agg(F.count("auc").alias("folds"), F.avg("auc").alias("mean"), F.coalesce(sd, F.lit(0.0)).alias("sd"), F.try_divide(F.sum(F.col("auc") * F.col("n_test")), F.sum(F.when(F.col("auc").isNotNull(), F.col("n_test"))).cast("double")).alias("weighted_mean"))


def ablation(train: DataFrame, test: DataFrame, presence: str, groups: dict[str, list[str]], keep_only: bool = False, **options) -> DataFrame:
    """(arm, layers, auc, delta): without each group of layers, or with it alone, against all. Groups must be a partition of the layers."""
    layers = [c for g in groups.values() for c in g]
    if len(set(layers)) != len(layers):
        raise guards.GuardError("a layer is in several groups")
    arms = {"baseline": layers} | {name: g if keep_only else [c for c in layers if c not in g] for name, g in groups.items()}
    auc = _on_test(train, test, presence, arms, **options)
    return against_baseline(train.sparkSession.createDataFrame([(n, len(u), auc[n]) for n, u in arms.items()], "arm string, layers int, auc double"))


def jackknife(train: DataFrame, test: DataFrame, presence: str, layers: list[str], **options) -> DataFrame:
    """(arm, auc) with all layers, without each (without_<layer>), and with each alone (only_<layer>)."""
    arms = {"all": layers} | {f"without_{c}": [x for x in layers if x != c] for c in layers if len(layers) > 1} | {f"only_{c}": [c] for c in layers}
    auc = _on_test(train, test, presence, arms, **options)
    return train.sparkSession.createDataFrame([(n, auc[n]) for n in arms], "arm string, auc double")


def against_baseline(arms: DataFrame, arm: str = "arm", value: str = "auc", baseline: str = "baseline") -> DataFrame:
    """Adds delta to the baseline's value. A table of arms."""
    base = F.broadcast(arms.where(F.col(arm) == baseline).select(F.col(value).alias("__base")))
    return arms.crossJoin(base).withColumn("delta", F.col(value) - F.col("__base")).drop("__base")


def masked_arm(name: str, train: DataFrame, test: DataFrame, mask: DataFrame, on: list[str], presence: str, layers: list[str], **options) -> DataFrame:
    """(arm, auc, unmasked_auc): a fit on the rows of a mask's cells, and the fit on all, both scored on the test rows in the mask."""
    inside = mask.select(*on).distinct().withColumn("__inside", F.lit(True))
    both = train_and_test(train, test, [presence, *layers, *on]).join(inside, on, "left").withColumn("__inside", F.coalesce("__inside", F.lit(False)))
    sets = {"mask": F.col(TRAIN) & F.col("__inside"), "train": F.col(TRAIN)}
    scored_rows = ~F.col(TRAIN) & F.col("__inside")
    _, auc = run_arms(both, presence, {s: Fit(tuple(layers), s) for s in sets}, sets, {s: (s, scored_rows) for s in sets}, **options)
    return train.sparkSession.createDataFrame([(name, auc["mask"], auc["train"])], "arm string, auc double, unmasked_auc double")
