"""Presence-background models: a weighted logistic fit on linear and quadratic features, exact attributions, comparators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp01


@dataclass
class Additive:
    """Coefficients on features that are clamped to the range seen in training: by layer (lambda, low, high), for the square likewise, and by category."""

    linear: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    quadratic: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    categorical: dict[str, dict[float, float]] = field(default_factory=dict)
    #: what a fit tells of itself: presences, rows, objective, intercept, whether it converged
    fitted: dict = field(default_factory=dict, compare=False)

    @property
    def layers(self) -> list[str]:
        return sorted({*self.linear, *self.quadratic, *self.categorical})

    @classmethod
    def of(cls, rows: DataFrame) -> Additive:
        """From a coefficient table; features that aren't additive are an error."""
        out = cls()
        for r in rows.collect():
            if r["kind"] == "linear":
                out.linear[r["feature"]] = (r["lambda"], r["low"], r["high"])
            elif r["kind"] == "quadratic":
                out.quadratic[r["feature"]] = (r["lambda"], r["low"], r["high"])
            elif r["kind"] == "categorical":
                out.categorical.setdefault(r["feature"], {})[r["code"]] = r["lambda"]
            elif r["kind"] == "other":
                raise ValueError(f"{r['feature']} isn't additive")
        return out

    def contribution(self, layer: str) -> Column:
        """Of one layer to the linear predictor; an unknown category or layer adds 0."""
        if layer in self.categorical:
            out = F.lit(0.0)
            for code, value in self.categorical[layer].items():
                out = F.when(F.col(layer) == code, F.lit(value)).otherwise(out)
            return out
        v, out = F.col(layer).cast("double"), F.lit(0.0)
        for table, x in ((self.linear, v), (self.quadratic, v * v)):
            if layer in table:
                a, low, high = table[layer]
                out = out + a * clamp01(x, F.lit(low), F.lit(high))
        return out

    def predictor(self, layers: list[str] | None = None) -> Column:
        return sum((self.contribution(c) for c in layers or self.layers), F.lit(0.0))


def attributions(df: DataFrame, model: Additive, layers: list[str], background: DataFrame | None = None) -> DataFrame:
    """Adds phi_<layer>: the exact Shapley value of an additive model, the contribution less its mean over the background."""
    mean = (df if background is None else background).agg(*[F.avg(model.contribution(c)).alias(f"__m_{c}") for c in layers])
    return df.crossJoin(F.broadcast(mean)).withColumns({f"phi_{c}": model.contribution(c) - F.col(f"__m_{c}") for c in layers}).drop(*[f"__m_{c}" for c in layers])


def output(df: DataFrame, eta: Column, kind: str = "cloglog", background: DataFrame | None = None) -> DataFrame:
    """Adds raw, and suitability: raw = exp(eta) / Z over the background, cloglog = 1 - exp(-exp(H) raw), logistic = exp(H) raw / (1 + exp(H) raw)."""
    if kind not in ("raw", "cloglog", "logistic"):
        raise ValueError(kind)
    b = (df if background is None else background).select(eta.alias("e")).where("e is not null")
    top = F.broadcast(b.agg(F.max("e").alias("__top")))
    z = b.crossJoin(top).agg(F.sum(F.exp(F.col("e") - F.col("__top"))).alias("__z"), F.sum(F.exp(F.col("e") - F.col("__top")) * (F.col("e") - F.col("__top"))).alias("__ze"), F.first("__top").alias("__top"))
    z = F.broadcast(z.withColumn("__h", F.ln("__z") - F.col("__ze") / F.col("__z")))
    raw = F.exp(eta - F.col("__top")) / F.col("__z")
    scaled = F.exp("__h") * F.col("raw")
    value = {"raw": F.col("raw"), "cloglog": 1 - F.exp(-scaled), "logistic": scaled / (1 + scaled)}[kind]
    return df.crossJoin(z).withColumn("raw", raw).withColumn("suitability", value).drop("__z", "__ze", "__top", "__h")


#: Codes of a categorical layer at most, a term each; more are an error.
CODES = 1000


def fit_presence_background(df: DataFrame, presence: str, layers: list[str], categorical: list[str] = (), beta: float = 0.5, classes: str = "LQ", background_weight: float = 100.0, iterations: int = 100) -> Additive:
    """A point-process fit by logistic regression with heavily weighted background and an L1 penalty scaled by beta. For several fits of a table see fitting.fit_all."""
    from .fitting import Fit, fit_all

    return fit_all(df, presence, {"fit": Fit(tuple(layers), beta=beta, classes=classes)}, categorical=categorical, background_weight=background_weight, iterations=iterations)["fit"]


#: Columns that fit_comparator adds for estimators that ask for them, and the part of the training rows that only validate.
WEIGHT, VALIDATION, VALIDATION_PART = "__weight", "__validation", 0.2


def comparators(seed: int = 42):
    """Estimators by name: logistic regression, random forest, boosted trees.

    A tree is at most 30 levels deep in Spark. Boosting stops at the first round that doesn't lower the
    loss on the rows of VALIDATION; fit_comparator sets them, and the weights.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    return {
        "logistic_regression": LogisticRegression(regParam=0.01, maxIter=100),
        "random_forest": RandomForestClassifier(numTrees=500, featureSubsetStrategy="sqrt", minInstancesPerNode=5, maxDepth=30, weightCol=WEIGHT, seed=seed),
        "boosted_trees": GBTClassifier(maxIter=500, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, weightCol=WEIGHT, validationIndicatorCol=VALIDATION, validationTol=0.0, seed=seed),
    }


def fit_comparator(train: DataFrame, label: str, layers: list[str], estimator):
    """A fitted pipeline. Weights balance the classes of the rows that are fitted; rows that validate are drawn from train by a hash."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    asks = {p.name: v for p, v in estimator.extractParamMap().items()}
    if asks.get("validationIndicatorCol") == VALIDATION:
        train = train.withColumn(VALIDATION, F.pmod(F.xxhash64(*train.columns, F.lit("validation")), F.lit(1 << 30)) < int(VALIDATION_PART * (1 << 30)))
    if asks.get("weightCol") == WEIGHT:
        fitted = train.where(~F.col(VALIDATION)) if VALIDATION in train.columns else train
        counts = {r[0]: r[1] for r in fitted.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("double")).count().collect()}
        n = sum(counts.values())
        weight = F.lit(1.0)
        for value, c in counts.items():
            weight = F.when(F.col(label).cast("double") == value, n / (len(counts) * c)).otherwise(weight)
        train = train.withColumn(WEIGHT, weight)
    stages = [VectorAssembler(inputCols=layers, outputCol="raw_features", handleInvalid="skip"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)]
    estimator = estimator.copy({estimator.getParam("labelCol"): label})
    return Pipeline(stages=[*stages, estimator]).fit(train)


def probability(model, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn("y_score", F.get(vector_to_array("probability"), F.lit(1))).drop("raw_features", "features", "rawPrediction", "probability", "prediction")


def permuted(df: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """df with one column dealt anew by a hash order: the value of the row after it in its bucket of the hash, so no task sees the whole column. There are as many buckets as shuffle partitions, 64 at least."""
    from pyspark.sql import Window

    from .sampling import draw

    h = draw(F.col(key), seed)
    buckets = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    w = Window.partitionBy(F.pmod(h, F.lit(buckets))).orderBy(h, key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("__v", F.coalesce(F.lead(column).over(w), F.first(column).over(whole))).drop(column).withColumnRenamed("__v", column)


#: Rows that one round of permutation_importance deals, about.
DEALT = 10_000_000


def permutation_importance(model, test: DataFrame, label: str, layers: list[str], key: str, seed: int = 42, repeats: int = 10, dealt_rows: int = DEALT) -> DataFrame:
    """(layer, drop): the AUC lost where the layer is permuted, on average over repeats. Rows that are equal in every permuted copy of the test rows, and in these as they are, are counted and scored once; the test rows are kept meanwhile.

    Copies are dealt in rounds of about ``dealt_rows`` rows, one copy at least, and what a round counted is settled: its shuffle files go before the next.
    The key is no input of the model.
    """
    from .fitting import ROWS
    from .metrics import auc
    from .rounds import release, settled, shuffles_removed

    test = test.persist()
    dealt, inputs = layers * repeats, [c for c in test.columns if c != key]

    def of(copy: DataFrame, i: int) -> DataFrame:
        return copy.groupBy(*inputs).agg(F.count("*").alias(ROWS)).withColumn("__copy", F.lit(i))

    step = max(1, dealt_rows // max(1, test.count()))
    rounds = []
    for lo in range(-1, len(dealt), step):
        copies = None
        for i in range(lo, min(lo + step, len(dealt))):
            one = of(test if i < 0 else permuted(test, dealt[i], key, seed + i), i)
            copies = one if copies is None else copies.unionByName(one)
        with shuffles_removed(test.sparkSession):
            rounds.append(settled(copies))
    test.unpersist()
    copies = rounds[0]
    for r in rounds[1:]:
        copies = copies.unionByName(r)
    # each distinct row once, whatever the number of copies that hold it
    copies = copies.groupBy(*inputs).agg(F.collect_list(F.struct("__copy", ROWS)).alias("__in"))
    scored = probability(model, copies).select(label, "y_score", F.inline("__in"))
    found = {r["__copy"]: r["auc"] for r in auc(scored, label, "y_score", ["__copy"], ROWS).collect()}
    release(*rounds)
    drops = [(c, None if None in (found.get(-1), found.get(i)) else found[-1] - found[i]) for i, c in enumerate(dealt)]
    return test.sparkSession.createDataFrame(drops, "layer string, drop double").groupBy("layer").agg(F.avg("drop").alias("drop"))


def response_curve(model: Additive, means: DataFrame, layer: str, low: float, high: float, steps: int = 50) -> DataFrame:
    """(x, eta) over a layer's range with the other layers at their means (a one-row table)."""
    grid = means.sparkSession.range(steps + 1).select((F.lit(low) + F.col("id") * (high - low) / steps).alias("x"))
    others = means.drop(layer)
    at = grid.crossJoin(F.broadcast(others)).withColumn(layer, F.col("x"))
    return at.select("x", model.predictor().alias("eta"))
