"""Evaluation of scores against labels, and of masks against masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import count_below, running_sums


def by_score(df: DataFrame, y: str = "y_true", score: str = "y_score", within: list[str] | None = None, rows: str | None = None) -> DataFrame:
    """(within, score, n, pos): rows and positives of each distinct score. Null labels and scores go. rows: how many rows one stands for."""
    n = F.col(rows) if rows else F.lit(1)
    known = df.where(F.col(y).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return known.groupBy(*(within or []), F.col(score).cast("double").alias("score")).agg(F.sum(n).alias("n"), F.sum(F.col(y).cast("long") * n).alias("pos"))


def auc(df: DataFrame, y: str = "y_true", score: str = "y_score", within: list[str] | None = None, rows: str | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counting half; null where a class is empty. rows: how many rows one stands for."""
    within = within or []
    run = running_sums(by_score(df, y, score, within, rows), "score", {"cum": "n"}, within=within)
    rank = F.col("cum") - (F.col("n") - 1) / 2.0
    out = run.groupBy(*within).agg(F.sum("pos").alias("n_pos"), (F.sum("n") - F.sum("pos")).alias("n_neg"), F.sum(F.col("pos") * rank).alias("ranks"))
    area = F.try_divide(F.col("ranks") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0, (F.col("n_pos") * F.col("n_neg")).cast("double"))
    return out.select(*within, "n_pos", "n_neg", area.alias("auc"))


def roc_points(df: DataFrame, y: str = "y_true", score: str = "y_score", within: list[str] | None = None) -> DataFrame:
    """(threshold, tp, fp, n_pos, n_neg): counts at score >= threshold for each distinct score."""
    within = within or []
    grouped = by_score(df, y, score, within)
    run = running_sums(grouped.withColumn("neg", F.col("n") - F.col("pos")), "score", {"tp": "pos", "fp": "neg"}, descending=True, within=within)
    total = grouped.groupBy(*within).agg(F.sum("pos").alias("n_pos"), (F.sum("n") - F.sum("pos")).alias("n_neg"))
    # one row without groups; with groups the size of their table decides whether it is broadcast
    joined = run.join(total, within) if within else run.crossJoin(F.broadcast(total))
    return joined.select(*within, F.col("score").alias("threshold"), "tp", "fp", "n_pos", "n_neg")


def youden_threshold(df: DataFrame, y: str = "y_true", score: str = "y_score", within: list[str] | None = None) -> DataFrame:
    """The threshold that maximises TPR - FPR; of ties the highest."""
    within = within or []
    j = F.try_divide(F.col("tp").cast("double"), F.col("n_pos").cast("double")) - F.try_divide(F.col("fp").cast("double"), F.col("n_neg").cast("double"))
    points = roc_points(df, y, score, within).withColumn("j", j)
    return points.groupBy(*within).agg(F.max_by("threshold", F.struct("j", "threshold")).alias("threshold"), F.max("j").alias("tss"))


def average_precision(df: DataFrame, y: str = "y_true", score: str = "y_score", within: list[str] | None = None) -> DataFrame:
    """Step sum of precision over the distinct thresholds."""
    within = within or []
    run = running_sums(by_score(df, y, score, within), "score", {"cum_n": "n", "cum_pos": "pos"}, descending=True, within=within)
    gain = F.col("pos") * F.col("cum_pos") / F.col("cum_n")
    return run.groupBy(*within).agg(F.try_divide(F.sum(gain), F.sum("pos").cast("double")).alias("average_precision"))


def brier(y: Column, score: Column) -> Column:
    return F.avg(F.pow(score - y, F.lit(2.0)))


def _or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(y: Column, flagged: Column) -> list[Column]:
    return [
        F.count_if((y == 1) & flagged).alias("tp"),
        F.count_if((y == 0) & ~flagged).alias("tn"),
        F.count_if((y == 0) & flagged).alias("fp"),
        F.count_if((y == 1) & ~flagged).alias("fn"),
    ]


def derived_metrics(df: DataFrame) -> DataFrame:
    """Adds the metrics that follow from tp, tn, fp, fn. A zero denominator gives 0."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    sens, spec, prec = _or_zero(tp, tp + fn), _or_zero(tn, tn + fp), _or_zero(tp, tp + fp)
    expected = _or_zero((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    kappa = _or_zero(_or_zero(tp + tn, n) - expected, 1 - expected)
    hss = _or_zero(2 * (tp * tn - fp * fn), (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))
    return df.select(
        "*",
        sens.alias("sensitivity"),
        spec.alias("specificity"),
        prec.alias("precision"),
        (sens + spec - 1).alias("tss"),
        _or_zero(2 * prec * sens, prec + sens).alias("f1"),
        kappa.alias("kappa"),
        hss.alias("hss"),
        _or_zero(tp + fp, n).alias("pred_frac"),
    )


def threshold_metrics(df: DataFrame, threshold: Column | float, y: str = "y_true", score: str = "y_score", within: list[str] | None = None) -> DataFrame:
    """Counts and metrics of flagging score >= threshold (a number, or a column constant in each group)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return derived_metrics(df.groupBy(*(within or [])).agg(*confusion(F.col(y), F.col(score) >= t)))


def overlap(df: DataFrame, predicted: str, reference: str, valid: str | None = None, within: list[str] | None = None) -> DataFrame:
    """Of two masks over cells: counts, IoU, hit rate, precision, F1. A zero denominator gives null."""
    rows = df.where(F.col(valid)) if valid else df
    p, r = F.coalesce(F.col(predicted), F.lit(False)), F.coalesce(F.col(reference), F.lit(False))
    c = rows.groupBy(*(within or [])).agg(F.count_if(p & r).alias("tp"), F.count_if(p & ~r).alias("fp"), F.count_if(~p & r).alias("fn"), F.count_if(~p & ~r).alias("tn"))
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    hit, prec = F.try_divide(tp, tp + fn), F.try_divide(tp, tp + fp)
    return c.select("*", F.try_divide(tp, tp + fp + fn).alias("iou"), hit.alias("hit_rate"), prec.alias("precision"), F.try_divide(2 * hit * prec, hit + prec).alias("f1"))


def rates_at(df: DataFrame, thresholds: DataFrame, value: str, is_presence: str) -> DataFrame:
    """For each threshold t: the share of presences and the share of all other rows with value >= t.

    The distinct thresholds divide the values into steps; rows are counted by step first, so
    that the join is of steps with steps. thresholds: one column t, a bounded list.
    """
    t = thresholds.select(F.col("t").cast("double")).distinct()
    ladder = t.agg(F.array_sort(F.collect_list("t")).alias("__ladder"))
    stepped = df.crossJoin(F.broadcast(ladder)).select(count_below(F.col("__ladder"), F.col(value), or_equal=True).alias("step"), F.col(is_presence).alias("p"))
    counts = stepped.groupBy("step").agg(F.count_if("p").alias("presence"), F.count_if(~F.col("p")).alias("area"))
    rungs = ladder.select(F.posexplode("__ladder").alias("k", "t"))
    total = counts.agg(F.sum("presence").alias("np"), F.sum("area").alias("na"))
    above = rungs.join(counts, F.col("step") > F.col("k"), "left").groupBy("t").agg(F.coalesce(F.sum("presence"), F.lit(0)).alias("p"), F.coalesce(F.sum("area"), F.lit(0)).alias("a"))
    return above.crossJoin(total).select("t", F.try_divide(F.col("p").cast("double"), F.col("np").cast("double")).alias("success_rate"), F.try_divide(F.col("a").cast("double"), F.col("na").cast("double")).alias("area_rate"))


def capture(df: DataFrame, in_mask: str, is_point: str) -> DataFrame:
    """Area share of a mask over cells, points inside, and capture per area."""
    c = df.agg(F.count_if(F.col(in_mask) & ~F.col(is_point)).alias("m"), F.count_if(~F.col(is_point)).alias("cells"), F.count_if(F.col(in_mask) & F.col(is_point)).alias("hits"), F.count_if(F.col(is_point)).alias("points"))
    area, caught = F.try_divide(F.col("m").cast("double"), F.col("cells").cast("double")), F.try_divide(F.col("hits").cast("double"), F.col("points").cast("double"))
    return c.select(area.alias("area_fraction"), "hits", "points", caught.alias("captured"), F.try_divide(caught, area).alias("capture_per_area"))
