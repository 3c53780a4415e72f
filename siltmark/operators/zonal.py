"""Statistics of cells by zone, and indices over zone tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import quantiles
from .sampling import bin_right, quantile_edges
from .stats import adjusted_p, spearman


def zonal_mean(cells: DataFrame, zone: str, value: str, least: int = 50) -> DataFrame:
    """Mean of the cells present in each zone, null where fewer than ``least``, and their count."""
    n = F.count(value)
    return cells.groupBy(zone).agg(n.alias("n"), F.when(n >= least, F.avg(value)).alias("mean"))


def zonal_weighted(cells: DataFrame, zone: str, value: str, where: Column, weight: str, least: int = 50) -> DataFrame:
    """Mean over the cells that ``where`` takes, and the mean weighted by weight; null where fewer than ``least`` cells or no weight."""
    v = F.when(where, F.col(value))
    both = F.when(F.col(value).isNotNull(), F.col(weight))
    n = F.count(value)
    return cells.groupBy(zone).agg(n.alias("n"), F.count(v).alias("n_taken"), F.when(F.count(v) >= least, F.avg(v)).alias("mean_taken"), F.when(n >= least, F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(both).cast("double"))).alias("weighted_mean"))


def z_score(value: str) -> Column:
    """Over the whole table of zones, by the sample's deviation; null where that is 0."""
    every = Window.partitionBy(F.lit(1))
    return F.try_divide(F.col(value) - F.avg(value).over(every), F.stddev_samp(value).over(every))


def index_of(df: DataFrame, values: list[str], into: str) -> DataFrame:
    """Mean of the z-scores that are present."""
    from ..functions.scalars import row_mean

    scored = df.select("*", *[z_score(v).alias(f"__{v}") for v in values])
    return scored.withColumn(into, row_mean(*[F.col(f"__{v}") for v in values])).drop(*[f"__{v}" for v in values])


def quantile_groups(df: DataFrame, by: str, value: str, groups: int = 5) -> DataFrame:
    """Rows cut by linear quantiles of ``by`` into right-closed bins: n, mean and quartiles of value."""
    rows = df.where(F.col(by).isNotNull() & F.col(value).isNotNull())
    edges = F.broadcast(quantile_edges(rows, by, groups))
    put = rows.crossJoin(edges).withColumn("bin", bin_right(F.col("edges"), F.col(by)))
    quartiles = quantiles(put, value, [0.25, 0.75], ["bin"]).select("bin", F.col("quantiles")[0].alias("q25"), F.col("quantiles")[1].alias("q75"))
    return put.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).join(quartiles, "bin")


def rank_correlations(df: DataFrame, target: str, families: dict[str, str], least: int = 5) -> DataFrame:
    """(variable, family, n, rho, t): rank correlation of each variable with the target; t with n - 2 degrees for its p-value."""
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(f).alias("family"), F.col(v).cast("double").alias("x")) for v, f in families.items()])
    long = df.select(F.col(target).cast("double").alias("y"), F.inline(cells))
    rho = spearman(long, "x", "y", ["variable", "family"]).where(F.col("n") >= least)
    return rho.withColumn("t", F.col("rho") * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), 1 - F.col("rho") * F.col("rho")))).withColumn("df", F.col("n") - 2)


def corrected_correlations(df: DataFrame, target: str, families: dict[str, str], least: int = 5, alpha: float = 0.05) -> DataFrame:
    from .stats import with_tails

    p = with_tails(rank_correlations(df, target, families, least), "t", "t", "df")
    out = adjusted_p(p, "p", ["family"], "variable")
    return out.withColumn("significant_holm", F.col("p_holm") < alpha).withColumn("significant_bh", F.col("p_bh") < alpha)
