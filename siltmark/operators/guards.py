"""Assertions as small aggregations. Each returns what is wrong, or raises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GuardError(AssertionError):
    pass


def leaked(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys in both."""
    return train.select(key).intersect(test.select(key))


def assert_no_leakage(train: DataFrame, test: DataFrame, key: str) -> None:
    if not (both := leaked(train, test, key)).isEmpty():
        raise GuardError(f"{both.count()} rows are in training and test")


def assert_counts(**pairs: tuple[int, int]) -> None:
    if wrong := {k: p for k, p in pairs.items() if p[0] != p[1]}:
        raise GuardError(f"expected, actual: {wrong}")


def partition_faults(parts: DataFrame, whole: DataFrame, item: str) -> DataFrame:
    """(item, fault): items of several parts, of none, or unknown."""
    n = parts.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    all_ = whole.select(F.col(item).alias("__w")).distinct()
    joined = n.join(all_, F.col(item) == F.col("__w"), "full")
    fault = F.when(F.col("__w").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return joined.select(F.coalesce(item, "__w").alias(item), fault.alias("fault")).where("fault is not null")


def alignment(layers: DataFrame, grid: list[str]) -> DataFrame:
    """Of a table of layer descriptions: whether the grid columns agree for all."""
    return layers.agg(F.count(F.lit(1)).alias("layers"), F.count_distinct(F.struct(*grid)).alias("grids")).withColumn("aligned", F.col("grids") <= 1)


def missing_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing, share) from one pass."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)])
    return row.select("n", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(columns)]))).select("column", "missing", F.try_divide(F.col("missing").cast("double"), F.col("n").cast("double")).alias("share"))
