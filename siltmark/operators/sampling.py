"""Deterministic sampling, splits, folds and de-duplication.

Every draw is ordered by a hash of a seed and the row's key, so it doesn't depend on
partitioning, and a row's fate doesn't depend on other rows' order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import quantiles, running_sums


def draw(key: Column, seed: int | str = 42) -> Column:
    """A number in 0 .. 2**60 - 1 from the key and the seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 15), 16, 10).cast("long")


def first_by_draw(df: DataFrame, n: int, key: str, seed: int | str = 42) -> DataFrame:
    """n rows without replacement."""
    return df.withColumn("__draw", draw(F.col(key), seed)).orderBy("__draw", key).limit(n).drop("__draw")


#: Bits of a draw that count rows by a coarse bucket.
_COARSE = 16


def _last_draw(drawn: DataFrame, fraction: float) -> int:
    """The draw (column __draw) of the row in place round(n * fraction), half to even: from the counts of coarse buckets, which reach the driver, and the rows of one of them. -2 where there is none."""
    coarse = F.shiftright("__draw", 60 - _COARSE)
    counts = {r[0]: r[1] for r in drawn.groupBy(coarse.alias("b")).count().collect()}
    want, bucket = round(sum(counts.values()) * fraction), None
    for bucket in sorted(counts):
        if want <= counts[bucket]:
            break
        want -= counts[bucket]
    if bucket is None or want <= 0:
        return -2 if bucket is None or bucket == min(counts) else (bucket << (60 - _COARSE)) - 1
    return drawn.where(coarse == bucket).select("__draw").orderBy("__draw").limit(want).agg(F.max("__draw")).first()[0]


def holdout_split(df: DataFrame, key: str, fraction: float = 0.3, seed: int | str = 42) -> DataFrame:
    """Adds is_test: the first round(n * fraction) rows by draw, half to even. Keys must be distinct; rows of one key go together."""
    drawn = F.coalesce(draw(F.col(key), seed), F.lit(-1))
    return df.withColumn("is_test", drawn <= _last_draw(df.select(drawn.alias("__draw")), fraction))


def stratified_split(df: DataFrame, key: str, stratum: str, fraction: float = 0.2, seed: int | str = 42) -> DataFrame:
    """The same within each stratum."""
    drawn = df.withColumn("__draw", draw(F.col(key), seed)).withColumn("__one", F.lit(1).cast("long"))
    n = df.groupBy(stratum).agg(F.bround(F.count(F.lit(1)) * F.lit(fraction)).cast("long").alias("__want"))
    placed = running_sums(drawn, "__draw", {"__place": "__one"}, within=[stratum])
    return placed.join(n, stratum).withColumn("is_test", F.col("__place") <= F.col("__want")).drop("__draw", "__one", "__place", "__want")


def cell(x: Column, y: Column, size: float, x0: float = 0.0, y0: float = 0.0) -> tuple[Column, Column]:
    """(row, col) by floor division; rows count up with y."""
    return F.floor((y - y0) / size).cast("long"), F.floor((x - x0) / size).cast("long")


def first_of_cell(df: DataFrame, row: str, col: str, order: str) -> DataFrame:
    """The first row of each cell in the given order."""
    keep = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.col(order)).alias("__kept")
    return df.groupBy(row, col).agg(keep).select("__kept.*")


def thin(df: DataFrame, x: str, y: str, key: str, size: float = 30.0, seed: int | str = 42, within: list[str] | None = None) -> DataFrame:
    """One row of each cell (of each group), drawn."""
    r, c = cell(F.col(x), F.col(y), size)
    keep = F.min_by(F.struct(*[F.col(k) for k in df.columns]), F.struct(draw(F.col(key), seed), F.col(key))).alias("__kept")
    return df.groupBy(*(within or []), r.alias("__r"), c.alias("__c")).agg(keep).select("__kept.*")


def block_codes(df: DataFrame, x: str, y: str, size: float = 2000.0, into: str = "fold") -> DataFrame:
    """Adds the code of the block 'bx_by' among all blocks in string order, from 0."""
    name = F.concat_ws("_", F.floor(F.col(x) / size).cast("long"), F.floor(F.col(y) / size).cast("long"))
    named = df.withColumn("__block", name)
    # one row for each block
    codes = named.select("__block").distinct().withColumn(into, (F.row_number().over(Window.orderBy("__block")) - 1).cast("long"))
    return named.join(codes, "__block").drop("__block")


def merge_small_blocks(df: DataFrame, x: str, y: str, block: str, least: int = 3) -> DataFrame:
    """Replaces blocks of fewer than ``least`` rows by the large block with the nearest centroid.

    Of equal distances the more populous block counts, then the smaller code. All blocks small: all null.
    """
    centre = df.groupBy(block).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.count(F.lit(1)).alias("n"))
    large = centre.where(F.col("n") >= least).select(F.col(block).alias("__to"), F.col("cx").alias("lx"), F.col("cy").alias("ly"), F.col("n").alias("ln"))
    small = centre.where(F.col("n") < least)
    d2 = F.pow(F.col("cx") - F.col("lx"), F.lit(2)) + F.pow(F.col("cy") - F.col("ly"), F.lit(2))
    # blocks with blocks: one row each, not points
    to = small.join(large, F.lit(True), "left").groupBy(block).agg(F.min_by("__to", F.struct(d2, -F.col("ln"), "__to")).alias("__to"))
    out = df.join(to, block, "left").join(large.select(F.col("__to").alias("__l")).distinct(), F.col(block) == F.col("__l"), "left")
    return out.withColumn(block, F.when(F.col("__l").isNotNull(), F.col(block)).otherwise(F.col("__to"))).drop("__to", "__l")


def quantile_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    """One row: edges, the distinct linear quantiles at k / bins."""
    return quantiles(df, value, [k / bins for k in range(bins + 1)], into="edges").select(F.array_distinct("edges").alias("edges"))


def bin_left(edges: Column, value: Column) -> Column:
    """Number of the half-open bin [edge, next), clipped to the first and last."""
    k = F.size(F.filter(edges, lambda e: e <= value)) - 1
    return F.greatest(F.lit(0), F.least(k, F.size(edges) - 2)).cast("long")


def bin_right(edges: Column, value: Column) -> Column:
    """Number of the bin (edge, next], the first closed on both sides."""
    return F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: e < value)) - 1).cast("long")


def matched_background(presence: DataFrame, pool: DataFrame, value: str, key: str, n: int, bins: int = 10, seed: int | str = 42) -> DataFrame:
    """A sample of pool with the distribution of presence over quantile bins of value."""
    edges = F.broadcast(quantile_edges(presence, value, bins))
    binned = presence.crossJoin(edges).groupBy(bin_left(F.col("edges"), F.col(value)).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    total = F.broadcast(presence.agg(F.count(F.lit(1)).alias("total")))
    want = binned.crossJoin(total).select("bin", F.bround(n * F.col("c") / F.col("total")).cast("long").alias("want"))
    drawn = pool.crossJoin(edges).withColumn("bin", bin_left(F.col("edges"), F.col(value))).drop("edges").withColumn("__draw", draw(F.col(key), seed)).withColumn("__one", F.lit(1).cast("long"))
    placed = running_sums(drawn, "__draw", {"__place": "__one"}, within=["bin"])
    return placed.join(F.broadcast(want), "bin").where(F.col("__place") <= F.col("want")).drop("__draw", "__one", "__place", "want")


def top_groups(df: DataFrame, group: str, n: int) -> DataFrame:
    """The n most frequent values, ties in order of the value."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(group)).limit(n)
