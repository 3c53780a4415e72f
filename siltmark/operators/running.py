"""Running totals over a whole table without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a range, about, ranges that a table has at most where there are fewer shuffle partitions, and rows of the sample for each range.
ROWS, PARTS, SAMPLE = 100_000, 64, 200
#: Entries that are compared at a time in a sorted array.
STEP = 16


def count_below(sorted_: Column, value: Column, or_equal: bool = False) -> Column:
    """Number of entries of a sorted array that are less than value (or equal): first by every STEP-th entry, then within one step."""
    under = (lambda c: c <= value) if or_equal else (lambda c: c < value)
    whole = F.size(F.filter(sorted_, lambda c, i: (i % STEP == STEP - 1) & under(c))) * STEP
    return whole + F.size(F.filter(F.slice(sorted_, whole + 1, STEP), under))


def _cuts(df: DataFrame, order: str, within: list[str], n: int, parts: int) -> DataFrame:
    """(within as __w0, .., __cuts): where ranges of a group begin, at about as many rows in every group, from a hash sample of SAMPLE rows for each range."""
    rate = min(1.0, SAMPLE * parts / n)
    h = F.pmod(F.xxhash64(*within, order, F.lit("cut")), F.lit(1 << 30))
    drawn = df.where(h < int(rate * (1 << 30))).select(*[F.col(w).alias(f"__w{i}") for i, w in enumerate(within)], F.col(order).cast("double").alias("__at"))
    found: dict[tuple, list[float]] = {}
    for r in drawn.collect():
        found.setdefault(tuple(r)[:-1], []).append(r[-1])
    step = max(1, round(rate * n / parts))
    cuts = [(*g, sorted(v)[step::step]) for g, v in found.items() if len(v) > step]
    schema = T.StructType([*drawn.schema.fields[:-1], T.StructField("__cuts", T.ArrayType(T.DoubleType()))])
    return df.sparkSession.createDataFrame(cuts, schema)


def cuts_of(df: DataFrame, order: str, parts: int) -> list[float]:
    """Values that cut a column into about so many ranges of about as many rows, from a hash sample of SAMPLE rows for each."""
    n = df.count()
    found = _cuts(df, order, [], n, parts).collect() if n else []
    return sorted(set(found[0]["__cuts"])) if found else []


def running_sums(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False, within: list[str] | None = None, parts: int | None = None, rows: int = ROWS) -> DataFrame:
    """Adds for each (name: column) of sums the total up to and including the row in the order.

    The order must be numeric and distinct within each group of ``within``, so group equal
    values first. One count tells how many ranges of about ``rows`` rows there are (at most ``parts``, by default
    as many as shuffle partitions). A table of one range is a window for each group. Of others a sample
    of SAMPLE rows for each range, which is all that reaches the driver, divides the groups; totals of
    ranges are added to the totals within a range, which are windows partitioned by range, so no task holds a large group.
    """
    within = within or []
    n = df.count()
    parts = min(parts or max(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-n // rows))
    direction = F.col(order).desc() if descending else F.col(order).asc()
    if parts <= 1:
        whole = Window.partitionBy(*within).orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(whole).alias(name) for name, c in sums.items()])
    # at most as many cuts as ranges
    cuts = F.broadcast(_cuts(df, order, within, n, parts))
    same = [F.col(w).eqNullSafe(F.col(f"__w{i}")) for i, w in enumerate(within)]
    ranged = df.join(cuts, same, "left").drop(*[f"__w{i}" for i in range(len(within))]) if within else df.join(cuts, F.lit(True), "left")
    none = F.array().cast("array<double>")
    sign = -1 if descending else 1
    ranged = ranged.withColumn("__range", sign * count_below(F.coalesce("__cuts", none), F.col(order).cast("double"), or_equal=True)).drop("__cuts")
    earlier = Window.partitionBy(*within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*within, "__range").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    totals = totals.select(*within, "__range", *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy(*within, "__range").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()])
    # one row for each group and range
    if within:
        totals = totals.select(*[F.col(w).alias(f"__w{i}") for i, w in enumerate(within)], F.col("__range").alias("__r"), *[f"__{n}" for n in sums])
        out = out.join(totals, [*same, F.col("__range") == F.col("__r")]).drop("__r", *[f"__w{i}" for i in range(len(within))])
    else:
        out = out.join(totals, "__range")
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.col(f"__{n}"))
    return out.drop("__range", *[f"__{n}" for n in sums])


def average_ranks(df: DataFrame, value: str, within: list[str] | None = None, into: str = "avg_rank") -> DataFrame:
    """(within, value, n, avg_rank): ranks of the distinct values, ties sharing their mean."""
    within = within or []
    n = df.groupBy(*within, value).agg(F.count(F.lit(1)).alias("n"))
    return running_sums(n, value, {"upto": "n"}, within=within).select(*within, value, "n", (F.col("upto") - (F.col("n") - 1) / 2.0).alias(into))


def quantiles(df: DataFrame, value: str, probabilities: list[float], within: list[str] | None = None, into: str = "quantiles", rows: str | None = None) -> DataFrame:
    """(within, into): exact linear quantiles of each group, as an array.

    Values are counted, ranked by running totals, and only those at the needed ranks are gathered,
    so no task holds a group's values. Nulls don't count; a table without values gives nulls. rows: a column that tells how many rows one stands for.
    """
    within = within or []
    n = df.where(F.col(value).isNotNull()).groupBy(*within, F.col(value).cast("double").alias("__v")).agg((F.sum(rows) if rows else F.count(F.lit(1))).alias("__n"))
    run = running_sums(n, "__v", {"__upto": "__n"}, within=within)
    asked = F.array(*[F.lit(float(p)) for p in probabilities])
    whole = F.sum("__n").alias("__total")
    ranks = F.array_distinct(F.flatten(F.transform(asked, lambda p: F.array(F.floor(p * (F.col("__total") - 1)), F.ceil(p * (F.col("__total") - 1)))))).alias("__ranks")
    if within:
        total = n.groupBy(*[F.col(w).alias(f"__w{i}") for i, w in enumerate(within)]).agg(whole).select("*", ranks)
        joined = run.join(total, [F.col(w).eqNullSafe(F.col(f"__w{i}")) for i, w in enumerate(within)]).drop(*[f"__w{i}" for i in range(len(within))])
    else:
        joined = run.crossJoin(F.broadcast(n.agg(whole).select("*", ranks)))  # one row
    held = F.filter("__ranks", lambda r: (r >= F.col("__upto") - F.col("__n")) & (r < F.col("__upto")))
    found = joined.select(*within, "__total", "__v", F.explode(held).alias("__r"))
    # two entries for each probability
    by = found.groupBy(*within).agg(F.map_from_entries(F.collect_list(F.struct("__r", "__v"))).alias("__m"), F.first("__total").alias("__total"))

    def between(p: Column) -> Column:
        x = p * (F.col("__total") - 1)
        a, b = F.try_element_at("__m", F.floor(x)), F.try_element_at("__m", F.ceil(x))
        return F.when(a == b, a).otherwise((F.ceil(x) - x) * a + (x - F.floor(x)) * b)

    return by.select(*within, F.transform(asked, between).alias(into))
