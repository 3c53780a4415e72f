"""Association, corrected significance and spatial autocorrelation."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from . import permuting
from .rounds import release, settled
from .running import average_ranks


def adjusted_p(df: DataFrame, p: str, family: list[str], key: str) -> DataFrame:
    """Adds p_holm, p_bh and p_bonferroni within each family. A family is a set of tests, of a few rows."""
    w = Window.partitionBy(*family)
    up = w.orderBy(p, key)
    m = F.count(p).over(w)
    k = F.row_number().over(up)
    ranked = df.withColumn("__m", m).withColumn("__k", k)
    holm = F.max((F.col("__m") - F.col("__k") + 1) * F.col(p)).over(up.rowsBetween(Window.unboundedPreceding, 0))
    bh = F.min(F.col(p) * F.col("__m") / F.col("__k")).over(up.rowsBetween(0, Window.unboundedFollowing))
    one = F.lit(1.0)
    return ranked.select(*df.columns, F.least(one, holm).alias("p_holm"), F.least(one, bh).alias("p_bh"), F.least(one, F.col(p) * F.col("__m")).alias("p_bonferroni"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs of columns, from one aggregation over complete pairs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(cells))


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """As a matrix on the driver; its size is that of the column list."""
    at = {c: i for i, c in enumerate(columns)}
    out = np.eye(len(columns))
    for a, b, r in correlations(df, columns).collect():
        out[at[a], at[b]] = out[at[b], at[a]] = math.nan if r is None else r
    return out


def variance_inflation(matrix: np.ndarray) -> np.ndarray:
    """Of each column: the diagonal of the inverse of the correlation matrix."""
    return np.diag(np.linalg.inv(matrix))


def choose_of_pair(a: str, b: str, names: list[str], matrix: np.ndarray, prefer: dict[frozenset, str] | None = None) -> str:
    """Which of two correlated columns goes: as preferred, else the one more correlated with the others on average, else the later by name."""
    if prefer and frozenset((a, b)) in prefer:
        return prefer[frozenset((a, b))]

    def burden(x: str) -> float:
        i = names.index(x)
        rest = [abs(matrix[i, j]) for j, n in enumerate(names) if n not in (a, b)]
        return sum(rest) / len(rest) if rest else 0.0

    x, y = burden(a), burden(b)
    return max(a, b) if x == y else (a if x > y else b)


def screen(df: DataFrame, columns: list[str], most_r: float = 0.8, most_vif: float = 10.0, prefer: dict[frozenset, str] | None = None) -> tuple[list[str], dict[str, str]]:
    """Columns kept, and for each dropped one the stage. Pairs go in falling |r|; then the highest inflation goes until none is over the limit."""
    matrix = correlation_matrix(df, columns)
    dropped: dict[str, str] = {}
    strong = sorted(((abs(matrix[i, j]), a, b) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j and abs(matrix[i, j]) >= most_r), key=lambda x: (-x[0], x[1], x[2]))
    for _, a, b in strong:
        if a not in dropped and b not in dropped:
            dropped[choose_of_pair(a, b, columns, matrix, prefer)] = "pearson"
    kept = [c for c in columns if c not in dropped]
    while len(kept) > 1:
        at = [columns.index(c) for c in kept]
        vif = variance_inflation(matrix[np.ix_(at, at)])
        worst = int(np.argmax(vif))
        if vif[worst] <= most_vif:
            break
        dropped[kept.pop(worst)] = "vif"
    return kept, dropped


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, n, rows, columns and V of the cross table of complete rows, without correction."""
    table = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("o"))
    ra, rb = table.groupBy("a").agg(F.sum("o").alias("r")), table.groupBy("b").agg(F.sum("o").alias("c"))
    share = table.join(ra, "a").join(rb, "b").agg(F.sum(F.col("o") * F.col("o") / (F.col("r").cast("double") * F.col("c"))).alias("s"), F.sum("o").alias("n"))
    size = ra.agg(F.count(F.lit(1)).alias("n_a")).crossJoin(rb.agg(F.count(F.lit(1)).alias("n_b")))
    out = share.crossJoin(size).withColumn("chi2", F.col("n") * (F.col("s") - 1))
    least = F.least("n_a", "n_b") - 1
    return out.select("n", "n_a", "n_b", "chi2", F.sqrt(F.try_divide(F.col("chi2"), (F.col("n") * least).cast("double"))).alias("v"))


def mann_whitney(df: DataFrame, value: str, group: str, within: list[str] | None = None) -> DataFrame:
    """U of group = 1 against group = 0, rank-biserial r = 2 U / (n1 n0) - 1, the tie-corrected z with continuity correction, and direction (higher if r > 0)."""
    within = within or []
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    ranks = average_ranks(rows, value, within)
    ones = rows.groupBy(*within, value).agg(F.sum(F.col(group).cast("long")).alias("n1"))
    per = ranks.join(ones, [*within, value]).groupBy(*within).agg(F.sum("n1").alias("n1"), (F.sum("n") - F.sum("n1")).alias("n0"), F.sum(F.col("n1") * F.col("avg_rank")).alias("r1"), F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")).alias("ties"))
    n, pairs = (F.col("n1") + F.col("n0")).cast("double"), (F.col("n1") * F.col("n0")).cast("double")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    out = per.withColumn("u", u).withColumn("r", F.try_divide(2 * F.col("u"), pairs) - 1)
    sd = F.sqrt(pairs / 12.0 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(F.col("u") - pairs / 2.0) - 0.5, F.lit(0.0)), sd)
    return out.select(*within, "n1", "n0", "u", "r", z.alias("z"), F.when(F.col("r") > 0, "higher").otherwise("lower").alias("direction"))


def spearman(df: DataFrame, x: str, y: str, within: list[str] | None = None) -> DataFrame:
    """Rank correlation of complete pairs, ties with average ranks."""
    within = within or []
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*within, F.col(x).alias("x"), F.col(y).alias("y"))
    rx = average_ranks(rows, "x", within, "rx").drop("n")
    ry = average_ranks(rows, "y", within, "ry").drop("n")
    pairs = rows.groupBy(*within, "x", "y").agg(F.count(F.lit(1)).alias("w")).join(rx, [*within, "x"]).join(ry, [*within, "y"])
    w, a, b = F.col("w"), F.col("rx"), F.col("ry")
    s = pairs.groupBy(*within).agg(F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * b).alias("sab"), F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"))
    n = F.col("n").cast("double")
    top = n * F.col("sab") - F.col("sa") * F.col("sb")
    below = F.sqrt((n * F.col("saa") - F.col("sa") * F.col("sa")) * (n * F.col("sbb") - F.col("sb") * F.col("sb")))
    return s.select(*within, "n", F.try_divide(top, below).alias("rho"))


def with_tails(table: DataFrame, kind: str, statistic: str, df: str | None = None, into: str = "p") -> DataFrame:
    """Adds the p-value of a statistic (z, t with df, chi2 with df). The table is a result of few rows; values are computed in batches."""
    f = {"z": lambda s, _: tails.normal_two_sided(s), "t": tails.t_two_sided, "chi2": tails.chi2_sf}[kind]

    @F.pandas_udf("double")
    def p(s: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or math.isnan(a) else f(a, b) for a, b in zip(s, d, strict=True)], dtype="float64")

    return table.withColumn(into, p(F.col(statistic).cast("double"), F.col(df).cast("double") if df else F.lit(0.0)))


def with_quantiles(table: DataFrame, probability: float, df: str, into: str) -> DataFrame:
    """Adds the value that Student's t with df degrees is under with the probability. A table of few rows."""

    @F.pandas_udf("double")
    def q(d: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or math.isnan(a) or a <= 0 else tails.t_quantile(probability, a) for a in d], dtype="float64")

    return table.withColumn(into, q(F.col(df).cast("double")))


def mcnemar(scores: DataFrame, model: str, key: str, y: str, score: str, threshold: str) -> DataFrame:
    """For each pair of models: the rows that only the first, only the second has right, and chi2 with continuity correction; null where none."""
    right = scores.select(F.col(model).alias("m"), F.col(key).alias("k"), ((F.col(score) >= F.col(threshold)).cast("int") == F.col(y).cast("int")).alias("ok"))
    a, b = right.select(F.col("m").alias("model_a"), "k", F.col("ok").alias("oa")), right.select(F.col("m").alias("model_b"), "k", F.col("ok").alias("ob"))
    pairs = a.join(b, "k").where("model_a < model_b").groupBy("model_a", "model_b").agg(F.count_if(F.col("oa") & ~F.col("ob")).alias("b"), F.count_if(~F.col("oa") & F.col("ob")).alias("c"))
    chi2 = F.try_divide(F.pow((F.abs(F.col("b") - F.col("c")) - 1).cast("double"), F.lit(2.0)), (F.col("b") + F.col("c")).cast("double"))
    return pairs.withColumn("chi2", chi2)


def average_rank_in_fold(df: DataFrame, fold: str, value: str) -> Column:
    """Rank by falling value within a fold, ties with their mean. A fold holds one row for each model."""
    w = Window.partitionBy(fold)
    return F.rank().over(w.orderBy(F.desc(value))) + (F.count(F.lit(1)).over(Window.partitionBy(fold, value)) - 1) / 2.0


def friedman(df: DataFrame, fold: str, model: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Mean ranks by model, and chi2 with tie correction over folds that have all models."""
    k = df.select(model).distinct().agg(F.count(F.lit(1)).alias("k"))
    full = df.groupBy(fold).agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(k)).where("c = k").select(fold, "k")
    ranked = df.join(full, fold).withColumn("rk", average_rank_in_fold(df, fold, value))
    mean = ranked.groupBy(model).agg(F.avg("rk").alias("mean_rank"), F.count(F.lit(1)).alias("folds"), F.first("k").alias("k"), F.sum("rk").alias("total"))
    ties = ranked.groupBy(fold, value).agg(F.count(F.lit(1)).alias("t"), F.first("k").alias("k")).agg(F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).alias("ties"))
    s = mean.agg(F.sum(F.col("total") * F.col("total")).alias("s"), F.first("folds").alias("n"), F.first("k").alias("k")).crossJoin(ties)
    n, kk = F.col("n").cast("double"), F.col("k").cast("double")
    raw = 12.0 / (n * kk * (kk + 1)) * F.col("s") - 3 * n * (kk + 1)
    chi2 = F.try_divide(raw, 1 - F.col("ties") / (n * kk * (kk * kk - 1)))
    return mean.select(model, "mean_rank"), s.select(F.col("n").alias("folds"), F.col("k").alias("models"), chi2.alias("chi2"))


def corrected_t(df: DataFrame, difference: str, n_train: float, n_test: float, within: list[str] | None = None) -> DataFrame:
    """Nadeau-Bengio: t = mean / sqrt((1/k + n_test/n_train) var) and Cohen's d of paired differences. No variance: t is 0 or infinite."""
    s = df.groupBy(*(within or [])).agg(F.count(difference).alias("k"), F.avg(difference).alias("mean_diff"), F.stddev_samp(difference).alias("sd_diff"))
    scale = F.sqrt((1.0 / F.col("k") + n_test / n_train) * F.col("sd_diff") * F.col("sd_diff"))
    t = F.when(F.col("sd_diff") == 0, F.when(F.col("mean_diff") == 0, F.lit(0.0)).otherwise(F.signum("mean_diff") * F.lit(float("inf")))).otherwise(F.try_divide(F.col("mean_diff"), scale))
    return s.select("*", t.alias("t"), F.try_divide(F.col("mean_diff"), F.col("sd_diff")).alias("cohens_d"))


def points(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(i, x, y) of the rows whose coordinates are finite."""
    p = df.select(F.col(key).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return p.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))


#: Rows of a cell that are one key; a cell with more is divided.
CELL = 4096


def _cell(reach: float) -> tuple[Column, Column]:
    """The cell of x and y, a hair wider than reach: rounding puts no row within reach two cells away."""
    size = reach * (1 + 1e-9)
    return F.floor(F.col("x") / size), F.floor(F.col("y") / size)


def _met(asking: DataFrame, held: DataFrame, reach: float, cell: int, spread_asking: bool, square: bool = True) -> DataFrame:
    """asking's columns with those of held within reach, the distance d, and the cell of the meeting as cx, cy, part.

    Within reach is what lies in the circle and, with ``square``, between x - reach and x + reach (y likewise) as these are rounded: the two differ by
    a rounding only, where a coordinate differs by reach to the last digit.
    A row meets the rows of nine cells only, and either side is sent to the nine. Where held is, all that a row of asking meets has the same cx, cy
    and part. Rows of the other side in a cell with over ``cell`` of them are dealt to parts, so a dense cell isn't one task.
    """
    cx, cy = _cell(reach)
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("o")
    stay, go = (held, asking) if spread_asking else (asking, held)
    stay = stay.withColumns({"cx": cx, "cy": cy})
    go = go.select("*", around).withColumns({"cx": cx + F.col("o.a"), "cy": cy + F.col("o.b")}).drop("o")
    dense = stay.groupBy("cx", "cy").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    stay = stay.join(dense, ["cx", "cy"], "left").withColumn("part", F.pmod(F.xxhash64(*stay.columns), parts).cast("int")).drop("parts")
    go = go.join(dense, ["cx", "cy"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    p, q = (go, stay) if spread_asking else (stay, go)
    dx, dy = F.col("x") - F.col("xj"), F.col("y") - F.col("yj")
    squares = F.pow(dx, F.lit(2)) + F.pow(dy, F.lit(2))
    # of squares: a root rounds to reach from beyond it
    near = squares <= reach * reach
    if square:
        near = near & F.col("xj").between(F.col("x") - reach, F.col("x") + reach) & F.col("yj").between(F.col("y") - reach, F.col("y") + reach)
    return p.join(q.withColumnsRenamed({"x": "xj", "y": "yj"}), ["cx", "cy", "part"]).where(near).withColumn("d", F.sqrt(squares)).drop("xj", "yj")


def pairs_within(asking: DataFrame, held: DataFrame, reach: float, cell: int = CELL, square: bool = True) -> DataFrame:
    """(i, j, d): each of asking (i, x, y) with the rows of held (i, x, y) of another key within reach."""
    return _met(asking, held.withColumnRenamed("i", "j"), reach, cell, True, square).where("i <> j").select("i", "j", "d")


def _start(places: DataFrame, k: int, reach: float) -> float:
    """reach, halved until a cell holds about k places where it holds more: no more pairs are made than the k nearest need."""
    cx, cy = _cell(reach)
    n = places.groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.count("*").cast("double").alias("n"))
    crowd = n.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
    return reach / 2.0 ** min(40, max(0, math.floor(0.5 * math.log2(max(crowd, 1.0) / k))))


def _widened(asking: DataFrame, held: DataFrame, found_in: Callable[[DataFrame, DataFrame, float], DataFrame], done: Column, reach: float, most: float) -> DataFrame:
    """What found_in(asking, held, reach) gives with reach doubled, up to most, for those (x, y and the like) that aren't done."""
    out, keys, short = None, asking.columns, asking
    while True:
        part = settled(found_in(short, held, reach))
        final = part if reach >= most else part.where(done)
        out = final if out is None else out.unionByName(final)
        if reach >= most:
            return out
        left = settled(short.join(part.where(done).select(*[F.col(c).alias(f"__{c}") for c in keys]), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], "left_anti"))
        release(short)
        short = left
        if short.isEmpty():
            return out
        reach = min(2 * reach, most)


def _nearest(p: DataFrame, k: int, reach: float, most: float | None) -> DataFrame:
    """(i, j, d, n): the k nearest others of points (i, x, y) within most, or wherever they are.

    Rows of one place are one: its k + 1 smallest keys are all that can be among any row's nearest, and its k + 1 nearest rows hold the k
    nearest of each of its own. Places search as near as the crowd allows first, and only those that are short search wider.
    """
    first = p.withColumn("r", F.row_number().over(Window.partitionBy("x", "y").orderBy("i"))).where(F.col("r") <= k + 1)
    places = settled(first.groupBy("x", "y").agg(F.array_sort(F.collect_list("i")).alias("ids")))
    wide, high, rows = places.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.sum(F.size("ids"))).first()
    if most is None:
        most = max(reach, math.hypot(wide or 0.0, high or 0.0) * (1 + 1e-9))

    def found_in(asking: DataFrame, held: DataFrame, reach: float) -> DataFrame:
        few = asking is not all_ and asking.count() * 4 < n_places
        met = _met(asking, held, reach, CELL, few)
        # of places at most k + 1, of their rows likewise
        at = ["x", "y"] if few else ["cx", "cy", "part", "x", "y"]
        near = met.withColumn("r", F.row_number().over(Window.partitionBy(*at).orderBy("d", F.col("ids")[0]))).where(F.col("r") <= k + 1)
        near = near.select(*at, "d", F.explode("ids").alias("j"))
        near = near.withColumn("r", F.row_number().over(Window.partitionBy(*at).orderBy("d", "j"))).where(F.col("r") <= k + 1)
        return near.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("near")).select("x", "y", "near")

    all_, n_places = places.select("x", "y"), places.count()
    by = _widened(all_, places, found_in, F.size("near") >= min(k + 1, rows or 0), _start(places, k + 1, reach), most)
    others = F.slice(F.filter("near", lambda e: e["j"] != F.col("i")), 1, k)
    return p.join(by, ["x", "y"]).select("i", F.posexplode(others).alias("n", "e")).select("i", "e.j", "e.d", (F.col("n") + 1).alias("n"))


def neighbours(df: DataFrame, key: str, x: str, y: str, k: int, reach: float) -> DataFrame:
    """(i, j, d, n): the k nearest other rows within reach, ties to the smaller key; fewer where reach holds fewer. Keys must be distinct."""
    return _nearest(points(df, key, x, y), k, reach, reach)


def nearest(df: DataFrame, key: str, x: str, y: str, k: int, reach: float) -> DataFrame:
    """(i, j, d, n): the k nearest other rows wherever they are, ties to the smaller key; fewer only where the table has fewer. Keys must be distinct.

    The search begins within reach, or nearer where rows are crowded. Rows without finite coordinates take no part.
    """
    return _nearest(points(df, key, x, y), k, reach, None)


def nearest_of_others(df: DataFrame, x: str, y: str, group: str, reach: float) -> DataFrame:
    """(group, d, n): how many rows of a group have their nearest row of another group at distance d, of those that have one within reach."""
    at = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(group).alias("g"))
    at = settled(at.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & F.col("g").isNotNull()).groupBy("x", "y", "g").agg(F.count("*").alias("n")))
    # two groups of a place are enough: one of them is another than the asker's
    places = settled(at.groupBy("x", "y").agg(F.min("g").alias("g0"), F.max("g").alias("g1")))

    def found_in(asking: DataFrame, held: DataFrame, reach: float) -> DataFrame:
        few = asking is not all_ and asking.count() * 4 < n
        met = _met(asking, held, reach, CELL, few).where((F.col("g") != F.col("g0")) | (F.col("g") != F.col("g1")))
        by = ["x", "y", "g"] if few else ["cx", "cy", "part", "x", "y", "g"]
        return met.groupBy(*by).agg(F.min("d").alias("d")).select("x", "y", "g", "d")

    all_, n = at.select("x", "y", "g"), at.count()
    by = _widened(all_, places, found_in, F.col("d").isNotNull(), _start(places, 2, reach), reach)
    return by.join(at, ["x", "y", "g"]).groupBy(F.col("g").alias(group), "d").agg(F.sum("n").alias("n"))


def morans_i(df: DataFrame, links: DataFrame, key: str, value: str) -> DataFrame:
    """Moran's I with row-standardised weights of links (i, j)."""
    mean = F.broadcast(df.agg(F.avg(value).alias("mean")))
    z = df.crossJoin(mean).select(F.col(key).alias("k"), (F.col(value) - F.col("mean")).alias("z"))
    lag = links.join(z.select(F.col("k").alias("j"), F.col("z").alias("zj")), "j").groupBy("i").agg(F.avg("zj").alias("lag"))
    s = z.join(lag, F.col("k") == F.col("i")).agg(F.sum(F.col("z") * F.col("lag")).alias("top"), F.count(F.lit(1)).alias("w"))
    below = z.agg(F.sum(F.col("z") * F.col("z")).alias("below"), F.count(F.lit(1)).alias("n"))
    return s.crossJoin(below).select("n", F.try_divide(F.col("n") * F.col("top"), F.col("w") * F.col("below")).alias("morans_i"))


def correlogram(df: DataFrame, key: str, x: str, y: str, value: str, band: float, reach: float, least: int = 30) -> DataFrame:
    """Moran's I by distance band (lo, hi]; directed pairs count; a band of fewer than ``least`` is null."""
    mean = F.broadcast(df.agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var")))
    z = df.crossJoin(mean).select(F.col(key).alias("k"), (F.col(value) - F.col("mean")).alias("z"), "var")
    p = points(df, key, x, y)
    pairs = pairs_within(p, p, reach, square=False).where("d > 0").withColumn("band", F.ceil(F.col("d") / band).cast("long"))
    both = pairs.join(z.select(F.col("k").alias("i"), F.col("z").alias("zi"), "var"), "i").join(z.select(F.col("k").alias("j"), F.col("z").alias("zj")), "j")
    out = both.groupBy("band").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("zi") * F.col("zj")).alias("c"), F.first("var").alias("var"))
    return out.select("band", "pairs", F.when(F.col("pairs") >= least, F.try_divide(F.col("c"), F.col("var"))).alias("morans_i"))


def permutation_p(df: DataFrame, links: DataFrame, key: str, value: str, within: list[str] | None = None, permutations: int = 999, seed: int = 42, most: int | None = None, near: str | None = None, whole: int = permuting.WHOLE, tile: int = permuting.TILE) -> DataFrame:
    """(within, n, links, morans_i, expected, p, permutations, verdict): Moran's I with row-standardised weights of links (within, i, j), and how often values dealt anew reach it.

    p counts permutations whose I is at least the observed one, the observed one among them. Up to ``whole`` points a task deals all values, in the order of the
    keys, for some of the permutations: the permutation k is numpy's for the seed (seed, k). More are divided into tiles of about ``tile`` points, by the
    numeric column ``near`` if it is given, and dealt between these (permuting). ``near`` is best one that links go along, since values at the other end of a link
    between tiles are sent. No values reach the driver. More than ``most`` points are an error, if it is given.
    Links whose ends have no value take no part. Keys must be distinct.
    """
    within = within or []
    known = df.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).cast("double").alias("v"), *([F.col(near).cast("double").alias("near")] if near else []))
    n, mean = known.agg(F.count("*"), F.avg("v")).first()
    if most is not None and n > most:
        raise ValueError(f"over {most} points")
    places, sizes = permuting.placed(known, n, "near" if near else None, whole, tile)
    below = places.agg(F.sum((F.col("v") - F.lit(mean)) * (F.col("v") - F.lit(mean)))).first()[0] or 0.0
    code = F.to_json(F.struct(*within, F.lit(0))) if within else F.lit("{}")
    groups, tops = permuting.permuted_sums(links, places, sizes, mean or 0.0, code, permutations, seed, dealt=max(permuting.DEALT, permuting.LEAST * n))
    release(places)
    seen = tops.groupBy("g").agg(F.max(F.when(F.col("k") == 0, F.col("top"))).alias("observed"), F.collect_list(F.when(F.col("k") > 0, F.col("top"))).alias("others"))
    over = F.size(F.filter("others", lambda t: t >= F.col("observed") - F.abs("observed") * 1e-12))
    p = ((over + 1) / (permutations + 1)).alias("p")
    out = groups.join(seen, "g").withColumnRenamed("g", "__g")
    if within:
        out = out.join(links.select(*within).distinct().withColumn("__g", code), "__g")
    value_ = F.try_divide(F.lit(float(n)) * F.col("observed"), F.col("s0") * F.lit(below)).alias("morans_i")
    found = out.select(*within, F.lit(n).cast("long").alias("n"), "links", value_, F.lit(-1.0 / (n - 1) if n > 1 else None).cast("double").alias("expected"), p, F.lit(permutations).alias("permutations"))
    return found.withColumn("verdict", F.when(F.col("p") < 0.05, "clustered").otherwise("spatially_random"))


def bootstrap_auc(df: DataFrame, y: str, score: str, within: list[str], replicates: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the AUC over resamples with replacement, by group. Each task makes a block of replicates from its group's counts by distinct score; resamples of one class are skipped."""
    from .metrics import by_score

    counts = by_score(df, y, score, within)
    packed = counts.groupBy(*within).agg(F.array_sort(F.collect_list(F.struct("score", "n", "pos"))).alias("rows"))
    blocks = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // 50) - 1))))

    @F.pandas_udf("array<double>")
    def resample(rows: pd.Series, block: pd.Series) -> pd.Series:
        out = []
        for r, b in zip(rows, block, strict=True):
            n = np.array([x["n"] for x in r], float)
            pos = np.array([x["pos"] for x in r], float)
            p = np.concatenate([pos, n - pos])
            total = int(p.sum())
            rng = np.random.default_rng([seed, int(b)])
            found = []
            for c in rng.multinomial(total, p / total, size=min(50, replicates - 50 * int(b))):
                one, zero = c[: len(n)], c[len(n) :]
                if one.sum() and zero.sum():
                    below = np.cumsum(zero) - zero
                    found.append(float((one * (below + zero / 2)).sum() / (one.sum() * zero.sum())))
            out.append(found)
        return pd.Series(out)

    aucs = blocks.withColumn("auc", F.explode(resample("rows", "block")))
    tail = (1 - level) / 2
    return aucs.groupBy(*within).agg(F.count(F.lit(1)).alias("replicates"), F.avg("auc").alias("mean_auc"), F.percentile("auc", tail).alias("low"), F.percentile("auc", 1 - tail).alias("high"))
