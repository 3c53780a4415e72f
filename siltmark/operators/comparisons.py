"""A thresholded surface against flood maps of others: regulatory zones, inundation categories, change seen by radar.

These agree in direction at best: none of them is a measurement of what the surface predicts. Each comparison gives a
row for every mask, and one with a status for a mask that isn't there, so a missing source never ends a study.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics
from .arms import TRAIN, against_baseline, run_arms
from .fitting import Fit
from .grid import KEY, assign_zones, connected_components, distance_to_source

OK, MISSING, SKIPPED = "ok", "missing", "skipped"
#: Decibels of change and of standing water, and cells of the smallest part that counts (fixed values).
FALL_DB, WATER_DB, LEAST_CELLS = -2.0, -17.0, 5
COUNTS = ("tp", "fp", "fn", "tn")
SHARES = ("iou", "hit_rate", "precision", "f1")


def _empty(spark, rows: list[tuple[str, str]]) -> DataFrame:
    of = spark.createDataFrame(rows, "mask string, status string")
    return of.select("*", F.lit(None).cast("double").alias("threshold"), *[F.lit(None).cast("long").alias(c) for c in COUNTS], *[F.lit(None).cast("double").alias(c) for c in SHARES])


def against_masks(cells: DataFrame, value: str, threshold: float, masks: dict[str, DataFrame | None], valid: DataFrame | None = None, absent: str = MISSING) -> DataFrame:
    """(mask, status, threshold, counts and overlap) of the cells at or over a threshold with each mask (row, col), over cells that have a value (and are in valid).

    All masks in one scan of the cells; a mask that is None has a row with its status and nulls.
    """
    spark, found = cells.sparkSession, {n: m for n, m in masks.items() if m is not None}
    out = _empty(spark, [(n, absent) for n in masks if n not in found])
    if not found:
        return out
    own = cells.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*KEY, (F.col(value) >= threshold).alias("__p"))
    if valid is not None:
        own = own.join(valid.select(*KEY).distinct(), KEY, "left_semi")
    marks = None
    for n, m in found.items():
        part = m.select(*KEY, F.lit(n).alias("mask")).distinct()
        marks = part if marks is None else marks.unionByName(part)
    held = marks.groupBy(*KEY).agg(F.collect_set("mask").alias("__in"))
    names = F.explode(F.array(*[F.lit(n) for n in found])).alias("mask")
    rows = own.join(held, KEY, "left").select("__p", "__in", names).select("mask", "__p", F.coalesce(F.array_contains("__in", F.col("mask")), F.lit(False)).alias("__r"))
    done = metrics.overlap(rows, "__p", "__r", within=["mask"]).select("mask", F.lit(OK).alias("status"), F.lit(float(threshold)).alias("threshold"), *COUNTS, *SHARES)
    # a surface without any cell has no counts
    left = spark.createDataFrame([(n,) for n in found], "mask string").join(done, "mask", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    return out.unionByName(left.select("mask", F.lit(OK).alias("status"), F.lit(float(threshold)).alias("threshold"), *zero, *SHARES))


def zone_comparison(cells: DataFrame, value: str, threshold: float, zones: DataFrame | None, size: float, tile: float, zone: str = "zone", subtype: str | None = None, ring: str = "ring") -> DataFrame:
    """Against the zones of the one-percent flood (sfha_1pct), and these with the shaded zones of the 0.2 percent flood (zone_x_0_2pct). zones: polygons with a zone, and a subtype if there is one."""
    from .protocols import flood_zone

    names = ("sfha_1pct", "zone_x_0_2pct")
    if zones is None:
        return against_masks(cells, value, threshold, dict.fromkeys(names))
    kind = flood_zone(F.col(zone), F.col(subtype) if subtype else None)
    of = zones.select(F.when(kind == "sfha", 2).when(kind == "shaded_x", 1).alias("__kind"), ring).where("__kind is not null")
    # of zones that overlap the one-percent flood's counts
    put = assign_zones(cells.select(*KEY), of, "__kind", ring, size, tile)
    return against_masks(cells, value, threshold, {names[0]: put.where("__kind = 2"), names[1]: put})


def category_comparison(cells: DataFrame, value: str, threshold: float, categories: dict[str, DataFrame | None]) -> DataFrame:
    """Against the cells of each inundation category; one whose map is missing says so."""
    return against_masks(cells, value, threshold, categories)


def changed_cells(before: DataFrame, after: DataFrame, value: str = "value", fall: float = FALL_DB, water: float = WATER_DB, least: int = LEAST_CELLS) -> tuple[DataFrame, DataFrame]:
    """(cells that flooded, cells that both images have): those that fell by more than `fall` decibels in connected parts of at least so many cells, without what was water before."""
    both = before.select(*KEY, F.col(value).alias("__a")).join(after.select(*KEY, F.col(value).alias("__b")), KEY).where("__a is not null and __b is not null and not isnan(__a) and not isnan(__b)")
    fallen = connected_components(both.where(F.col("__b") - F.col("__a") < fall).select(*KEY), least).select(*KEY)
    return fallen.join(both.where(F.col("__a") < water).select(*KEY), KEY, "left_anti"), both.select(*KEY)


def change_comparison(cells: DataFrame, value: str, threshold: float, before: DataFrame | None, after: DataFrame | None, name: str = "radar_change", **options) -> DataFrame:
    """Against the cells that flooded between two images, over those that both have; skipped where an image is missing."""
    if before is None or after is None:
        return against_masks(cells, value, threshold, {name: None}, absent=SKIPPED)
    flooded, valid = changed_cells(before, after, **options)
    return against_masks(cells, value, threshold, {name: flooded}, valid)


def external_comparisons(cells: DataFrame, value: str, thresholds: dict[str, float], zones: DataFrame | None, categories: dict[str, DataFrame | None], before: DataFrame | None, after: DataFrame | None, size: float, tile: float, **options) -> DataFrame:
    """(source, mask, label, status, threshold, counts and overlap): every comparison at every threshold by label."""
    out = None
    for label, t in thresholds.items():
        parts = {"zones": zone_comparison(cells, value, t, zones, size, tile, **options), "categories": category_comparison(cells, value, t, categories), "change": change_comparison(cells, value, t, before, after)}
        for source, part in parts.items():
            one = part.select(F.lit(source).alias("source"), "mask", F.lit(label).alias("label"), "status", F.lit(float(t)).alias("threshold"), *COUNTS, *SHARES)
            out = one if out is None else out.unionByName(one)
    return out


def dated_sources_check(cells: DataFrame, rows: DataFrame, sources: DataFrame, year: str, cutoff: int, presence: str, is_test: str, size: float = 1.0, least: int = 50, years: tuple[int, int] = (1800, 2030), **options) -> DataFrame:
    """(arm, sources, auc, delta): a model of the distance to the nearest source alone, with all sources and with only those surely built by the cutoff.

    cells, sources and rows have (row, col); rows are presences and background with a held-out part. A source whose year isn't a number between `years`
    isn't dated, so the restricted arm is a lower bound. Fewer than ``least`` dated sources are an error. Both arms share their scans.
    """
    y = F.col(year).try_cast("double") if dict(sources.dtypes)[year] == "string" else F.col(year).cast("double")
    marked = sources.select(*KEY, F.coalesce((y > years[0]) & (y < years[1]) & (y <= cutoff), F.lit(False)).alias("__old")).where("row is not null and col is not null")
    n = marked.agg(F.count("*"), F.count_if("__old")).first()
    if n[1] < least:
        raise ValueError(f"only {n[1]} sources are dated {cutoff} or before")
    arms = {f"sources_to_{cutoff}": (marked.where("__old"), n[1]), "baseline": (marked, n[0])}
    wide = rows
    for k, (of, _) in enumerate(arms.values()):
        at = of.select(*KEY).distinct().withColumn("__s", F.lit(True))
        held = cells.select(*KEY).join(at, KEY, "left").withColumn("__s", F.coalesce("__s", F.lit(False)))
        wide = wide.join(distance_to_source(held, "__s", size).withColumnRenamed("distance", f"__d{k}"), KEY)
    wide = wide.withColumn(TRAIN, ~F.col(is_test)).persist()
    fits = {a: Fit((f"__d{k}",), "train") for k, a in enumerate(arms)}
    auc = run_arms(wide, presence, fits, {"train": F.col(TRAIN)}, {a: (a, ~F.col(TRAIN)) for a in arms}, **options)[1]
    return against_baseline(rows.sparkSession.createDataFrame([(a, m, auc[a]) for a, (_, m) in arms.items()], "arm string, sources long, auc double"))
