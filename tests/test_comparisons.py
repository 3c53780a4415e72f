"""Comparisons with masks that may be missing, dated sources, and surfaces that are scored once."""

import random

import pytest
from pyspark.sql import functions as F

from siltmark.operators import comparisons, fitting, guards, surfaces, trees
from siltmark.operators.model import Additive


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(6)
    rows = [(r, c, None if (r, c) == (0, 0) else rng.random(), float(r), float(c)) for r in range(20) for c in range(20)]
    return spark.createDataFrame(rows, "row long, col long, value double, a double, b double").persist()


def plain(rows, flagged, reference):
    tp = sum(flagged(r) and reference(r) for r in rows)
    fp = sum(flagged(r) and not reference(r) for r in rows)
    fn = sum(not flagged(r) and reference(r) for r in rows)
    return tp, fp, fn, len(rows) - tp - fp - fn


def test_masks_zones_and_what_is_missing(spark, cells):
    held = [r for r in cells.collect() if r.value is not None]
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((2, 3), (12, 3), (12, 9), (2, 9))])
    wide = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (15, 0), (15, 12), (0, 12))])
    zones = spark.range(1).select(F.lit("AE").alias("zone"), F.lit(None).cast("string").alias("sub"), square.alias("ring")).unionByName(spark.range(1).select(F.lit("X").alias("zone"), F.lit("0.2 pct").alias("sub"), wide.alias("ring")))
    got = {r["mask"]: r for r in comparisons.zone_comparison(cells, "value", 0.6, zones, 1.0, 7.0, subtype="sub").collect()}
    inner = lambda r: 2 <= r.col < 12 and 3 <= r.row < 9
    outer = lambda r: r.col < 15 and r.row < 12
    for name, mask in (("sfha_1pct", inner), ("zone_x_0_2pct", outer)):
        assert tuple(got[name][c] for c in comparisons.COUNTS) == plain(held, lambda r: r.value >= 0.6, mask) and got[name].status == "ok"
    without = {r["mask"]: r.tp for r in comparisons.zone_comparison(cells, "value", 0.6, zones, 1.0, 7.0).collect()}
    assert without["zone_x_0_2pct"] == without["sfha_1pct"]
    mask = cells.where("row > 10").select("row", "col")
    whole = comparisons.external_comparisons(cells, "value", {"low": 0.2, "high": 0.8}, None, {"minor": mask, "major": None}, None, None, 1.0, 7.0).collect()
    assert len(whole) == 10 and {(r.source, r["mask"], r.status) for r in whole} == {("zones", "sfha_1pct", "missing"), ("zones", "zone_x_0_2pct", "missing"), ("categories", "minor", "ok"), ("categories", "major", "missing"), ("change", "radar_change", "skipped")}
    assert all(r.iou is None for r in whole if r.status != "ok")
    none = comparisons.against_masks(cells.limit(0), "value", 0.5, {"m": mask}).first()
    assert (none.status, none.tp, none.iou) == ("ok", 0, None)


def test_change_in_parts_that_are_large_enough(spark, cells):
    before = cells.select("row", "col", F.when((F.col("row") == 4) & (F.col("col") == 5), -18.0).otherwise(-9.0).alias("value"))
    fell = ((F.col("row") == 4) & (F.col("col") < 8)) | (F.col("row").isin(15, 16) & (F.col("col") == 3))
    after = before.where("col < 19").withColumn("value", F.col("value") - F.when(fell, 2.5).otherwise(1.0))
    flooded, valid = comparisons.changed_cells(before, after)
    # the run of eight without what was water; the pair is too small
    assert {(r.row, r.col) for r in flooded.collect()} == {(4, c) for c in range(8) if c != 5} and valid.count() == 20 * 19
    one = comparisons.change_comparison(cells, "value", 0.5, before, after).first()
    assert one.tp + one.fn == 7 and one.tp + one.fp + one.fn + one.tn == 379


def test_sources_that_are_surely_old(spark, cells):
    rng = random.Random(1)
    rows = cells.select("row", "col", ((F.col("col") < 6) & (F.col("row") % 3 > 0) | (F.col("row") * 7 % 19 == 3)).cast("int").alias("y"), (F.col("row") % 4 == 0).alias("is_test"))
    sources = spark.createDataFrame([(r, 2 + k % 2, rng.choice(["1990", "2015", "unknown", None, "1"])) for k, r in enumerate(list(range(20)) * 3)], "row long, col long, built string")
    old = sources.where("built = '1990'").count()
    got = {r.arm: r for r in comparisons.dated_sources_check(cells, rows, sources, "built", 2000, "y", "is_test", least=3).collect()}
    assert got["sources_to_2000"].sources == old and got["baseline"].sources == 60 and got["baseline"].delta == 0 and got["baseline"].auc > 0.6
    at = {(r.row, r.col) for r in sources.collect()}
    near = spark.createDataFrame([(r.row, r.col, min(((r.row - a) ** 2 + (r.col - b) ** 2) ** 0.5 for a, b in at)) for r in cells.collect()], "row long, col long, d double")
    joined = rows.join(near, ["row", "col"])
    fitted = fitting.fit_all(joined.where("not is_test"), "y", {"d": fitting.Fit(("d",))})["d"]
    assert got["baseline"].auc == pytest.approx(fitting.scored(joined.where("is_test"), "y", {"d": (fitted, ["d"], None)}).first()["auc"])
    with pytest.raises(ValueError):
        comparisons.dated_sources_check(cells, rows, sources, "built", 2000, "y", "is_test", least=61)


def test_surfaces_are_scored_once(spark, cells, tmp_path):
    path = f"file://{tmp_path}/s"
    known = cells.where("value is not null").withColumns({"y": ((F.col("value") > 0.6) | (F.col("a") > 16)).cast("int"), "id": F.col("row") * 20 + F.col("col")})
    models = {"additive": fitting.fit_all(known, "y", {"f": fitting.Fit(("value", "a"))})["f"], "forest": trees.fit_trees(known, "y", ["value", "b"], "id", {"f": trees.replace(trees.RECIPES["random_forest"], trees=5)})["all", "f"]}
    assert surfaces.score_surfaces(known, models, path, 8) == {"additive": (9, 9), "forest": (9, 9)}
    assert surfaces.score_surfaces(known, models, path, 8) == {"additive": (0, 9), "forest": (0, 9)}
    for n, m in models.items():
        own = surfaces.surface(spark, path, n, m)
        direct = surfaces.scored_cells(known, {n: m}).select("row", "col", F.col("score").alias("direct"))
        assert own.count() == 399 and own.join(direct, ["row", "col"]).where("abs(score - direct) > 1e-12").count() == 0
    # points agree; a surface of other cells doesn't
    assert surfaces.assert_agreement(known, "y", models, path).count() == 2
    with pytest.raises(guards.GuardError):
        surfaces.assert_agreement(known.withColumn("value", 1 - F.col("value")), "y", models, path)
    # another fit is another fingerprint, and only its tiles are scored
    anew = models | {"additive": fitting.fit_all(known, "y", {"f": fitting.Fit(("value", "a"), beta=3.0)})["f"]}
    assert surfaces.score_surfaces(known, anew, path, 8) == {"additive": (9, 9), "forest": (0, 9)}
    # what a run that broke off has written doesn't count
    spark.createDataFrame([(0, 0, 9.9, "forest", "broken")], "row long, col long, score double, model string, run string").write.mode("append").parquet(f"{path}/cells")
    assert surfaces.surface(spark, path, "forest", models["forest"]).count() == 399
    # new cells of a new tile
    more = known.unionByName(known.withColumn("row", F.col("row") + 40))
    assert surfaces.score_surfaces(more, models, path, 8) == {"additive": (9, 18), "forest": (9, 18)}


def test_points_of_one_class_agree_without_areas(spark, cells, tmp_path):
    path = f"file://{tmp_path}/one"
    known = cells.where("value is not null").withColumn("y", F.lit(1))
    models = {"additive": Additive(linear={"value": (1.0, 0.0, 1.0)})}
    surfaces.score_surfaces(known, models, path, 8)
    got = surfaces.assert_agreement(known, "y", models, path).collect()
    assert [(r.direct, r.sampled, r.agrees) for r in got] == [(None, None, True)]
