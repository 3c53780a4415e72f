"""Grids scored by many models, tile by tile, and only where that wasn't done before.

A model is known by a fingerprint of its coefficients or trees. What a run has scored is a table of its own folder, and counts once its
tiles are entered in the list of finished tiles; so a run that breaks off leaves nothing behind that counts, and the next one goes on.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import guards, metrics, trees
from .grid import KEY
from .model import Additive
from .rounds import release, settled

_DONE = "model string, fingerprint string, tile_row long, tile_col long, run string"
_CELLS = "row long, col long, score double, model string, run string"

Model = Additive | trees.Ensemble


def fingerprint(model: Model) -> str:
    """Of what a model's scores depend on."""
    h = hashlib.sha256(type(model).__name__.encode())
    if isinstance(model, Additive):
        for table in (model.linear, model.quadratic, model.categorical):
            h.update(repr(sorted((k, sorted(v.items()) if isinstance(v, dict) else v) for k, v in table.items())).encode())
    else:
        h.update(repr((model.layers, model.boosted, model.base, sorted((k, sorted(v[0].items()), v[1]) for k, v in model.statistics.items()))).encode())
        for a in (model.start, model.layer, model.threshold, model.left, model.right, model.value):
            h.update(a.tobytes())
    return h.hexdigest()[:32]


def scored_cells(cells: DataFrame, models: dict[str, Model], rows: dict[str, Column] | None = None) -> DataFrame:
    """(cells' columns, model, score): each cell by each model; an additive model's score is its linear predictor."""
    rows, out = rows or {}, None
    additive = {n: m for n, m in models.items() if isinstance(m, Additive)}
    if additive:
        each = F.array(*[F.struct(F.lit(n).alias("model"), F.when(rows.get(n, F.lit(True)), m.predictor()).alias("score")) for n, m in additive.items()])
        out = cells.select("*", F.inline(each)).where("score is not null")
    if grown := {n: m for n, m in models.items() if n not in additive}:
        part = trees.scores(cells, grown, {n: c for n, c in rows.items() if n in grown}, score="score").where("score is not null")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no models")
    return out


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def score_surfaces(cells: DataFrame, models: dict[str, Model], path: str, tile: int = 256) -> dict[str, tuple[int, int]]:
    """Scores the cells (row, col and layers) of the tiles that a model with this fingerprint hasn't scored yet, under path; (tiles scored now, all tiles) by model."""
    spark, run = cells.sparkSession, uuid.uuid4().hex
    at = [F.floor(F.col(k) / tile).cast("long").alias(f"tile_{k}") for k in KEY]
    marks = {n: fingerprint(m) for n, m in models.items()}
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(f).alias("fingerprint")) for n, f in marks.items()]))
    wanted = settled(cells.select(*at).distinct().select("tile_row", "tile_col", each))
    on = ["model", "fingerprint", "tile_row", "tile_col"]
    todo = settled(wanted.join(_table(spark, f"{path}/done", _DONE), on, "left_anti"))
    counts = {r["model"]: r["n"] for r in todo.groupBy("model").agg(F.count("*").alias("n")).collect()}
    sizes = {r["model"]: r["n"] for r in wanted.groupBy("model").agg(F.count("*").alias("n")).collect()}
    if counts:
        # which models a tile is to be scored by
        by = todo.groupBy("tile_row", "tile_col").agg(F.collect_set("model").alias("__models"))
        tiled = cells.select("*", *at).join(by, ["tile_row", "tile_col"]).drop("tile_row", "tile_col")
        found = scored_cells(tiled, {n: models[n] for n in counts}, {n: F.array_contains("__models", n) for n in counts})
        found.select(*[F.col(k).cast("long").alias(k) for k in KEY], "score", "model", F.lit(run).alias("run")).write.mode("append").parquet(f"{path}/cells")
        todo.select("*", F.lit(run).alias("run")).write.mode("append").parquet(f"{path}/done")
    release(wanted, todo)
    return {n: (counts.get(n, 0), sizes.get(n, 0)) for n in models}


def surface(spark: SparkSession, path: str, name: str, model: Model) -> DataFrame:
    """(row, col, score) of the finished tiles of a model."""
    done = _table(spark, f"{path}/done", _DONE).where((F.col("model") == name) & (F.col("fingerprint") == fingerprint(model))).select("run").distinct()
    return _table(spark, f"{path}/cells", _CELLS).where(F.col("model") == name).join(F.broadcast(done), "run", "left_semi").select(*KEY, "score")


def assert_agreement(points: DataFrame, label: str, models: dict[str, Model], path: str, within: float = 1e-9) -> DataFrame:
    """(model, points, direct, sampled, agrees): the AUC of points (row, col, layers and label) scored directly, and by the surface's cell; an error where they differ. Points of one class have no area, and agree if neither has one."""
    direct = metrics.auc(scored_cells(points, models), label, "score", ["model"]).select("model", F.col("auc").alias("direct"), (F.col("n_pos") + F.col("n_neg")).alias("points"))
    spark, sampled = points.sparkSession, None
    for n, m in models.items():
        part = points.select(*KEY, label).join(surface(spark, path, n, m), KEY).select(label, "score", F.lit(n).alias("model"))
        sampled = part if sampled is None else sampled.unionByName(part)
    agrees = F.coalesce(F.abs(F.col("direct") - F.col("sampled")) <= within, F.col("direct").isNull() & F.col("sampled").isNull())
    found = metrics.auc(sampled, label, "score", ["model"]).select("model", F.col("auc").alias("sampled"))
    both = settled(direct.join(found, "model", "left").select("model", "points", "direct", "sampled", agrees.alias("agrees")))
    if wrong := [r["model"] for r in both.where("not agrees").collect()]:
        raise guards.GuardError(f"surface and points disagree: {sorted(wrong)}")
    return both
