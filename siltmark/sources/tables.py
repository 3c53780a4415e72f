"""Other inputs and outputs: header-row JSON, coefficient files, text grids, CSV tables, cached results."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import without

#: Rows of a coefficient file that aren't features.
METADATA_ROWS = ("linearPredictorNormalizer", "densityNormalizer", "numBackgroundPoints", "entropy")
#: Fixed value: what stands for a suppressed estimate.
SUPPRESSED = -666666666


def header_json(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows of an array of arrays whose first row is the header, as string columns by name."""
    parsed = df.select(F.from_json(column, "array<array<string>>").alias("a")).where(F.size("a") > 1)
    rows = parsed.select(F.get("a", F.lit(0)).alias("h"), F.explode(F.slice("a", F.lit(2), F.size("a") - 1)).alias("r"))
    return rows.select(*[F.get("r", (F.array_position("h", n) - 1).cast("int")).alias(n) for n in names])


def estimate(value: Column) -> Column:
    """A number, null for the code of suppressed estimates."""
    return without(value.try_cast("double"), SUPPRESSED)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for a zero denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def fallback_if_all_null(column: str, other: str) -> Column:
    """column, or other where the whole table has none of column. Over a table of zones."""
    from pyspark.sql import Window

    return F.when(F.count(column).over(Window.partitionBy(F.lit(1))) == 0, F.col(other)).otherwise(F.col(column))


def coefficients(lines: DataFrame, line: str = "value") -> DataFrame:
    """(feature, kind, code, lambda, low, high) of lines 'name, lambda, min, max'; kinds linear, quadratic, categorical, meta, other."""
    p = F.split(line, ",")
    name = F.trim(F.get(p, 0))
    kind = (
        F.when(name.isin(*METADATA_ROWS), "meta")
        .when(name.rlike(r"^\(.*=.*\)$"), "categorical")
        .when(name.endswith("^2"), "quadratic")
        .when(name.rlike(r"[*'`]") | name.startswith("I("), "other")
        .otherwise("linear")
    )
    feature = F.when(kind == "categorical", F.regexp_extract(name, r"^\(([^=]*)=", 1)).when(kind == "quadratic", F.regexp_replace(name, r"\^2$", "")).otherwise(name)
    number = [F.trim(F.get(p, k)).try_cast("double") for k in (1, 2, 3)]
    code = F.when(kind == "categorical", F.regexp_extract(name, r"=(.*)\)$", 1).try_cast("double"))
    return lines.where(F.trim(line) != "").select(feature.alias("feature"), kind.alias("kind"), code.alias("code"), number[0].alias("lambda"), number[1].alias("low"), number[2].alias("high"))


def parameters(coefficient_rows: DataFrame) -> DataFrame:
    """k: features with a coefficient that isn't zero."""
    return coefficient_rows.where("kind <> 'meta'").agg(F.count_if(F.col("lambda") != 0).alias("k"))


def text_grid_header(rows: int, cols: int, x0: float, y0: float, size: float, nodata: float = -9999) -> str:
    return f"ncols {cols}\nnrows {rows}\nxllcorner {x0:.6f}\nyllcorner {y0:.6f}\ncellsize {size:.6f}\nNODATA_value {nodata:g}\n"


def grid_lines(cells: DataFrame, value: str, cols: int, nodata: float = -9999) -> DataFrame:
    """(row, line): a text grid's lines, six significant digits, from the top row; a row of cells is one line."""
    v = F.col(value).cast("double")
    scale = F.pow(F.lit(10.0), 5 - F.floor(F.log10(F.abs(F.when(v != 0, v)))))
    word = F.coalesce(F.regexp_replace(F.when(v == 0, v).otherwise(F.rint(v * scale) / scale).cast("string"), "[.]0$", ""), F.lit(f"{nodata:g}"))
    held = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int"), word))).alias("m"))
    words = F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.coalesce(F.element_at("m", c), F.lit(f"{nodata:g}")))
    return held.select("row", F.array_join(words, " ").alias("line"))


def read_text_grid(lines: DataFrame) -> DataFrame:
    """(row, col, value) from (pos, line) of a text grid with six header lines; nodata is null."""
    nodata = F.broadcast(lines.where(F.lower("line").startswith("nodata_value")).select(F.element_at(F.split(F.trim("line"), r"\s+"), 2).try_cast("double").alias("nodata")))
    body = lines.where("pos >= 6 and trim(line) <> ''").select((F.col("pos") - 6).alias("row"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "word"))
    v = F.col("word").try_cast("double")
    return body.crossJoin(nodata).select("row", "col", F.when(v != F.col("nodata"), v).alias("value"))


def write_csv(df: DataFrame, path: str, metadata: dict | None = None) -> None:
    """A result table as CSV with a header; metadata as JSON text beside it."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
    if metadata is not None:
        df.sparkSession.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta")


def cached(spark: SparkSession, path: str, fingerprint: dict, make) -> DataFrame:
    """The table at path for this fingerprint; made and written if it isn't there."""
    at = f"{path}/{hashlib.sha256(json.dumps(fingerprint, sort_keys=True).encode()).hexdigest()[:16]}"
    try:
        return spark.read.parquet(at)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.parquet(at)
    return spark.read.parquet(at)
