"""Survey logs: text formats of high-water marks, read as lines with their place in the file.

Every parser takes (file, pos, line) and returns the same columns. A row whose northing,
easting or elevation isn't a number is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ["pt_id", "northing_ft", "easting_ft", "elevation_ft", "description", "type", "event", "source_file"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of the files of a path; a file is a row first, so its lines keep their order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")).alias("pos", "line"))


def event_of(file: Column) -> Column:
    """The name of the file's folder."""
    return F.element_at(F.split(file, "/"), -2)


def _part(k: int) -> Column:
    return F.trim(F.get(F.col("parts"), k))


def _rows(lines: DataFrame, keep: Column, kind: str, least: int = 5) -> DataFrame:
    split = lines.withColumn("line", F.trim("line")).where("line <> ''").withColumn("parts", F.split("line", ","))
    numbers = [_part(k).try_cast("double") for k in (1, 2, 3)]
    rows = split.where((F.size("parts") >= least) & keep).select(
        _part(0).alias("pt_id"),
        *[n.alias(c) for n, c in zip(numbers, COLUMNS[1:4], strict=True)],
        _part(4).alias("description"),
        F.lit(kind).alias("type"),
        event_of(F.col("file")).alias("event"),
        F.element_at(F.split("file", "/"), -1).alias("source_file"),
    )
    return rows.dropna(subset=COLUMNS[1:4])


def _said() -> Column:
    return F.upper(_part(4))


def standard(lines: DataFrame) -> DataFrame:
    """Marks HW, B HW and WH..., with headers PT... and [... left out."""
    header = F.upper("line").startswith("PT") | F.col("line").startswith("[")
    return _rows(lines, ~header & (_said().isin("HW", "B HW") | _said().startswith("WH")), "HW")


def receiver(lines: DataFrame) -> DataFrame:
    """Marks HW and B HW whose first STATUS: field is FIXED."""
    status = F.get(F.filter("parts", lambda p: F.upper(F.trim(p)).startswith("STATUS:")), 0)
    fixed = F.coalesce(F.contains(F.upper(status), F.lit("FIXED")), F.lit(False))
    return _rows(lines, ~F.upper("line").startswith("PT") & _said().isin("HW", "B HW") & fixed, "HW", least=6)


def plain(lines: DataFrame) -> DataFrame:
    """Marks HW; // begins a comment."""
    return _rows(lines, ~F.col("line").startswith("//") & (_said() == "HW"), "HW")


def described(lines: DataFrame) -> DataFrame:
    """Marks whose description has HIGH WATER."""
    return _rows(lines, F.contains(_said(), F.lit("HIGH WATER")), "HW")


def edges_of_water(lines: DataFrame) -> DataFrame:
    """Marks EOW and EOA, before any slash."""
    base = F.trim(F.get(F.split(_said(), "/"), 0))
    return _rows(lines, ~F.col("line").startswith("//") & base.isin("EOW", "EOA"), "EOW")


def raw_log(lines: DataFrame, ahead: int = 5) -> DataFrame:
    """Blocks that begin with --GS,PN; of the next lines, up to the next block, the first with STATUS: must say FIXED.

    The look-ahead is a frame of following lines of the same file.
    """
    following = Window.partitionBy("file").orderBy("pos").rowsBetween(1, ahead)
    trimmed = lines.withColumn("line", F.trim("line")).withColumn("next", F.collect_list("line").over(following))
    parts = trimmed.where(F.col("line").startswith("--GS,PN")).withColumn("parts", F.split("line", ","))
    said = F.trim(F.regexp_replace(F.element_at("parts", -1), "^-+", ""))
    up = F.upper(F.col("description"))
    kind = F.when(up.isin("HW", "B HW") | up.startswith("WH") | F.contains(up, F.lit("HIGH WATER")) | (up == "HIGHWATER"), "HW").when(F.trim(F.get(F.split(up, "/"), 0)).isin("EOW", "EOA"), "EOW")

    def first(prefix: str) -> Column:
        return F.get(F.filter("parts", lambda p: p.startswith(prefix)), 0)

    def second_word(c: Column) -> Column:
        return F.get(F.split(F.trim(c), r"\s+"), 1)

    def stops(line: Column) -> Column:
        return line.startswith("GPS,") | line.startswith("--GS,PN") | line.startswith("BP,")

    # the state is null until a line decides
    decided = F.aggregate("next", F.lit(None).cast("boolean"), lambda s, l: F.when(s.isNotNull(), s).when(stops(l), F.lit(False)).when(F.contains(l, F.lit("STATUS:")), F.contains(l, F.lit("FIXED"))))
    rows = parts.withColumn("description", said).withColumn("type", kind).where(F.col("type").isNotNull() & F.coalesce(decided, F.lit(False)))
    return rows.select(
        F.trim(F.replace(F.get("parts", F.lit(1)), F.lit("PN"), F.lit(""))).alias("pt_id"),
        second_word(first("N ")).try_cast("double").alias("northing_ft"),
        second_word(first("E ")).try_cast("double").alias("easting_ft"),
        F.trim(F.replace(first("EL"), F.lit("EL"), F.lit(""))).try_cast("double").alias("elevation_ft"),
        "description",
        "type",
        event_of(F.col("file")).alias("event"),
        F.element_at(F.split("file", "/"), -1).alias("source_file"),
    ).dropna(subset=COLUMNS[1:4])


FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {"A": standard, "B": receiver, "D": plain, "H": described, "EOW": edges_of_water, "RW5": raw_log}


def parse(lines: DataFrame, fmt: str) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; known: {sorted(FORMATS)}")
    return FORMATS[fmt](lines)


def read_manifest(spark: SparkSession, manifest: list[tuple[str, str, str]]) -> DataFrame:
    """Union of (event, path, format); the event of the manifest counts."""
    out = None
    for event, path, fmt in manifest:
        part = parse(read_lines(spark, path), fmt).withColumn("event", F.lit(event))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def combined_points(text: DataFrame, files: DataFrame | None = None, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """One table of survey points in the grid: text rows (with x and y) are marks by point, those of point files by file. provenance tells which, and of which type; points out of bounds go."""
    of = text.withColumn("provenance", F.when(F.col("type") == "HW", "point_level_HW").when(F.col("type") == "EOW", "point_level_EOW"))
    columns = [*COLUMNS, "provenance", "x", "y"]
    out = of.select(*columns)
    if files is not None:
        out = out.unionByName(files.select(*columns))
    return inside(out, bounds) if bounds else out


def inside(points: DataFrame, bounds: tuple[float, float, float, float], x: str = "x", y: str = "y") -> DataFrame:
    return points.where(F.col(x).between(bounds[0], bounds[2]) & F.col(y).between(bounds[1], bounds[3]))
