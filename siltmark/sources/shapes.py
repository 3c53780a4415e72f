"""Point shapefiles: records by their index, attributes, coordinate systems and bounds.

Files are read by Spark (binaryFile), so they may lie wherever Spark reads. The index file tells where records begin; they are dealt out in
ranges of RANGE records, and each range is parsed in a task of its own. A file of the format has at most 2 GB, so one file's bytes are one row.
"""

from __future__ import annotations

import struct
import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.projection import UTM_14, System, system_of, with_changed
from .surveys import COLUMNS, inside

RANGE = 1 << 16
#: Shape types that are points: plain, with height, with a measure (fixed values).
POINTS = (1, 11, 21)
PARTS = ("shp", "shx", "dbf", "prj")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(stem, shp, shx, dbf, prj) of the shapefiles under a path: the bytes of each part, null where it is missing."""
    files = spark.read.format("binaryFile").load(path)
    kind, stem = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)), F.regexp_replace("path", r"\.[^.]+$", "")
    return files.where(kind.isin(*PARTS)).groupBy(stem.alias("stem")).agg(*[F.max(F.when(kind == p, F.col("content"))).alias(p) for p in PARTS]).where("shp is not null")


def headers(files: DataFrame) -> DataFrame:
    """(stem, kind, records, prj): the shape type, how many records the index tells of, and the text of the coordinate system."""
    # the type is the number at byte 32, of which the first byte tells; the index has 8 bytes a record after 100
    kind = F.conv(F.hex(F.substring("shp", 33, 1)), 16, 10).cast("int")
    records = F.floor((F.octet_length("shx") - 100) / 8).cast("long")
    return files.select("stem", kind.alias("kind"), records.alias("records"), F.decode("prj", "UTF-8").alias("prj"))


_RANGES = "stem string, first long, start long, size long, dfirst long, dsize long, fields string"


def _fields(dbf: bytes | None) -> tuple[int, int, list[tuple[str, int, int]]]:
    """Where attribute rows begin, their width, and (name, place, width) of each."""
    if not dbf or len(dbf) < 32:
        return 0, 0, []
    begin, width = struct.unpack("<HH", dbf[8:12])
    out, at, place = [], 32, 1
    while at + 32 <= begin and dbf[at] != 0x0D:
        name = dbf[at : at + 11].split(b"\0")[0].decode("latin-1").strip()
        out.append((name, place, dbf[at + 16]))
        place += dbf[at + 16]
        at += 32
    return begin, width, out


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (stem, shx, dbf's first bytes): ranges of records with their bytes in both files."""
    import json

    for batch in batches:
        for stem, shx, dbf in zip(*(batch.column(k) for k in range(3)), strict=True):
            index = np.frombuffer(shx.as_py()[100:], ">i4").reshape(-1, 2).astype(np.int64) * 2
            begin, width, fields = _fields(dbf.as_py())
            n = len(index)
            if not n:
                continue
            first = np.arange(0, n, RANGE)
            last = np.minimum(first + RANGE, n) - 1
            start = index[first, 0]
            size = index[last, 0] + 8 + index[last, 1] - start
            yield pa.RecordBatch.from_arrays(
                [pa.array([stem.as_py()] * len(first)), pa.array(first), pa.array(start), pa.array(size), pa.array(begin + first * width), pa.array((last - first + 1) * width), pa.array([json.dumps(fields)] * len(first))],
                names=["stem", "first", "start", "size", "dfirst", "dsize", "fields"],
            )


_RECORDS = T.StructType([T.StructField("stem", T.StringType()), T.StructField("record", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType()))])


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points of ranges of records. A record without a shape has no point; where it is, record numbers go on."""
    import json

    for batch in batches:
        for stem, first, shp, dbf, fields in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            record, x, y, attributes, at, k = [], [], [], [], 0, 0
            width = len(dbf) and sum(w for _, _, w in json.loads(fields)) + 1
            while at + 12 <= len(shp):
                size = 2 * struct.unpack(">i", shp[at + 4 : at + 8])[0]
                if struct.unpack("<i", shp[at + 8 : at + 12])[0] in POINTS and at + 28 <= len(shp):
                    a, b = struct.unpack("<dd", shp[at + 12 : at + 28])
                    row = dbf[k * width : (k + 1) * width] if width else b""
                    record.append(first + k)
                    x.append(a)
                    y.append(b)
                    attributes.append([(n, row[p : p + w].decode("utf-8", "replace").strip()) for n, p, w in json.loads(fields)] if row[:1] != b"*" else [])
                at, k = at + 8 + size, k + 1
            yield pa.RecordBatch.from_arrays([pa.array([stem] * len(x), pa.string()), pa.array(record, pa.int64()), pa.array(x, pa.float64()), pa.array(y, pa.float64()), pa.array(attributes, pa.map_(pa.string(), pa.string()))], names=_RECORDS.names)


def records(files: DataFrame) -> DataFrame:
    """(stem, record, x, y, attributes) of the points of files (stem, shp, shx, dbf), records counted from 0."""
    index = files.where("shx is not null").select("stem", "shx", F.substring("dbf", 1, 1 << 14).alias("dbf"))
    ranges = index.mapInArrow(_ranges, _RANGES)

    def part(content: str, start: str, size: str) -> Column:
        return F.substring(F.coalesce(content, F.lit(b"")), F.col(start).cast("int") + 1, F.col(size).cast("int"))

    cut = ranges.join(files.select("stem", "shp", "dbf"), "stem").select("stem", "first", part("shp", "start", "size").alias("shp"), part("dbf", "dfirst", "dsize").alias("dbf"), "fields")
    return cut.repartition("stem", "first").mapInArrow(_parsed, _RECORDS)


def read_points(files: DataFrame, event: str, assumed: System | None = None, target: System = UTM_14, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Survey rows of point files in the target system, with x, y, attributes and provenance: marks of high water, as a whole file is.

    A file whose shapes aren't points is left out with a warning, and so is one without a coordinate system if none is assumed.
    Points out of bounds (x0, y0, x1, y1) are left out, with a warning that tells how many. Feet and heights are null.
    """
    out = None
    kept = []
    for h in headers(files).collect():
        name = h["stem"].rpartition("/")[2]
        if h["kind"] not in POINTS:
            warnings.warn(f"{name}: no points", stacklevel=2)
        elif h["prj"] is None and assumed is None:
            warnings.warn(f"{name}: no coordinate system, and none is assumed", stacklevel=2)
        else:
            kept.append((h["stem"], assumed if h["prj"] is None else system_of(h["prj"])))
    found = records(files.where(F.col("stem").isin([s for s, _ in kept])))
    for system in dict.fromkeys(s for _, s in kept):
        own = found.where(F.col("stem").isin([n for n, s in kept if s == system]))
        part = with_changed(own, "x", "y", system, target)
        out = part if out is None else out.unionByName(part)
    out = found.limit(0) if out is None else out
    if bounds is not None:
        if away := out.where(~(F.col("x").between(bounds[0], bounds[2]) & F.col("y").between(bounds[1], bounds[3]))).count():
            warnings.warn(f"{away} points out of bounds: is the coordinate system right?", stacklevel=2)
        out = inside(out, bounds)
    none = F.lit(None).cast("double")
    file = F.concat(F.element_at(F.split("stem", "/"), -1), F.lit(".shp"))
    return out.select(
        F.col("record").cast("string").alias(COLUMNS[0]), *[none.alias(c) for c in COLUMNS[1:4]], F.lit("HW").alias("description"), F.lit("HW").alias("type"), F.lit(event).alias("event"),
        file.alias("source_file"), F.lit("file_level_HW").alias("provenance"), "x", "y", "attributes",
    )


def read_manifest(spark: SparkSession, manifest: list[tuple[str, str, System | None]], **options) -> DataFrame:
    """Union of the point files of (event, path, assumed system)."""
    out = None
    for event, path, assumed in manifest:
        part = read_points(read_files(spark, path), event, assumed, **options)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("an empty manifest")
    return out


def packed(points: DataFrame, stem: str, key: str, x: str, y: str) -> DataFrame:
    """(stem, shp, shx, dbf, prj) of points by stem, ordered by key, with the key as attribute ID: files of the format as rows. A stem's points are one row, as its file is."""
    schema = "stem string, shp binary, shx binary, dbf binary, prj binary"

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        n = table.num_rows
        xs, ys = (table.column(c).to_numpy() for c in ("x", "y"))
        body = np.zeros(n, np.dtype([("n", ">i4"), ("size", ">i4"), ("kind", "<i4"), ("x", "<f8"), ("y", "<f8")]))
        body["n"], body["size"], body["kind"], body["x"], body["y"] = np.arange(1, n + 1), 10, 1, xs, ys
        index = np.zeros(n, np.dtype([("at", ">i4"), ("size", ">i4")]))
        index["at"], index["size"] = 50 + 14 * np.arange(n), 10

        def head(length: int) -> bytes:
            box = (xs.min(), ys.min(), xs.max(), ys.max()) if n else (0, 0, 0, 0)
            return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, length // 2) + struct.pack("<2i", 1000, 1) + struct.pack("<8d", *box, 0, 0, 0, 0)

        rows = b"".join(b" " + str(k).rjust(18)[:18].encode() for k in table.column("key").to_pylist())
        dbf = struct.pack("<4BIHH20x", 3, 100, 1, 1, n, 65, 19) + b"ID".ljust(11, b"\0") + b"N" + bytes(4) + bytes([18]) + bytes(15) + b"\r" + rows + b"\x1a"
        shp, shx = head(100 + body.nbytes) + body.tobytes(), head(100 + index.nbytes) + index.tobytes()
        return pa.table({"stem": pa.array([table.column("stem")[0].as_py()]), "shp": pa.array([shp], pa.binary()), "shx": pa.array([shx], pa.binary()), "dbf": pa.array([dbf], pa.binary()), "prj": pa.nulls(1, pa.binary())})

    of = points.select(F.col(stem).cast("string").alias("stem"), F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return of.groupBy("stem").applyInArrow(pack, schema)
