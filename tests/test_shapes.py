"""Point shapefiles written and read back, and grids brought to another system and back."""

import struct

import pytest
from pyspark.sql import functions as F

from siltmark.functions import projection
from siltmark.operators import grid
from siltmark.sources import shapes

CONIC = 'PROJCS["NAD83 Kansas North (ftUS)",GEOGCS["NAD83",DATUM["D",SPHEROID["GRS 1980",6378137,298.257222101]],PRIMEM["Greenwich",0],UNIT["degree",0.017453292519943295]],PROJECTION["Lambert_Conformal_Conic"],PARAMETER["standard_parallel_1",39.78333333333333],PARAMETER["standard_parallel_2",38.71666666666667],PARAMETER["latitude_of_origin",38.33333333333334],PARAMETER["central_meridian",-98],PARAMETER["false_easting",1312333.3333],PARAMETER["false_northing",0],UNIT["US survey foot",0.3048006096012192]]'
ZONE = 'PROJCS["UTM 14",GEOGCS["G",UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["Central_Meridian",-99.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'


def write(folder, stem, rows, prj=None, kind=1):
    """rows: (x, y) or None for a record without a shape."""
    body, index, dbf = b"", b"", b""
    for k, p in enumerate(rows):
        content = struct.pack("<i", 0) if p is None else struct.pack("<i2d", kind, *p) + (b"\0" * 16 if kind == 11 else b"")
        index += struct.pack(">2i", (100 + len(body)) // 2, len(content) // 2)
        body += struct.pack(">2i", k + 1, len(content) // 2) + content
        dbf += b" " + f"n{k}".ljust(6).encode() + str(k * 10).rjust(4).encode()
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n // 2) + struct.pack("<2i", 1000, kind) + bytes(64)
    fields = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([6]) + bytes(15) + b"SIZE".ljust(11, b"\0") + b"N" + bytes(4) + bytes([4]) + bytes(15) + b"\r"
    (folder / f"{stem}.shp").write_bytes(head(100 + len(body)) + body)
    (folder / f"{stem}.shx").write_bytes(head(100 + len(index)) + index)
    (folder / f"{stem}.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 32 + len(fields), 11) + fields + dbf)
    if prj:
        (folder / f"{stem}.prj").write_text(prj)


def test_points_come_back_with_attributes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shapes, "RANGE", 3)
    at = [(600000.0 + 10 * k, 4300000.0 - 7 * k) for k in range(10)]
    at[4] = None
    write(tmp_path, "marks", at, ZONE)
    write(tmp_path, "raised", [(600001.5, 4300002.5)], ZONE, kind=11)
    got = shapes.read_points(shapes.read_files(spark, str(tmp_path)), "e1").orderBy("source_file", F.col("pt_id").cast("int")).collect()
    marks = [r for r in got if r.source_file == "marks.shp"]
    assert [(r.pt_id, r.x, r.y) for r in marks] == [(str(k), *p) for k, p in enumerate(at) if p]
    assert marks[5].attributes == {"NAME": "n6", "SIZE": "60"} and {r.provenance for r in got} == {"file_level_HW"} and {r.event for r in got} == {"e1"}
    assert [(r.x, r.y) for r in got if r.source_file == "raised.shp"] == [(600001.5, 4300002.5)]


def test_systems_bounds_and_what_is_left_out(spark, tmp_path):
    feet = [(1300000.0, 100000.0), (9000000.0, 100000.0)]
    write(tmp_path, "conic", feet, CONIC)
    write(tmp_path, "bare", feet)
    write(tmp_path, "area", [None], ZONE, kind=5)
    files = shapes.read_files(spark, str(tmp_path))
    x, y = projection.feet_to_grid(F.lit(1300000.0), F.lit(100000.0))
    here = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    box = (here.x - 10, here.y - 10, here.x + 10, here.y + 10)
    with pytest.warns(UserWarning) as seen:
        one = shapes.read_points(files, "e", bounds=box).collect()
    assert [(r.source_file, round(r.x, 2), round(r.y, 2)) for r in one] == [("conic.shp", round(here.x, 2), round(here.y, 2))]
    said = " ".join(str(w.message) for w in seen)
    assert "area: no points" in said and "bare: no coordinate system" in said and "1 points out of bounds" in said
    with pytest.warns(UserWarning):
        both = shapes.read_manifest(spark, [("a", str(tmp_path), projection.STATE_PLANE_FEET)], bounds=box).collect()
    assert {r.source_file for r in both} == {"conic.shp", "bare.shp"}
    with pytest.raises(ValueError):
        projection.system_of('PROJCS["x",PROJECTION["Albers"],UNIT["m",1]]')


def test_packed_points_are_files_of_the_format(spark):
    rows = [(k, float(k), float(-k), "a" if k % 3 else "b") for k in range(50)]
    df = spark.createDataFrame(rows, "id long, x double, y double, g string")
    got = shapes.records(shapes.packed(df, "g", "id", "x", "y")).collect()
    assert {(int(r.attributes["ID"]), r.x, r.y, r.stem) for r in got} == set(rows)
    assert {r.records for r in shapes.headers(shapes.packed(df, "g", "id", "x", "y")).collect()} == {17, 33}


def test_round_trips_are_under_a_millimetre(spark):
    points = [(x, y) for x in (2.6e5, 5e5, 7.4e5) for y in (4.0e6, 4.3e6, 4.6e6)]
    df = spark.createDataFrame(points, "x double, y double")
    for system in (projection.STATE_PLANE_FEET, projection.STATE_PLANE, projection.Geographic()):
        there = projection.changed(F.col("x"), F.col("y"), projection.UTM_14, system)
        back = df.select("x", "y", there[0].alias("u"), there[1].alias("v"))
        again = projection.changed(F.col("u"), F.col("v"), system, projection.UTM_14)
        for r in back.select("x", "y", again[0].alias("x2"), again[1].alias("y2")).collect():
            assert abs(r.x - r.x2) < 1e-3 and abs(r.y - r.y2) < 1e-3


def test_warped_planes_stay_planes(spark):
    source = grid.Frame(1000.0, 2000.0, 10.0)
    target = grid.Frame(1037.0, 2041.0, 25.0)
    cells = grid.frame_cells(spark, (0, 40), (0, 40)).select("row", "col", ((F.col("col") + 0.5) * 10 + 1000 + 3 * ((F.col("row") + 0.5) * 10 + 2000)).alias("value"))
    for r in grid.warp(cells, source, grid.frame_cells(spark, (1, 10), (1, 10)), target).collect():
        assert r.value == pytest.approx((r.col + 0.5) * 25 + 1037 + 3 * ((r.row + 0.5) * 25 + 2041))
    near = {(r.row, r.col): r.value for r in grid.warp(cells, source, grid.frame_cells(spark, (0, 3), (0, 3)), target, method="nearest").collect()}
    held = {(r.row, r.col): r.value for r in cells.collect()}
    assert len(near) == 9 and all(v == held[int(((r + 0.5) * 25 + 41) // 10), int(((c + 0.5) * 25 + 37) // 10)] for (r, c), v in near.items())
    # a system apart and back: within a cell's fall
    feet = grid.Frame(1300000.0, 100000.0, 30.0, projection.STATE_PLANE_FEET)
    with pytest.raises(ValueError):
        grid.warp(cells, source, cells, feet, method="cubic")
    assert grid.warp(cells, source, grid.frame_cells(spark, (0, 5), (0, 5)), feet).count() == 0
