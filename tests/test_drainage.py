"""Filled and breached surfaces against a priority flood, with passes joined in one process and in rounds."""

import heapq
import random

import pytest

from siltmark.operators import drainage, grid

RING = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def flooded(z):
    """Cells by their level, lowest first, from the edge inwards."""
    out = {}
    heap = [(v, k) for k, v in z.items() if any((k[0] + a, k[1] + b) not in z for a, b in RING)]
    heapq.heapify(heap)
    while heap:
        v, k = heapq.heappop(heap)
        if k in out:
            continue
        out[k] = v
        for a, b in RING:
            n = (k[0] + a, k[1] + b)
            if n in z and n not in out:
                heapq.heappush(heap, (max(v, z[n]), n))
    return out


def surfaces():
    rng = random.Random(1)
    plain = {(r, c): float(rng.randint(0, 30)) for r in range(14) for c in range(17)}
    # a bowl with a deep middle and a hole in the table; a plateau with a valley across it; one cell; none
    bowl = {(r, c): float(abs(r - 8) + abs(c - 8) - 30 * (r == c == 8)) for r in range(17) for c in range(17) if (r, c) != (13, 4)}
    plateau = {(r, c): (10.0 if 4 <= r < 10 else 14.0 - r) + abs(c - 5.5) for r in range(14) for c in range(12)}
    return {"plain": plain, "bowl": bowl, "plateau": plateau, "single": {(3, 4): 2.0}}


def table(spark, z):
    return spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row long, col long, value double")


@pytest.mark.parametrize("name", ["plain", "bowl", "plateau", "single"])
@pytest.mark.parametrize("local", [drainage.LOCAL, 0])
def test_filled_to_the_lowest_way_out(spark, name, local):
    z = surfaces()[name]
    got = {(r["row"], r["col"]): r["filled"] for r in drainage.filled_surface(table(spark, z), local=local).collect()}
    assert got == flooded(z)


@pytest.mark.parametrize("name", ["plain", "bowl", "plateau"])
def test_every_cell_falls_outside_along_the_lowest_way(spark, name):
    z = surfaces()[name]
    level = flooded(z)
    got = {(r["row"], r["col"]): r for r in drainage.breached_surface(table(spark, z)).collect()}
    rounds = {(r["row"], r["col"]): r for r in drainage.breached_surface(table(spark, z), local=0).collect()}
    assert got == rounds and got.keys() == z.keys()
    for k, r in got.items():
        assert r["breached"] <= z[k]
        way, at = [z[k]], k
        while got[at]["to_row"] is not None:
            to = (got[at]["to_row"], got[at]["to_col"])
            assert max(abs(to[0] - at[0]), abs(to[1] - at[1])) == 1 and got[to]["breached"] < got[at]["breached"]
            at = to
            way.append(z[at])
        # outside, with no higher cell on the way than there must be
        assert any((at[0] + a, at[1] + b) not in z for a, b in RING)
        assert max(way) == level[k]


def test_accumulation_reaches_the_outlet_across_a_plateau(spark):
    z = surfaces()["plateau"]
    df = table(spark, z)
    cut = drainage.breached_surface(df)
    surface = cut.selectExpr("row", "col", "breached as value")
    routed = grid.flow_accumulation(surface, directions=cut)
    assert routed.where("accumulation > 40").count() > 0
    free = grid.flow_direction(surface).where("to_row is null")
    inner = {k for k in z if all((k[0] + a, k[1] + b) in z for a, b in RING)}
    assert not inner & {(r["row"], r["col"]) for r in free.collect()}
    whole = grid.flow_accumulation(surface).join(free, ["row", "col"]).agg({"accumulation": "sum"}).first()[0]
    assert whole == len(z)


def test_surfaces_of_nothing(spark):
    none = table(spark, {(0, 0): 1.0}).limit(0)
    assert drainage.filled_surface(none).count() == 0 and drainage.breached_surface(none).count() == 0


def test_directions_in_a_circle_are_an_error(spark):
    circle = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 0)], "row long, col long, to_row long, to_col long")
    with pytest.raises(ValueError):
        grid.flow_accumulation(None, directions=circle, most_rounds=5)
