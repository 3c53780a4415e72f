"""Values dealt anew between tiles: whole permutations, the sums of all links, and nothing large on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmark.operators import permuting, stats


@pytest.fixture(scope="module")
def grid(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(i % 12), float(i // 12), float(rng.random()), "a" if i % 3 else "b") for i in range(120)]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double, g string").repartition(3)
    links = stats.neighbours(df, "id", "x", "y", 4, 1.5).select("i", "j").localCheckpoint()
    return rows, df, links


@pytest.mark.parametrize("near", [None, "y"])
@pytest.mark.parametrize("most", [permuting.LINKS, 1])
def test_tiles_deal_whole_permutations_and_sum_all_links(spark, grid, near, most, monkeypatch):
    rows, df, links = grid
    known = df.select(F.col("id").alias("key"), F.col("z").alias("v"), F.col("y").alias("near"))
    places, sizes = permuting.placed(known, 120, "near" if near else None, 50, 20)
    assert len(sizes) > 4 and sum(sizes) == 120 and max(sizes) < 60
    dealt = {}

    def asked(packed, *rest):
        # a row that names all places of a tile, in order, for each tile
        out = real(packed, *rest)
        if 0 not in rest[0]:
            return out
        whole = spark.createDataFrame([(t, 99 << 40, 0, t, np.arange(n, dtype=np.int32).tobytes()) for t, n in enumerate(sizes)], "tile int, part long, kind int, src int, b binary")
        none = {c: F.lit(None) for c in packed.columns if c not in whole.columns}
        return out.unionByName(real(whole.withColumns(none).select(packed.columns), *rest))

    def kept(*a):
        out = dealing(*a).localCheckpoint()
        for r in out.where(f"part = {99 << 40}").collect():
            dealt[r.k, r.tile] = np.frombuffer(bytes(r.data))
        return out.where(f"part <> {99 << 40}")

    real, dealing = permuting._linked, permuting._dealt
    monkeypatch.setattr(permuting, "_linked", asked)
    monkeypatch.setattr(permuting, "_dealt", kept)
    # rounds of 4 permutations
    groups, tops = permuting.permuted_sums(links, places, sizes, 0.5, F.lit("{}"), 9, 3, most, 480)
    at = {r.key: (r.tile, r.pos) for r in places.collect()}
    z = np.array([r[3] for r in rows]) - 0.5
    near_ = links.collect()
    degree = np.bincount([r.i for r in near_], minlength=120)
    tops = {r.k: r.top for r in tops.collect()}
    assert sorted(tops) == list(range(10)) and groups.first().links == len(near_)
    assert groups.first().s0 == pytest.approx(sum(1 / degree[r.i] for r in near_))
    seen = set()
    for k in range(10):
        q = np.array([dealt[k, at[i][0]][at[i][1]] for i in range(120)])
        assert np.array_equal(np.sort(q), np.sort(z)) and np.array_equal(q, z) == (k == 0)
        assert tops[k] == pytest.approx(sum(q[r.i] * q[r.j] / degree[r.i] for r in near_))
        seen.add(q.tobytes())
    assert len(seen) == 10


def test_shares_keep_all_margins_and_follow_chance():
    sizes = np.array([5, 0, 3, 12])
    found = np.array([permuting._shares(sizes, 1, k) for k in range(1, 2001)])
    assert (found.sum(axis=1) == sizes).all() and (found.sum(axis=2) == sizes).all()
    assert np.abs(found.mean(axis=0) - np.outer(sizes, sizes) / 20).max() < 0.12


def test_more_points_than_a_task_holds_give_the_same_verdicts(grid):
    _, df, links = grid
    one = stats.permutation_p(df, links, "id", "y", permutations=40, seed=7).first()
    many = stats.permutation_p(df, links, "id", "y", permutations=40, seed=7, near="y", whole=50, tile=20).first()
    assert many.morans_i == pytest.approx(one.morans_i) and (many.n, many.links, many.p, many.verdict) == (120, one.links, one.p, "clustered")
    by = links.join(df.select(F.col("id").alias("i"), "g"), "i")
    whole, tiles = ({r.g: (r.links, round(r.morans_i, 9)) for r in stats.permutation_p(df, by, "id", "z", ["g"], permutations=5, **kw).collect()} for kw in ({}, {"whole": 50, "tile": 20}))
    assert whole == tiles and set(whole) == {"a", "b"}


def test_no_values_reach_the_driver(spark, grid, monkeypatch):
    _, df, links = grid
    most = []

    def counted(f):
        def g(self, *a):
            out = f(self, *a)
            most.append(len(out) if isinstance(out, list) else out.num_rows)
            return out

        return g

    for name in ("collect", "toArrow"):
        monkeypatch.setattr(type(df), name, counted(getattr(type(df), name)))
    out = stats.permutation_p(df, links, "id", "z", permutations=5)
    assert out.collect() and max(most) < 10
    assert "LocalRelation" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_whole_numbers_are_sent_in_two_bytes_with_the_same_sums(grid, monkeypatch):
    _, df, links = grid
    sent, packed = [], permuting._packed_values

    def kept(*a):
        out = packed(*a)
        sent.append(sum(len(r.z) for r in out.localCheckpoint().collect()))
        return out

    monkeypatch.setattr(permuting, "_packed_values", kept)
    for column, width in (("x", 2), ("z", 8)):
        known = df.select(F.col("id").alias("key"), F.col(column).alias("v"), F.col("y").alias("near"))
        places, sizes = permuting.placed(known, 120, "near", 50, 20)
        tops = {}
        for narrow in (permuting._narrow, lambda places: "float64"):
            with monkeypatch.context() as m:
                m.setattr(permuting, "_narrow", narrow)
                tops[narrow] = {r.k: r.top for r in permuting.permuted_sums(links, places, sizes, 0.5, F.lit("{}"), 7, 3, dealt=480)[1].collect()}
        one, two = tops.values()
        assert sent[-2:] == [120 * width, 120 * 8] and one == pytest.approx(two) and len(one) == 8


def test_rounds_deal_more_where_there_are_more_points(grid, monkeypatch):
    _, df, links = grid
    asked, sums = [], permuting.permuted_sums
    monkeypatch.setattr(permuting, "DEALT", 480)
    monkeypatch.setattr(permuting, "permuted_sums", lambda *a, **k: (asked.append(k["dealt"]), sums(*a, **k))[1])
    stats.permutation_p(df, links, "id", "z", permutations=2, near="y", whole=50, tile=20)
    assert asked == [permuting.LEAST * 120]
