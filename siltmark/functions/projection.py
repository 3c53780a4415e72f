"""Coordinate changes in closed form, as built-in functions: Lambert conformal conic to geographic to transverse Mercator.

Both systems are on one datum, so no shift comes between. Series are those of Snyder's manual,
good to less than a millimetre within a zone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ellipsoid GRS 80, and the US survey foot in metres (fixed values).
A, FLATTENING = 6378137.0, 1 / 298.257222101
US_FOOT = 1200 / 3937
_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


@dataclass(frozen=True)
class Conic:
    """Two standard parallels, origin in degrees, false origin in metres."""

    first: float
    second: float
    latitude: float
    longitude: float
    x0: float
    y0: float

    @staticmethod
    def _t(p: float) -> float:
        s = _E * math.sin(p)
        return math.tan(math.pi / 4 - p / 2) / ((1 - s) / (1 + s)) ** (_E / 2)

    @property
    def constants(self) -> tuple[float, float, float]:
        """n, a F and the radius of the origin's parallel."""
        p, q, o = (math.radians(v) for v in (self.first, self.second, self.latitude))
        m, k = (math.cos(v) / math.sqrt(1 - _E2 * math.sin(v) ** 2) for v in (p, q))
        n = (math.log(m) - math.log(k)) / (math.log(self._t(p)) - math.log(self._t(q)))
        f = A * m / (n * self._t(p) ** n)
        return n, f, f * self._t(o) ** n

    def project(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """Metres (x, y) of radians."""
        n, f, r0 = self.constants
        s = F.lit(_E) * F.sin(lat)
        t = F.tan(math.pi / 4 - lat / 2) / F.pow((1 - s) / (1 + s), F.lit(_E / 2))
        r, theta = f * F.pow(t, F.lit(n)), n * (lon - math.radians(self.longitude))
        return self.x0 + r * F.sin(theta), self.y0 + r0 - r * F.cos(theta)

    def geographic(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(latitude, longitude) in radians of metres x, y. The cone must open to the north."""
        n, f, r0 = self.constants
        dx, dy = x - self.x0, F.lit(r0) - (y - self.y0)
        chi = math.pi / 2 - 2 * F.atan(F.pow(F.sqrt(dx * dx + dy * dy) / f, F.lit(1 / n)))
        e4, e6, e8 = _E2**2, _E2**3, _E2**4
        lat = chi + (_E2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360) * F.sin(2 * chi) + (7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520) * F.sin(4 * chi)
        lat = lat + (7 * e6 / 120 + 81 * e8 / 1120) * F.sin(6 * chi) + 4279 * e8 / 161280 * F.sin(8 * chi)
        return lat, F.atan2(dx, dy) / n + math.radians(self.longitude)


@dataclass(frozen=True)
class Mercator:
    """Central meridian in degrees, scale there, false origin in metres."""

    longitude: float
    scale: float = 0.9996
    x0: float = 500000.0
    y0: float = 0.0

    def project(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """Metres (x, y) of radians."""
        e4, e6, second = _E2**2, _E2**3, _E2 / (1 - _E2)
        sin, cos = F.sin(lat), F.cos(lat)
        n = A / F.sqrt(1 - _E2 * sin * sin)
        t, c, a = F.pow(F.tan(lat), F.lit(2)), second * cos * cos, (lon - math.radians(self.longitude)) * cos
        arc = (1 - _E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * lat - (3 * _E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * lat)
        arc = A * (arc + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * lat) - 35 * e6 / 3072 * F.sin(6 * lat))
        p = {k: F.pow(a, F.lit(k)) for k in (2, 3, 4, 5, 6)}
        x = a + (1 - t + c) * p[3] / 6 + (5 - 18 * t + t * t + 72 * c - 58 * second) * p[5] / 120
        y = p[2] / 2 + (5 - t + 9 * c + 4 * c * c) * p[4] / 24 + (61 - 58 * t + t * t + 600 * c - 330 * second) * p[6] / 720
        return self.scale * n * x + self.x0, self.scale * (arc + n * F.tan(lat) * y) + self.y0

    def geographic(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(latitude, longitude) in radians of metres x, y."""
        e4, e6, second = _E2**2, _E2**3, _E2 / (1 - _E2)
        root = math.sqrt(1 - _E2)
        g = (1 - root) / (1 + root)
        mu = (y - self.y0) / self.scale / (A * (1 - _E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256))
        foot = mu + (3 * g / 2 - 27 * g**3 / 32) * F.sin(2 * mu) + (21 * g**2 / 16 - 55 * g**4 / 32) * F.sin(4 * mu) + 151 * g**3 / 96 * F.sin(6 * mu) + 1097 * g**4 / 512 * F.sin(8 * mu)
        # each value once, however often it is needed
        of = _let(foot, lambda p: F.struct(p.alias("p"), F.tan(p).alias("tan"), F.cos(p).alias("cos"), (1 - _E2 * F.sin(p) * F.sin(p)).alias("w")))
        with_n = _let(of, lambda o: F.struct(o["p"].alias("p"), o["tan"].alias("tan"), o["cos"].alias("cos"), (A / F.sqrt(o["w"])).alias("n"), (A * (1 - _E2) / (o["w"] * F.sqrt(o["w"]))).alias("r")))
        terms = _let(with_n, lambda o: F.struct(o.alias("o"), (o["tan"] * o["tan"]).alias("t"), (second * o["cos"] * o["cos"]).alias("c"), ((x - self.x0) / (o["n"] * self.scale)).alias("d")))

        def place(v: Column) -> Column:
            o, t, c, d = v["o"], v["t"], v["c"], v["d"]
            p = {k: F.pow(d, F.lit(k)) for k in (2, 3, 4, 5, 6)}
            up = p[2] / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * second) * p[4] / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * second - 3 * c * c) * p[6] / 720
            along = d - (1 + 2 * t + c) * p[3] / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * second + 24 * t * t) * p[5] / 120
            return F.struct((o["p"] - o["n"] * o["tan"] / o["r"] * up).alias("lat"), (math.radians(self.longitude) + along / o["cos"]).alias("lon"))

        out = _let(terms, place)
        return out["lat"], out["lon"]


@dataclass(frozen=True)
class Geographic:
    """Longitude and latitude in degrees as x and y."""

    def project(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        return F.degrees(lon), F.degrees(lat)

    def geographic(self, x: Column, y: Column) -> tuple[Column, Column]:
        return F.radians(y), F.radians(x)


@dataclass(frozen=True)
class Scaled:
    """A system in another unit than metres."""

    of: Conic | Mercator
    metres: float

    def project(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        x, y = self.of.project(lat, lon)
        return x / self.metres, y / self.metres

    def geographic(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.of.geographic(x * self.metres, y * self.metres)


System = Conic | Mercator | Geographic | Scaled


def _moved(x: Column, y: Column, source: System, target: System) -> Column:
    """A struct of x and y in the target. Latitude and longitude are computed once, however often the projection needs them, so that expressions stay small."""
    lat, lon = source.geographic(x.cast("double"), y.cast("double"))

    def put(g: Column) -> Column:
        u, v = target.project(g["lat"], g["lon"])
        return F.struct(u.alias("x"), v.alias("y"))

    return _let(F.struct(lat.alias("lat"), lon.alias("lon")), put)


def changed(x: Column, y: Column, source: System, target: System) -> tuple[Column, Column]:
    """Coordinates of one system in another; null where a coordinate is."""
    if source == target:
        return x.cast("double"), y.cast("double")
    of = _moved(x, y, source, target)
    return of["x"], of["y"]


def with_changed(df: DataFrame, x: str, y: str, source: System, target: System, into: tuple[str, str] = ("x", "y")) -> DataFrame:
    """df with the coordinates x and y of one system in another, as the columns of into."""
    if source == target:
        return df.withColumns({into[0]: F.col(x).cast("double"), into[1]: F.col(y).cast("double")})
    of = df.withColumn("__moved", _moved(F.col(x), F.col(y), source, target))
    return of.withColumns({into[0]: F.col("__moved.x"), into[1]: F.col("__moved.y")}).drop("__moved")


def system_of(text: str) -> System:
    """The system that a .prj text tells of: degrees, a conic of two parallels or a transverse Mercator, in metres or other units. Others are an error; datums are taken as one."""
    if text.lstrip().upper().startswith("GEOGCS"):
        return Geographic()
    kind = re.search(r'PROJECTION\s*\[\s*"([^"]+)"', text, re.I)
    given = {k.lower(): float(v) for k, v in re.findall(r'PARAMETER\s*\[\s*"([^"]+)"\s*,\s*([-+0-9.eE]+)', text, re.I)}
    # the last unit is that of the coordinates; the first one, degrees, that of angles
    unit = float(re.findall(r'UNIT\s*\[\s*"[^"]+"\s*,\s*([-+0-9.eE]+)', text, re.I)[-1])
    x0, y0 = given.get("false_easting", 0.0) * unit, given.get("false_northing", 0.0) * unit
    name = kind[1].lower() if kind else ""
    if "lambert_conformal_conic" in name and "standard_parallel_2" in given:
        of: Conic | Mercator = Conic(given["standard_parallel_1"], given["standard_parallel_2"], given["latitude_of_origin"], given["central_meridian"], x0, y0)
    elif name == "transverse_mercator" and given.get("latitude_of_origin", 0.0) == 0:
        of = Mercator(given["central_meridian"], given.get("scale_factor", 1.0), x0, y0)
    else:
        raise ValueError(f"unknown projection {kind[1] if kind else text[:60]}")
    return of if unit == 1 else Scaled(of, unit)


#: State plane, Kansas north (degrees: 39 47', 38 43', 38 20'), and UTM zone 14 (fixed values).
STATE_PLANE = Conic(39 + 47 / 60, 38 + 43 / 60, 38 + 20 / 60, -98.0, 400000.0, 0.0)
UTM_14 = Mercator(-99.0)
STATE_PLANE_FEET = Scaled(STATE_PLANE, US_FOOT)


def feet_to_grid(easting: Column, northing: Column, plane: Conic = STATE_PLANE, grid: Mercator = UTM_14) -> tuple[Column, Column]:
    """US survey feet of a state plane as metres of the grid; null where a coordinate is."""
    return grid.project(*plane.geographic(easting.cast("double") * US_FOOT, northing.cast("double") * US_FOOT))
