"""Column expressions of single rows. A missing input gives null."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layers that are modelled on a logarithmic scale.
LOG10_LAYERS, LOG1P_LAYERS = ("flow_accumulation",), ("spi",)


def number(value: Column) -> Column:
    """A double; NaN and what isn't a number are null."""
    v = value.try_cast("double")
    return F.when(~F.isnan(v), v)


def without(value: Column, *sentinels: float) -> Column:
    """Null for the codes that stand for missing values."""
    return F.when(~value.isin(*sentinels), value)


def all_present(*values: Column) -> Column:
    return reduce(and_, [v.isNotNull() & ~F.isnan(v.cast("double")) for v in values])


def modelled(name: str, value: Column) -> Column:
    """The layer's modelling transform; where the logarithm doesn't exist it is null."""
    if name in LOG10_LAYERS:
        return F.when(value > 0, F.log10(F.when(value > 0, value)))
    if name in LOG1P_LAYERS:
        return F.when(value > -1, F.log1p(F.when(value > -1, value)))
    return value


def _steep(slope: Column, least: float) -> Column:
    return F.when(slope.isNotNull(), F.greatest(F.tan(slope), F.lit(least)))


def twi(acc: Column, slope: Column, cell_area: float = 100.0, least: float = 1e-4) -> Column:
    """Wetness index: ln(contributing area / tan(slope)); slope in radians."""
    area = acc * cell_area
    return F.when(area > 0, F.ln(F.when(area > 0, area) / _steep(slope, least)))


def spi(acc: Column, slope: Column, cell_area: float = 100.0) -> Column:
    """Stream power: contributing area times tan(slope)."""
    return acc * cell_area * F.tan(slope)


def aicc(loglik: Column, k: Column, n: Column) -> Column:
    """Small-sample Akaike criterion; infinite where n - k - 1 isn't positive."""
    spare = n - k - 1
    return F.when(spare <= 0, F.lit(float("inf"))).otherwise(2 * k - 2 * loglik + 2 * k * (k + 1) / F.when(spare > 0, spare))


def clamp01(v: Column, low: Column, high: Column) -> Column:
    """Position between low and high, within 0 to 1; 0 where they are equal."""
    return F.when(v.isNull(), F.lit(None)).when(high == low, F.lit(0.0)).otherwise(F.least(F.greatest(F.try_divide(v - low, (high - low).cast("double")), F.lit(0.0)), F.lit(1.0)))


def row_mean(*values: Column) -> Column:
    """Mean of what is present."""
    present = F.filter(F.array(*values), lambda v: v.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda a, v: a + v)
    return F.try_divide(total, F.size(present).cast("double"))


#: Runoff curve numbers by land cover class, for soil groups A, B, C, D (TR-55, good condition).
CURVE_NUMBERS = {
    11: (100, 100, 100, 100),
    31: (77, 86, 91, 94),
    41: (30, 55, 70, 77),
    42: (30, 55, 70, 77),
    43: (30, 55, 70, 77),
    51: (30, 48, 65, 73),
    52: (30, 48, 65, 73),
    71: (30, 58, 71, 78),
    72: (30, 58, 71, 78),
    73: (30, 58, 71, 78),
    74: (30, 58, 71, 78),
    81: (39, 61, 74, 80),
    82: (67, 78, 85, 89),
    90: (30, 55, 70, 77),
    95: (30, 58, 71, 78),
}
#: Developed classes, and the curve numbers of open space and of paved ground.
DEVELOPED, OPEN_SPACE, PAVED, WATER = (21, 22, 23, 24), (39, 61, 74, 80), 98, 11


def curve_number(cover: Column, soil: Column, impervious: Column) -> Column:
    """By cover class and soil group 1 to 4. Developed cover mixes open space and paved ground by impervious per cent; water is 100 on any soil; an unknown class is null."""

    def by_soil(values) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in values]), soil.cast("int") - 1)

    table = F.when(cover == WATER, F.lit(100.0))
    share = impervious / 100.0
    table = table.when(cover.isin(*DEVELOPED), by_soil(OPEN_SPACE) * (1 - share) + PAVED * share)
    for code, values in CURVE_NUMBERS.items():
        if code != WATER:
            table = table.when(cover == code, by_soil(values))
    return table


def point_fingerprint(points: Column) -> Column:
    """Aggregate: twelve hexadecimal digits of the set of (x, y), rounded to millimetres, in any order. points: struct of two numbers."""
    x = F.format_string("%.3f,%.3f", F.bround(points["x"], 3), F.bround(points["y"], 3))
    return F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(x)), ";").cast("binary"), 256), 1, 12)
