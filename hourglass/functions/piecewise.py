"""Piecewise-linear index maps, categories and stages as plain Column expressions.

Everything here compiles into whole-stage codegen: a knot table becomes a chain of ``when`` branches, so no
Python runs per row and the tables never travel as data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# National index breakpoints (concentration knots -> index knots).
INDEX_KNOTS = (0, 50, 100, 200, 300, 400, 500)
CONCENTRATION_KNOTS = {
    "pm25": (0, 30, 60, 90, 120, 250, 500),
    "pm10": (0, 50, 100, 250, 350, 430, 600),
    "no2": (0, 40, 80, 180, 280, 400, 600),
    "so2": (0, 40, 80, 380, 800, 1600, 2400),
    "nh3": (0, 200, 400, 800, 1200, 1800, 2400),
    "co": (0, 1, 2, 10, 17, 34, 50),
    "o3": (0, 50, 100, 168, 208, 748, 1000),
}
POLLUTANTS = tuple(CONCENTRATION_KNOTS)
EIGHT_HOUR_POLLUTANTS = ("co", "o3")
PARTICULATES = ("pm25", "pm10")

# US index knots, in the unit each table is published in, and molar masses in g/mol.
US_INDEX_KNOTS = (0, 50, 100, 150, 200, 300, 400, 500)
US_CONCENTRATION_KNOTS = {
    "pm25": (0, 12, 35.5, 55.5, 150.5, 250.5, 350.5, 500.5),
    "pm10": (0, 55, 155, 255, 355, 425, 505, 605),
    "no2": (0, 54, 101, 361, 650, 1250, 1650, 2050),
    "so2": (0, 36, 76, 186, 305, 605, 805, 1005),
    "co": (0, 4.5, 9.5, 12.5, 15.5, 30.5, 40.5, 50.5),
    "o3": (0, 0.055, 0.071, 0.086, 0.106, 0.201, 0.505, 0.605),
}
MOLAR_MASS = {"no2": 46.0055, "so2": 64.066, "o3": 47.998, "co": 28.01}
MOLAR_VOLUME = 24.45
INDEX_CAP = 500


def to_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def interpolate(value: Column | str, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Linear interpolation over the knots, held flat outside them; NULL and NaN stay NULL."""
    x = to_column(value).cast("double")
    expr = F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double")).when(x <= float(xs[0]), F.lit(float(ys[0])))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:], strict=False):
        slope = (y1 - y0) / (x1 - x0)
        expr = expr.when(x < float(x1), F.lit(float(slope)) * (x - F.lit(float(x0))) + F.lit(float(y0)))
    return expr.otherwise(F.lit(float(ys[-1])))


def sub_index(pollutant: str, concentration: Column | str) -> Column:
    """Sub-index of one pollutant, clamped to 0..500."""
    return interpolate(concentration, CONCENTRATION_KNOTS[pollutant], INDEX_KNOTS)


def _us_unit_factor(pollutant: str) -> float:
    """Stored unit (ug/m3, CO in mg/m3) to the unit of the US table (ppb, CO and O3 in ppm)."""
    if pollutant not in MOLAR_MASS:
        return 1.0
    factor = MOLAR_VOLUME / MOLAR_MASS[pollutant]
    return factor / 1000.0 if pollutant == "o3" else factor


def to_us_index(pollutant: str, concentration: Column | str) -> Column:
    """Concentration to the integer US index, rounded half up and capped at 500."""
    scaled = to_column(concentration).cast("double") * F.lit(_us_unit_factor(pollutant))
    index = interpolate(scaled, US_CONCENTRATION_KNOTS[pollutant], US_INDEX_KNOTS)
    return F.when(index.isNotNull(), F.least(F.floor(index + 0.5).cast("double"), F.lit(float(INDEX_CAP))))


def from_us_index(pollutant: str, index: Column | str) -> Column:
    """Inverse map: US index to concentration in the stored unit."""
    inverse = interpolate(to_column(index), US_INDEX_KNOTS, US_CONCENTRATION_KNOTS[pollutant])
    return inverse / F.lit(_us_unit_factor(pollutant))


def us_round_trip(pollutant: str, concentration: Column | str) -> Column:
    """Concentration recovered after publication as an integer US index."""
    return from_us_index(pollutant, to_us_index(pollutant, concentration))


def ppb_to_mass(pollutant: str, ppb: Column | str) -> Column:
    """ppb to ug/m3 (CO: to mg/m3) at 25 C and 1 atm; particulates pass through."""
    value = to_column(ppb).cast("double")
    if pollutant not in MOLAR_MASS:
        return value
    mass = value * F.lit(MOLAR_MASS[pollutant] / MOLAR_VOLUME)
    return mass / 1000.0 if pollutant == "co" else mass


def valid_index(sources: dict[str, Column | str], min_present: int = 3, required: Sequence[str] = PARTICULATES) -> Column:
    """True where at least ``min_present`` concentrations exist and one of ``required`` is among them.

    A sub-index exists exactly where its concentration does, so the concentrations are tested, not the long maps.
    """
    has = {p: to_column(c).isNotNull() & ~F.isnan(to_column(c)) for p, c in sources.items()}
    present = sum((h.cast("int") for h in has.values()), F.lit(0))
    anchored = F.lit(False)
    for name in required:
        anchored = anchored | has[name]
    return (present >= min_present) & anchored


# Category and stage names with their cuts.
CATEGORY_LABELS = ("Good", "Satisfactory", "Moderate", "Poor", "Very Poor", "Severe")
CATEGORY_UPPER = (50, 100, 200, 300, 400)
CLASS_LOWER = (51, 101, 201, 301, 401)
STAGE_LABELS = {"I": "Poor", "II": "Very Poor", "III": "Severe", "IV": "Severe+"}
STAGE_LOWER = {"I": 201, "II": 301, "III": 401, "IV": 451}


def category(index: Column | str) -> Column:
    """Category name by inclusive upper bound (50, 100, 200, 300, 400)."""
    x = to_column(index)
    expr = F.when(x.isNull(), F.lit(None).cast("string"))
    for upper, label in zip(CATEGORY_UPPER, CATEGORY_LABELS, strict=False):
        expr = expr.when(x <= upper, label)
    return expr.otherwise(CATEGORY_LABELS[-1])


def ordinal_class(index: Column | str) -> Column:
    """Ordinal class 0..5 by lower cuts 51/101/201/301/401; differs from ``category`` inside (50, 51) and so on."""
    x = to_column(index)
    return F.when(x.isNotNull(), sum(((x >= cut).cast("int") for cut in CLASS_LOWER), F.lit(0)))


def stage_number(index: Column | str) -> Column:
    """Stage 0..4 from a continuous index: >=201, >=301, >=401, >450."""
    x = to_column(index)
    return F.when(x.isNull(), F.lit(None)).when(x > 450, 4).when(x >= 401, 3).when(x >= 301, 2).when(x >= 201, 1).otherwise(0)


def stage_label(index: Column | str) -> Column:
    """Stage I..IV of the index truncated to a whole number, NULL below stage I (IV starts at 451)."""
    whole = to_column(index).cast("long")
    expr = F.when(whole.isNull(), F.lit(None).cast("string"))
    for label in reversed(STAGE_LOWER):
        expr = expr.when(whole >= STAGE_LOWER[label], label)
    return expr


def nowcast_weight(low: Column, high: Column) -> Column:
    """Stability weight of a 12 h window: min/max clipped to [0.5, 1]; 1 when the maximum is not positive."""
    return F.when(high > 0, F.greatest(F.lit(0.5), F.least(low / high, F.lit(1.0)))).otherwise(F.lit(1.0))
