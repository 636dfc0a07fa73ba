"""Meteorological column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EPSILON, GRAVITY, R_DRY, CALM = 0.622, 9.80665, 287.05, 2.5
EARTH_KM, EARTH_KM_SUPPORT, KM_PER_LAT, KM_PER_LON = 6371.0, 6371.0088, 110.57, 111.32
LAPSE, LAPSE_LAND = -0.0065, 0.007


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def wind_uv(speed: Column, direction: Column) -> tuple[Column, Column]:
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def wind_direction(u: Column, v: Column) -> Column:
    return F.pmod(270.0 - F.degrees(F.atan2(v, u)), F.lit(360.0))


def earth_to_grid(u: Column, v: Column, sin_a: Column, cos_a: Column) -> tuple[Column, Column]:
    return u * cos_a + v * sin_a, v * cos_a - u * sin_a


def grid_to_earth(u: Column, v: Column, sin_a: Column, cos_a: Column) -> tuple[Column, Column]:
    norm = sin_a * sin_a + cos_a * cos_a
    return (u * cos_a - v * sin_a) / norm, (u * sin_a + v * cos_a) / norm


def relative_humidity(t: Column, q: Column, p: Column) -> Column:
    e = q * p / (EPSILON + (1 - EPSILON) * q)
    tc = t - 273.15
    return 100.0 * e / (611.2 * F.exp(17.67 * tc / (tc + 243.5)))


def q_from_dewpoint(td: Column, p: Column) -> Column:
    tc = td - 273.15
    e = 611.2 * F.exp(17.67 * tc / (tc + 243.5))
    return EPSILON * e / (p - (1 - EPSILON) * e)


def q_saturation(t: Column, p: Column) -> Column:
    """Specific humidity of saturated air over water."""
    tc = t - 273.15
    e = F.least(610.94 * F.exp(17.625 * tc / (tc + 243.04)), 0.99 * p)
    return EPSILON * e / F.greatest(p - (1 - EPSILON) * e, F.lit(1.0))


def height_adjust_temperature(t: Column, dz: Column) -> Column:
    return t + LAPSE * dz


def height_adjust_pressure(p: Column, dz: Column, t: Column) -> Column:
    return p * F.exp(-GRAVITY * dz / (R_DRY * t))


def unit_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def arc_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance from the chord."""
    p, q = unit_sphere(lat1, lon1), unit_sphere(lat2, lon2)
    chord = F.sqrt(sum(((a - b) * (a - b) for a, b in zip(p[1:], q[1:])), (p[0] - q[0]) * (p[0] - q[0])))
    return 2 * radius * F.asin(F.least(chord / 2, F.lit(1.0)))


def blend(distance: Column, transition: float) -> Column:
    """Compact transition from 1 at 0 to 0 from ``transition`` on, by the rational blend of ``depth_share``."""
    return 1 - depth_share(clip(distance, 0.0, transition), transition)


def edge_taper(distance: Column, width: float, shape: str) -> Column:
    """Weight of the inner field by distance to the edge."""
    r = clip(distance / width, 0.0, 1.0)
    if shape == "linear":
        return r
    if shape == "cosine":
        return 0.5 - 0.5 * F.cos(F.pi() * r)
    return r * r * r * (r * (r * 6 - 15) + 10)


def soil_texture(sand: Column, silt: Column, clay: Column) -> Column:
    """Class 1 to 12 of the texture triangle by shares in percent; of several that hold the highest counts, default 6."""
    c15, c2 = silt + 1.5 * clay, silt + 2 * clay
    classes = {
        1: (sand >= 85) & (c15 < 15),
        2: sand.between(70, 90) & (sand != 90) & (c15 >= 15) & (c2 < 30),
        3: (c2 >= 30) & ((clay >= 7) & (clay < 20) & (sand > 52) | (clay < 7) & (silt < 50)),
        4: (silt >= 50) & ((clay >= 12) & (clay < 27) | (clay < 12) & (silt < 80)),
        5: (silt >= 80) & (clay < 12),
        6: (clay >= 7) & (clay < 27) & (silt >= 28) & (silt < 50) & (sand <= 52),
        7: (clay >= 20) & (clay < 35) & (silt < 28) & (sand > 45),
        8: (clay >= 27) & (clay < 40) & (sand <= 20),
        9: (clay >= 27) & (clay < 40) & (sand > 20) & (sand <= 45),
        10: (clay >= 35) & (sand > 45),
        11: (clay >= 40) & (silt >= 40),
        12: (clay >= 40) & (sand <= 45) & (silt < 40),
    }
    return F.coalesce(F.greatest(*[F.when(holds, k) for k, holds in classes.items()]), F.lit(6))


#: Fixed values by soil class 1 to 10 of the source model: field capacity, wilting point, porosity; layer bounds in metres; the classes that hold water.
FIELD_CAPACITY = (1e-10, 1e-10, 0.196, 0.260, 0.340, 0.370, 0.463, 0.763, 1e-10, 1e-10)
WILTING_POINT = (0.0, 0.0, 0.042, 0.100, 0.110, 0.185, 0.257, 0.265, 0.0, 0.0)
POROSITY = (1e-10, 1e-10, 0.364, 0.445, 0.455, 0.475, 0.507, 0.863, 1e-10, 1e-10)
SOIL_BOUNDS = (0.0, 0.01, 0.03, 0.09, 0.27, 0.81, 2.43, 7.29, 21.87)
WATER_DENSITY, HOLDS_WATER = 1000.0, (3, 8)


def by_class(code: Column, values: tuple) -> Column:
    """A fixed value by class from 1; null outside."""
    return F.when(code.between(1, len(values)), F.element_at(F.array(*map(F.lit, values)), F.greatest(code.cast("int"), F.lit(1))))


def water_content(mass: Column, layer: int) -> Column:
    """Volume share of the water mass (kg/m2) of a soil layer from 0."""
    return mass / (WATER_DENSITY * (SOIL_BOUNDS[layer + 1] - SOIL_BOUNDS[layer]))


def soil_moisture_index(mass: Column, layer: int, code: Column) -> Column:
    """0 at the wilting point, 1 at field capacity, more above it; null for classes that hold no water."""
    wilting = by_class(code, WILTING_POINT)
    return F.when(code.between(*HOLDS_WATER), F.greatest((water_content(mass, layer) - wilting) / (by_class(code, FIELD_CAPACITY) - wilting), F.lit(0.0)))


def relative_saturation(mass: Column, layer: int, code: Column) -> Column:
    """Share of the pores that is water, from 0 to 1; null for classes that hold none."""
    return F.when(code.between(*HOLDS_WATER), clip(water_content(mass, layer) / by_class(code, POROSITY), 0.0, 1.0))


def index_to_water(index: Column, dry: Column, wilting: Column, capacity: Column, most: Column) -> Column:
    """Water content of the target class from a moisture index, within its bounds."""
    return clip(wilting + index * (capacity - wilting), dry, most)


def saturation_to_water(saturation: Column, dry: Column, most: Column) -> Column:
    """Water content of the target class from a share of its pores."""
    return clip(clip(saturation, 0.0, 1.0) * most, dry, most)


def to_degrees(angle: Column, unit: Column) -> Column:
    """Degrees of an angle in a declared unit; an error for units that aren't degrees or radians."""
    u = F.lower(F.trim(unit))
    return F.when(u.isin("radian", "radians", "rad"), F.degrees(angle)).when(u.isin("degree", "degrees", "deg", "degrees_north", "degrees_east"), angle).otherwise(F.raise_error(F.concat(F.lit("unknown unit of angle: "), F.coalesce(unit, F.lit("none")))).cast("double"))


def as_percent(df, column: str, name: str):
    """A cover in percent: a column whose largest value is 1 or less is a fraction. ``name``_ok tells values outside 0 to 100."""
    most = df.agg(F.max(column).alias("_most"))  # one row
    x = F.when(F.col("_most") <= 1, F.col(column) * 100).otherwise(F.col(column))
    return df.crossJoin(F.broadcast(most)).withColumn(name, x).withColumn(f"{name}_ok", F.coalesce(F.col(name).between(0, 100), F.lit(False))).drop("_most")


def as_fraction(df, column: str, name: str):
    """An albedo as a fraction: a column whose largest value is over 1 is in percent. ``name``_ok tells values outside 0 to 1."""
    most = df.agg(F.max(column).alias("_most"))
    x = F.when(F.col("_most") > 1, F.col(column) / 100).otherwise(F.col(column))
    return df.crossJoin(F.broadcast(most)).withColumn(name, x).withColumn(f"{name}_ok", F.coalesce(F.col(name).between(0, 1), F.lit(False))).drop("_most")


def dry_mixing_ratio(species: list[Column]) -> list[Column]:
    total = sum(species[1:], species[0])
    return [s / (1 - total) for s in species]


def snow_temperature(skin: Column) -> Column:
    return clip(skin, F.greatest(skin - 10, F.lit(180.0)), F.least(skin, F.lit(273.15)))


def relaxation_weight(distance: Column, width: float) -> Column:
    """1 at the edge, 0 from ``width`` on."""
    c = F.cos(0.5 * F.pi() * distance / width)
    return F.when(distance >= width, 0.0).otherwise(c * c)


def wind10_weight(h0: Column, h1: Column) -> Column:
    return clip((10 - h0) / (h1 - h0), 0.0, 1.0)


def shapiro_response(order: int, strength: float, wavelength: Column) -> Column:
    return 1 - strength * F.pow(F.sin(F.pi() / wavelength), F.lit(float(order)))


def sleve_basis(zeta: Column, top: float, scale: float, exponent: float) -> Column:
    """Decay of a terrain scale with height."""
    power = lambda x: F.pow(x / scale, F.lit(exponent))
    return F.sinh(power(F.lit(top)) - power(zeta)) / F.sinh(power(F.lit(top)))


def sleve_slope(zeta: Column, top: float, scale: float, exponent: float) -> Column:
    """Change of that decay with height."""
    power = lambda x: F.pow(x / scale, F.lit(exponent))
    return -exponent / scale * F.pow(zeta / scale, F.lit(exponent - 1)) * F.cosh(power(F.lit(top)) - power(zeta)) / F.sinh(power(F.lit(top)))


def land_temperature(skin: Column, dz: Column, depth: Column) -> Column:
    """A soil temperature at a depth, brought to another height: the change grows with depth, see ``depth_share``."""
    return skin - LAPSE_LAND * dz * depth_share(depth)


def depth_share(depth: Column | float, full: float = 3.0):
    """The share of a change of height that a depth takes: 0 at the surface, 1 from ``full`` metres on, by a rational blend of third order."""
    c = 3 * full
    x = min(max(depth, -full), full) if isinstance(depth, (int, float)) else clip(depth, -full, full)
    return (9 * c * c * x + 27 * x * x * x) / (c * c * c + 27 * c * x * x)


def wrap_lon(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


#: Units of the observations' parameters and what makes them the models': a factor, and what is added after it.
OBSERVED = {"celsius": (1.0, 273.15), "hectopascal": (100.0, 0.0), "centimetre": (0.01, 0.0)}


def from_observed(value: Column, unit: str) -> Column:
    """An observed value in the models' unit: kelvin, pascal or metre. Another unit is an error."""
    if unit not in OBSERVED:
        raise ValueError(f"unknown unit {unit}")
    factor, added = OBSERVED[unit]
    return value * factor + added


def slope_of(nx: Column, ny: Column, nz: Column) -> tuple[Column, Column]:
    """Slope and aspect in radians of a surface from its normal, of any length but 0: the slope from 0, the aspect from north by east."""
    length = F.sqrt(nx * nx + ny * ny + nz * nz)
    return F.acos(clip(F.try_divide(nz, length), -1.0, 1.0)), F.pmod(F.pi() / 2 - F.atan2(ny, nx), 2 * F.pi())


def horizon_zenith(horizon: Column) -> Column:
    """Zenith angle in degrees of a horizon in radians; one under the level counts as level."""
    return 90.0 - F.greatest(F.degrees(horizon), F.lit(0.0))
