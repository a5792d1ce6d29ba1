"""Geometry as column expressions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6378137.0
# South-west corner of each map, latitude and longitude.
ORIGINS = {
    "boston-seaport": (42.336849169438615, -71.05785369873047),
    "singapore-onenorth": (1.2882100868743724, 103.78475189208984),
    "singapore-hollandvillage": (1.2993652317780957, 103.78217697143555),
    "singapore-queenstown": (1.2782562240223188, 103.76741409301758),
}


def origin(location: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a location's origin; null if it isn't known."""
    out = []
    for k in (0, 1):
        pick = F.lit(None).cast("double")
        for name, point in ORIGINS.items():
            pick = F.when(location == name, F.lit(point[k])).otherwise(pick)
        out.append(pick)
    return out[0], out[1]


def clamped(x: Column) -> Column:
    """To [-1, 1]; NaN and null stay what they are, where greatest() alone would make them 1."""
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def enu_to_wgs84(x: Column, y: Column, location: Column) -> Column:
    """Struct of lat and lon, on the sphere, of a point x metres east and y north of a location's origin."""
    lat0, lon0 = (F.radians(c) for c in origin(location))
    bearing, angle = F.atan2(x, y), F.hypot(x, y) / EARTH_RADIUS_M
    sin_lat = F.sin(lat0) * F.cos(angle) + F.cos(lat0) * F.sin(angle) * F.cos(bearing)
    lat = F.asin(clamped(sin_lat))
    lon = lon0 + F.atan2(F.sin(bearing) * F.sin(angle) * F.cos(lat0), F.cos(angle) - F.sin(lat0) * F.sin(lat))
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(lon).alias("lon"))


def wgs84_to_enu(lat: Column, lon: Column, location: Column) -> Column:
    """Inverse of `enu_to_wgs84`: struct of x and y in metres."""
    lat0, lon0 = (F.radians(c) for c in origin(location))
    a, d = F.radians(lat), F.radians(lon) - lon0
    angle = F.acos(clamped(F.sin(lat0) * F.sin(a) + F.cos(lat0) * F.cos(a) * F.cos(d)))
    bearing = F.atan2(F.sin(d) * F.cos(a), F.cos(lat0) * F.sin(a) - F.sin(lat0) * F.cos(a) * F.cos(d))
    return F.struct((EARTH_RADIUS_M * angle * F.sin(bearing)).alias("x"), (EARTH_RADIUS_M * angle * F.cos(bearing)).alias("y"))


def mercator_scale(lat: Column) -> Column:
    return 1 / F.cos(F.radians(lat))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees from north, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def box_footprint(cx: Column, cy: Column, width: Column, length: Column, yaw: Column, location: Column) -> Column:
    """Closed ring of five (lon, lat) pairs; null where the location isn't known."""
    corners = []
    for along, across in ((0.5, 0.5), (0.5, -0.5), (-0.5, -0.5), (-0.5, 0.5), (0.5, 0.5)):
        lx, ly = length * along, width * across
        p = enu_to_wgs84(cx + lx * F.cos(yaw) - ly * F.sin(yaw), cy + lx * F.sin(yaw) + ly * F.cos(yaw), location)
        corners.append(F.array(p["lon"], p["lat"]))
    return F.when(location.isin(*ORIGINS), F.array(*corners))


def yaw_approx(rot_z: Column) -> Column:
    return 2 * F.asin(clamped(rot_z))


def yaw_true(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def norm(values: Column) -> Column:
    """L2 norm of an array."""
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, v: s + v * v))


def round_half_up(x: Column, places: int = 4) -> Column:
    """Toward plus infinity on ties, unlike round()."""
    return F.floor(x * 10.0**places + 0.5) / 10.0**places


def plausible(lat: Column, lon: Column) -> Column:
    """Finite and on the globe; false for null."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def parse_bounds(spec: str) -> dict[str, tuple[float, float, float, float]]:
    """location=minLat,maxLat,minLon,maxLon entries, separated by semicolons."""
    found: dict[str, tuple[float, float, float, float]] = {}
    if not spec or not spec.strip():
        raise ValueError("bounds must not be blank")
    for entry in spec.split(";"):
        name, _, numbers = entry.partition("=")
        name = name.strip()
        try:
            box = tuple(float(x) for x in numbers.split(","))
        except ValueError as e:
            raise ValueError(f"bounds of {name!r} are not numbers") from e
        if not name or len(box) != 4:
            raise ValueError(f"bounds need a name and four numbers: {entry!r}")
        low_lat, high_lat, low_lon, high_lon = box
        if not (-90 <= low_lat < high_lat <= 90 and -180 <= low_lon < high_lon <= 180):
            raise ValueError(f"bounds of {name!r} are empty or off the globe")
        if name in found:
            raise ValueError(f"bounds of {name!r} are given twice")
        found[name] = box
    return found
