"""Geometry as column expressions, and Arrow-batched codecs where arithmetic alone doesn't do."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
MERCATOR_M = 6_378_137.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres; NULL if a coordinate is."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * F.lit(EARTH_M) * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def flat_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, km_per_degree: float = 111.32) -> Column:
    """Kilometres on a local plane, for short stretches."""
    return F.lit(km_per_degree) * F.sqrt(F.pow((lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)), 2) + F.pow(lat2 - lat1, 2))


def fold(degrees: Column) -> Column:
    """A longitude difference folded to -180..180."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing 0..360; NULL if the points are less than a metre apart."""
    dlon = F.radians(fold(lon2 - lon1))
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.when(haversine(lon1, lat1, lon2, lat2) >= 1.0, F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.lit(MERCATOR_M) * F.radians(lon), F.lit(MERCATOR_M) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_M), F.degrees(2 * F.atan(F.exp(y / MERCATOR_M)) - math.pi / 2)


def between(a: Column, b: Column, share: Column) -> Column:
    """The value at a share of the way from a to b."""
    return a + (b - a) * share


def segment_share(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on a segment (0..1) the nearest point to p lies; 0 for a segment without length."""
    length = F.pow(bx - ax, 2) + F.pow(by - ay, 2)
    share = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.when(length > 0, length)
    return F.when(length == 0, F.lit(0.0)).when(share < 0, F.lit(0.0)).when(share > 1, F.lit(1.0)).otherwise(share)


def turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Degrees by which a path a, b, c turns at b (0: straight on); NULL where an arm has no length."""
    ux, uy, vx, vy = bx - ax, by - ay, cx - bx, cy - by
    norm = F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy))
    return F.when(norm > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / norm)))))


def point_key(lon: Column, lat: Column, places: int = 6) -> Column:
    """One whole number for a rounded coordinate."""
    scale = 10**places
    return F.floor((lon + 180.0) * scale + 0.5).cast("long") * (10 ** (places + 3)) + F.floor((lat + 90.0) * scale + 0.5).cast("long")


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd point-in-polygon test over an array of structs (lon, lat); the ring closes itself."""
    n = F.size(ring)
    crossed = F.filter(F.sequence(F.lit(0), n - 1), lambda i: _crosses(lon, lat, F.get(ring, i), F.get(ring, (i + 1) % n)))
    return F.coalesce(F.size(crossed) % 2 == 1, F.lit(False))


def _crosses(lon: Column, lat: Column, a: Column, b: Column) -> Column:
    ay, by = a["lat"], b["lat"]
    at = a["lon"] + (lat - ay) / F.when(by == ay, F.lit(1.0)).otherwise(by - ay) * (b["lon"] - a["lon"])
    return ((ay > lat) != (by > lat)) & (lon < at)


def path_metres(path: Column) -> Column:
    """Length of an array of structs (lon, lat)."""
    legs = F.zip_with(path, F.slice(path, 2, F.greatest(F.size(path), F.lit(1))), lambda a, b: F.coalesce(haversine(a["lon"], a["lat"], b["lon"], b["lat"]), F.lit(0.0)))
    return F.aggregate(legs, F.lit(0.0), lambda acc, x: acc + x)


# --- codecs ----------------------------------------------------------------------------------------------------------


def _encode_number(n: int) -> str:
    n = ~(n << 1) if n < 0 else n << 1
    out = []
    while n >= 0x20:
        out.append(chr((0x20 | (n & 0x1F)) + 63))
        n >>= 5
    return "".join(out) + chr(n + 63)


def encode_path(points: list[tuple[float, float]], places: int = 5) -> str:
    """Polyline text of (lon, lat) points, latitude first, in steps of 10**-places."""
    last = (0, 0)
    out = []
    for lon, lat in points:
        now = (math.floor(lat * 10**places + 0.5), math.floor(lon * 10**places + 0.5))
        out += [_encode_number(now[0] - last[0]), _encode_number(now[1] - last[1])]
        last = now
    return "".join(out)


def decode_path(text: str, places: int = 5) -> list[tuple[float, float]]:
    """(lon, lat) points of polyline text; empty if it is malformed."""
    numbers, value, shift = [], 0, 0
    for c in text:
        b = ord(c) - 63
        if not 0 <= b < 64:
            return []
        value |= (b & 0x1F) << shift
        shift += 5
        if b < 0x20:
            numbers.append(~(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    if shift or len(numbers) % 2:
        return []
    lat = lon = 0
    out = []
    for dlat, dlon in zip(numbers[::2], numbers[1::2], strict=True):
        lat, lon = lat + dlat, lon + dlon
        out.append((lon / 10**places, lat / 10**places))
    return out


def polyline(points: Column) -> Column:
    """Polyline text of an array of structs (lon, lat)."""

    def encode(column: pd.Series) -> pd.Series:
        return column.map(lambda p: None if p is None else encode_path([(x["lon"], x["lat"]) for x in p]))

    return F.pandas_udf(encode, "string")(points)


def from_polyline(text: Column) -> Column:
    """The array of structs (lon, lat) of polyline text."""

    def decode(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else [{"lon": a, "lat": b} for a, b in decode_path(t)])

    return F.pandas_udf(decode, "array<struct<lon:double,lat:double>>")(text)


def tile_of(z: int, x: int, y: int) -> int:
    """Number of a tile along the Hilbert curves of all zooms."""
    base = sum(4**k for k in range(z))
    d, s = 0, 1 << z >> 1
    while s:
        rx, ry = int((x & s) > 0), int((y & s) > 0)
        d += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = s - 1 - (x & (s - 1)), s - 1 - (y & (s - 1))
            x, y = y, x
        s >>= 1
    return base + d


def tile_at(number: int) -> tuple[int, int, int]:
    """(z, x, y) of a tile number."""
    z = 0
    while number >= 4**z:
        number -= 4**z
        z += 1
    x = y = 0
    s = 1
    while s < 1 << z:
        rx = 1 & (number >> 1)
        ry = 1 & (number ^ rx)
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y = x + s * rx, y + s * ry
        number >>= 2
        s <<= 1
    return z, x, y


def simplified(points: list[tuple[float, float]], metres: float) -> list[int]:
    """Places of the points that Douglas and Peucker's method keeps at a tolerance in metres (strictly farther ones stay)."""
    if len(points) < 3:
        return list(range(len(points)))
    lat0 = points[0][1]
    k = 111_320.0
    flat = [(lon * k * math.cos(math.radians(lat0)), lat * k) for lon, lat in points]
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        (ax, ay), (bx, by) = flat[a], flat[b]
        length = (bx - ax) ** 2 + (by - ay) ** 2
        far, at = metres, -1
        for i in range(a + 1, b):
            px, py = flat[i]
            t = 0.0 if length == 0 else max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length))
            d = math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))
            if d > far:
                far, at = d, i
        if at >= 0:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return sorted(keep)


#: Fixed values of the shifted grid: axis in metres and squared eccentricity.
SHIFT_AXIS, SHIFT_E2 = 6_378_245.0, 0.00669342162296594323


def shifted(lon: Column, lat: Column) -> tuple[Column, Column]:
    """WGS-84 to the shifted grid (GCJ-02)."""
    x, y, pi = lon - 105.0, lat - 35.0, F.lit(math.pi)
    ripple = (20.0 * F.sin(6.0 * x * pi) + 20.0 * F.sin(2.0 * x * pi)) * 2.0 / 3.0
    dlat = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + ripple
    dlat = dlat + (20.0 * F.sin(y * pi) + 40.0 * F.sin(y / 3.0 * pi)) * 2.0 / 3.0 + (160.0 * F.sin(y / 12.0 * pi) + 320.0 * F.sin(y * pi / 30.0)) * 2.0 / 3.0
    dlon = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + ripple
    dlon = dlon + (20.0 * F.sin(x * pi) + 40.0 * F.sin(x / 3.0 * pi)) * 2.0 / 3.0 + (150.0 * F.sin(x / 12.0 * pi) + 300.0 * F.sin(x / 30.0 * pi)) * 2.0 / 3.0
    rad = F.radians(lat)
    magic = 1 - SHIFT_E2 * F.pow(F.sin(rad), 2)
    root = F.sqrt(magic)
    return lon + dlon * 180.0 / (SHIFT_AXIS / root * F.cos(rad) * pi), lat + dlat * 180.0 / (SHIFT_AXIS * (1 - SHIFT_E2) / (magic * root) * pi)


def unshifted(lon: Column, lat: Column, rounds: int = 3) -> tuple[Column, Column]:
    """The inverse, by a few fixed-point steps."""
    x, y = lon, lat
    for _ in range(rounds):
        sx, sy = shifted(x, y)
        x, y = x - (sx - lon), y - (sy - lat)
    return x, y
