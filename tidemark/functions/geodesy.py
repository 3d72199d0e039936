"""Ground distances and areas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS84 ellipsoid.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def affine(row: Column, col: Column, t: dict[str, Column]) -> tuple[Column, Column]:
    """Ground coordinates of a pixel's centre."""
    x, y = col + 0.5, row + 0.5
    return t["a"] * x + t["b"] * y + t["c"], t["d"] * x + t["e"] * y + t["f"]


def inverse_affine(x: Column, y: Column, t: dict[str, Column]) -> tuple[Column, Column]:
    """Row and column of a ground point."""
    det = t["a"] * t["e"] - t["b"] * t["d"]
    dx, dy = x - t["c"], y - t["f"]
    return (t["a"] * dy - t["d"] * dx) / det - 0.5, (t["e"] * dx - t["b"] * dy) / det - 0.5


def meridian_arc(lat1: Column, lat2: Column) -> Column:
    """Metres between two near latitudes (degrees) along a meridian: Simpson's rule over the radius of curvature."""
    e2 = WGS84_F * (2 - WGS84_F)

    def radius(lat: Column) -> Column:
        return WGS84_A * (1 - e2) / F.pow(1 - e2 * F.pow(F.sin(F.radians(lat)), 2), 1.5)

    mid = (lat1 + lat2) / 2
    return F.abs(F.radians(lat2 - lat1)) * (radius(lat1) + 4 * radius(mid) + radius(lat2)) / 6


def parallel_geodesic(lat: Column, dlon: Column) -> Column:
    """Metres of the geodesic between two points of one latitude that are a small angle (degrees) apart: the chord through the
    ellipsoid, bent by the curvature of its normal section."""
    e2 = WGS84_F * (2 - WGS84_F)
    n = WGS84_A / F.sqrt(1 - e2 * F.pow(F.sin(F.radians(lat)), 2))
    chord = 2 * n * F.cos(F.radians(lat)) * F.sin(F.radians(F.abs(dlon)) / 2)
    return 2 * n * F.asin(chord / (2 * n))


def geographic_row_area(row: Column, e: Column, f: Column, a: Column) -> Column:
    """Square metres of a pixel of a north-up geographic grid in a row: its width times its height on the ellipsoid."""
    top = f + row * e
    return parallel_geodesic(top + e / 2, a) * meridian_arc(top, top + e)


def point_segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length))).otherwise(0.0)
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def utm_inverse(x: Column, y: Column, zone: int | Column, south: bool | Column = False) -> tuple[Column, Column]:
    """Longitude and latitude of UTM metres, by the Krüger series to the third order (Karney 2011)."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    north = F.when(F.lit(south) if isinstance(south, bool) else south, 10_000_000.0).otherwise(0.0)
    xi, eta = (y - north) / (0.9996 * radius), (x - 500_000.0) / (0.9996 * radius)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return 6.0 * zone - 183.0 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(lat)


def utm_forward(lon: Column, lat: Column, zone: int | Column, south: bool | Column = False) -> tuple[Column, Column]:
    """UTM metres of a longitude and latitude; the same series the other way."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * n**0.5 / (1 + n)
    sin, dl = F.sin(F.radians(lat)), F.radians(lon - (6.0 * zone - 183.0))
    t = F.sinh(F.atanh(sin) - k * F.atanh(k * sin))
    xi1, eta1 = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    xi, eta = xi1, eta1
    for j, a in enumerate(alpha, 1):
        xi = xi + a * F.sin(2 * j * xi1) * F.cosh(2 * j * eta1)
        eta = eta + a * F.cos(2 * j * xi1) * F.sinh(2 * j * eta1)
    north = F.when(F.lit(south) if isinstance(south, bool) else south, 10_000_000.0).otherwise(0.0)
    return 500_000.0 + 0.9996 * radius * eta, 0.9996 * radius * xi + north


def utm_zone(crs: Column) -> Column:
    """1 to 60 of a reference system that is WGS84 UTM, else null."""
    return F.when(crs.rlike("^EPSG:32[67](0[1-9]|[1-5][0-9]|60)$"), F.substring(crs, 9, 2).cast("int"))


def utm_south(crs: Column) -> Column:
    return F.substring(crs, 8, 1) == "7"


def to_degrees(crs: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a point of a geographic or UTM grid; null for other reference systems."""
    zone, plain = utm_zone(crs), crs == "EPSG:4326"
    lon, lat = utm_inverse(x, y, zone, utm_south(crs))
    return F.when(plain, x).when(zone.isNotNull(), lon), F.when(plain, y).when(zone.isNotNull(), lat)


def with_local_plane(df: DataFrame, lon: str, lat: str, lon0: str, lat0: str, x: str, y: str) -> DataFrame:
    """``df`` with ``x`` and ``y``: metres east and north of (lon0, lat0) in the azimuthal-equidistant plane of the ellipsoid.

    Length and direction of the geodesic come from three rounds of Vincenty's inverse series (1975), each a projection, so no
    expression is written out twice; they are right to 4 mm in 100 km. Points near the antipode are not its domain.
    """
    b = WGS84_A * (1 - WGS84_F)
    reduced = lambda c: F.atan((1 - WGS84_F) * F.tan(F.radians(F.col(c))))
    step = df.withColumns({"_u1": reduced(lat0), "_u2": reduced(lat), "_l": F.radians(F.pmod(F.col(lon) - F.col(lon0) + 180.0, F.lit(360.0)) - 180.0)})
    step = step.withColumns({"_s1": F.sin("_u1"), "_c1": F.cos("_u1"), "_s2": F.sin("_u2"), "_c2": F.cos("_u2"), "_m": F.col("_l")})
    c = F.col
    for last in (False, False, True):
        step = step.withColumns({"_e": c("_c2") * F.sin("_m"), "_n": c("_c1") * c("_s2") - c("_s1") * c("_c2") * F.cos("_m"), "_cs": c("_s1") * c("_s2") + c("_c1") * c("_c2") * F.cos("_m")})
        step = step.withColumn("_ss", F.sqrt(c("_e") * c("_e") + c("_n") * c("_n"))).withColumns({"_sg": F.atan2("_ss", "_cs"), "_sa": F.when(c("_ss") > 0, c("_c1") * c("_e") / c("_ss")).otherwise(0.0)})
        step = step.withColumn("_ca", 1 - c("_sa") * c("_sa")).withColumns({"_mm": F.when(c("_ca") > 1e-15, c("_cs") - 2 * c("_s1") * c("_s2") / c("_ca")).otherwise(0.0), "_k": WGS84_F / 16 * c("_ca") * (4 + WGS84_F * (4 - 3 * c("_ca")))})
        if not last:
            bend = c("_sg") + c("_k") * c("_ss") * (c("_mm") + c("_k") * c("_cs") * (2 * c("_mm") * c("_mm") - 1))
            step = step.withColumn("_m", c("_l") + (1 - c("_k")) * WGS84_F * c("_sa") * bend)
    step = step.withColumn("_q", c("_ca") * (WGS84_A**2 - b**2) / b**2)
    step = step.withColumns({"_A": 1 + c("_q") / 16384 * (4096 + c("_q") * (-768 + c("_q") * (320 - 175 * c("_q")))), "_B": c("_q") / 1024 * (256 + c("_q") * (-128 + c("_q") * (74 - 47 * c("_q"))))})
    mm2 = c("_mm") * c("_mm")
    less = c("_B") * c("_ss") * (c("_mm") + c("_B") / 4 * (c("_cs") * (2 * mm2 - 1) - c("_B") / 6 * c("_mm") * (4 * c("_ss") * c("_ss") - 3) * (4 * mm2 - 3)))
    step = step.withColumn("_d", b * c("_A") * (c("_sg") - less))
    ratio = F.when(c("_ss") > 0, c("_d") / c("_ss")).otherwise(0.0)
    return step.withColumns({x: ratio * c("_e"), y: ratio * c("_n")}).drop(*[n for n in step.columns if n not in df.columns])


def azimuthal_equidistant(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north of a centre on the sphere of the local radius; within 0.2 % some hundred kilometres away."""
    e2 = WGS84_F * (2 - WGS84_F)
    s = 1 - e2 * F.pow(F.sin(F.radians(lat0)), 2)
    radius = WGS84_A * F.sqrt(F.lit(1 - e2)) / s
    p, p0, dl = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    c = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(dl))))
    k = F.when(F.abs(c) < 1e-12, 1.0).otherwise(c / F.sin(c))
    return radius * k * F.cos(p) * F.sin(dl), radius * k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(dl))
