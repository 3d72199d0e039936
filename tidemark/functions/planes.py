"""The planes of `geodesy` over arrays, for tasks in which pairs of a scene and a point are too many to be rows."""

from __future__ import annotations

import numpy as np

from .geodesy import WGS84_A, WGS84_F


def local_plane(lon: np.ndarray, lat: np.ndarray, lon0: np.ndarray, lat0: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Metres east and north of the centres ``lon0[at], lat0[at]``, by the series of `geodesy.with_local_plane`."""
    b, f = WGS84_A * (1 - WGS84_F), WGS84_F
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(v))) for v in (lat0, lat))
    s1, c1, s2, c2 = np.sin(u1)[at], np.cos(u1)[at], np.sin(u2), np.cos(u2)
    m = apart = np.radians(np.mod(lon - lon0[at] + 180.0, 360.0) - 180.0)
    s1c2, c1s2, s1s2, c1c2 = s1 * c2, c1 * s2, s1 * s2, c1 * c2
    for last in (False, False, True):
        cos = np.cos(m)
        e, n, cs = c2 * np.sin(m), c1s2 - s1c2 * cos, s1s2 + c1c2 * cos
        ss = np.sqrt(e * e + n * n)
        sg = np.arctan2(ss, cs)
        sa = c1 * e / np.where(ss > 0, ss, 1.0)
        ca = 1 - sa * sa
        mm = np.where(ca > 1e-15, cs - 2 * s1s2 / np.where(ca > 1e-15, ca, 1.0), 0.0)
        if not last:
            k = f / 16 * ca * (4 + f * (4 - 3 * ca))
            m = apart + (1 - k) * f * sa * (sg + k * ss * (mm + k * cs * (2 * mm * mm - 1)))
    q, mm2 = ca * ((WGS84_A**2 - b**2) / b**2), mm * mm
    big_a = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))
    big_b = q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
    less = big_b * ss * (mm + big_b / 4 * (cs * (2 * mm2 - 1) - big_b / 6 * mm * (4 * ss * ss - 3) * (4 * mm2 - 3)))
    ratio = np.where(ss > 0, b * big_a * (sg - less) / np.where(ss > 0, ss, 1.0), 0.0)
    return ratio * e, ratio * n


def utm_plane(lon: np.ndarray, lat: np.ndarray, zone: np.ndarray, south: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTM metres, by the series of `geodesy.utm_forward`."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    k = 2 * n**0.5 / (1 + n)
    sin, dl = np.sin(np.radians(lat)), np.radians(lon - (6.0 * zone - 183.0))
    t = np.sinh(np.arctanh(sin) - k * np.arctanh(k * sin))
    xi1, eta1 = np.arctan2(t, np.cos(dl)), np.arctanh(np.sin(dl) / np.sqrt(1 + t * t))
    xi, eta = xi1, eta1
    for j, a in enumerate((n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240), 1):
        xi = xi + a * np.sin(2 * j * xi1) * np.cosh(2 * j * eta1)
        eta = eta + a * np.cos(2 * j * xi1) * np.sinh(2 * j * eta1)
    return 500_000.0 + 0.9996 * radius * eta, 0.9996 * radius * xi + np.where(south, 10_000_000.0, 0.0)
