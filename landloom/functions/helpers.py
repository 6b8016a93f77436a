"""Small geometry helpers on rings of (x, y), for the few things that column expressions can't say."""

from __future__ import annotations

import numpy as np

Ring = list[tuple[float, float]]


def vincenty(lng1: np.ndarray, lat1: np.ndarray, lng2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Metres on the WGS84 ellipsoid, all pairs at once; NaN where a place is missing. Pairs for which the iteration fails, near antipodes, are solved by ``by_azimuth``."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    span = np.radians(lng2 - lng1)
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = span.copy()
    with np.errstate(all="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cs = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0, cu1 * cu2 * sl / np.where(ss == 0, 1, ss))
            c2a = 1 - sa * sa
            c2m = np.where(c2a == 0, 0, cs - 2 * su1 * su2 / np.where(c2a == 0, 1, c2a))
            c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
            new = span + (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1)))
            moved, lam = np.abs(new - lam), new
            if not np.any(moved > 1e-12):
                break
        k = c2a * (a * a - b * b) / (b * b)
        big = 1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768))
        small = k / 1024 * (256 + k * (k * (74 - 47 * k) - 128))
        delta = small * ss * (c2m + small / 4 * (cs * (2 * c2m * c2m - 1) - small / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))
        out = np.where(moved > 1e-9, np.nan, b * big * (sigma - delta))
    # An iteration that comes to rest beyond half a turn has found another line than the shortest.
    lost = np.flatnonzero((np.isnan(out) | (np.abs(lam) > np.pi)) & ~np.isnan(lng1 + lat1 + lng2 + lat2))
    if len(lost):
        out[lost] = by_azimuth(lng1[lost], lat1[lost], lng2[lost], lat2[lost])
    return out


def by_azimuth(lng1: np.ndarray, lat1: np.ndarray, lng2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """The same lengths for any pairs, antipodes among them: the azimuth at the first place is bisected until the line comes to the second one's latitude at its longitude.

    Longitudes grow with the azimuth where the first place is the one farther from the equator, taken as southern. Longitude and length are integrals along the auxiliary sphere of functions that hardly vary; 16 Gauss
    nodes give all digits. Of two places on a meridian, half a turn apart, the way over the nearer pole counts.
    """
    a, f = 6378137.0, 1 / 298.257223563
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    swap = np.abs(u1) < np.abs(u2)
    u1, u2 = np.where(swap, u2, u1), np.where(swap, u1, u2)
    u1, u2 = np.where(u1 > 0, -u1, u1), np.where(u1 > 0, -u2, u2)
    u1 = np.minimum(u1, -1e-13)  # so that a line that leaves the equator knows its side
    turn = np.abs((np.radians(lng2 - lng1) + np.pi) % (2 * np.pi) - np.pi)
    s1, c1, s2, c2 = np.sin(u1), np.maximum(np.cos(u1), 1e-16), np.sin(u2), np.maximum(np.cos(u2), 1e-16)
    node, weight = np.polynomial.legendre.leggauss(16)

    def line(azimuth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longitude and length of the line that starts so, where it reaches the second latitude."""
        sa, ca = np.sin(azimuth), np.cos(azimuth)
        s0 = sa * c1
        back = np.sqrt(np.maximum(ca * ca * c1 * c1 + (c2 - c1) * (c2 + c1), 0)) / c2
        sigma1, sigma2 = np.arctan2(s1, ca * c1), np.arctan2(s2, back * c2)
        omega = np.arctan2(s0 * s2, back * c2) - np.arctan2(s0 * s1, ca * c1)
        k2 = f * (2 - f) / (1 - f) ** 2 * np.maximum(1 - s0 * s0, 0)
        half = (sigma2 - sigma1) / 2
        root = np.sqrt(1 + k2 * np.sin((sigma1 + sigma2) / 2 + half * node[:, None]) ** 2)
        less = f * s0 * half * (weight[:, None] * (2 - f) / (1 + (1 - f) * root)).sum(axis=0)
        return omega - less, a * (1 - f) * half * (weight[:, None] * root).sum(axis=0)

    low, high = np.zeros(len(u1)), np.full(len(u1), np.pi)
    for _ in range(60):
        middle = (low + high) / 2
        short = line(middle)[0] < turn
        low, high = np.where(short, middle, low), np.where(short, high, middle)
    return line((low + high) / 2)[1]


def signed_area(ring: Ring) -> float:
    if len(ring) < 3:
        return 0.0
    x0, y0 = ring[0]
    return sum((ax - x0) * (by - y0) - (bx - x0) * (ay - y0) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])) / 2


def open_ring(ring: Ring) -> Ring:
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


def _turn(p, q, r) -> float:
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


def hull(points: Ring) -> Ring:
    """Convex hull, counter-clockwise, by monotone chain."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def chain(seq: Ring) -> Ring:
        out: Ring = []
        for p in seq:
            while len(out) > 1 and _turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(pts[::-1])
