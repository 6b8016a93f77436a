"""Geometry in Arrow batches: overlap areas of many pairs at once, and polygons cut to a box."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of edges that are looked at together.
EDGES = 1 << 20

Ring = list[tuple[float, float]]


class Edges:
    """The edges of a batch of polygons that aren't upright: ends from left to right, the row of each, and whether the inside is below it (1) or above (-1)."""

    def __init__(self, geoms: pa.Array) -> None:
        parts = pc.struct_field(geoms, "parts")  # null where the geometry is
        rings = parts.flatten()
        points = rings.flatten()
        n_parts, n_rings, n_points = (np.asarray(x.value_lengths().fill_null(0), np.int64) for x in (parts, rings, points))
        flat = points.flatten()
        x, y = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
        row_of_ring = np.repeat(np.repeat(np.arange(len(n_parts)), n_parts), n_rings)
        start = np.cumsum(n_points) - n_points
        first = np.zeros(len(n_points), bool)  # exterior rings
        first[(np.cumsum(n_rings) - n_rings)[n_rings > 0]] = True
        ring = np.repeat(np.arange(len(n_points)), n_points)
        after = np.arange(1, len(x) + 1)
        after[(start + n_points - 1)[n_points > 0]] = start[n_points > 0]
        ox, oy = x[start[ring]], y[start[ring]]  # areas from a ring's first vertex keep their digits
        area = np.bincount(ring, (x - ox) * (y[after] - oy) - (x[after] - ox) * (y - oy), len(n_points))
        way = np.where(area >= 0, 1.0, -1.0) * np.where(first, 1.0, -1.0)
        keep = np.flatnonzero(x[after] != x)
        p, q = keep, after[keep]
        right = x[q] > x[p]
        left_end, right_end = np.where(right, p, q), np.where(right, q, p)
        self.x0, self.y0, self.x1, self.y1 = x[left_end], y[left_end], x[right_end], y[right_end]
        self.sign = np.where(right, -1.0, 1.0) * way[ring[keep]]
        self.row, self.rows = row_of_ring[ring[keep]], len(n_parts)

    def within(self, low: np.ndarray, high: np.ndarray) -> None:
        """Only edges that reach into their row's range of x; what is left and right of it counts nothing."""
        kept = (self.x1 > low[self.row]) & (self.x0 < high[self.row])
        for name in ("x0", "y0", "x1", "y1", "sign", "row"):
            setattr(self, name, getattr(self, name)[kept])

    def span(self) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full(self.rows, np.inf), np.full(self.rows, -np.inf)
        np.minimum.at(low, self.row, self.x0)
        np.maximum.at(high, self.row, self.x1)
        return low, high


def overlap_areas(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Area common to the two polygons of each row, concave rings, holes and several parts included; 0 where one is null or none.

    A polygon is what lies below its edges, each with a sign, so the overlap is the sum over pairs of edges of the area below both, and as the signs of a polygon's edges sum to 0 at each x, minus half
    the sum of the areas between both. These are trapezoids or two triangles, in closed form.
    """
    left, right = Edges(a), Edges(b)
    (l0, l1), (r0, r1) = left.span(), right.span()
    low, high = np.maximum(l0, r0), np.minimum(l1, r1)
    for side in (left, right):
        side.within(low, high)
        order = np.argsort(side.row, kind="stable")
        for name in ("x0", "y0", "x1", "y1", "sign", "row"):
            setattr(side, name, getattr(side, name)[order])
    total = np.zeros(left.rows)
    count = np.bincount(right.row, minlength=left.rows)
    first = np.cumsum(count) - count
    n = count[left.row]
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + EDGES, side="right")))
        e = np.repeat(np.arange(at, stop), n[at:stop])
        f = np.arange(len(e)) - np.repeat(ends[at:stop] - n[at:stop] - done, n[at:stop]) + first[left.row[e]]
        x0, x1 = np.maximum(left.x0[e], right.x0[f]), np.minimum(left.x1[e], right.x1[f])
        both = np.flatnonzero(x1 > x0)
        e, f, x0, x1 = e[both], f[both], x0[both], x1[both]

        def height(side: Edges, k: np.ndarray, x: np.ndarray) -> np.ndarray:
            # From the nearer end, so that an end's own height comes out exactly.
            t = (x - side.x0[k]) / (side.x1[k] - side.x0[k])
            rise = side.y1[k] - side.y0[k]
            return np.where(t <= 0.5, side.y0[k] + t * rise, side.y1[k] - (1 - t) * rise)

        d0, d1 = (height(left, e, x) - height(right, f, x) for x in (x0, x1))
        crossing = (d0 > 0) != (d1 > 0)
        whole = np.abs(d0 + d1)
        with np.errstate(all="ignore"):
            between = np.where(crossing, (d0 * d0 + d1 * d1) / np.where(d0 != d1, np.abs(d0 - d1), 1), whole) * (x1 - x0) / 2
        total += np.bincount(left.row[e], -0.5 * left.sign[e] * right.sign[f] * between, left.rows)
        at = stop
    return np.maximum(total, 0.0)


# --- clipping ---------------------------------------------------------------------------------------------------------


def _signed(ring: Ring) -> float:
    x0, y0 = ring[0]
    return sum((ax - x0) * (by - y0) - (bx - x0) * (ay - y0) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])) / 2


def _half(rings: list[Ring], axis: int, at: float, sign: int) -> list[Ring]:
    """The rings of a polygon, exteriors counter-clockwise and holes clockwise, of what lies beyond a line parallel to an axis.

    Chains of vertices that are strictly beyond run from an entry point on the line to an exit point. Along the line, in order, every two neighbouring points bound an interval of the inside, one being an exit and the
    other an entry; walking from each exit to its entry closes the chains to rings. Rings that cross nothing stay whole.
    """
    out, chains = [], []
    for ring in rings:
        beyond = [sign * (p[axis] - at) > 0 for p in ring]
        if all(beyond):
            out.append(ring)
        if all(beyond) or not any(beyond):
            continue
        n = len(ring)
        begin = next(k for k in range(n) if not beyond[k - 1] and beyond[k])

        def cross(p, q):
            t = (at - p[axis]) / (q[axis] - p[axis])
            other = p[1 - axis] + t * (q[1 - axis] - p[1 - axis])
            return (at, other) if axis == 0 else (other, at)

        chain: Ring = []
        for k in range(n):
            i = (begin + k) % n
            if beyond[i]:
                if not beyond[i - 1]:
                    chain = [cross(ring[i - 1], ring[i])]
                chain.append(ring[i])
                if not beyond[(i + 1) % n]:
                    chain.append(cross(ring[i], ring[(i + 1) % n]))
                    chains.append(chain)
    # Ends along the line; of equal places an exit and the entry that its own chain doesn't have are neighbours if possible, which order by chain gives.
    ends = sorted([(c[0][1 - axis], k, "in") for k, c in enumerate(chains)] + [(c[-1][1 - axis], k, "out") for k, c in enumerate(chains)])
    partner: dict[int, int] = {}
    while ends:
        (_, k, kind), rest = ends[0], ends[1:]
        j = next((j for j, e in enumerate(rest) if e[2] != kind), None)  # the next one, but for points that lie on one another
        if j is None:
            break
        partner.update({k: rest[j][1]} if kind == "out" else {rest[j][1]: k})
        ends = rest[:j] + rest[j + 1 :]
    left = set(partner)
    while left:
        k = start = min(left)
        ring = []
        while k in left:
            left.discard(k)
            ring += chains[k]
            k = partner[k]
        if k == start:
            out.append(ring)
    return out


def _tidy(ring: Ring) -> Ring:
    """Without vertices that repeat."""
    kept = [p for p, q in zip(ring, ring[-1:] + ring[:-1]) if p != q]
    return kept


def _inside(p: tuple[float, float], ring: Ring) -> bool:
    within = False
    for a, b in zip(ring, ring[1:] + ring[:1]):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) / (b[1] - a[1]) * (b[0] - a[0]):
            within = not within
    return within


def clip_polygon(parts: list[list[Ring]], x0: float, y0: float, x1: float, y1: float) -> list[list[Ring]]:
    """The true parts of a (multi)polygon inside a box: closed rings, exteriors first and counter-clockwise, each with its holes, clockwise. What only touches the box has no area and isn't a part."""
    out = []
    for part in parts:
        rings = []
        for k, ring in enumerate(part):
            ring = _tidy(ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring)
            if len(ring) > 2:
                rings.append(ring if (_signed(ring) > 0) == (k == 0) else ring[::-1])
        for axis, at, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
            rings = _half(rings, axis, at, sign)
        rings = [r for r in map(_tidy, rings) if len(r) > 2]
        least = 1e-15 * (x1 - x0 + y1 - y0) * max([abs(v) for v in (x0, y0, x1, y1)] + [x1 - x0])
        sized = [(_signed(r), r) for r in rings]
        shells = sorted(((a, r, []) for a, r in sized if a > least), key=lambda s: s[0])
        for a, hole in sized:
            if a < -least:
                middle = [((p[0] + q[0]) / 2, (p[1] + q[1]) / 2) for p, q in pairwise([*hole, hole[0]])]
                held = next((s for s in shells if sum(_inside(p, s[1]) for p in middle) * 2 > len(middle)), None)  # the smallest that holds it
                if held:
                    held[2].append(hole)
        out += [[[*r, r[0]] for r in (shell, *holes)] for _, shell, holes in sorted(shells, key=lambda s: s[1])]
    return out


def clipped(geoms: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
    """Polygons cut to boxes; null for null and where nothing is left. Several parts make a multi-polygon."""
    out = []
    for geom, *box in zip(geoms.to_pylist(), *(c.to_pylist() for c in (x0, y0, x1, y1))):
        parts = clip_polygon([[[(p["x"], p["y"]) for p in ring] for ring in part] for part in geom["parts"]], *box) if geom else []
        kind = geom and ("MultiPolygon" if len(parts) > 1 else geom["type"])
        out.append({"type": kind, "parts": [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts]} if parts else None)
    return pa.array(out, geoms.type)
