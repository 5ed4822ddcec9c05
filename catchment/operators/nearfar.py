"""Sums of ``mass / haversine`` of a block of postal codes over a block of
stores, without a term per pair.

Both blocks are halved again and again into boxes (codes and stores of about
``LEAF``).  Boxes far enough apart, for their sizes, meet through Chebyshev
points: the stores' masses are put on the points of their box, the sums are
taken at the points of the codes' box and read off at the codes.  The number
of points follows from where the kernel has its poles, so that what is
left out is below the rounding.  Boxes too close are halved further, and the
smallest meet pair by pair.  So a code costs about the stores around it and
a number of points that grows with the logarithm of the stores.

The places are projected to a plane (stereographic), where the haversine of
two places z and w is exactly ``|z - w|**2 / ((1 + |z|**2) (1 + |w|**2))``.
"""

from __future__ import annotations

from collections.abc import Callable

#: Codes or stores of a box that is not halved.
LEAF = 256
#: Pairs of two boxes that are summed one by one.
FEW_PAIRS = 65536
#: Most points a side of a box.
MOST_POINTS = 36
#: Logarithm of the share of a sum that may be left out (about 1e-15), twice.
DIGITS = 35.5
#: Store blocks whose boxes a task keeps.
KEPT_BLOCKS = 8


def inverse_haversine_sums(near: float) -> Callable:
    """A function that begins a task's sums and gives the function
    ``sums(lat, lon, lats, lons, mass, key)``: for every code (degrees) the
    sum of ``mass / haversine`` over the stores that are not at its very
    place, and their number; None where a place is beyond 90 degrees from the
    middle of the stores.  Places and masses are finite.  Pairs with a
    haversine below ``near``, or close for the size of their box, take it from
    the angles, as other forms lose digits there.  The boxes of the stores
    are kept under ``key``.

    All that the tasks run is nested, so it is sent to them by value."""
    leaf, few, most, digits, kept_blocks = LEAF, FEW_PAIRS, MOST_POINTS, DIGITS, KEPT_BLOCKS

    def begin():
        import math

        import numpy as np

        kept = {}

        def boxes(x, y):
            """Order of the places, and boxes [from, to, x0, x1, y0, y1, halves, points]."""
            order = np.arange(len(x))

            def grow(a, b):
                i = order[a:b]
                xs, ys = x[i], y[i]
                box = [a, b, float(xs.min()), float(xs.max()), float(ys.min()), float(ys.max()), None, {}]
                across, along = box[3] - box[2], box[5] - box[4]
                if b - a > leaf and max(across, along) > 0:
                    m = (b - a) // 2
                    order[a:b] = i[np.argpartition(xs if across >= along else ys, m)]
                    box[6] = (grow(a, a + m), grow(a + m, b))
                return box

            return order, grow(0, len(x))

        def count(gap, other, half):
            """Points a side: the poles are at ``gap`` (0: anywhere along the side)
            beyond it, and off the real line by ``other``."""
            half = max(half, 1e-12)
            x, y = (1 + gap / half if gap > 0 else 0.0), other / half
            apart = math.acosh(max((math.hypot(x - 1, y) + math.hypot(x + 1, y)) / 2, 1))
            return math.ceil(digits / apart / 3 + 0.3) * 3 if apart > 1e-3 else 1 << 20

        def nodes(low, high, n):
            angle = (np.arange(n) + 0.5) * np.pi / n
            return np.cos(angle), np.sin(angle) * (-1.0) ** np.arange(n), (low + high) / 2, max((high - low) / 2, 1e-12)

        def weights(v, low, high, n):
            at, signed, middle, half = nodes(low, high, n)
            apart = (v[:, None] - middle) / half - at
            hit = apart == 0
            w = signed / np.where(hit, 1, apart)
            rows = hit.any(axis=1)
            w[rows] = hit[rows]
            return w / w.sum(axis=1, keepdims=True)

        def grid(box, n):
            sides = []
            for k, m in zip((2, 4), n, strict=True):
                at, _, middle, half = nodes(box[k], box[k + 1], m)
                sides.append(middle + half * at)
            return np.repeat(sides[0], n[1]), np.tile(sides[1], n[0])

        def on_points(box, n, x, y, mass):
            """The masses of a box put on its points."""
            if n not in box[7]:
                i = slice(box[0], box[1])
                heaps = (weights(x[i], box[2], box[3], n[0]) * mass[i, None]).T @ weights(y[i], box[4], box[5], n[1])
                box[7][n] = (*grid(box, n), heaps.ravel())
            return box[7][n]

        room, run = np.empty(1 << 15), 1 << 9

        def squares(x, y, xs, ys):
            """Squared distances from runs of places to all (xs, ys), by a product
            of places seen from the middle of the first."""
            mx, my = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2
            x, y, xs, ys = x - mx, y - my, xs - mx, ys - my
            own = x * x + y * y
            here = np.stack([own, np.ones(len(x)), -2 * x, -2 * y], axis=1)
            there = np.stack([np.ones(len(xs)), xs * xs + ys * ys, xs, ys])
            step = max(1, len(room) // len(xs))
            for a in range(0, len(x), step):
                d = room[: len(x[a : a + step]) * len(xs)].reshape(-1, len(xs))
                yield slice(a, a + len(d)), np.matmul(here[a : a + step], there, out=d), own.max()

        def add(out, x, y, xs, ys, mass):
            """Sums over places that are far apart, for the size of a box."""
            for a in range(0, len(xs), run):
                part = slice(a, a + run)
                for rows, d, _ in squares(x, y, xs[part], ys[part]):
                    out[rows] += np.divide(1, d, out=d) @ mass[part]

        def projection(lat, lon):
            lat, lon = np.radians(lat), np.radians(lon)
            middle = np.array([(np.cos(lat) * np.cos(lon)).mean(), (np.cos(lat) * np.sin(lon)).mean(), np.sin(lat).mean()])
            y0, x0 = math.atan2(middle[2], math.hypot(middle[0], middle[1])), math.atan2(middle[1], middle[0])

            def project(lat, lon):
                dlon, lat = np.radians(lon) - x0, np.radians(lat)
                # differences by half angles: no digits are lost near the middle
                turn = 2 * np.sin(dlon / 2) ** 2
                below = 2 - 2 * np.sin((lat - y0) / 2) ** 2 - np.cos(y0) * np.cos(lat) * turn
                x = np.cos(lat) * np.sin(dlon) / below
                y = (np.sin(lat - y0) + np.sin(y0) * np.cos(lat) * turn) / below
                return x, y, 1 + x * x + y * y

            return project

        def stores(lats, lons, mass, key):
            if key not in kept:
                while len(kept) >= kept_blocks:
                    kept.pop(next(iter(kept)))
                project = projection(lats, lons)
                x, y, scale = project(lats, lons)
                if not (scale <= 2).all():
                    return project, None
                order, root = boxes(x, y)
                ordered = (v[order] for v in (x, y, scale, mass * scale, lats, lons))
                kept[key] = project, (*ordered, root)
            return kept[key]

        def sums(lat, lon, lats, lons, mass, key):
            project, side = stores(lats, lons, mass, key)
            x, y, scale = project(lat, lon)
            if side is None or not len(lat) or not (scale <= 2).all():
                return None
            xs, ys, scales, heavy, lats, lons, root = side
            order, top = boxes(x, y)
            x, y, lat, lon, scale = (v[order] for v in (x, y, lat, lon, scale))
            total, apart = np.zeros(len(x)), np.full(len(x), len(xs), np.int64)

            def one_by_one(t, j):
                """Sums over the stores ``j``, which may be close."""
                first, side = t[0], (xs[j], ys[j])
                for rows, d, size in squares(x[first : t[1]], y[first : t[1]], *side):
                    close = np.flatnonzero(d < max(4 * near, 0.01 * size))  # the product loses digits there
                    p, q = np.divmod(close, len(j))
                    c, r = p + rows.start + first, j[q]
                    dy, dx = np.radians(lats[r] - lat[c]) / 2, np.radians(lons[r] - lon[c]) / 2
                    h = np.sin(dy) ** 2 + np.sin(dx) ** 2 * np.cos(np.radians(lats[r])) * np.cos(np.radians(lat[c]))
                    none = h == 0
                    d[p, q] = np.where(none, 1, h * scale[c] * scales[r])
                    np.divide(1, d, out=d)
                    d[p[none], q[none]] = 0
                    np.subtract.at(apart, c[none], 1)
                    total[rows.start + first : rows.stop + first] += d @ heavy[j]

            met, close, far = [(top, root)], {}, {}
            while met:
                t, s = met.pop()
                nt, ns = t[1] - t[0], s[1] - s[0]
                gx, gy = max(s[2] - t[3], t[2] - s[3], 0.0), max(s[4] - t[5], t[4] - s[5], 0.0)
                if nt * ns > few:
                    if gx > 0 or gy > 0:
                        ps = count(gx, gy, (s[3] - s[2]) / 2), count(gy, gx, (s[5] - s[4]) / 2)
                        pt = count(gx, gy, (t[3] - t[2]) / 2), count(gy, gx, (t[5] - t[4]) / 2)
                        from_points = max(ps) <= most and ps[0] * ps[1] < ns
                        at_points = max(pt) <= most and pt[0] * pt[1] < nt
                        cost = (pt[0] * pt[1] if at_points else nt) * (ps[0] * ps[1] if from_points else ns)
                        if 2 * cost <= nt * ns:
                            own = slice(s[0], s[1])
                            side = on_points(s, ps, xs, ys, heavy) if from_points else (xs[own], ys[own], heavy[own])
                            far.setdefault((t[0], t[1], pt if at_points else None), (t, []))[1].append(side)
                            continue
                    wide_t, wide_s = max(t[3] - t[2], t[5] - t[4]), max(s[3] - s[2], s[5] - s[4])
                    if t[6] and (wide_t >= wide_s or not s[6]):
                        met += [(half, s) for half in t[6]]
                        continue
                    if s[6]:
                        met += [(t, half) for half in s[6]]
                        continue
                close.setdefault((t[0], t[1]), (t, []))[1].append(np.arange(s[0], s[1]))
            for t, parts in close.values():
                stores_of = np.concatenate(parts)
                for a in range(0, len(stores_of), run):
                    one_by_one(t, stores_of[a : a + run])
            for (_, _, n), (t, sides) in far.items():
                i, side = slice(t[0], t[1]), [np.concatenate(parts) for parts in zip(*sides, strict=True)]
                if n is None:
                    add(total[i], x[i], y[i], *side)
                    continue
                out = np.zeros(n[0] * n[1])
                add(out, *grid(t, n), *side)
                read = weights(x[i], t[2], t[3], n[0]) @ out.reshape(n)
                total[i] += (read * weights(y[i], t[4], t[5], n[1])).sum(axis=1)
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            return (total * scale)[back], apart[back]

        return sums

    return begin
