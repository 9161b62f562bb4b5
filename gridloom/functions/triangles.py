"""Delaunay triangulation and interpolation over it, in numpy."""

from __future__ import annotations

import numpy as np


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (n, 3) of points, by inserting them one at a time (Bowyer and Watson).

    Points are inserted along a space-filling order after a tiny fixed
    displacement, which decides between the equal choices that grids offer.
    """
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), int)
    low, span = points.min(0), max(np.ptp(points, axis=0).max(), 1e-300)
    p = (points - low) / span
    p = p + np.random.default_rng(0).uniform(-1e-7, 1e-7, p.shape)
    p = np.vstack([p, [[-50, -50], [50, -50], [0, 80]]])
    order = np.lexsort(((p[:n, 1] * 64).astype(int), (p[:n, 0] * 64).astype(int)))
    triangles = np.array([[n, n + 1, n + 2]])
    centre, radius = _circles(p, triangles)
    done: list[np.ndarray] = []
    for k in order:
        hit = ((centre - p[k]) ** 2).sum(1) < radius
        bad = triangles[hit]
        sides = np.sort(np.concatenate([bad[:, [0, 1]], bad[:, [1, 2]], bad[:, [2, 0]]]), 1)
        sides, times = np.unique(sides, axis=0, return_counts=True)
        sides = sides[times == 1]
        new = np.column_stack([sides, np.full(len(sides), k)])
        c, r = _circles(p, new)
        triangles, centre, radius = np.concatenate([triangles[~hit], new]), np.concatenate([centre[~hit], c]), np.concatenate([radius[~hit], r])
        # Circles left of all points to come are final.
        if len(triangles) > 512:
            final = centre[:, 0] + np.sqrt(radius) < p[k, 0] - 1 / 32
            done.append(triangles[final])
            triangles, centre, radius = triangles[~final], centre[~final], radius[~final]
    found = np.concatenate([*done, triangles])
    return found[(found < n).all(1)]


def _circles(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and squared radii of triangles' circles."""
    a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
    b, c = b - a, c - a
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    d = np.where(d == 0, 1e-300, d)
    bb, cc = (b**2).sum(1), (c**2).sum(1)
    u = np.stack([(c[:, 1] * bb - b[:, 1] * cc) / d, (b[:, 0] * cc - c[:, 0] * bb) / d], 1)
    return a + u, (u**2).sum(1)


def _gradients(points: np.ndarray, values: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """A gradient at each point: the plane of least squares through its neighbours, nearer ones weighing more."""
    pairs = np.unique(np.concatenate([triangles[:, list(s)] for s in ((0, 1), (1, 0), (1, 2), (2, 1), (2, 0), (0, 2))]), axis=0)
    i, j = pairs[:, 0], pairs[:, 1]
    d = points[j] - points[i]
    w = 1 / np.maximum((d**2).sum(1), 1e-300)
    dv = values[j] - values[i]
    a = np.zeros((len(points), 2, 2))
    b = np.zeros((len(points), 2))
    np.add.at(a, i, w[:, None, None] * d[:, :, None] * d[:, None, :])
    np.add.at(b, i, (w * dv)[:, None] * d)
    a += 1e-12 * np.trace(a, axis1=1, axis2=2)[:, None, None] * np.eye(2) + 1e-300 * np.eye(2)
    return np.linalg.solve(a, b[:, :, None])[:, :, 0]


def interpolate(points: np.ndarray, values: np.ndarray, at: np.ndarray, method: str = "linear") -> np.ndarray:
    """Values at places inside the hull of the points, NaN outside.

    linear: by the three corners.  cubic: corners, and their gradients along
    the sides, blended by cubic Bezier patches of each triangle.
    """
    out = np.full(len(at), np.nan)
    triangles = delaunay(points)
    if not len(triangles):
        return out
    a, b, c = (points[triangles[:, k]] for k in range(3))
    det = (b[:, 1] - c[:, 1]) * (a[:, 0] - c[:, 0]) + (c[:, 0] - b[:, 0]) * (a[:, 1] - c[:, 1])
    flat = np.abs(det) < 1e-12 * np.ptp(points, axis=0).max() ** 2
    triangles, a, b, c, det = triangles[~flat], a[~flat], b[~flat], c[~flat], det[~flat]
    if method == "cubic":
        g = _gradients(points, values, triangles)
    low, high = np.minimum(np.minimum(a, b), c), np.maximum(np.maximum(a, b), c)
    slack = 1e-9 * np.ptp(points, axis=0).max()
    for k, q in enumerate(at):
        near = np.flatnonzero(((low - slack <= q) & (q <= high + slack)).all(1))
        if not len(near):
            continue
        u = ((b[near, 1] - c[near, 1]) * (q[0] - c[near, 0]) + (c[near, 0] - b[near, 0]) * (q[1] - c[near, 1])) / det[near]
        v = ((c[near, 1] - a[near, 1]) * (q[0] - c[near, 0]) + (a[near, 0] - c[near, 0]) * (q[1] - c[near, 1])) / det[near]
        w = 1 - u - v
        best = int(np.argmax(np.minimum(np.minimum(u, v), w)))
        weights = np.array([u[best], v[best], w[best]])
        if weights.min() < -1e-9:
            continue
        corners = triangles[near[best]]
        if method == "linear":
            out[k] = weights @ values[corners]
            continue
        weights = np.clip(weights, 0, 1)
        f, p = values[corners], points[corners]
        total, middle = (weights**3) @ f, 0.0
        for i in range(3):
            for j in range(3):
                if i != j:
                    control = f[i] + g[corners[i]] @ (p[j] - p[i]) / 3
                    total += 3 * weights[i] ** 2 * weights[j] * control
                    middle += control / 4
        out[k] = total + 6 * weights.prod() * (middle - f.sum() / 6)
    return out
