"""Small numerical kernels in NumPy: robust box edges, polyline fusion, sliding-window localisation."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

NOTHING = (0.0, 1000.0)


def robust_edge(d: np.ndarray, sigma: np.ndarray, off: np.ndarray | None = None, steps: int = 10) -> tuple[float, float]:
    """The most certain of the distances that agree, and its sigma.

    Starting from the largest distance, the weighted mean of those with
    sigma up to 1 and within 2.25 sigmas is found ten times; the answer is
    not the mean but the member of least sigma.  If nothing agrees with the
    start, the mean is undefined and from then on everything with sigma up to
    1 agrees.  ``off`` excludes members.  Nothing left: 0 and 1000.
    """
    d, sigma = np.asarray(d, np.float32).astype(float), np.asarray(sigma, float)
    usable = sigma <= 1.0
    if off is not None:
        usable &= ~np.asarray(off, bool)
    if not len(d):
        return NOTHING
    x, inside = d.max(), usable
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(steps):
            inside = usable & ~(np.sqrt(np.abs((d - x) / sigma)) > 1.5)
            weight = (1 / sigma**2)[inside].sum()
            x = x + np.divide(((d - x) / sigma**2)[inside].sum(), weight)
    if not inside.any():
        return NOTHING
    best = np.flatnonzero(inside)[np.argmin(sigma[inside])]
    return float(d[best]), float(sigma[best])


def edge_distances(ref: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Distances of ``ref`` (2) to the four edge lines of boxes (n, 4, 2), positive inside; edges run from corner to corner."""
    a, b = box, np.roll(box, -1, axis=1)
    e = (b - a) / np.linalg.norm(b - a, axis=2, keepdims=True)
    w = ref - a
    return -(w[..., 0] * e[..., 1] - w[..., 1] * e[..., 0])


def merge_boxes(mean: np.ndarray, box: np.ndarray, sigma: np.ndarray, angle: np.ndarray, mode: int = 0, limit_deg: float = 3.0) -> tuple[np.ndarray, np.ndarray, float]:
    """One box (4, 2) with its edge sigmas and heading from the sightings of a cluster, the first being the reference."""
    ref = mean[0]
    first = angle[0]
    turned = np.mod(angle - first + 3 * np.pi, 2 * np.pi) - np.pi
    middle = np.sort(turned)[len(turned) // 2]
    heading = first + middle
    off = (np.abs(turned - middle) > np.radians(limit_deg)) if mode == 0 else np.zeros(len(mean), bool)
    d = edge_distances(ref, box)
    got = [robust_edge(d[:, k], sigma[:, k], off) for k in range(4)]
    bottom, right, top, left = (g[0] for g in got)
    along, across = np.array([np.cos(heading), np.sin(heading)]), np.array([np.sin(heading), -np.cos(heading)])
    corners = np.array([ref - along * bottom - across * left, ref - along * bottom + across * right, ref + along * top + across * right, ref + along * top - across * left])
    return corners, np.array([g[1] for g in got]), float(heading)


def knots_of(low: float, high: float) -> np.ndarray:
    """Knots a metre apart from ``low``, the last one at ``high``, strictly rising."""
    inner = low + np.arange(max(0, int(np.ceil(high - low - 1e-9))))
    inner = inner[inner < high - 1e-9]
    return np.concatenate((inner, [high])) if len(inner) else np.array([low, high])


def solve_banded(diagonal: np.ndarray, first: np.ndarray, second: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """x of A x = ``rhs`` (n, k) for a positive definite A with two bands beside its diagonal, by its factors L D L^T."""
    n = len(diagonal)
    d, e, f = diagonal.tolist(), [0.0, *first.tolist()], [0.0, 0.0, *second.tolist()]
    x = rhs.copy()
    for i in range(1, n):
        if i > 1:
            e[i] -= f[i] * e[i - 1]
            far, f[i] = f[i], f[i] / d[i - 2]
            d[i] -= far * f[i]
            x[i] -= f[i] * x[i - 2]
        near, e[i] = e[i], e[i] / d[i - 1]
        d[i] -= near * e[i]
        x[i] -= e[i] * x[i - 1]
    x /= np.array(d)[:, None]
    for i in range(n - 2, -1, -1):
        x[i] -= e[i + 1] * x[i + 1]
        if i + 2 < n:
            x[i] -= f[i + 2] * x[i + 2]
    return x


def inverse_diagonal(diagonal: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Diagonal of the inverse of a positive definite tridiagonal matrix, by eliminating from both ends."""
    n = len(diagonal)
    down, up = diagonal.tolist(), diagonal.tolist()
    b2 = (beside * beside).tolist()
    for i in range(1, n):
        down[i] -= b2[i - 1] / down[i - 1]
    for i in range(n - 2, -1, -1):
        up[i] -= b2[i] / up[i + 1]
    return 1 / (np.array(down) + np.array(up) - diagonal)


def fuse_lines(points: np.ndarray, sigma: np.ndarray, forward: np.ndarray, smooth: float, trim: float = 0.35) -> tuple[np.ndarray, np.ndarray]:
    """One polyline (n, 3) and the variances (n, 2) of its knots from the vertices of a cluster of lines.

    Vertices are turned to their main direction, agreeing with ``forward``,
    about the first; height over each knot is the weighted least-squares fit
    of linear interpolation with second-difference smoothness of variance
    ``smooth``.  The system is linear and banded: one solve, whose time and
    memory grow with the length of the line alone.  Knots from the middle on
    are cut at the first whose variance exceeds ``trim``; three or fewer left
    is no line.
    """
    origin = points[0]
    mean = points.mean(0)
    _, vectors = np.linalg.eigh(np.cov((points - mean).T, bias=True))
    axis = vectors[:2, 2] / np.linalg.norm(vectors[:2, 2])
    if axis @ forward[:2] < 0:
        axis = -axis
    turn = np.array([[axis[0], axis[1], 0], [-axis[1], axis[0], 0], [0, 0, 1.0]])
    local = (points - origin) @ turn.T
    knots = knots_of(local[:, 0].min(), local[:, 0].max())
    n = len(knots)
    at = np.clip(np.searchsorted(knots, local[:, 0], side="right") - 1, 0, n - 2)
    share = (local[:, 0] - knots[at]) / (knots[at + 1] - knots[at])
    weight = 1 / sigma**2
    own = np.bincount(at, weight * (1 - share) ** 2, n) + np.bincount(at + 1, weight * share**2, n)
    beside = np.bincount(at, weight * share * (1 - share), n)[: n - 1]
    rhs = np.column_stack([np.bincount(at, weight * (1 - share) * c, n) + np.bincount(at + 1, weight * share * c, n) for c in local[:, 1:].T])
    whole, first, second = own + 1e-9, beside.copy(), np.full(max(n - 2, 0), 1 / smooth)
    for k, c in enumerate((1.0, 4.0, 1.0)):
        whole[k : n - 2 + k] += c / smooth
    for k in (0, 1):
        first[k : n - 2 + k] -= 2 / smooth
    fit = solve_banded(whole, first, second, rhs)
    var = inverse_diagonal(own + 1e-5, beside)
    stop = next((i for i in range(n // 2, n) if var[i] > trim), n)
    line = (np.column_stack((knots, fit))[:stop]) @ turn + origin
    if stop <= 3 or np.isnan(line).any():
        return np.zeros((0, 3)), np.zeros((0, 2))
    return line, np.column_stack((var, var))[:stop]


# --- localisation ---------------------------------------------------------------------------------


def rotation_of(v: np.ndarray) -> np.ndarray:
    """Rodrigues' formula."""
    n = np.linalg.norm(v)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    if n < 1e-9:
        return np.eye(3) + k
    return np.eye(3) + np.sin(n) / n * k + (1 - np.cos(n)) / n**2 * k @ k


def log_of(r: np.ndarray) -> np.ndarray:
    c = np.clip((np.trace(r) - 1) / 2, -1, 1)
    v = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) / 2
    s = np.linalg.norm(v)
    return v if s < 1e-9 else v * np.arctan2(s, c) / s


@dataclass
class Window:
    """Poses (R, t) of a window with what is known about them."""

    r: list[np.ndarray]
    t: list[np.ndarray]
    #: (pose, R, t): prior with sigmas 10 m and (0.01, 0.01, 0.04) rad
    priors: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)
    #: (pose, next pose, R01, t01)
    odometry: list[tuple[int, int, np.ndarray, np.ndarray]] = field(default_factory=list)
    #: (pose, point in body, two map points of the line, sigma)
    lines: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, float]] = field(default_factory=list)


def _hat(v: np.ndarray) -> np.ndarray:
    """Cross-product matrices of vectors (..., 3)."""
    out = np.zeros((*v.shape, 3))
    out[..., 0, 1], out[..., 0, 2], out[..., 1, 2] = -v[..., 2], v[..., 1], -v[..., 0]
    out[..., 1, 0], out[..., 2, 0], out[..., 2, 1] = v[..., 2], -v[..., 1], v[..., 0]
    return out


class _System:
    """Normal equations of a window, assembled by 6 x 6 blocks: diagonal ones, and those of consecutive factors."""

    PRIOR = 1 / np.array([10.0, 10, 10, 0.01, 0.01, 0.04])

    def __init__(self, w: Window, huber: float):
        self.w, self.n, self.huber = w, len(w.r), huber
        if w.lines:
            self.at = np.array([x[0] for x in w.lines])
            self.p = np.array([x[1] for x in w.lines], float)
            self.q = np.array([x[2] for x in w.lines], float)
            u = np.array([x[3] for x in w.lines], float) - self.q
            u /= np.linalg.norm(u, axis=1, keepdims=True)
            self.off = np.eye(3) - u[:, :, None] * u[:, None, :]
            self.off /= np.array([x[4] for x in w.lines], float)[:, None, None]
            self.hat = _hat(self.p)
        if w.odometry:
            self.a, self.b = (np.array([x[i] for x in w.odometry]) for i in (0, 1))
            self.r01, self.t01 = (np.array([x[i] for x in w.odometry], float) for i in (2, 3))
            step = np.maximum(np.linalg.norm(self.t01, axis=1), 0.1)[:, None]
            self.scale = 1 / np.hstack((step * [0.05, 0.1, 0.05], np.full((len(step), 3), 0.01)))

    def build(self, r: np.ndarray, t: np.ndarray, full: bool = True):
        """(cost, H, g), or the cost alone."""
        n, cost = self.n, 0.0
        h, g = np.zeros((n, n, 6, 6)), np.zeros((n, 6))
        for i, r0, t0 in self.w.priors:
            e = np.concatenate((t[i] - t0, log_of(np.asarray(r0).T @ r[i]))) * self.PRIOR
            cost += e @ e / 2
            h[i, i] += np.diag(self.PRIOR**2)
            g[i] += self.PRIOR * e
        if self.w.odometry:
            ra, rb = r[self.a], r[self.b]
            local = np.einsum("kji,kj->ki", ra, t[self.b] - t[self.a])
            turn = np.einsum("kji,klj,klm->kim", self.r01, ra, rb)
            e = np.hstack((local - self.t01, [log_of(x) for x in turn])) * self.scale
            cost += (e * e).sum() / 2
            if full:
                ja, jb = np.zeros((len(e), 6, 6)), np.zeros((len(e), 6, 6))
                rat = ra.transpose(0, 2, 1)
                ja[:, :3, :3], ja[:, :3, 3:], jb[:, :3, :3] = -rat, _hat(local), rat
                ja[:, 3:, 3:], jb[:, 3:, 3:] = -rb.transpose(0, 2, 1) @ ra, np.eye(3)
                ja, jb = ja * self.scale[:, :, None], jb * self.scale[:, :, None]
                for x, jx in ((self.a, ja), (self.b, jb)):
                    np.add.at(g, x, np.einsum("kij,ki->kj", jx, e))
                    for y, jy in ((self.a, ja), (self.b, jb)):
                        np.add.at(h, (x, y), np.einsum("kia,kib->kab", jx, jy))
        if self.w.lines:
            ri = r[self.at]
            e = np.einsum("kij,kj->ki", self.off, np.einsum("kij,kj->ki", ri, self.p) + t[self.at] - self.q)
            size = np.linalg.norm(e, axis=1)
            cost += np.where(size <= self.huber, size * size / 2, self.huber * (size - self.huber / 2)).sum()
            if full:
                weight = np.where(size <= self.huber, 1.0, self.huber / np.maximum(size, 1e-300))
                j = np.concatenate((self.off, -self.off @ ri @ self.hat), axis=2)
                np.add.at(g, self.at, np.einsum("kij,ki,k->kj", j, e, weight))
                np.add.at(h, (self.at, self.at), np.einsum("kia,kib,k->kab", j, j, weight))
        if not full:
            return cost
        return cost, h.transpose(0, 2, 1, 3).reshape(6 * n, 6 * n), g.ravel()


def solve_window(w: Window, steps: int = 20, huber: float = 1.0) -> float:
    """Gauss-Newton with Levenberg's damping over all poses, in place; the final cost.

    A pose moves by t += dt, R <- R exp(dr).  Point-to-line residuals are in
    sigmas under Huber's loss.
    """
    system = _System(w, huber)
    r, t = np.array(w.r, float), np.array(w.t, float)
    damp, cost = 1e-6, system.build(r, t, False)
    for _ in range(steps):
        _, h, g = system.build(r, t)
        for _ in range(8):
            d = -np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-9), g).reshape(-1, 6)
            r1, t1 = r @ np.array([rotation_of(x) for x in d[:, 3:]]), t + d[:, :3]
            new = system.build(r1, t1, False)
            if new <= cost:
                break
            damp *= 10
        else:
            break
        r, t, gain, cost, damp = r1, t1, cost - new, new, max(damp / 10, 1e-12)
        if gain <= 1e-10 * max(cost, 1e-12) and np.abs(d).max() < 1e-9:
            break
    w.r, w.t = list(r), list(t)
    return float(cost)
