"""Hand-made scenes for the numerical kernels; no Spark."""

import numpy as np
import pytest

from stripeworks.operators import kernels, raster
from stripeworks.schema import CameraConfig


def test_edge_takes_the_most_certain_inlier():
    d, s = kernels.robust_edge(np.array([1, 1.02, 0.98]), np.array([0.1, 0.05, 0.2]))
    assert d == pytest.approx(1.02) and s == 0.05


def test_edge_without_inliers_at_the_start():
    d, s = kernels.robust_edge(np.array([1, 1.1, 9]), np.array([0.1, 0.1, 5]))
    assert d == pytest.approx(1.0) and s == 0.1


def test_edge_without_usable_sigma():
    assert kernels.robust_edge(np.array([1.0, 2.0]), np.array([2.0, 3.0])) == (0.0, 1000.0)
    assert kernels.robust_edge(np.array([]), np.array([])) == (0.0, 1000.0)


def test_boxes_merge_to_themselves():
    mean = np.array([[5.0, 7.0]] * 3)
    yaw = np.radians([30.0, 30, 30])
    along, across = np.array([np.cos(yaw[0]), np.sin(yaw[0])]), np.array([np.sin(yaw[0]), -np.cos(yaw[0])])
    box = np.array([[mean[0] - 2 * along - across, mean[0] - 2 * along + across, mean[0] + 2 * along + across, mean[0] + 2 * along - across]] * 3)
    corners, sigma, heading = kernels.merge_boxes(mean, box, np.full((3, 4), 0.1), yaw, 0)
    assert np.allclose(corners, box[0], atol=1e-6) and heading == pytest.approx(yaw[0]) and np.allclose(sigma, 0.1)


def test_boxes_do_not_depend_on_the_world():
    """A rigid motion of the scene moves the result and nothing else."""
    rng = np.random.default_rng(2)
    yaw = np.radians(20 + rng.normal(0, 1, 6))
    mean = rng.normal(0, 0.1, (6, 2))

    def corners(m, a):
        al, ac = np.stack([np.cos(a), np.sin(a)], 1), np.stack([np.sin(a), -np.cos(a)], 1)
        return np.stack([m - 2 * al - ac / 2, m - 2 * al + ac / 2, m + 2 * al + ac / 2, m + 2 * al - ac / 2], 1)

    sigma = rng.uniform(0.05, 0.5, (6, 4))
    one, _, h0 = kernels.merge_boxes(mean, corners(mean, yaw), sigma, yaw, 1)
    t, s = 0.7, np.array([30.0, -20])
    r = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    moved = mean @ r.T + s
    two, _, h1 = kernels.merge_boxes(moved, corners(moved, yaw + t), sigma, yaw + t, 1)
    assert np.allclose(one @ r.T + s, two, atol=1e-4) and h1 == pytest.approx(h0 + t)


def test_knots_rise_and_end_at_the_maximum():
    k = kernels.knots_of(0.5, 12.2)
    assert k[0] == 0.5 and k[-1] == 12.2 and (np.diff(k) > 0).all() and np.allclose(np.diff(k)[:-1], 1)
    assert kernels.knots_of(1.0, 1.5).tolist() == [1.0, 1.5]


def test_noisy_sine_is_fused():
    rng = np.random.default_rng(1)
    x = np.concatenate([np.linspace(0.5, 8, 16), np.linspace(5, 12.2, 16)])
    pts = np.column_stack((x, 0.3 * np.sin(x / 3) + rng.normal(0, 0.02, len(x)), np.zeros(len(x))))
    line, var = kernels.fuse_lines(pts, np.full(len(x), 0.05), np.array([1.0, 0]), 0.04)
    assert len(line) > 8 and (np.diff(line[:, 0]) > 0).all() and (var[:, 0] < 0.35).all()
    assert np.abs(line[:, 1] - 0.3 * np.sin(line[:, 0] / 3)).max() < 0.1
    back, _ = kernels.fuse_lines(pts, np.full(len(x), 0.05), np.array([-1.0, 0]), 0.04)
    assert (np.diff(back[:, 0]) < 0).all(), "the line runs the way it is told"


def test_banded_systems_against_dense_ones():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 30):
        one, two = rng.normal(size=max(n - 1, 0)), rng.normal(size=max(n - 2, 0))
        own = 8 + rng.random(n)
        a = np.diag(own) + sum(np.diag(b, k) for b, k in ((one, 1), (one, -1)) if n > 1) + sum(np.diag(b, k) for b, k in ((two, 2), (two, -2)) if n > 2)
        rhs = rng.normal(size=(n, 2))
        assert np.allclose(kernels.solve_banded(own, one, two, rhs), np.linalg.solve(a, rhs))
        tri = np.diag(own) + sum(np.diag(b, k) for b, k in ((one, 1), (one, -1)) if n > 1)
        assert np.allclose(kernels.inverse_diagonal(own, one), np.diag(np.linalg.inv(tri)))


def test_lines_are_fused_as_by_the_dense_system():
    rng = np.random.default_rng(6)
    for length in (0.8, 1.7, 2.5, 25.0):
        x = np.sort(rng.uniform(0, length, 80))
        x[[0, -1]] = 0, length
        pts, sigma = np.column_stack((x, np.zeros(80), rng.normal(0, 0.1, 80))), rng.uniform(0.05, 0.3, 80)
        line, var = kernels.fuse_lines(pts, sigma, np.array([1.0, 0]), 0.04, trim=np.inf)
        mean = pts.mean(0)
        axis = np.linalg.eigh(np.cov((pts - mean).T, bias=True))[1][:2, 2]
        axis = axis / np.linalg.norm(axis) * (1 if axis[0] > 0 else -1)
        turn = np.array([[axis[0], axis[1], 0], [-axis[1], axis[0], 0], [0, 0, 1.0]])
        q = (pts - pts[0]) @ turn.T
        knots = kernels.knots_of(q[:, 0].min(), q[:, 0].max())
        n = len(knots)
        j = np.zeros((80, n))
        for r, v in enumerate(q[:, 0]):
            k = min(max(int(np.searchsorted(knots, v, side="right")) - 1, 0), n - 2)
            j[r, k + 1] = (v - knots[k]) / (knots[k + 1] - knots[k])
            j[r, k] = 1 - j[r, k + 1]
        info = j.T @ (j / sigma[:, None] ** 2)
        bend = np.array([np.convolve(np.eye(n)[i], [1, -2, 1], "same") for i in range(1, n - 1)]).reshape(-1, n)
        fit = np.linalg.solve(info + bend.T @ bend / 0.04 + 1e-9 * np.eye(n), j.T @ (q[:, 1:] / sigma[:, None] ** 2))
        if n > 3:
            assert np.allclose(line, np.column_stack((knots, fit)) @ turn + pts[0], atol=1e-7)
            assert np.allclose(var[:, 0], np.diag(np.linalg.inv(info + 1e-5 * np.eye(n))))
        else:
            assert not len(line)


def test_a_line_of_many_kilometres_is_fused():
    x = np.arange(0, 40_000, 0.5)
    line, var = kernels.fuse_lines(np.column_stack((x, np.sin(x / 500), 0 * x)), np.full(len(x), 0.1), np.array([1.0, 0]), 0.04)
    assert len(line) > 39_990 and (var < 0.35).all()


def test_window_is_solved_from_lines_and_odometry():
    rng = np.random.default_rng(4)
    true_r = [kernels.rotation_of(np.array([0, 0, 0.02 * i])) for i in range(30)]
    true_t = [np.array([0.1 * i, 1.0 * i, 0.02 * i]) for i in range(30)]
    w = kernels.Window([r @ kernels.rotation_of(rng.normal(0, 0.01, 3)) for r in true_r], [t + rng.normal(0, 0.3, 3) for t in true_t])
    w.odometry = [(i, i + 1, true_r[i].T @ true_r[i + 1], true_r[i].T @ (true_t[i + 1] - true_t[i])) for i in range(29)]
    for i, (r, t) in enumerate(zip(true_r, true_t)):
        for p, u in (([3.0, 5, 0], [0, 1, 0]), ([-3.0, 8, 0], [0, 1, 0]), ([0, 10.0, 0], [1, 0, 0])):
            q = r @ np.array(p) + t
            w.lines.append((i, np.array(p), q, q + r @ np.array(u, float), 0.1))
    cost = kernels.solve_window(w)
    assert cost < 1e-8 and max(np.linalg.norm(a - b) for a, b in zip(w.t, true_t)) < 1e-4


def test_rotation_vectors_there_and_back():
    for v in ([0.1, -0.2, 0.3], [1e-12, 0, 0], [0, 3.0, 0]):
        assert np.allclose(kernels.log_of(kernels.rotation_of(np.array(v))), v, atol=1e-9)


def test_labels():
    g = np.array([[1, 5, 0, 2], [0, 5, 0, 2], [3, 3, 3, 2]])
    lab = raster.label_mask(g)
    assert lab[0, 1] == lab[1, 1] and lab[0, 1] not in (lab[0, 0], lab[2, 0]), "stop lines are labelled apart"
    assert lab[2, 0] == lab[0, 3], "other labels are one foreground"
    assert lab[0, 0] != lab[2, 0] and (lab[g == 0] == 0).all()


def test_labels_against_flooding():
    rng = np.random.default_rng(0)
    for _ in range(20):
        fg = rng.random((15, 17)) < 0.55
        lab = raster.label_components(fg)
        seen = np.zeros(fg.shape, int)
        for r, c in zip(*np.nonzero(fg)):
            if not seen[r, c]:
                stack, k = [(r, c)], seen.max() + 1
                while stack:
                    y, x = stack.pop()
                    if 0 <= y < 15 and 0 <= x < 17 and fg[y, x] and not seen[y, x]:
                        seen[y, x] = k
                        stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        assert (lab == seen).all()


def test_warp_puts_ground_points_where_geometry_says():
    cam = CameraConfig(height=80, width=40, resolution=0.25)
    k = np.array([[500.0, 0, 320], [0, 500.0, 240], [0, 0, 1]])
    t = raster.homography(k, np.eye(3), 1.5, cam)
    image = np.zeros((480, 640), np.uint8)
    u, v = 25, 40
    x, z = (u - 20) * 0.25, (80 - v - 1) * 0.25
    image[int(np.floor(500 * 1.5 / z + 240 + 0.5)), int(np.floor(500 * x / z + 320 + 0.5))] = 200
    out = raster.warp(image, t, 80, 40)
    assert out[v, u] == 200 and out.shape == (80, 40)


def test_ground_mask_holds_the_far_ground_only():
    cam = CameraConfig(height=80, width=40, resolution=0.25)
    k = np.array([[500.0, 0, 320], [0, 500.0, 240], [0, 0, 1]])
    m = raster.ground_mask(k, np.eye(3), 1.5, cam, 480, 640)
    far, near = 500 * 1.5 / (79 * 0.25) + 240, 500 * 1.5 / (39 * 0.25) + 240
    rows = np.flatnonzero(m.any(1))
    assert rows.min() == int(np.ceil(far)) and rows.max() == int(np.floor(near)) and m[300, 320] and not m[400, 320]
