"""Marker pose from a detection, camera intrinsics and marker size, on small arrays."""

from __future__ import annotations

import math

import numpy as np

STEPS, APART = 50, 0.1


def _proper(m: np.ndarray) -> np.ndarray:
    """The nearest rotation."""
    u, _, vt = np.linalg.svd(m)
    return u @ np.diag((1, 1, np.sign(np.linalg.det(u @ vt)))) @ vt


def homography_to_pose(h: np.ndarray, fx: float, fy: float, cx: float, cy: float) -> np.ndarray:
    """4x4 transform whose third axis points away from the scene: the marker lies at negative z."""
    k = np.array(((fx, 0, cx), (0, fy, cy), (0, 0, 1)))
    m = np.linalg.inv(k) @ h
    scale = 1 / math.sqrt(np.linalg.norm(m[:, 0]) * np.linalg.norm(m[:, 1]))
    m = m * (-scale if m[2, 2] > 0 else scale)
    out = np.eye(4)
    u, _, vt = np.linalg.svd(np.column_stack((m[:, 0], m[:, 1], np.cross(m[:, 0], m[:, 1]))))
    out[:3, :3], out[:3, 3] = u @ vt, m[:, 2]
    return out


def homography_to_model_view(h: np.ndarray, f: float, g: float, a: float, b: float) -> np.ndarray:
    """The same for a projection with focal lengths f, g and offsets a, b, without making the axes orthogonal."""
    k = np.array(((f, 0, -a), (0, g, -b), (0, 0, -1)))
    m = np.linalg.inv(k) @ h
    scale = 1 / math.sqrt(np.linalg.norm(m[:, 0]) * np.linalg.norm(m[:, 1]))
    m = m * (-scale if m[2, 2] > 0 else scale)
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = np.column_stack((m[:, 0], m[:, 1], np.cross(m[:, 0], m[:, 1]))), m[:, 2]
    return out


def quaternion_matrix(q) -> np.ndarray:
    w, x, y, z = q
    return np.array(((w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)), (2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)), (2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z)))


def initial_pose(h: np.ndarray, tagsize: float, fx: float, fy: float, cx: float, cy: float) -> tuple[np.ndarray, np.ndarray]:
    m = homography_to_pose(h, -fx, fy, cx, cy)
    m[:3, 3] *= tagsize / 2
    m = np.diag((1.0, -1.0, -1.0, 1.0)) @ m
    return m[:3, :3], m[:3, 3]


def orthogonal_iteration(rays: np.ndarray, points: np.ndarray, r: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation, translation and object-space error: in turn the best translation for the rotation, and the best
    rotation for the points projected onto their rays."""
    f = np.array([np.outer(v, v) / (v @ v) for v in rays])
    mean = f.mean(0)
    back = np.linalg.inv(np.eye(3) - mean)

    def shift(r: np.ndarray) -> np.ndarray:
        return back @ np.einsum("nij,nj->i", f - np.eye(3), points @ r.T) / len(points)

    for _ in range(steps):
        q = np.einsum("nij,nj->ni", f, points @ r.T + shift(r))
        r = _proper((q - q.mean(0)).T @ (points - points.mean(0)))
    t = shift(r)
    e = np.einsum("nij,nj->ni", np.eye(3) - f, points @ r.T + t)
    return r, t, float((e * e).sum())


def mirrored(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Start of the second minimum: the marker's plane mirrored about the line of sight."""
    sight = t / np.linalg.norm(t)
    half_turn = 2 * np.outer(sight, sight) - np.eye(3)
    normal = r[:, 2]
    other = half_turn @ normal
    axis = np.cross(normal, other)
    s, c = np.linalg.norm(axis), normal @ other
    if s < 1e-9:
        return r
    k = axis / s
    cross = np.array(((0, -k[2], k[1]), (k[2], 0, -k[0]), (-k[1], k[0], 0)))
    if c < 0:  # keep the visible face towards the camera
        other, c, cross = -other, -c, -cross
    angle = math.atan2(s, c)
    return (np.eye(3) + math.sin(angle) * cross + (1 - math.cos(angle)) * cross @ cross) @ r


def pose_candidates(h: np.ndarray, corners: np.ndarray, tagsize: float, fx: float, fy: float, cx: float, cy: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """One pose or two, each (R, t, error)."""
    s = tagsize / 2
    points = np.array(((-s, s, 0), (s, s, 0), (s, -s, 0), (-s, -s, 0)))
    rays = np.c_[(corners[:, 0] - cx) / fx, (corners[:, 1] - cy) / fy, np.ones(4)]
    first = orthogonal_iteration(rays, points, initial_pose(h, tagsize, fx, fy, cx, cy)[0])
    second = orthogonal_iteration(rays, points, mirrored(first[0], first[1]))
    angle = math.acos(max(-1.0, min(1.0, (np.trace(first[0].T @ second[0]) - 1) / 2)))
    return [first, second] if angle > APART and second[1][2] > 0 else [first]


def pose(h: np.ndarray, corners: np.ndarray, tagsize: float, fx: float, fy: float, cx: float, cy: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The candidate with the smaller error, the first on a tie."""
    return min(pose_candidates(h, corners, tagsize, fx, fy, cx, cy), key=lambda x: x[2])
