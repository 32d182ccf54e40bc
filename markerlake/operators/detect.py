"""Detection of markers in one image at a time, on arrays: the production path beside the relational operators."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from ..families import Family
from .segments import label_image


@dataclass(frozen=True)
class DetectorConfig:
    quad_decimate: float = 2.0
    quad_sigma: float = 0.0
    refine_edges: bool = True
    decode_sharpening: float = 0.25
    min_cluster_pixels: int = 24
    max_nmaxima: int = 10
    cos_critical: float = math.cos(math.radians(10))
    max_line_fit_mse: float = 10.0
    min_white_black_diff: int = 5
    deglitch: bool = False
    max_hamming: int = 2


@dataclass
class Quad:
    p: np.ndarray  # 4 corners
    reversed_border: bool
    h: np.ndarray = field(default=None)


def decimate(im: np.ndarray, factor: float) -> np.ndarray:
    if factor == 1.5:
        h, w = im.shape[0] // 3 * 3, im.shape[1] // 3 * 3
        b = im[:h, :w].astype(np.int32).reshape(h // 3, 3, w // 3, 3)
        # Each output is the block's corner (4), its two edge neighbours (2 each) and the centre (1).
        out = np.empty((h // 3, 2, w // 3, 2), np.int32)
        for oy, cy in ((0, 0), (1, 2)):
            for ox, cx in ((0, 0), (1, 2)):
                out[:, oy, :, ox] = (4 * b[:, cy, :, cx] + 2 * b[:, cy, :, 1] + 2 * b[:, 1, :, cx] + b[:, 1, :, 1]) // 9
        return out.reshape(h // 3 * 2, w // 3 * 2).astype(np.uint8)
    if factor != int(factor):
        raise ValueError("the factor must be 1.5 or a whole number")
    return im[:: int(factor), :: int(factor)]


def blurred(im: np.ndarray, sigma: float) -> np.ndarray:
    from .raster import gaussian_kernel

    size = int(4 * abs(sigma)) | 1
    if size <= 1:
        return im
    kernel, half, low = gaussian_kernel(abs(sigma), size), size // 2, im.astype(np.int32)
    for axis in (1, 0):
        n = low.shape[axis]
        if n >= size:
            taps = sum(k * np.take(low, range(j, n - size + 1 + j), axis) for j, k in enumerate(kernel)) >> 8
            low = low.copy()
            low[(slice(None), slice(half, n - half)) if axis else slice(half, n - half)] = taps
    return low.astype(np.uint8) if sigma > 0 else np.clip(2 * im.astype(np.int32) - low, 0, 255).astype(np.uint8)


def _around(a: np.ndarray, pick) -> np.ndarray:
    """pick over the 3x3 neighbourhood, clipped at the edges."""
    for axis in (0, 1):
        n = a.shape[axis]
        lo, hi = np.take(a, [0, *range(n - 1)], axis), np.take(a, [*range(1, n), n - 1], axis)
        a = pick(pick(a, lo), hi)
    return a


def threshold(im: np.ndarray, min_diff: int = 5, deglitch: bool = False) -> np.ndarray:
    h, w = im.shape
    th, tw = h // 4, w // 4
    tiles = im[: th * 4, : tw * 4].reshape(th, 4, tw, 4)
    lo, hi = _around(tiles.min((1, 3)).astype(np.int32), np.minimum), _around(tiles.max((1, 3)).astype(np.int32), np.maximum)
    ty, tx = np.minimum(np.arange(h) // 4, th - 1), np.minimum(np.arange(w) // 4, tw - 1)
    low, span = lo[np.ix_(ty, tx)], (hi - lo)[np.ix_(ty, tx)]
    out = np.where(im > low + span // 2, 255, 0)
    out[: th * 4, : tw * 4][span[: th * 4, : tw * 4] < min_diff] = 127
    if deglitch:
        high = np.zeros_like(out)
        high[1:-1, 1:-1] = _around(out, np.maximum)[1:-1, 1:-1]
        out[1:-1, 1:-1] = _around(high, np.minimum)[1:-1, 1:-1]
    return out


def clusters(b: np.ndarray, comp: np.ndarray, min_pixels: int) -> list[np.ndarray]:
    """Boundary points (x2, y2, gx, gy) of each pair of touching components, in order of the pair."""
    h, w = b.shape
    size = np.bincount(comp.ravel(), minlength=h * w)
    big = (size[comp] >= min_pixels) & (b != 127)
    ys, xs = slice(1, h - 1), slice(1, w - 1)
    found, before = [], None
    meets: dict[tuple[int, int], np.ndarray] = {}
    for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1)):
        there = (slice(1 + dy, h - 1 + dy), slice(1 + dx, w - 1 + dx))
        hit = big[ys, xs] & big[there] & (b[ys, xs] + b[there] == 255)
        meets[dx, dy] = hit
        if (dx, dy) == (-1, 1):
            before = np.zeros_like(hit)
            before[:, 1:] = meets[1, 1][:, :-1]
            hit = hit & ~before
        y, x = np.nonzero(hit)
        y, x = y + 1, x + 1
        d = b[y + dy, x + dx] - b[y, x]
        c0, c1 = comp[y, x], comp[y + dy, x + dx]
        found.append(np.stack((np.maximum(c0, c1), np.minimum(c0, c1), 2 * x + dx, 2 * y + dy, dx * d, dy * d), 1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    cut = np.flatnonzero((np.diff(rows[:, :2], axis=0) != 0).any(1)) + 1
    return [g[:, 2:] for g in np.split(rows, cut)] if len(rows) else []


def _moments(pts: np.ndarray, im: np.ndarray) -> np.ndarray:
    """Prefix sums, with a zero row first."""
    x, y = pts[:, 0] * 0.5 + 0.5, pts[:, 1] * 0.5 + 0.5
    ix, iy = x.astype(int), y.astype(int)
    h, w = im.shape
    inside = (ix > 0) & (ix + 1 < w) & (iy > 0) & (iy + 1 < h)
    jx, jy = np.where(inside, ix, 1), np.where(inside, iy, 1)
    g = im.astype(np.int32)
    weight = np.where(inside, np.hypot(g[jy, jx + 1] - g[jy, jx - 1], g[jy + 1, jx] - g[jy - 1, jx]) + 1, 1.0)
    sums = np.cumsum(weight[:, None] * np.stack((np.ones_like(x), x, y, x * x, x * y, y * y), 1), 0)
    return np.concatenate((np.zeros((1, 6)), sums))


def fit_lines(m: np.ndarray, i0: np.ndarray, i1: np.ndarray):
    """(centre x, y, normal x, y), err and mse of circular ranges i0..i1 of prefix sums."""
    n = len(m) - 1
    s = m[i1 + 1] - m[i0] + np.where((i1 < i0)[..., None], m[n], 0)
    count = np.where(i1 < i0, n - i0 + i1 + 1, i1 - i0 + 1)
    ex, ey = s[..., 1] / s[..., 0], s[..., 2] / s[..., 0]
    cxx, cxy, cyy = s[..., 3] / s[..., 0] - ex * ex, s[..., 4] / s[..., 0] - ex * ey, s[..., 5] / s[..., 0] - ey * ey
    root = np.sqrt((cxx - cyy) ** 2 + 4 * cxy * cxy)
    small, large = (cxx + cyy - root) / 2, (cxx + cyy + root) / 2
    a, b = np.stack((cxx - large, cxy), -1), np.stack((cxy, cyy - large), -1)
    normal = np.where(((a * a).sum(-1) > (b * b).sum(-1))[..., None], a, b)
    length = np.linalg.norm(normal, axis=-1, keepdims=True)
    normal = np.where(length < 1e-12, 0, normal / np.maximum(length, 1e-12))
    return np.concatenate((np.stack((ex, ey), -1), normal), -1), count * small, small


def _corners(m: np.ndarray, cfg: DetectorConfig) -> np.ndarray | None:
    """Four places of the boundary where its sides meet."""
    n = len(m) - 1
    k = min(20, n // 12)
    if k < 2:
        return None
    at = np.arange(n)
    _, err, _ = fit_lines(m, (at - k) % n, (at + k) % n)
    taps = np.exp(-np.arange(-3, 4) ** 2 / 2)
    smooth = sum(t * np.roll(err, -j) for t, j in zip(taps, range(-3, 4)))
    top = np.flatnonzero((smooth > np.roll(smooth, 1)) & (smooth > np.roll(smooth, -1)))
    if len(top) < 4:
        return None
    if len(top) > cfg.max_nmaxima:
        bar = np.sort(smooth[top])[::-1][cfg.max_nmaxima]
        top = top[smooth[top] > bar]
    c = len(top)
    if c < 4:
        return None
    i, j = np.meshgrid(top, top, indexing="ij")
    line, err, mse = fit_lines(m, i, j)
    four = np.array([(a, b, d, e) for a in range(c - 3) for b in range(a + 1, c - 2) for d in range(b + 1, c - 1) for e in range(d + 1, c)])
    a, b, d, e = four.T
    ok = np.all([mse[x, y] <= cfg.max_line_fit_mse for x, y in ((a, b), (b, d), (d, e), (e, a))], 0)
    ok &= np.abs((line[a, b, 2:] * line[b, d, 2:]).sum(-1)) <= cfg.cos_critical
    total = np.where(ok, err[a, b] + err[b, d] + err[d, e] + err[e, a], np.inf)
    best = int(np.argmin(total))
    return top[four[best]] if total[best] / n < cfg.max_line_fit_mse else None


def _meet(l0: np.ndarray, l1: np.ndarray) -> np.ndarray | None:
    """Where two lines (centre, normal) meet."""
    u, v = (np.array((-x[3], x[2])) for x in (l0, l1))
    det = u[1] * v[0] - u[0] * v[1]
    if not abs(det) >= 0.001:
        return None
    d = l1[:2] - l0[:2]
    return l0[:2] + u * ((v[0] * d[1] - v[1] * d[0]) / det)


def fit_quad(pts: np.ndarray, im: np.ndarray, cfg: DetectorConfig, tag_width: int, wanted: set[bool]) -> Quad | None:
    x, y = pts[:, 0], pts[:, 1]
    if (x.max() - x.min()) * (y.max() - y.min()) < tag_width:
        return None
    dx = x - np.float32((x.min() + x.max()) * 0.5 + 0.05118)
    dy = y - np.float32((y.min() + y.max()) * 0.5 - 0.028581)
    reversed_border = bool((dx * pts[:, 2] + dy * pts[:, 3]).sum() < 0)
    if reversed_border not in wanted:
        return None
    pts = pts[np.lexsort((y, x, np.arctan2(dy, dx).astype(np.float32)))]
    m = _moments(pts, im)
    idx = _corners(m, cfg)
    if idx is None:
        return None
    line, _, mse = fit_lines(m, idx, np.roll(idx, -1))
    if (mse > cfg.max_line_fit_mse).any():
        return None
    p = [_meet(line[k], line[(k + 1) % 4]) for k in range(4)]
    if any(q is None for q in p):
        return None
    p = np.array(p, np.float32).astype(float)
    side = np.roll(p, -1, 0) - p
    cross = side[:, 0] * np.roll(side, -1, 0)[:, 1] - side[:, 1] * np.roll(side, -1, 0)[:, 0]
    length = np.linalg.norm(side, axis=1)
    if (length == 0).any() or (cross < 0).any():
        return None
    diagonal = p[2] - p[0]
    area = abs(np.cross(np.r_[p[1] - p[0], 0], np.r_[diagonal, 0])[2]) / 2 + abs(np.cross(np.r_[p[3] - p[0], 0], np.r_[diagonal, 0])[2]) / 2
    cos = (side * np.roll(side, -1, 0)).sum(1) / (length * np.roll(length, -1))
    if area < 0.95 * tag_width * tag_width or (np.abs(cos) > cfg.cos_critical).any():
        return None
    return Quad(p, reversed_border)


def bilinear(im: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between pixel centres; -1 outside."""
    x, y = x - 0.5, y - 0.5
    ix, iy = np.floor(x).astype(int), np.floor(y).astype(int)
    h, w = im.shape
    ok = (ix >= 0) & (iy >= 0) & (ix + 1 < w) & (iy + 1 < h)
    jx, jy = np.where(ok, ix, 0), np.where(ok, iy, 0)
    fx, fy, g = x - ix, y - iy, im
    v = g[jy, jx] * (1 - fx) * (1 - fy) + g[jy, jx + 1] * fx * (1 - fy) + g[jy + 1, jx] * (1 - fx) * fy + g[jy + 1, jx + 1] * fx * fy
    return np.where(ok, v, -1.0)


def refine(im: np.ndarray, q: Quad, decimate_by: float) -> None:
    """Moves the sides to the strongest edges of the full image, and the corners to where they meet."""
    lines = []
    reach = np.arange(-int(decimate_by + 1) * 4, int(decimate_by + 1) * 4 + 1) / 4
    for k in range(4):
        a, b = q.p[k], q.p[(k + 1) % 4]
        d = b - a
        length = max(np.linalg.norm(d), 1e-12)
        normal = np.array((d[1], -d[0])) / length * (-1 if q.reversed_border else 1)
        n = max(16, int(length / 8))
        alpha = (1 + np.arange(n)) / (n + 1)
        at = alpha[:, None] * a + (1 - alpha)[:, None] * b
        x, y = at[:, :1] + reach * normal[0], at[:, 1:] + reach * normal[1]
        g1, g2 = bilinear(im, x + normal[0], y + normal[1]), bilinear(im, x - normal[0], y - normal[1])
        w = np.where((g1 >= 0) & (g2 >= 0) & (g1 >= g2), (g2 - g1) ** 2, 0.0)
        total = w.sum(1)
        keep = total > 0
        if keep.sum() < 2:
            lines.append(None)
            continue
        n0 = (w * reach).sum(1)[keep] / total[keep]
        best = at[keep] + n0[:, None] * normal
        e = best.mean(0)
        c = np.cov(best.T, bias=True)
        theta = 0.5 * math.atan2(-2 * c[0, 1], c[1, 1] - c[0, 0])
        lines.append(np.array((*e, math.cos(theta), math.sin(theta))))
    for k in range(4):
        l0, l1 = lines[k], lines[(k + 1) % 4]
        if l0 is not None and l1 is not None and (p := _meet(l0, l1)) is not None:
            q.p[(k + 1) % 4] = p


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """The projective map of four points or more, by linear least squares with the last entry 1."""
    rows, rhs = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [(x, y, 1, 0, 0, 0, -x * u, -y * u), (0, 0, 0, x, y, 1, -x * v, -y * v)]
        rhs += [u, v]
    a = np.array(rows, float)
    if np.linalg.matrix_rank(a, 1e-10) < 8:
        return None
    h = np.linalg.solve(a, rhs) if len(a) == 8 else np.linalg.lstsq(a, np.array(rhs), rcond=None)[0]
    return np.append(h, 1.0).reshape(3, 3)


def project(h: np.ndarray, xy: np.ndarray) -> np.ndarray:
    p = np.c_[xy, np.ones(len(xy))] @ h.T
    return p[:, :2] / p[:, 2:]


def _plane(xy: np.ndarray, v: np.ndarray) -> np.ndarray | None:
    a = np.c_[xy, np.ones(len(xy))]
    m = a.T @ a
    return np.linalg.solve(m, a.T @ v) if np.linalg.cond(m) < 1e12 else None


def sample(im: np.ndarray, q: Quad, f: Family, sharpening: float) -> tuple[int, float] | None:
    """(codeword, margin) of a quad read as a family; None where its border has the wrong polarity."""
    w = f.width_at_border
    line = np.arange(w) + 0.5
    models = []
    for white in (True, False):
        out = -0.5 if white else 0.5
        cells = [np.stack(c, 1) for c in ((np.full(w, out), line), (np.full(w, w - out), line), (line, np.full(w, out)), (line, np.full(w, w - out)))]
        tag = 2 * (np.concatenate(cells) / w - 0.5)
        at = project(q.h, tag)
        ix, iy = np.trunc(at).astype(int).T
        ok = (ix >= 0) & (iy >= 0) & (ix < im.shape[1]) & (iy < im.shape[0]) & (at >= 0).all(1)
        model = _plane(tag[ok], im[iy[ok], ix[ok]].astype(float)) if ok.sum() >= 3 else None
        if model is None:
            return None
        models.append(model)
    if (models[0][2] - models[1][2] < 0) != f.reversed_border:
        return None
    bits = np.array(f.bits)
    tag = 2 * ((bits + 0.5) / w - 0.5)
    at = project(q.h, tag)
    v = bilinear(im, at[:, 0], at[:, 1])
    mid = np.c_[tag, np.ones(len(tag))] @ ((models[0] + models[1]) / 2)
    low = (w - f.total_width) // 2
    grid = np.zeros((f.total_width + 2, f.total_width + 2))
    grid[bits[:, 1] - low + 1, bits[:, 0] - low + 1] = np.where(v < 0, 0, v - mid)
    around = 4 * grid[1:-1, 1:-1] - grid[:-2, 1:-1] - grid[2:, 1:-1] - grid[1:-1, :-2] - grid[1:-1, 2:]
    value = (grid[1:-1, 1:-1] + sharpening * around)[bits[:, 1] - low, bits[:, 0] - low]
    code = 0
    for b in (value > 0).tolist():
        code = code << 1 | b
    on = value > 0
    return code, float(min(value[on].sum() / (1 + on.sum()), -value[~on].sum() / (1 + (~on).sum())))


def rotate90(code: int, nbits: int) -> int:
    centre = nbits % 4
    n, k = nbits - centre, nbits // 4
    body = code >> centre
    return ((body << k | body >> (n - k)) & ((1 << n) - 1)) << centre | code & centre


class CodeIndex:
    """A family's codes as an array; a lookup is one pass of xor and bit counts over at most 65,535 numbers."""

    def __init__(self, f: Family):
        self.family, self.codes = f, np.array(f.codes, np.uint64)

    def find(self, code: int, most: int) -> tuple[int, int, int] | None:
        """(id, hamming, rotation) of the first turn with a code near enough."""
        for turn in range(4):
            d = np.bitwise_count(self.codes ^ np.uint64(code))
            if len(d) and d.min() <= most:
                return int(d.argmin()), int(d.min()), turn
            code = rotate90(code, self.family.nbits)
        return None


SQUARE = np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)], float)
CORNERS = np.array([(-1, 1), (1, 1), (1, -1), (-1, -1)], float)


def quads(im: np.ndarray, cfg: DetectorConfig, families: list[Family]) -> list[Quad]:
    b = threshold(im, cfg.min_white_black_diff, cfg.deglitch)
    h, w = im.shape
    width = max(3, int(min(f.width_at_border for f in families) / max(1.0, cfg.quad_decimate)))
    wanted = {f.reversed_border for f in families}
    found = []
    for pts in clusters(b, label_image(b), cfg.min_cluster_pixels):
        if cfg.min_cluster_pixels <= len(pts) <= 2 * (2 * w + 2 * h):
            q = fit_quad(pts, im, cfg, width, wanted)
            if q is not None:
                found.append(q)
    return found


def overlap(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two convex quadrilaterals share area or an edge point: no side of either separates them."""
    for a in (p, q):
        for k in range(4):
            d = a[(k + 1) % 4] - a[k]
            normal = np.array((-d[1], d[0]))
            x, y = p @ normal, q @ normal
            if x.max() < y.min() or y.max() < x.min():
                return False
    return True


def reconcile(found: list[dict]) -> list[dict]:
    """Best first within (family, id): fewer errors, larger margin, smaller corners; a worse overlap goes."""
    kept: list[dict] = []
    for d in sorted(found, key=lambda d: (d["hamming"], -d["decision_margin"], d["p"].tolist())):
        if not any(k["family"] == d["family"] and k["id"] == d["id"] and overlap(k["p"], d["p"]) for k in kept):
            kept.append(d)
    return sorted(kept, key=lambda d: (d["id"], d["family"], d["p"].tolist()))


def detect(im: np.ndarray, families: list[Family], cfg: DetectorConfig = DetectorConfig()) -> list[dict]:
    """Detections of a gray image, as rows of the detections schema without image_id."""
    if not families or im.shape[0] < 8 or im.shape[1] < 8:
        return []
    small = blurred(decimate(im, cfg.quad_decimate) if cfg.quad_decimate > 1 else im, cfg.quad_sigma)
    source = small if cfg.quad_decimate <= 1 else im
    indexes = [CodeIndex(f) for f in families]
    found = []
    for q in quads(small, cfg, families) if min(small.shape) >= 8 else []:
        if cfg.quad_decimate > 1:
            q.p = q.p * cfg.quad_decimate
        if cfg.refine_edges:
            refine(source, q, cfg.quad_decimate)
        q.h = homography(SQUARE, q.p)
        if q.h is None:
            continue
        for index in indexes:
            f = index.family
            if f.reversed_border != q.reversed_border or (got := sample(source, q, f, cfg.decode_sharpening)) is None:
                continue
            hit = index.find(got[0], cfg.max_hamming)
            if got[1] < 0 or hit is None:
                continue
            t = hit[2] * math.pi / 2
            turn = np.array(((round(math.cos(t)), -round(math.sin(t)), 0), (round(math.sin(t)), round(math.cos(t)), 0), (0, 0, 1)))
            h = q.h @ turn
            found.append({"family": f.name, "id": hit[0], "hamming": hit[1], "decision_margin": got[1], "h": h, "c": project(h, np.zeros((1, 2)))[0], "p": project(h, CORNERS)})
    return reconcile(found)


def render(f: Family, i: int) -> np.ndarray:
    """A marker as a small image, one pixel a cell."""
    n, ring = f.total_width, f.width_at_border + (0 if f.reversed_border else 2)
    s, b = (n - ring) // 2, (n - f.width_at_border) // 2
    im = np.zeros((n, n), np.uint8)
    im[s, s : n - s] = im[n - 1 - s, s : n - s] = im[s : n - s, s] = im[s : n - s, n - 1 - s] = 255
    for k, (x, y) in enumerate(f.bits):
        if f.codes[i] >> (f.nbits - 1 - k) & 1:
            im[y + b, x + b] = 255
    return im
