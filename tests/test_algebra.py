"""Matrices and rigid motions on columns against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from markerlake.functions import matrices as mx
from markerlake.functions import rigid as rg


def mat(a):
    a = np.asarray(a, float)
    return mx.matrix(a.shape[0], a.shape[1], F.array(*(F.lit(float(x)) for x in a.ravel())))


def back(r):
    return None if r is None or r["data"] is None else np.array(r["data"]).reshape(r["nrows"], r["ncols"])


def test_matrices(spark):
    rnd = np.random.default_rng(1)
    a, b, v = rnd.normal(size=(3, 3)), rnd.normal(size=(3, 3)), rnd.normal(size=(3, 1))
    spd = a @ a.T + np.eye(3)
    want = {
        "mul": a @ b, "tr": rnd.normal(size=(2, 3)), "add": a + b, "sub": a - b, "inv": np.linalg.inv(a), "solve": np.linalg.solve(a, v), "chol": np.linalg.cholesky(spd).T,
        "sel": a[1:3, 0:2], "put": np.where(np.arange(9).reshape(3, 3) == 5, 7.0, a), "expr": a @ (b - a).T @ np.linalg.inv(b) + 2 * a, "cross": np.cross(v.ravel(), a[0])[:, None], "norm": v / np.linalg.norm(v),
    }
    t = want["tr"]
    df = spark.range(1).select(
        mx.multiply(mat(a), mat(b)).alias("mul"), mx.transpose(mat(t.T)).alias("tr"), mx.add(mat(a), mat(b)).alias("add"), mx.subtract(mat(a), mat(b)).alias("sub"),
        mx.inverse(mat(a)).alias("inv"), mx.solve(mat(a), mat(v)).alias("solve"), mx.chol(mat(spd)).alias("chol"), mx.select(mat(a), 1, 2, 0, 1).alias("sel"), mx.put(mat(a), 1, 2, F.lit(7.0)).alias("put"),
        mx.evaluate("M*(M-M)'M^-1 + 2M", mat(a), mat(b), mat(a), mat(b), mat(a)).alias("expr"), mx.cross(mat(v), mat(a[:1])).alias("cross"), mx.normalize(mat(v)).alias("norm"),
        mx.det(mat(a)).alias("det"), mx.svd(mat(a)).alias("svd"), mx.inverse(mat(np.zeros((2, 2)))).alias("none"), mx.multiply(mat(a), mat(t)).alias("shape"),
        mx.dot(mat(v), mat(v)).alias("dot"), mx.err_inf(mat(a), mat(b)).alias("err"), mx.largest(mat(a)).alias("top"), mx.distance(mat(a), mat(b)).alias("dist"),
    )
    r = df.first()
    for k, w in want.items():
        assert np.allclose(back(r[k]), w), k
    assert math.isclose(r.det, np.linalg.det(a)) and np.allclose(r.svd.s, np.linalg.svd(a)[1]) and np.allclose(back(r.svd.u) @ np.diag(r.svd.s) @ back(r.svd.v).T, a)
    assert back(r.none) is None and r["shape"] is None
    assert math.isclose(r.dot, float((v * v).sum())) and math.isclose(r.err, np.abs(a - b).max()) and math.isclose(r.top, a.max()) and math.isclose(r.dist, np.linalg.norm(a - b))
    for bad in ("M+", "M)", "(M", "M M", "x"):
        with pytest.raises(ValueError):
            mx.evaluate(bad, mat(a))


def test_rigid(spark):
    axis, angle, p = np.array((1.0, -2.0, 0.5)), 0.7, np.array((0.3, 2.0, -1.0))
    k = axis / np.linalg.norm(axis)
    c = np.array(((0, -k[2], k[1]), (k[2], 0, -k[0]), (-k[1], k[0], 0)))
    rot = np.eye(3) + math.sin(angle) * c + (1 - math.cos(angle)) * c @ c
    q = rg.angleaxis_to_quat(F.lit(angle), rg.vec(*axis))
    m = rg.quat_to_mat44(q, rg.vec(1, 2, 3))
    half = rg.angleaxis_to_quat(F.lit(angle / 2), rg.vec(*axis))
    xyt = rg.vec(1, 2, 0.5)
    r = spark.range(1).select(
        rg.quat_rotate(q, rg.vec(*p)).alias("rot"), rg.mat44_transform(m, rg.vec(*p)).alias("move"), rg.mat44_multiply(m, rg.mat44_inverse(m)).alias("one"), rg.mat44_to_quat(m).alias("q2"), q.alias("q"),
        rg.quat_multiply(q, rg.quat_inverse(q)).alias("unit"), rg.quat_to_angle(q).alias("angle"), rg.quat_to_axis(q).alias("axis"), rg.slerp(rg.vec(1, 0, 0, 0), q, F.lit(0.5)).alias("mid"), half.alias("half"),
        rg.quat_to_rpy(rg.rpy_to_quat(F.lit(0.1), F.lit(-0.4), F.lit(1.2))).alias("rpy"), rg.xyt_multiply(xyt, rg.xyt_inverse(xyt)).alias("plane"), rg.mat44_to_xyt(rg.xyt_to_mat44(xyt)).alias("xyt"),
        rg.xyt_transform(xyt, rg.vec(1, 0)).alias("point"), rg.cross(rg.vec(1, 0, 0), rg.vec(0, 1, 0)).alias("cross"), rg.mat44_rotate(m, rg.vec(*p)).alias("turn"),
    ).first()
    assert np.allclose(r.rot, rot @ p) and np.allclose(r.move, rot @ p + (1, 2, 3)) and np.allclose(r.turn, rot @ p)
    assert np.allclose(np.array(r.one).reshape(4, 4), np.eye(4)) and np.allclose(r.q, r.q2) and np.allclose(r.unit, (1, 0, 0, 0))
    assert np.allclose(r.axis, k) and math.isclose(r.angle, angle) and np.allclose(r.mid, r.half) and np.allclose(r.rpy, (0.1, -0.4, 1.2))
    assert np.allclose(r.plane, 0) and np.allclose(r.xyt, (1, 2, 0.5)) and np.allclose(r.point, (1 + math.cos(0.5), 2 + math.sin(0.5))) and r.cross == [0, 0, 1]


def test_drawing_and_hull(spark):
    from markerlake.functions import geometry as g
    from markerlake.operators import raster

    px = spark.createDataFrame([(0, y, x, 10) for y in range(6) for x in range(8)], "image_id int, y int, x int, v int")
    line = {(r.y, r.x) for r in raster.draw_line(px, 1.2, 1.2, 5.2, 3.2, 99).collect() if r.v == 99}
    assert {(1, 1), (3, 5)} <= line and len(line) in (5, 6, 7)
    assert len([1 for r in raster.draw_line(px, 1, 1, 5, 3, 99, width=2).collect() if r.v == 99]) > len(line)
    near = {(r.y, r.x): r.v for r in raster.fill_line_max(px, 2.5, 2.5, 5.5, 2.5, [200, 50], 1.0).collect()}
    assert near[2, 3] == 200 and near[3, 3] == 50 and near[5, 0] == 10
    pts = F.array(*(g.point(float(x), float(y)) for x, y in ((0, 0), (4, 0), (2, 0), (4, 4), (0, 4), (2, 2), (0, 0))))
    r = spark.range(1).select(g.convex_hull(pts).alias("h"), g.closest_on_boundary(pts, g.point(2, -3)).alias("c"), g.crossings(F.array(g.point(0, 0), g.point(4, 0), g.point(4, 4), g.point(0, 4)), F.lit(1.0)).alias("x")).first()
    assert [(p.x, p.y) for p in r.h] == [(0, 0), (4, 0), (4, 4), (0, 4)] and (r.c.x, r.c.y) == (2, 0) and r.x == [0, 4]
