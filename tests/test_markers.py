"""Detection, pose, containers and streaming on rendered markers."""

import math

import numpy as np
import pytest

from markerlake.engine import MarkerEngine
from markerlake.families import FAMILIES, read_codes, with_codes
from markerlake.operators import detect as dt
from markerlake.operators import pose as ps
from markerlake.sources import netpbm

F16 = FAMILIES["tag16h5"]


def scene(f, i, rot=0, size=200, at=40, scale=8, paper=255):
    t = np.kron(np.rot90(dt.render(f, i), rot), np.ones((scale, scale), np.uint8))
    im = np.full((size, size), paper, np.uint8)
    im[at : at + t.shape[0], at : at + t.shape[1]] = t
    return im


@pytest.mark.parametrize("name", ["tag16h5", "tag25h9", "tagCircle21h7"])
def test_every_turn_and_size(name):
    f = FAMILIES[name]
    paper = 128 if f.reversed_border else 255
    for i in (0, 1, len(f.codes) - 1):
        for rot in range(4):
            for d in (1.0, 1.5, 2.0):
                got = dt.detect(scene(f, i, rot, paper=paper), [f], dt.DetectorConfig(quad_decimate=d))
                assert [(x["id"], x["hamming"]) for x in got] == [(i, 0)], (i, rot, d)
                p = dt.detect(scene(f, i, 0, paper=paper), [f], dt.DetectorConfig(quad_decimate=d))[0]["p"]
                assert np.abs(np.roll(p, rot, 0) - got[0]["p"]).max() < 0.5 or rot


def test_family_distance_and_correction():
    for f in (F16, FAMILIES["tag25h9"], FAMILIES["tagCircle21h7"]):
        least = min(bin(a ^ t).count("1") for i, a in enumerate(f.codes) for b in f.codes[:i] for t in turns(b, f.nbits))
        assert least >= f.h - 1
        limit = min(3, (f.h - 1) // 2)
        index = dt.CodeIndex(f)
        rnd = np.random.default_rng(1)
        for i, code in enumerate(f.codes):
            for n in range(limit + 1):
                bad = code
                for b in rnd.choice(f.nbits, n, replace=False):
                    bad ^= 1 << int(b)
                assert index.find(bad, limit) == (i, n, 0)


def turns(code, n):
    for _ in range(4):
        yield code
        code = dt.rotate90(code, n)


def test_guards():
    assert dt.detect(np.full((100, 100), 7, np.uint8), [F16]) == []
    assert dt.detect(np.zeros((7, 7), np.uint8), [F16]) == []
    assert dt.detect(scene(F16, 0), []) == []
    two = np.concatenate((scene(F16, 3), scene(F16, 3)), 1)
    assert [x["id"] for x in dt.detect(two, [F16])] == [3, 3]
    with pytest.raises(ValueError):
        dt.decimate(scene(F16, 0), 2.5)
    with pytest.raises(RuntimeError):
        MarkerEngine(None, ["tag99"])


def test_codes_as_parameter(tmp_path):
    (tmp_path / "c.txt").write_text("0xd5d628584\n0xd97f18b49, 0xdd280910e")
    f = with_codes("tag36h11", read_codes(str(tmp_path / "c.txt")))
    assert len(f.bits) == 36 and len(set(f.bits)) == 36
    assert [x["id"] for x in dt.detect(scene(f, 2), [f])] == [2]


def rotation(axis, angle):
    k = np.array(axis, float) / np.linalg.norm(axis)
    c = np.array(((0, -k[2], k[1]), (k[2], 0, -k[0]), (-k[1], k[0], 0)))
    return np.eye(3) + math.sin(angle) * c + (1 - math.cos(angle)) * c @ c


@pytest.mark.parametrize("tilt", [0.0, 0.3, 0.7])
def test_pose_round_trip(tilt):
    size, fx, fy, cx, cy = 0.16, 600.0, 600.0, 400.0, 300.0
    r, t = rotation((0.2, 1, 0.1), tilt), np.array((0.05, -0.03, 0.9))
    s = size / 2
    world = np.array(((-s, s, 0), (s, s, 0), (s, -s, 0), (-s, -s, 0))) @ r.T + t
    corners = np.c_[fx * world[:, 0] / world[:, 2] + cx, fy * world[:, 1] / world[:, 2] + cy]
    h = dt.homography(dt.CORNERS, corners)
    got_r, got_t, err = ps.pose(h, corners, size, fx, fy, cx, cy)
    assert err < 1e-9 and np.abs(got_r - r).max() < 1e-3 and np.abs(got_t - t).max() < 1e-3


def test_containers():
    rnd = np.random.default_rng(2)
    for c in (1, 3, 4):
        s = rnd.integers(0, 256, (5, 7, c), dtype=np.uint8)
        assert (netpbm.parse(netpbm.pam_bytes(s)) == s).all()
        assert (netpbm.parse(netpbm.pnm_bytes(s)) == s[:, :, : 1 if c == 1 else 3]).all()
    assert netpbm.parse(b"P4\n# c\n3 2\n\xa0\x40")[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert netpbm.parse(b"P5 2 1 65535\n\x01\x02\xff\x00")[:, :, 0].tolist() == [[1, 255]]
    for bad in (b"", b"P5\n4 4\n255\nxx", b"GIF89", b"P7\nWIDTH 3\nENDHDR\n"):
        with pytest.raises(ValueError):
            netpbm.parse(bad)


def test_engine(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(4):
        (folder / f"{i}.pnm").write_bytes(netpbm.pnm_bytes(scene(F16, i)[:, :, None]))
    (folder / "bad.pnm").write_bytes(b"P5\n9 9\n255\n")
    images = netpbm.read_images(spark, str(folder))
    assert images.filter("error IS NOT NULL").count() == 1
    engine = MarkerEngine(spark, ["tag16h5"])
    found = engine.detect(images)
    assert sorted(r.id for r in found.collect()) == [0, 1, 2, 3]
    sizes = spark.createDataFrame([("tag16h5", 0.16)], "family string, tagsize double")
    poses = engine.pose(found, sizes, 600, 600, 100, 100).collect()
    assert len(poses) == 4 and all(r.t[2] > 0 and r.err < 1e-6 for r in poses)
    total = [r for r in engine.histogram(found).collect() if r.image_id is None][0]
    assert (total.h0, total.total) == (4, 4)
    drawn = {(r.id, r.y, r.x): r.v for r in engine.render().filter("id < 2").collect()}
    for i in range(2):
        im = dt.render(F16, i)
        assert all(drawn[i, y, x] == im[y, x] for y in range(8) for x in range(8))
    small = images.filter("image_id LIKE '%0.pnm'")
    assert netpbm.pixels(small).selectExpr("sum(v)").first()[0] == int(scene(F16, 0).astype(int).sum())
    assert netpbm.encoded(small).first().content == netpbm.pnm_bytes(scene(F16, 0)[:, :, None])
    from markerlake.streaming.frames import detections_stream

    q = detections_stream(engine, str(folder)).writeStream.format("memory").queryName("frames").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.table("frames").collect()) == [0, 1, 2, 3]


def test_relational_twins(spark):
    """The image kernels and the relational operators agree on a small raster."""
    from markerlake.operators import raster, segments

    im = (np.random.default_rng(3).integers(0, 2, (30, 34)) * 200 + np.arange(34)).astype(np.uint8)
    im[5:20, 5:25] = 250
    rows = [(0, y, x, int(im[y, x])) for y in range(30) for x in range(34)]
    px = spark.createDataFrame(rows, "image_id int, y int, x int, v int")
    t = dt.threshold(im)
    got = raster.threshold(px)
    assert all(t[r.y, r.x] == r.v for r in got.collect())
    comp = segments.components(got)
    pts = segments.boundary_points(comp, 10).collect()
    want = sorted(tuple(map(int, p)) for c in dt.clusters(t, segments.label_image(t), 10) for p in c)
    assert sorted((r.x2, r.y2, r.gx, r.gy) for r in pts) == want and len(want) > 20
