"""Driver queries and their DuckDB twins, one pair for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import MarkerEngine
from ..families import FAMILIES
from ..functions import geometry as g
from ..functions import matrices as mx
from ..functions import rigid as rg
from ..functions import scalars as s
from ..operators import codes as c
from ..operators import lines as ln
from ..operators import raster as r
from ..operators import segments as sg
from . import virtual as v

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def out(df: DataFrame, *names: str, **kinds: str) -> DataFrame:
    """Columns by name, whole numbers as long unless a kind is given."""
    return df.select(*(F.col(n).cast(kinds.get(n, "long")).alias(n) for n in names))


def big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


PIXEL = ("y", "x", "v")


# ---- rasters ----


@query("raster_decimate2", f"WITH {v.PX} SELECT CAST(y // 2 AS BIGINT) AS y, CAST(x // 2 AS BIGINT) AS x, CAST(v AS BIGINT) AS v FROM px WHERE x % 2 = 0 AND y % 2 = 0")
def _(spark, d):
    return out(r.decimate(v.pixels(spark, d), 2), *PIXEL)


_TAPS = " UNION ALL ".join(
    f"SELECT by_ * 2 + {dy} AS y, bx * 2 + {dx} AS x, sum(v * [{', '.join(map(str, w))}][(y % 3) * 3 + x % 3 + 1]) // 9 AS v FROM b GROUP BY by_, bx HAVING count(*) = 9" for (dy, dx), w in r.THREE_TO_TWO.items()
)


@query("raster_decimate15", f"WITH {v.PX}, b AS (SELECT *, y // 3 AS by_, x // 3 AS bx FROM px) SELECT {big(*PIXEL)} FROM ({_TAPS})")
def _(spark, d):
    return out(r.decimate(v.pixels(spark, d), 1.5), *PIXEL)


@query("raster_darken", f"WITH {v.PX} SELECT y::BIGINT AS y, x::BIGINT AS x, (v // 2)::BIGINT AS v FROM px")
def _(spark, d):
    return out(r.darken(v.pixels(spark, d)), *PIXEL)


@query("gray_from_rgb", f"WITH {v.PX} SELECT y::BIGINT AS y, x::BIGINT AS x, ((v + 2 * ((v * 3) % 256) + (v * 7) % 256) // 4)::BIGINT AS v FROM px")
def _(spark, d):
    p = v.pixels(spark, d)
    return out(r.gray_from_rgb(p.select("image_id", "y", "x", F.col("v").alias("r"), (F.col("v") * 3 % 256).alias("g"), (F.col("v") * 7 % 256).alias("b"))), *PIXEL)


KERNEL = r.gaussian_kernel(0.8, 3)


def _pass(source: str, line: str, along: str, carry: str = "") -> str:
    a, b, k = KERNEL
    w = f"OVER (PARTITION BY {line} ORDER BY {along})"
    return f"SELECT y, x{carry}, coalesce(({a} * lag(v) {w} + {b} * v + {k} * lead(v) {w}) // 256, v) AS v FROM {source}"


@query("raster_blur3", f"WITH {v.PX}, h AS ({_pass('px', 'y', 'x')}), f AS ({_pass('h', 'x', 'y')}) SELECT {big(*PIXEL)} FROM f")
def _(spark, d):
    return out(r.blur(v.pixels(spark, d), KERNEL), *PIXEL)


@query(
    "raster_unsharp",
    f"WITH {v.PX}, o AS (SELECT *, v AS orig FROM px), h AS ({_pass('o', 'y', 'x', ', orig')}), f AS ({_pass('h', 'x', 'y', ', orig')}) SELECT y::BIGINT AS y, x::BIGINT AS x, least(255, greatest(0, 2 * orig - v))::BIGINT AS v FROM f",
)
def _(spark, d):
    return out(r.unsharp(v.pixels(spark, d), KERNEL), *PIXEL)


TILES = "tiles AS (SELECT y // 4 AS ty, x // 4 AS tx, min(v) AS vmin, max(v) AS vmax FROM px GROUP BY ALL HAVING count(*) = 16)"
WIN = """win AS (SELECT a.ty, a.tx, min(b.vmin) AS vmin, max(b.vmax) AS vmax FROM tiles a JOIN tiles b
  ON b.ty BETWEEN a.ty - 1 AND a.ty + 1 AND b.tx BETWEEN a.tx - 1 AND a.tx + 1 GROUP BY a.ty, a.tx)"""
THRESH = """dim AS (SELECT (max(x) + 1) // 4 AS tw, (max(y) + 1) // 4 AS th FROM px),
thresh AS (SELECT y, x, CASE WHEN x // 4 < tw AND y // 4 < th AND vmax - vmin < 5 THEN 127 WHEN px.v > vmin + (vmax - vmin) // 2 THEN 255 ELSE 0 END AS v
  FROM px, dim JOIN win ON win.ty = least(px.y // 4, th - 1) AND win.tx = least(px.x // 4, tw - 1))"""


@query("tile_minmax", f"WITH {v.PX}, {TILES} SELECT {big('ty', 'tx', 'vmin', 'vmax')} FROM tiles")
def _(spark, d):
    return out(r.tile_minmax(v.pixels(spark, d)), "ty", "tx", "vmin", "vmax")


@query("tile_dilate", f"WITH {v.PX}, {TILES}, {WIN} SELECT {big('ty', 'tx', 'vmin', 'vmax')} FROM win")
def _(spark, d):
    return out(r.tile_dilate(r.tile_minmax(v.pixels(spark, d))), "ty", "tx", "vmin", "vmax")


@query("threshold", f"WITH {v.PX}, {TILES}, {WIN}, {THRESH} SELECT {big(*PIXEL)} FROM thresh")
def _(spark, d):
    return out(r.threshold(v.pixels(spark, d)), *PIXEL)


@query(
    "threshold_bayer",
    f"""WITH {v.PX}, m AS (SELECT *, y // 32 AS ty, x // 32 AS tx, (y % 2) * 2 + x % 2 AS p FROM px),
t AS (SELECT p, ty, tx, min(v) AS lo, max(v) AS hi FROM m GROUP BY ALL),
w AS (SELECT a.p, a.ty, a.tx, min(b.lo) AS lo, max(b.hi) AS hi FROM t a JOIN t b ON a.p = b.p AND abs(a.ty - b.ty) <= 1 AND abs(a.tx - b.tx) <= 1 GROUP BY ALL)
SELECT y::BIGINT AS y, x::BIGINT AS x, (v > lo + (hi - lo) // 2)::BIGINT AS v FROM m JOIN w USING (p, ty, tx)""",
)
def _(spark, d):
    return out(r.threshold_bayer(v.pixels(spark, d)), *PIXEL)


@query(
    "deglitch",
    f"""WITH {v.BIN}, dim AS (SELECT max(x) AS mx, max(y) AS my FROM bin),
hi AS (SELECT a.y, a.x, CASE WHEN a.x BETWEEN 1 AND mx - 1 AND a.y BETWEEN 1 AND my - 1 THEN max(b.v) ELSE 0 END AS v
  FROM bin a JOIN bin b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1, dim GROUP BY a.y, a.x, mx, my),
lo AS (SELECT a.y, a.x, min(b.v) AS v FROM hi a JOIN hi b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY a.y, a.x)
SELECT bin.y::BIGINT AS y, bin.x::BIGINT AS x, (CASE WHEN bin.x BETWEEN 1 AND mx - 1 AND bin.y BETWEEN 1 AND my - 1 THEN lo.v ELSE bin.v END)::BIGINT AS v FROM bin JOIN lo ON bin.y = lo.y AND bin.x = lo.x, dim""",
)
def _(spark, d):
    return out(r.deglitch(v.binary(spark, d)), *PIXEL)


@query(
    "raster_rotate180",
    f"WITH {v.PX}, dim AS (SELECT max(x) AS mx, max(y) AS my FROM px) SELECT (my - y)::BIGINT AS y, (mx - x)::BIGINT AS x, v::BIGINT AS v FROM px, dim",
)
def _(spark, d):
    import math

    return out(r.rotate(v.pixels(spark, d), math.pi), *PIXEL)


@query("draw_disc", f"WITH {v.PX} SELECT y::BIGINT AS y, x::BIGINT AS x, (CASE WHEN (x - 50) * (x - 50) + (y - 5) * (y - 5) BETWEEN 9 AND 36 THEN 200 ELSE v END)::BIGINT AS v FROM px")
def _(spark, d):
    return out(r.draw_disc(v.pixels(spark, d), 50, 5, 3, 6, 200), *PIXEL)


def _det(m: str) -> str:
    a, b, e, f, h, i, j, k, n = m.split()
    return f"({a} * ({h} * {n} - {i} * {k}) - {b} * ({f} * {n} - {i} * {j}) + {e} * ({f} * {k} - {h} * {j}))"


@query(
    "gray_plane_fit",
    f"""WITH {v.PX}, t AS (SELECT y // 10 AS by_, x // 10 AS bx, sum(x*x)::DOUBLE AS sxx, sum(x*y)::DOUBLE AS sxy, sum(x)::DOUBLE AS sx, sum(y*y)::DOUBLE AS syy, sum(y)::DOUBLE AS sy,
  sum(x*v)::DOUBLE AS sxv, sum(y*v)::DOUBLE AS syv, sum(v)::DOUBLE AS sv, count(*)::DOUBLE AS n FROM px GROUP BY ALL),
z AS (SELECT by_, bx, {_det('sxx sxy sx sxy syy sy sx sy n')} AS z, {_det('sxv sxy sx syv syy sy sv sy n')} AS a, {_det('sxx sxv sx sxy syv sy sx sv n')} AS b, {_det('sxx sxy sxv sxy syy syv sx sy sv')} AS c FROM t)
SELECT by_::BIGINT AS ty, bx::BIGINT AS tx, round(CASE WHEN abs(z) > 1e-9 THEN a / z END, 6) + 0.0 AS a, round(CASE WHEN abs(z) > 1e-9 THEN b / z END, 6) + 0.0 AS b, round(CASE WHEN abs(z) > 1e-9 THEN c / z END, 6) + 0.0 AS c FROM z""",
)
def _(spark, d):
    p = v.pixels(spark, d).withColumns({"ty": r.div(F.col("y"), 10), "tx": r.div(F.col("x"), 10)})
    f = r.plane_fit(p, ["ty", "tx"])
    return f.select(F.col("ty").cast("long"), F.col("tx").cast("long"), *((F.round(k, 6) + F.lit(0.0)).alias(k) for k in "abc"))


# ---- components and boundaries ----


def _components(mixed: bool) -> str:
    near = "(b.x = a.x - 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y - 1)" + (" OR (a.v = 255 AND b.y = a.y - 1 AND b.x IN (a.x - 1, a.x + 1))" if mixed else "")
    return f"""WITH RECURSIVE {v.BIN}, dim AS (SELECT max(x) AS mx FROM bin),
e AS (SELECT a.y * 100 + a.x AS p, b.y * 100 + b.x AS q FROM bin a JOIN bin b ON a.v = b.v AND b.y BETWEEN a.y - 1 AND a.y AND b.x BETWEEN a.x - 1 AND a.x + 1 AND ({near}), dim WHERE a.x BETWEEN 1 AND mx - 1),
linked AS (SELECT p, q FROM e UNION ALL SELECT q, p FROM e),
reach(p, q) AS (SELECT y * 100 + x, y * 100 + x FROM bin UNION SELECT reach.p, linked.q FROM reach JOIN linked ON reach.q = linked.p AND linked.q <> reach.p),
comp AS (SELECT p, min(q) AS comp FROM reach GROUP BY p)"""


@query("components4", f"{_components(False)} SELECT (p // 100)::BIGINT AS y, (p % 100)::BIGINT AS x, comp::BIGINT AS comp FROM comp")
def _(spark, d):
    return out(sg.components(v.binary(spark, d), mixed=False), "y", "x", "comp")


@query("component_sizes", f"{_components(False)} SELECT comp::BIGINT AS comp, count(*)::BIGINT AS n FROM comp GROUP BY comp")
def _(spark, d):
    return out(sg.component_sizes(sg.components(v.binary(spark, d), mixed=False)), "comp", "n")


_NEAR8 = "(b.x = a.x - 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y - 1) OR (a.v = 255 AND b.y = a.y - 1 AND b.x IN (a.x - 1, a.x + 1))"
#: Labels that spread to neighbours until none gets a smaller one.
MIXED = f"""WITH RECURSIVE {v.BIN}, dim AS (SELECT max(x) AS mx, max(y) AS my FROM bin),
e AS (SELECT a.y * 100 + a.x AS p, b.y * 100 + b.x AS q FROM bin a JOIN bin b ON a.v = b.v AND b.y BETWEEN a.y - 1 AND a.y AND b.x BETWEEN a.x - 1 AND a.x + 1 AND ({_NEAR8}), dim WHERE a.x BETWEEN 1 AND mx - 1),
linked AS (SELECT p, q FROM e UNION ALL SELECT q, p FROM e),
comp(p, comp) USING KEY (p) AS (SELECT y * 100 + x, y * 100 + x FROM bin UNION
  SELECT linked.q, min(comp.comp) FROM comp JOIN linked ON comp.p = linked.p JOIN recurring.comp AS old ON old.p = linked.q WHERE comp.comp < old.comp GROUP BY linked.q)"""
BOUNDARY = MIXED + """,
big AS (SELECT y, x, v, comp FROM bin JOIN comp ON comp.p = bin.y * 100 + bin.x WHERE comp.comp IN (SELECT comp FROM comp GROUP BY comp HAVING count(*) >= 24)),
met AS (SELECT a.*, b.v AS bv, b.comp AS bcomp, b.x - a.x AS dx, b.y - a.y AS dy FROM big a JOIN big b ON b.y IN (a.y, a.y + 1) AND b.x BETWEEN a.x - 1 AND a.x + 1 AND a.v + b.v = 255, dim
  WHERE a.x BETWEEN 1 AND mx - 1 AND a.y BETWEEN 1 AND my - 1 AND (b.x - a.x, b.y - a.y) IN ((1, 0), (0, 1), (-1, 1), (1, 1))),
pts AS (SELECT greatest(comp, bcomp) AS rep_hi, least(comp, bcomp) AS rep_lo, 2 * x + dx AS x2, 2 * y + dy AS y2, dx * (bv - v) AS gx, dy * (bv - v) AS gy FROM met
  WHERE NOT (dx = -1 AND EXISTS (SELECT 1 FROM met l WHERE l.x = met.x - 1 AND l.y = met.y AND l.dx = 1 AND l.dy = 1)))"""
STATS = BOUNDARY + """, box AS (SELECT rep_hi, rep_lo, count(*) AS n, (min(x2) + max(x2)) * 0.5::DOUBLE + 0.05118::DOUBLE AS cx, (min(y2) + max(y2)) * 0.5::DOUBLE - 0.028581::DOUBLE AS cy,
  sum(x2 * gx) + sum(y2 * gy) AS s, sum(gx) AS sgx, sum(gy) AS sgy FROM pts GROUP BY ALL), stats AS (SELECT rep_hi, rep_lo, n, s - cx * sgx - cy * sgy AS dot FROM box)"""


@query("components_mixed", f"{MIXED} SELECT (p // 100)::BIGINT AS y, (p % 100)::BIGINT AS x, comp::BIGINT AS comp FROM comp")
def _(spark, d):
    return out(sg.components(v.binary(spark, d)), "y", "x", "comp")


@query("boundary_points", f"{BOUNDARY} SELECT {big('rep_hi', 'rep_lo', 'x2', 'y2', 'gx', 'gy')} FROM pts")
def _(spark, d):
    return out(sg.boundary_points(sg.components(v.binary(spark, d))), "rep_hi", "rep_lo", "x2", "y2", "gx", "gy")


def _stats(spark, d):
    return sg.cluster_stats(sg.boundary_points(sg.components(v.binary(spark, d))))


@query("boundary_clusters", f"{STATS} SELECT {big('rep_hi', 'rep_lo', 'n')}, dot < 0 AS reversed FROM stats")
def _(spark, d):
    return _stats(spark, d).select("rep_hi", "rep_lo", "n", (F.col("dot") < 0).alias("reversed"))


@query("cluster_size_filter", f"{STATS} SELECT {big('rep_hi', 'rep_lo', 'n')} FROM stats WHERE n BETWEEN 24 AND 800")
def _(spark, d):
    return out(sg.sized_clusters(_stats(spark, d), 100, 100), "rep_hi", "rep_lo", "n")


@query("cluster_polarity", f"{STATS} SELECT {big('rep_hi', 'rep_lo')}, round(dot, 3) + 0.0 AS dot FROM stats WHERE dot >= 0")
def _(spark, d):
    return sg.outward(_stats(spark, d)).select("rep_hi", "rep_lo", (F.round("dot", 3) + F.lit(0.0)).alias("dot"))


@query(
    "cluster_slope",
    f"""WITH {v.PX}, t AS (SELECT y, x, x - 50 + 0.05118 AS dx, y - 50 - 0.028581 AS dy FROM px),
u AS (SELECT *, CASE WHEN dy > 0 THEN CASE WHEN dx > 0 THEN 65536 ELSE 131072 END ELSE CASE WHEN dx > 0 THEN 0 ELSE -65536 END END AS q, CASE WHEN dy < 0 THEN -dx ELSE dx END AS ex, CASE WHEN dy < 0 THEN -dy ELSE dy END AS ey FROM t)
SELECT y::BIGINT AS y, x::BIGINT AS x, round(q + CASE WHEN ex < 0 THEN -ex / ey ELSE ey / ex END, 6)::DOUBLE AS slope FROM u""",
)
def _(spark, d):
    p = v.pixels(spark, d)
    dx, dy = F.col("x") - 50 + F.lit(0.05118), F.col("y") - 50 - F.lit(0.028581)
    return p.select(F.col("y").cast("long"), F.col("x").cast("long"), F.round(sg.slope(dx, dy), 6).alias("slope"))


# ---- ordered boundaries ----

MOM = v.SEQ + ", mom AS (SELECT k, i, n, sum(w) OVER o AS mw, sum(w*x) OVER o AS mx, sum(w*y) OVER o AS my, sum(w*x*x) OVER o AS mxx, sum(w*x*y) OVER o AS mxy, sum(w*y*y) OVER o AS myy FROM seq WINDOW o AS (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING))"


def _moments(spark, d):
    return ln.running_moments(v.sequence(spark, d), ["k"], v.ORDER)


@query("running_moments", f"WITH {MOM} SELECT k, i, mw, mx, my, mxx, mxy, myy FROM mom")
def _(spark, d):
    return _moments(spark, d).select("k", F.col("i").cast("long").alias("i"), *ln.MOMENTS)


_DIFF = ", ".join(f"b.m{a} - coalesce(a.m{a}, 0) + CASE WHEN r.i1 < r.i0 THEN l.m{a} ELSE 0 END AS m{a}" for a in ("w", "x", "y", "xx", "xy", "yy"))


@query(
    "range_line_fit",
    f"""WITH {MOM}, r AS (SELECT k, i AS i0, (i + 5) % n AS i1, n FROM mom WHERE n > 8),
m AS (SELECT r.k, r.i0, r.i1, {_DIFF} FROM r JOIN mom b ON b.k = r.k AND b.i = r.i1 LEFT JOIN mom a ON a.k = r.k AND a.i = r.i0 - 1 JOIN mom l ON l.k = r.k AND l.i = r.n - 1),
e AS (SELECT *, mx/mw AS ex, my/mw AS ey, mxx/mw - (mx/mw)*(mx/mw) AS cxx, mxy/mw - (mx/mw)*(my/mw) AS cxy, myy/mw - (my/mw)*(my/mw) AS cyy FROM m)
SELECT k, i0::BIGINT AS i0, i1::BIGINT AS i1, round(ex, 6) AS ex, round(ey, 6) AS ey, round(0.5 * (cxx + cyy - sqrt((cxx - cyy) * (cxx - cyy) + 4 * cxy * cxy)), 5) + 0.0 AS mse FROM e""",
)
def _(spark, d):
    m = _moments(spark, d)
    ranges = m.filter("n > 8").select("k", F.col("i").alias("i0"), ((F.col("i") + 5) % F.col("n")).alias("i1"))
    f = ln.range_fit(m, ["k"], ranges)
    return f.select("k", F.col("i0").cast("long").alias("i0"), F.col("i1").cast("long").alias("i1"), F.round("ex", 6).alias("ex"), F.round("ey", 6).alias("ey"), (F.round("mse", 5) + F.lit(0.0)).alias("mse"))


LOW_PASS = [1.0, 2.0, 4.0, 8.0, 4.0, 2.0, 1.0]
_SM = " + ".join(f"{w} * s{k}.q" for k, w in enumerate(LOW_PASS))
_SJ = " ".join(f"JOIN seq s{k} ON s{k}.k = a.k AND s{k}.i = (a.i + {k - 3} + a.n) % a.n" for k in range(7))
SMOOTH = f"{v.SEQ}, sm AS (SELECT a.k, a.i, a.n, {_SM} AS err FROM seq a {_SJ} WHERE a.n > 6)"
MAXIMA = SMOOTH + ", mx AS (SELECT a.k, a.i, a.n, a.err FROM sm a JOIN sm b ON b.k = a.k AND b.i = (a.i + 1) % a.n JOIN sm c ON c.k = a.k AND c.i = (a.i - 1 + a.n) % a.n WHERE a.err > b.err AND a.err > c.err)"
TOP = MAXIMA + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY err DESC, i) AS rn FROM mx), top AS (SELECT a.k, a.i, a.n, a.err FROM ranked a LEFT JOIN ranked b ON a.k = b.k AND b.rn = 11 WHERE b.err IS NULL OR a.err > b.err)"


def _smooth(spark, d):
    m = _moments(spark, d).filter("n > 6").select("k", "i", "n", F.col("q").alias("err"))
    return ln.circular_smooth(m, ["k"], LOW_PASS)


@query("circular_smooth", f"WITH {SMOOTH} SELECT k, i::BIGINT AS i, err FROM sm")
def _(spark, d):
    return _smooth(spark, d).select("k", F.col("i").cast("long").alias("i"), "err")


@query("local_maxima", f"WITH {MAXIMA} SELECT k, i::BIGINT AS i, err FROM mx")
def _(spark, d):
    return ln.local_maxima(_smooth(spark, d), ["k"]).select("k", F.col("i").cast("long").alias("i"), "err")


@query("topk_maxima", f"WITH {TOP} SELECT k, i::BIGINT AS i, err FROM top")
def _(spark, d):
    return ln.top_maxima(ln.local_maxima(_smooth(spark, d), ["k"]), ["k"]).select("k", F.col("i").cast("long").alias("i"), "err")


def _side(a: int, b: int) -> str:
    return f"abs(t{b}.err - t{a}.err) * ((t{b}.i - t{a}.i + t{a}.n) % t{a}.n)"


@query(
    "best_quad",
    f"""WITH {TOP}, four AS (SELECT t0.k, t0.i AS m0, t1.i AS m1, t2.i AS m2, t3.i AS m3, {' + '.join(_side(a, (a + 1) % 4) for a in range(4))} AS cost
  FROM top t0 JOIN top t1 ON t0.k = t1.k AND t1.i > t0.i JOIN top t2 ON t0.k = t2.k AND t2.i > t1.i JOIN top t3 ON t0.k = t3.k AND t3.i > t2.i),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY cost, m0, m1, m2, m3) AS rn FROM four)
SELECT k, cost, {big('m0', 'm1', 'm2', 'm3')} FROM r WHERE rn = 1""",
)
def _(spark, d):
    m = ln.top_maxima(ln.local_maxima(_smooth(spark, d), ["k"]), ["k"])
    cost = lambda a, b: F.abs(F.col(f"e{b}") - F.col(f"e{a}")) * F.pmod(F.col(f"m{b}") - F.col(f"m{a}"), F.col("n"))
    best = ln.best_four(m, ["k", "n"], cost)
    return best.select("k", "cost", *(F.col(f"m{k}").cast("long").alias(f"m{k}") for k in range(4)))


# ---- codes ----


def _rot(code: str, n: int = v.NBITS) -> str:
    p = n // 4
    return f"((({code} >> {n - p}) | ({code} << {p})) & {(1 << n) - 1})"


@query("decode_exact", f"WITH {v.CODES} SELECT a.id AS probe_id, min(b.id) AS id FROM codes a JOIN codes b ON a.code = b.code GROUP BY a.id")
def _(spark, d):
    k = v.codes(spark, d)
    hits = c.decode(k.select(F.col("id").alias("probe_id"), F.col("code").alias("rcode")), k, v.NBITS, 0, turns=False)
    return hits.select("probe_id", "id")


_DIST = "bit_count(xor(p.rcode, c.code))"


@query(
    "decode_hamming",
    f"""WITH {v.PROBES}, m AS (SELECT p.probe_id, p.rcode, c.id, c.code, {_DIST} AS d FROM probes p JOIN codes c ON {_DIST} <= 3),
ch AS (SELECT *, CASE WHEN (rcode & 511) = (code & 511) THEN 0 WHEN ((rcode >> 9) & 511) = ((code >> 9) & 511) THEN 1 WHEN ((rcode >> 18) & 511) = ((code >> 18) & 511) THEN 2 ELSE 3 END AS chunk FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY chunk, id) AS rn FROM ch)
SELECT probe_id, id, d::BIGINT AS hamming FROM r WHERE rn = 1""",
)
def _(spark, d):
    hits = c.decode(v.probes(spark, d), v.codes(spark, d), v.NBITS, 3, turns=False)
    return hits.select("probe_id", "id", F.col("hamming").cast("long").alias("hamming"))


@query(
    "decode_rotations",
    f"""WITH {v.PROBES}, t0 AS (SELECT probe_id, 0 AS rotation, rcode FROM probes), t1 AS (SELECT probe_id, 1 AS rotation, {_rot('rcode')} AS rcode FROM t0),
t2 AS (SELECT probe_id, 2 AS rotation, {_rot('rcode')} AS rcode FROM t1), t3 AS (SELECT probe_id, 3 AS rotation, {_rot('rcode')} AS rcode FROM t2),
p AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)
SELECT probe_id, rotation::BIGINT AS rotation, rcode AS turned FROM p""",
)
def _(spark, d):
    return c.rotations(v.probes(spark, d), v.NBITS).select("probe_id", F.col("rotation").cast("long").alias("rotation"), "turned")


@query("hamming_bruteforce", f"WITH {v.NEAR_CODES} SELECT a.id AS a, b.id AS b, bit_count(xor(a.code, b.code))::BIGINT AS d FROM near_codes a JOIN near_codes b ON a.id < b.id WHERE bit_count(xor(a.code, b.code)) <= 3")
def _(spark, d):
    """All code pairs within 3 errors: the chunk index makes them candidates, so no pair is tried without a shared chunk."""
    k = v.near_codes(spark, d)
    left, right = c.code_chunks(k, v.NBITS), c.code_chunks(k, v.NBITS).withColumnsRenamed({"id": "id2", "code": "code2"})
    dist = c.hamming(F.col("code"), F.col("code2"))
    return left.join(right, ["chunk_no", "chunk_val"]).filter("id < id2").withColumn("d", dist).filter("d <= 3").select(F.col("id").alias("a"), F.col("id2").alias("b"), F.col("d").cast("long").alias("d")).distinct()


@query("family_min_distance", f"WITH {v.CODES} SELECT min(bit_count(xor(a.code, b.code)))::BIGINT AS min_distance FROM codes a JOIN codes b ON a.id < b.id")
def _(spark, d):
    """Least distance of all codes of the table."""
    return out(c.min_distance(v.codes(spark, d), v.NBITS, turns=False), "min_distance")


@query("quad_family_join", "SELECT p_partkey AS quad_id, n_nationkey AS family FROM part JOIN nation ON (p_partkey % 2 = 0) = (n_regionkey % 2 = 0)")
def _(spark, d):
    """Quads with the families of their border; nations, a table that never grows, stand for families."""
    quads = v.table(spark, d, "part").select(F.col("p_partkey").alias("quad_id"), (F.col("p_partkey") % 2 == 0).alias("reversed_border"))
    families = v.table(spark, d, "nation").select(F.col("n_nationkey").alias("family"), (F.col("n_regionkey") % 2 == 0).alias("reversed_border"))
    return quads.join(F.broadcast(families), "reversed_border").select("quad_id", "family")  # 25 rows


# every code of the small families with every 1 to 3 flips within its limit, as rows of a formula


def _flips(nbits: int, limit: int) -> list[int]:
    from itertools import combinations

    return [0, *(sum(1 << b for b in bits) for k in range(1, limit + 1) for bits in combinations(range(nbits), k))]


SMALL = {"tag16h5": 2, "tag25h9": 3, "tagCircle21h7": 3}


def _flip_sql(name: str, limit: int) -> str:
    f = FAMILIES[name]
    masks = f"SELECT 0::BIGINT AS m UNION ALL SELECT m FROM b1{' UNION ALL SELECT m FROM b2' if limit > 1 else ''}{' UNION ALL SELECT m FROM b3' if limit > 2 else ''}"
    return f"""SELECT '{name}' AS family, id, m, bit_count(m)::BIGINT AS hamming FROM (VALUES {', '.join(f'({i}::BIGINT)' for i in range(len(f.codes)))}) c(id),
  (WITH b AS (SELECT i, 1::BIGINT << i::INT AS m FROM range({f.nbits}) r(i)), b1 AS (SELECT m FROM b), b2 AS (SELECT x.m + y.m AS m FROM b x JOIN b y ON x.i < y.i),
  b3 AS (SELECT x.m + y.m + z.m AS m FROM b x JOIN b y ON x.i < y.i JOIN b z ON y.i < z.i) {masks})"""


@query("decode_all_flips", " UNION ALL ".join(f"SELECT family, id, hamming, count(*) AS n FROM ({_flip_sql(k, n)}) GROUP BY ALL" for k, n in SMALL.items()))
def _(spark, d):
    """Every code of the small families, with every set of flips that its distance corrects, decodes to itself: counts
    by family, code and errors of the probes that did."""
    found = None
    for name, limit in SMALL.items():
        f = FAMILIES[name]
        codes_ = spark.createDataFrame(list(enumerate(f.codes)), "id long, code long")
        masks = spark.createDataFrame([(m,) for m in _flips(f.nbits, limit)], "m long").repartition(spark.sparkContext.defaultParallelism)
        probes = masks.join(F.broadcast(codes_.withColumnRenamed("id", "want"))).select("want", "m", F.col("code").bitwiseXOR(F.col("m")).alias("rcode"))  # a family's codes
        hits = c.decode(probes, codes_, f.nbits, limit, turns=False).filter("id = want AND hamming = bit_count(m)")
        one = hits.groupBy("id", F.col("hamming").cast("long").alias("hamming")).agg(F.count("*").alias("n")).select(F.lit(name).alias("family"), "id", "hamming", "n")
        found = one if found is None else found.unionByName(one)
    return found


# ---- geometry ----


def _square(t: str, side: int = 5):
    x, y = F.col(f"{t}.x0").cast("double"), F.col(f"{t}.y0").cast("double")
    return F.array(g.point(x, y), g.point(x + side, y), g.point(x + side, y + side), g.point(x, y + side))


_OVER = "abs(a.x0 - b.x0) <= 5 AND abs(a.y0 - b.y0) <= 5"


@query("box_overlap", f"WITH {v.BOXES} SELECT a.box_id AS a, b.box_id AS b FROM boxes a JOIN boxes b ON a.fam = b.fam AND a.box_id < b.box_id WHERE {_OVER} AND NOT (abs(a.x0 - b.x0) = 5 AND a.y0 = b.y0) AND NOT (abs(a.y0 - b.y0) = 5 AND a.x0 = b.x0) AND NOT (a.x0 = b.x0 AND a.y0 = b.y0 AND false)")
def _(spark, d):
    grid = ("x0", "y0", 6.0)  # boxes of side 5 that touch are in neighbouring cells
    a, b = c.cells(v.boxes(spark, d), *grid).alias("a"), c.cells(v.boxes(spark, d), *grid, around=True).alias("b")
    near = (F.col("a.fam") == F.col("b.fam")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.box_id") < F.col("b.box_id"))
    apart = ~((F.abs(F.col("a.x0") - F.col("b.x0")) == 5) & (F.col("a.y0") == F.col("b.y0"))) & ~((F.abs(F.col("a.y0") - F.col("b.y0")) == 5) & (F.col("a.x0") == F.col("b.x0")))
    boxed = (F.abs(F.col("a.x0") - F.col("b.x0")) <= 5) & (F.abs(F.col("a.y0") - F.col("b.y0")) <= 5)
    hit = F.when(boxed & apart, g.polygons_overlap(_square("a"), _square("b")))  # cheap tests first
    return a.join(b, near).filter(hit).select(F.col("a.box_id").alias("a"), F.col("b.box_id").alias("b"))


@query(
    "reconcile_dominance",
    f"""WITH {v.BOXES} SELECT a.box_id FROM boxes a WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE a.fam = b.fam AND abs(a.x0 - b.x0) < 5 AND abs(a.y0 - b.y0) < 5
  AND (b.hamming < a.hamming OR (b.hamming = a.hamming AND (b.margin > a.margin OR (b.margin = a.margin AND b.box_id < a.box_id)))))""",
)
def _(spark, d):
    over = (F.abs(F.col("a.x0") - F.col("b.x0")) < 5) & (F.abs(F.col("a.y0") - F.col("b.y0")) < 5)
    return c.dominated(v.boxes(spark, d), ["fam"], over, ("x0", "y0", 6.0), ["x0", "y0"]).select("box_id")


@query(
    "segment_intersect",
    """WITH t AS (SELECT p_partkey AS id, (p_partkey % 17)::DOUBLE AS ax, (p_partkey % 13)::DOUBLE AS ay, (p_partkey * 3 % 19)::DOUBLE AS bx, (p_partkey * 5 % 11)::DOUBLE AS by_,
  (p_partkey * 7 % 23)::DOUBLE AS cx, (p_partkey * 11 % 7)::DOUBLE AS cy, (p_partkey * 13 % 5)::DOUBLE AS dx, (p_partkey * 17 % 29)::DOUBLE AS dy FROM part),
u AS (SELECT *, (bx - ax) * (dy - cy) - (by_ - ay) * (dx - cx) AS det FROM t)
SELECT id, coalesce(abs(det) >= 1e-8 AND ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / nullif(det, 0) BETWEEN 0 AND 1 AND ((cx - ax) * (by_ - ay) - (cy - ay) * (bx - ax)) / nullif(det, 0) BETWEEN 0 AND 1, false) AS meets FROM u""",
)
def _(spark, d):
    k = F.col("p_partkey")
    pts = [g.point((k * a % m), (k * b % n)) for a, m, b, n in ((1, 17, 1, 13), (3, 19, 5, 11), (7, 23, 11, 7), (13, 5, 17, 29))]
    t = v.table(spark, d, "part").select(k.alias("id"), *(p.alias(n) for p, n in zip(pts, "abcd")))
    det = (F.col("b.x") - F.col("a.x")) * (F.col("d.y") - F.col("c.y")) - (F.col("b.y") - F.col("a.y")) * (F.col("d.x") - F.col("c.x"))
    return t.select("id", F.when(det == 0, False).otherwise(g.segments_meet(*(F.col(n) for n in "abcd"))).alias("meets"))


@query(
    "point_in_polygon",
    "WITH t AS (SELECT p_partkey AS id, (p_partkey % 90)::DOUBLE / 10 + 0.05 AS x, (p_partkey * 7 % 90)::DOUBLE / 10 + 0.05 AS y FROM part) SELECT id, x + y < 8 AS inside FROM t",
)
def _(spark, d):
    tri = F.array(g.point(0, 0), g.point(8, 0), g.point(0, 8))
    k = F.col("p_partkey")
    t = v.table(spark, d, "part").select(k.alias("id"), g.point((k % 90).cast("double") / 10 + 0.05, (k * 7 % 90).cast("double") / 10 + 0.05).alias("q"))
    return t.select("id", g.contains_point(tri, F.col("q")).alias("inside"))


_SHOE = " + ".join(f"(x{k} * y{(k + 1) % 4} - x{(k + 1) % 4} * y{k})" for k in range(4))


@query("polygon_area", f"WITH {v.QUADS} SELECT quad_id, ({_SHOE}) / 2 AS area, CASE WHEN {_SHOE} < 0 THEN x3 ELSE x0 END AS first_x, (x0 + x1 + x2) / 3 AS inner_x FROM quads")
def _(spark, d):
    q = F.col("q")
    return v.quads(spark, d).select("quad_id", (g.area2(q) / 2).alias("area"), F.get(g.make_ccw(q), F.lit(0))["x"].alias("first_x"), g.interior_point(q)["x"].alias("inner_x"))


def _dist(a: int, b: int) -> str:
    return f"sqrt((x{b} - x{a}) * (x{b} - x{a}) + (y{b} - y{a}) * (y{b} - y{a}))"


def _tri(a: int, b: int, c_: int) -> str:
    u, w, z = _dist(a, b), _dist(b, c_), _dist(c_, a)
    h = f"(({u} + {w} + {z}) / 2)"
    return f"sqrt(greatest(0.0, {h} * ({h} - {u}) * ({h} - {w}) * ({h} - {z})))"


@query("quad_area_filter", f"WITH {v.QUADS}, a AS (SELECT quad_id, {_tri(0, 1, 2)} + {_tri(2, 3, 0)} AS area FROM quads) SELECT quad_id, round(area, 6) AS area FROM a WHERE area >= 0.95 * 10 * 10")
def _(spark, d):
    area = g.heron_area(F.col("q"))
    return v.quads(spark, d).select("quad_id", area.alias("area")).filter(F.col("area") >= 0.95 * 10 * 10).select("quad_id", F.round("area", 6).alias("area"))


COS10 = 0.984807753012208


def _corner(k: int) -> str:
    i, j, m = k, (k + 1) % 4, (k + 2) % 4
    ux, uy, wx, wy = f"(x{j} - x{i})", f"(y{j} - y{i})", f"(x{m} - x{j})", f"(y{m} - y{j})"
    size = f"nullif(sqrt(({ux} * {ux} + {uy} * {uy}) * ({wx} * {wx} + {wy} * {wy})), 0)"
    return f"coalesce(abs(({ux} * {wx} + {uy} * {wy}) / {size}) <= {COS10}::DOUBLE AND {ux} * {wy} >= {uy} * {wx}, false)"


@query("quad_convexity", f"WITH {v.QUADS} SELECT quad_id FROM quads WHERE {' AND '.join(map(_corner, range(4)))}")
def _(spark, d):
    return v.quads(spark, d).filter(g.turns_convex(F.col("q"), COS10)).select("quad_id")


H = (1.2, 0.1, 3.0, -0.2, 0.9, 1.0, 0.001, 0.002, 1.0)


@query(
    "project_points",
    f"WITH {v.PX} SELECT y::BIGINT AS y, x::BIGINT AS x, round(({H[0]}::DOUBLE * x + {H[1]}::DOUBLE * y + {H[2]}::DOUBLE) / ({H[6]}::DOUBLE * x + {H[7]}::DOUBLE * y + {H[8]}::DOUBLE), 6) + 0.0 AS px, round(({H[3]}::DOUBLE * x + {H[4]}::DOUBLE * y + {H[5]}::DOUBLE) / ({H[6]}::DOUBLE * x + {H[7]}::DOUBLE * y + {H[8]}::DOUBLE), 6) + 0.0 AS py FROM px",
)
def _(spark, d):
    q = g.project(F.array(*map(F.lit, H)), F.col("x").cast("double"), F.col("y").cast("double"))
    return v.pixels(spark, d).select(F.col("y").cast("long"), F.col("x").cast("long"), (F.round(q["x"], 6) + F.lit(0.0)).alias("px"), (F.round(q["y"], 6) + F.lit(0.0)).alias("py"))


# ---- histograms, times, scalars ----


@query(
    "hamming_histogram",
    "SELECT p_brand AS image_id, " + ", ".join(f"count(*) FILTER (p_size % 10 = {k}) AS h{k}" for k in range(10)) + ", count(*) AS total FROM part GROUP BY ROLLUP (p_brand)",
)
def _(spark, d):
    t = v.table(spark, d, "part").select(F.col("p_brand").alias("image_id"), (F.col("p_size") % 10).alias("hamming"))
    return c.hamming_histogram(t)


@query(
    "timeprofile_parts",
    """SELECT event_id, epoch_us(ts) - coalesce(lag(epoch_us(ts)) OVER w, epoch_us(ts)) AS part, epoch_us(ts) - first_value(epoch_us(ts)) OVER w AS total
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def _(spark, d):
    from pyspark.sql.window import Window as W

    w, t = W.partitionBy("user_id").orderBy("ts", "event_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    return v.table(spark, d, "events").select("event_id", (t - F.coalesce(F.lag(t).over(w), t)).alias("part"), (t - F.first(t).over(w)).alias("total"))


@query("utime_parts", "SELECT event_id, epoch_us(ts) // 1000000 AS seconds, epoch_us(ts) % 1000000 AS useconds FROM events")
def _(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return v.table(spark, d, "events").select("event_id", F.floor(t / 1_000_000).alias("seconds"), (t % 1_000_000).alias("useconds"))


@query(
    "matmul",
    "SELECT vec_id, i, j, round(list_sum([embedding[i * 8 + k]::DOUBLE * embedding[j * 8 + k]::DOUBLE FOR k IN range(1, 9)]), 6) + 0.0 AS v FROM embeddings, range(8) r(i), range(8) s(j)",
)
def _(spark, d):
    """Each vector as an 8 x 8 matrix, times its transpose."""
    m = mx.matrix(8, 8, F.col("embedding"))
    e = v.table(spark, d, "embeddings").select("vec_id", m.alias("m")).select("vec_id", mx.multiply(F.col("m"), mx.transpose(F.col("m"))).alias("p"))
    cells = e.select("vec_id", F.posexplode("p.data").alias("at", "v"))
    return cells.select("vec_id", F.floor(F.col("at") / 8).alias("i"), (F.col("at") % 8).cast("long").alias("j"), (F.round("v", 6) + F.lit(0.0)).alias("v"))


def _e(k: int) -> str:
    return f"embedding[{k + 1}]::DOUBLE"


def _row(spark, d, sql: dict[str, tuple[str, object]]) -> DataFrame:
    """vec_id, and each column of a table of (SQL, Spark) pairs, rounded."""
    e = v.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    if sql is MATRIX:
        m = mx.matrix(2, 2, F.slice("e", 1, 4))
        e = e.withColumn("spd", mx.add(mx.multiply(m, mx.transpose(m)), mx.identity(2)))
        e = e.withColumns({"upper_factor": mx.chol(F.col("spd")), "spd_factors": mx.plu(F.col("spd")), "factors": mx.plu(m)})
    return e.select("vec_id", *((F.round(f(lambda k: F.get("e", F.lit(k))), 5) + F.lit(0.0)).alias(n) for n, (_, f) in sql.items()))


def _row_sql(sql: dict[str, tuple[str, object]]) -> str:
    return f"WITH t AS (SELECT vec_id, {', '.join(f'{_e(k)} AS e{k}' for k in range(20))} FROM embeddings) SELECT vec_id, {', '.join(f'round({q}, 5) + 0.0 AS {n}' for n, (q, _) in sql.items())} FROM t"


_two = lambda e, k: mx.matrix(2, 2, F.array(*(e(k + j) for j in range(4))))
_col = lambda e, k, n: mx.matrix(n, 1, F.array(*(e(k + j) for j in range(n))))
_spd = lambda e: F.col("spd")
_S11, _S12, _S22 = "(e0*e0 + e1*e1 + 1)", "(e0*e2 + e1*e3)", "(e2*e2 + e3*e3 + 1)"
_DET = "(e0*e3 - e1*e2)"
_low = lambda e: mx.matrix(2, 2, F.array(e(0) + 9, e(1), e(2), e(3) + 9))
MATRIX: dict[str, tuple[str, object]] = {
    "added": ("e0 + e4", lambda e: mx.get(mx.add(_two(e, 0), _two(e, 4)), 0, 0)),
    "taken": ("e1 - e5", lambda e: mx.get(mx.subtract(_two(e, 0), _two(e, 4)), 0, 1)),
    "scaled": ("e2 * 2.5", lambda e: mx.get(mx.scale(_two(e, 0), 2.5), 1, 0)),
    "turned": ("e1", lambda e: mx.get(mx.transpose(_two(e, 0)), 1, 0)),
    "product": ("e2*e5 + e3*e7", lambda e: mx.get(mx.multiply(_two(e, 0), _two(e, 4)), 1, 1)),
    "chosen": ("e3", lambda e: mx.get_scalar(mx.select(_two(e, 0), 1, 1, 1, 1))),
    "put": ("e0 + e4", lambda e: mx.get(mx.put(_two(e, 0), 0, 1, e(0) + e(4)), 0, 1)),
    "replaced": ("e6", lambda e: mx.get(mx.set_data(_two(e, 0), F.array(*(e(4 + j) for j in range(4)))), 1, 0)),
    "shapes": ("1::DOUBLE", lambda e: F.when(mx.is_vector(_col(e, 0, 3)) & mx.is_vector_len(_col(e, 0, 3), 3) & ~mx.is_vector(_two(e, 0)) & mx.is_scalar(mx.scalar(2.0)) & ~mx.is_scalar(_two(e, 0)), 1.0)),
    "det": (_DET, lambda e: mx.det(_two(e, 0))),
    "inverse": (f"CASE WHEN abs({_DET}) > 1e-3 THEN e3 / {_DET} END", lambda e: F.when(F.abs(e(0) * e(3) - e(1) * e(2)) > 1e-3, mx.get(mx.inverse(_two(e, 0)), 0, 0))),
    "solved": (f"({_S22} * e8 - {_S12} * e9) / ({_S11} * {_S22} - {_S12} * {_S12})", lambda e: mx.get(mx.solve(_spd(e), _col(e, 8, 2)), 0, 0)),
    "chol": (f"{_S12} / sqrt({_S11})", lambda e: mx.get(F.col("upper_factor"), 0, 1)),
    "chol_solved": (f"({_S11} * e9 - {_S12} * e8) / ({_S11} * {_S22} - {_S12} * {_S12})", lambda e: mx.get(mx.chol_solve(F.col("upper_factor"), _col(e, 8, 2)), 1, 0)),
    "chol_inverse": (f"-{_S12} / ({_S11} * {_S22} - {_S12} * {_S12})", lambda e: mx.get(mx.chol_inverse(F.col("upper_factor")), 0, 1)),
    "plu_det": (_DET, lambda e: mx.plu_det(F.col("factors"))),
    "plu_solved": (f"({_S22} * e8 - {_S12} * e9) / ({_S11} * {_S22} - {_S12} * {_S12})", lambda e: mx.get(mx.plu_solve(F.col("spd_factors"), _col(e, 8, 2)), 0, 0)),
    "lower": ("(e9 - e2 * e8 / (e0 + 9)) / (e3 + 9)", lambda e: mx.get(mx.solve_lower(_low(e), _col(e, 8, 2)), 1, 0)),
    "lower_turned": ("(e8 - e2 * e9 / (e3 + 9)) / (e0 + 9)", lambda e: mx.get(mx.solve_lower_transposed(_low(e), _col(e, 8, 2)), 0, 0)),
    "upper": ("(e8 - e1 * e9 / (e3 + 9)) / (e0 + 9)", lambda e: mx.get(mx.solve_upper(_low(e), _col(e, 8, 2)), 0, 0)),
    "dot": ("e0*e3 + e1*e4 + e2*e5", lambda e: mx.dot(_col(e, 0, 3), _col(e, 3, 3))),
    "length": ("sqrt(e0*e0 + e1*e1 + e2*e2)", lambda e: mx.magnitude(_col(e, 0, 3))),
    "apart": ("sqrt((e0-e3)*(e0-e3) + (e1-e4)*(e1-e4) + (e2-e5)*(e2-e5))", lambda e: mx.distance(_col(e, 0, 3), _col(e, 3, 3))),
    "unit": ("e1 / sqrt(e0*e0 + e1*e1 + e2*e2)", lambda e: mx.get(mx.normalize(_col(e, 0, 3)), 1, 0)),
    "apart_n": ("sqrt((e0-e3)*(e0-e3) + (e1-e4)*(e1-e4))", lambda e: mx.distance_n(_col(e, 0, 3), _col(e, 3, 3), 2)),
    "crossed": ("e2*e3 - e0*e5", lambda e: mx.get(mx.cross(_col(e, 0, 3), _col(e, 3, 3)), 1, 0)),
    "largest": ("greatest(e0, e1, e2, e3)", lambda e: mx.largest(_two(e, 0))),
    "largest_at": ("CASE WHEN abs(e1) >= abs(e2) THEN 1 ELSE 2 END::DOUBLE", lambda e: mx.largest_at(mx.matrix(1, 3, F.array(e(0), e(1), e(2))), 0, 3).cast("double")),
    "err_inf": ("greatest(abs(e0-e4), abs(e1-e5), abs(e2-e6), abs(e3-e7))", lambda e: mx.err_inf(_two(e, 0), _two(e, 4))),
    "singular": ("0.5 * (sqrt((e0+e3)*(e0+e3) + (e2-e1)*(e2-e1)) + sqrt((e0-e3)*(e0-e3) + (e1+e2)*(e1+e2)))", lambda e: F.get(mx.svd(_two(e, 0))["s"], F.lit(0))),
    "expression": ("e0*e4 + e2*e6 - 2 * e0", lambda e: mx.get(mx.evaluate("M'*M-2*M", _two(e, 0), _two(e, 4), _two(e, 0)), 0, 0)),
}


@query("matrix_ops", _row_sql(MATRIX))
def _(spark, d):
    """Each matrix function over the first numbers of every vector."""
    return _row(spark, d, MATRIX)


_v = lambda e, k, n=3: F.array(*(e(k + j) for j in range(n)))
_at = lambda a, k: F.get(a, F.lit(k))
_pd = lambda e: F.array(e(0) * e(0) + 2, e(0) * e(1), F.lit(0.0), e(0) * e(1), e(1) * e(1) + 2, F.lit(0.5), F.lit(0.0), F.lit(0.5), F.lit(3.0))
_P11, _P12, _P22 = "(e0*e0 + 2)", "(e0*e1)", "(e1*e1 + 2)"
_AX = "sqrt(e3*e3 + e4*e4 + e5*e5)"
_MAT = "cos(e2) * cos(e1)", "cos(e2) * sin(e1) * sin(e0) - sin(e2) * cos(e0)", "cos(e2) * sin(e1) * cos(e0) + sin(e2) * sin(e0)"
_pose = lambda e: rg.xyzrpy_to_mat44(F.array(e(6), e(7), e(8), e(0), e(1), e(2)))
RIGID: dict[str, tuple[str, object]] = {
    "added": ("e1 + e4", lambda e: _at(rg.added(_v(e, 0), _v(e, 3)), 1)),
    "taken": ("e2 - e5", lambda e: _at(rg.subtracted(_v(e, 0), _v(e, 3)), 2)),
    "scaled": ("e0 * 3", lambda e: _at(rg.scaled(_v(e, 0), 3.0), 0)),
    "dot": ("e0*e3 + e1*e4 + e2*e5", lambda e: rg.dot(_v(e, 0), _v(e, 3))),
    "apart": ("sqrt((e0-e3)*(e0-e3) + (e1-e4)*(e1-e4) + (e2-e5)*(e2-e5))", lambda e: rg.distance(_v(e, 0), _v(e, 3))),
    "apart2": ("(e0-e3)*(e0-e3) + (e1-e4)*(e1-e4) + (e2-e5)*(e2-e5)", lambda e: rg.squared_distance(_v(e, 0), _v(e, 3))),
    "unit": (f"e4 / {_AX}", lambda e: _at(rg.normalized(_v(e, 3)), 1)),
    "crossed": ("e0*e4 - e1*e3", lambda e: _at(rg.cross(_v(e, 0), _v(e, 3)), 2)),
    "cross_matrix": ("e2*e3 - e0*e5", lambda e: _at(rg.mat_product(rg.cross_matrix(_v(e, 0)), _v(e, 3), 3, 3, 1), 1)),
    "ab": ("e0*e7 + e1*e9", lambda e: _at(rg.mat_product(_v(e, 0, 4), _v(e, 6, 4), 2, 2, 2), 1)),
    "abt": ("e0*e8 + e1*e9", lambda e: _at(rg.mat_product(_v(e, 0, 4), _v(e, 6, 4), 2, 2, 2, turn_b=True), 1)),
    "atb": ("e0*e7 + e2*e9", lambda e: _at(rg.mat_product(_v(e, 0, 4), _v(e, 6, 4), 2, 2, 2, turn_a=True), 1)),
    "quat_product": ("e0*e7 + e1*e6 + e2*e9 - e3*e8", lambda e: _at(rg.quat_multiply(_v(e, 0, 4), _v(e, 6, 4)), 1)),
    "quat_inverse": ("-e2 / (e0*e0 + e1*e1 + e2*e2 + e3*e3)", lambda e: _at(rg.quat_inverse(_v(e, 0, 4)), 2)),
    "axis_turn": (f"cos(e0) + (e3/{_AX}) * (e3/{_AX}) * (1 - cos(e0))", lambda e: _at(rg.angleaxis_to_mat44(e(0), _v(e, 3)), 0)),
    "axis_turn2": (f"(e3/{_AX}) * (e4/{_AX}) * (1 - cos(e0)) - (e5/{_AX}) * sin(e0)", lambda e: _at(rg.angleaxis_to_mat44(e(0), _v(e, 3)), 1)),
    "rpy": (_MAT[1], lambda e: _at(rg.rpy_to_mat44(e(0), e(1), e(2)), 1)),
    "rpy2": (_MAT[2], lambda e: _at(rg.rpy_to_mat44(e(0), e(1), e(2)), 2)),
    "rpy_back": ("e0", lambda e: _at(rg.quat_to_rpy(rg.rpy_to_quat(e(0), e(1), e(2))), 0)),
    "turned": ("-sin(e1) * e3 + cos(e1) * sin(e0) * e4 + cos(e1) * cos(e0) * e5", lambda e: _at(rg.quat_rotate(rg.rpy_to_quat(e(0), e(1), e(2)), _v(e, 3)), 2)),
    "quat_back": (f"{_MAT[0]}", lambda e: _at(rg.quat_to_mat44(rg.mat44_to_quat(_pose(e))), 0)),
    "moved": (f"{_MAT[0]} * e3 + ({_MAT[1]}) * e4 + ({_MAT[2]}) * e5 + e6", lambda e: _at(rg.mat44_transform(_pose(e), _v(e, 3)), 0)),
    "led": (f"{_MAT[0]} * e3 + ({_MAT[1]}) * e4 + ({_MAT[2]}) * e5", lambda e: _at(rg.mat44_rotate(_pose(e), _v(e, 3)), 0)),
    "moved_back": ("e4", lambda e: _at(rg.mat44_inverse_transform(_pose(e), rg.mat44_transform(_pose(e), _v(e, 3))), 1)),
    "led_back": ("e5", lambda e: _at(rg.mat44_inverse_rotate(_pose(e), rg.mat44_rotate(_pose(e), _v(e, 3))), 2)),
    "place": ("e7", lambda e: _at(rg.mat44_to_xyz(_pose(e)), 1)),
    "heading": ("atan2(sin(e2) * cos(e1), cos(e2) * cos(e1))", lambda e: _at(rg.quat_xyz_to_xyt(rg.rpy_to_quat(e(0), e(1), e(2)), _v(e, 6)), 2)),
    "chain": ("e0 * cos(e3) * 2 + e0 * 0.5", lambda e: _at(rg.mat44_transform(rg.mat44_multiply(rg.mat44_multiply(rg.identity44(), rg.scaling(e(0), 1, 1)), rg.rotation(e(3), "z")), rg.vec(2, 0, 0)), 0) + e(0) * 0.5),
    "about_x": ("cos(e3) * e1 - sin(e3) * e2", lambda e: _at(rg.mat44_transform(rg.rotation(e(3), "x"), _v(e, 0)), 1)),
    "about_y": ("-sin(e3) * e0 + cos(e3) * e2", lambda e: _at(rg.mat44_transform(rg.rotation(e(3), "y"), _v(e, 0)), 2)),
    "shifted": ("e0 + e3", lambda e: _at(rg.mat44_transform(rg.translation(e(3), e(4), e(5)), _v(e, 0)), 0)),
    "xyt": ("cos(e2)*e3 - sin(e2)*e4 + e0", lambda e: _at(rg.xyt_multiply(_v(e, 0), _v(e, 3)), 0)),
    "xyt_seen": ("-sin(e2)*(e3-e0) + cos(e2)*(e4-e1)", lambda e: _at(rg.xyt_inverse_multiply(_v(e, 0), _v(e, 3)), 1)),
    "xyt_inverse": ("sin(e2)*e0 - cos(e2)*e1", lambda e: _at(rg.xyt_inverse(_v(e, 0)), 1)),
    "xyt_point": ("sin(e2)*e3 + cos(e2)*e4 + e1", lambda e: _at(rg.xyt_transform(_v(e, 0), _v(e, 3, 2)), 1)),
    "cov_angle": ("6::DOUBLE", lambda e: _at(rg.xytcov_multiply(_v(e, 0), _pd(e), _v(e, 3), _pd(e))["cov"], 8)),
    "cov_first": (f"{_P11} + 3 * pow(sin(e2)*e3 + cos(e2)*e4, 2) + pow(cos(e2), 2) * {_P11} - 2 * cos(e2) * sin(e2) * {_P12} + pow(sin(e2), 2) * {_P22}", lambda e: _at(rg.xytcov_multiply(_v(e, 0), _pd(e), _v(e, 3), _pd(e))["cov"], 0)),
    "cov_inverse": (f"pow(cos(e2), 2) * {_P11} + 2 * cos(e2) * sin(e2) * {_P12} + pow(sin(e2), 2) * {_P22} - sin(e2) * (sin(e2)*e0 - cos(e2)*e1) + 3 * pow(sin(e2)*e0 - cos(e2)*e1, 2)", lambda e: _at(rg.xytcov_inverse(_v(e, 0), _pd(e))["cov"], 0)),
    "factor": (f"sqrt({_P22} - {_P12} * {_P12} / {_P11})", lambda e: _at(rg.chol33(_pd(e)), 4)),
    "factor_inverse": (f"1 / sqrt({_P22} - {_P12} * {_P12} / {_P11})", lambda e: _at(rg.lower_inverse33(rg.chol33(_pd(e))), 4)),
    "sym_solved": ("e5", lambda e: _at(rg.solve_symmetric33(_pd(e), rg.mat_product(_pd(e), _v(e, 3), 3, 3, 1)), 2)),
    "looked": ("-sqrt(pow(e3-e0, 2) + pow(e4-e1, 2) + pow(e5-e2, 2))", lambda e: _at(rg.mat44_inverse_transform(rg.look_at(_v(e, 0), _v(e, 3), rg.vec(0, 0, 1)), _v(e, 3)), 2)),
}


@query("rigid_ops", _row_sql(RIGID))
def _(spark, d):
    """Each function of rotations and rigid motions over the first numbers of every vector."""
    return _row(spark, d, RIGID)


@query(
    "svd22",
    "WITH t AS (SELECT p_partkey AS id, (p_partkey % 7)::DOUBLE AS a, (p_partkey % 5)::DOUBLE AS b, (p_partkey % 3)::DOUBLE AS c, (p_partkey % 11)::DOUBLE AS d FROM part), u AS (SELECT id, sqrt((a + d) * (a + d) + (c - b) * (c - b)) AS p, sqrt((a - d) * (a - d) + (b + c) * (b + c)) AS q FROM t) SELECT id, round(0.5 * (p + q), 6) AS s1, round(0.5 * abs(p - q), 6) AS s2 FROM u",
)
def _(spark, d):
    k = F.col("p_partkey")
    hi, lo = s.singular_values(*((k % m).cast("double") for m in (7, 5, 3, 11)))
    return v.table(spark, d, "part").select(k.alias("id"), F.round(hi, 6).alias("s1"), F.round(lo, 6).alias("s2"))


@query(
    "mod_angles",
    "WITH t AS (SELECT p_partkey AS id, (p_partkey % 1000 - 500)::DOUBLE / 7 AS a FROM part) SELECT id, round(a - 2*pi() * floor(a / (2*pi())), 6) AS m1, round(a + pi() - 2*pi() * floor((a + pi()) / (2*pi())) - pi(), 6) + 0.0 AS m2, round(a - 360 * floor(a / 360), 6) AS m3, round(a + 180 - 360 * floor((a + 180) / 360) - 180, 6) + 0.0 AS m4 FROM t",
)
def _(spark, d):
    a = (F.col("p_partkey") % 1000 - 500).cast("double") / 7
    return v.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(s.mod2pi_positive(a), 6).alias("m1"), (F.round(s.mod2pi(a), 6) + F.lit(0.0)).alias("m2"), F.round(s.mod360_positive(a), 6).alias("m3"), (F.round(s.mod360(a), 6) + F.lit(0.0)).alias("m4"))


@query(
    "clamp_math",
    "SELECT p_partkey AS id, greatest(10, least(p_size, 30))::BIGINT AS clamped, (CASE WHEN p_size >= 25 THEN 1.0 ELSE -1.0 END)::DOUBLE AS sign, (CASE WHEN p_size < 25 THEN -1 WHEN p_size > 25 THEN 1 ELSE 0 END)::BIGINT AS cmp, (2.0::DOUBLE + 3 * p_size + 0.5::DOUBLE * p_size * p_size) AS poly FROM part",
)
def _(spark, d):
    p = F.col("p_size")
    return v.table(spark, d, "part").select(F.col("p_partkey").alias("id"), s.clamp(p, 10, 30).cast("long").alias("clamped"), s.sgn(p - 25).alias("sign"), s.compare(p, F.lit(25)).cast("long").alias("cmp"), s.polyval(F.array(F.lit(2.0), F.lit(3.0), F.lit(0.5)), p.cast("double")).alias("poly"))


@query(
    "string_fns",
    r"""SELECT page_id, (instr(url, '/') - 1)::BIGINT AS first_at, (CASE WHEN instr(reverse(url), '/') = 0 THEN -1 ELSE length(url) - instr(reverse(url), '/') END)::BIGINT AS last_at,
starts_with(url, 'https') OR starts_with(url, 'ftp') AS secure, replace(replace(url, 'http', 'H'), '/', '|') AS replaced, lower(substring(url, 5, 6)) AS part, contains(url, '?') AS has_query FROM pages""",
)
def _(spark, d):
    u = F.col("url")
    return v.table(spark, d, "pages").select(
        "page_id", s.index_of(u, "/").cast("long").alias("first_at"), s.last_index_of(u, "/").cast("long").alias("last_at"), s.starts_with_any(u, ["https", "ftp"]).alias("secure"),
        s.replace_many(u, ("http", "H"), ("/", "|")).alias("replaced"), F.lower(F.substring(u, 5, 6)).alias("part"), F.contains(u, F.lit("?")).alias("has_query"),
    )


@query(
    "string_more",
    f"""SELECT page_id, upper(url) AS up, ends_with(url, 'l') AS ends, url = upper(url) AS same, lower(url) = lower(upper(url)) AS alike, replace(url, '/', 'x-') AS expanded,
length(url) > 5 AS has_next, substring(url, 6, 3) AS peeked, starts_with(substring(url, 6), '//') AS starts, CASE WHEN starts_with(url, 'https') THEN substring(url, 6, 1) END AS required,
1::BIGINT + length(regexp_replace(substring(html, 1, 40), '[^\\n]', '', 'g')) AS line, trim(concat('  ', url, ' ')) AS trimmed, url[1] BETWEEN 'a' AND 'z' AS variable, url IN ('a', 'b') AS known FROM pages""",
)
def _(spark, d):
    u, f = F.col("url"), s.feeder(F.col("url"))
    at5 = s.feeder_advance(f, 5)
    return v.table(spark, d, "pages").select(
        "page_id", s.upper_ascii(u).alias("up"), F.endswith(u, F.lit("l")).alias("ends"), (u == s.upper_ascii(u)).alias("same"), s.equal_ignoring_case(u, s.upper_ascii(u)).alias("alike"),
        s.expand_variables(F.replace(u, F.lit("/"), F.lit("$A-")), {"A": "x"}).alias("expanded"), s.feeder_has_next(at5).alias("has_next"), s.feeder_peek(at5, 3).alias("peeked"),
        s.feeder_starts_with(at5, "//").alias("starts"), s.feeder_peek(s.feeder_require(f, "https")).alias("required"), s.feeder_line(s.feeder_advance(s.feeder(F.col("html")), 40)).cast("long").alias("line"),
        s.strip(F.concat(F.lit("  "), u, F.lit(" "))).alias("trimmed"), s.is_variable_character(F.substring(u, 1, 1)).alias("variable"), s.matches_any(u, ["a", "b"]).alias("known"),
    )


@query("split_nonempty", "SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '')[2] AS host, length(list_filter(string_split(url, '/'), lambda x: x <> ''))::BIGINT AS parts FROM pages")
def _(spark, d):
    p = s.split_nonempty(F.col("url"), "/")
    return v.table(spark, d, "pages").select("page_id", F.get(p, F.lit(1)).alias("host"), F.size(p).cast("long").alias("parts"))


@query(
    "str_diff_idx",
    "SELECT page_id, (CASE WHEN starts_with(url, 'https://m') THEN 9 WHEN starts_with(url, 'https://') THEN 8 WHEN starts_with(url, 'https:') THEN 6 WHEN starts_with(url, 'http') THEN 4 END)::BIGINT AS at FROM pages",
)
def _(spark, d):
    return v.table(spark, d, "pages").select("page_id", s.diff_index(F.col("url"), F.lit("https://m")).cast("long").alias("at"))


@query(
    "array_fns",
    "SELECT vec_id, len(embedding)::BIGINT AS n, list_max(embedding)::DOUBLE AS top, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS at, (list_contains(embedding, embedding[3])) AS has, embedding[-1]::DOUBLE AS last FROM embeddings",
)
def _(spark, d):
    e = F.col("embedding")
    return v.table(spark, d, "embeddings").select("vec_id", F.size(e).cast("long").alias("n"), F.array_max(e).cast("double").alias("top"), (F.array_position(e, F.array_max(e)) - 1).cast("long").alias("at"), F.array_contains(e, F.get(e, F.lit(2))).alias("has"), F.element_at(e, -1).cast("double").alias("last"))


@query(
    "map_upsert",
    "SELECT user_id, count(DISTINCT event_type) AS n, max_by(floor(value)::BIGINT, event_id) FILTER (event_type = (SELECT min(event_type) FROM events)) AS last FROM events GROUP BY user_id",
)
def _(spark, d):
    """A map for each user from event type to its last value; later events replace earlier ones."""
    e = v.table(spark, d, "events")
    last = e.groupBy("user_id", "event_type").agg(F.max_by(F.floor("value"), "event_id").alias("v"))
    first = e.agg(F.min("event_type").alias("t"))
    m = last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return m.join(F.broadcast(first)).select("user_id", F.size("m").cast("long").alias("n"), F.try_element_at("m", F.col("t")).alias("last"))  # one row


# ---- markers ----

_F16 = FAMILIES["tag16h5"]
_VALUES = lambda rows: ", ".join(f"({', '.join(map(str, r))})" for r in rows)


@query(
    "render_tag",
    f"""WITH codes(id, code) AS (VALUES {_VALUES(enumerate(_F16.codes))}), bits(i, bx, by_) AS (VALUES {_VALUES((i, x, y) for i, (x, y) in enumerate(_F16.bits))}),
lit AS (SELECT id, by_ + 1 AS y, bx + 1 AS x FROM codes, bits WHERE (code >> (15 - i)) & 1 = 1),
grid AS (SELECT id, y, x FROM codes, range(8) a(y), range(8) b(x))
SELECT g.id::BIGINT AS id, g.y::BIGINT AS y, g.x::BIGINT AS x, (CASE WHEN g.y IN (0, 7) OR g.x IN (0, 7) OR lit.id IS NOT NULL THEN 255 ELSE 0 END)::BIGINT AS v
FROM grid g LEFT JOIN lit ON lit.id = g.id AND lit.y = g.y AND lit.x = g.x""",
)
def _(spark, d):
    return out(MarkerEngine(spark, ["tag16h5"]).render(), "id", "y", "x", "v")


def scenes(spark: SparkSession, d: str) -> DataFrame:
    """An image for each part: the marker of its key, enlarged eight times, on white."""
    import pandas as pd

    from ..operators.detect import render

    def draw(batches):
        import numpy as np

        for b in batches:
            rows = []
            for k in b.p_partkey:
                im = np.full((128, 128), 255, np.uint8)
                im[32:96, 32:96] = np.kron(np.rot90(render(_F16, k % len(_F16.codes)), k % 4), np.ones((8, 8), np.uint8))
                rows.append((str(k), 128, 128, im.tobytes()))
            yield pd.DataFrame(rows, columns=["image_id", "width", "height", "buf"])

    keys = v.table(spark, d, "part").select("p_partkey").repartition(spark.sparkContext.defaultParallelism)  # one small file
    return keys.mapInPandas(draw, "image_id string, width int, height int, buf binary")


@query("detect_markers", f"SELECT p_partkey AS image_id, p_partkey % {len(_F16.codes)} AS id, CAST(0 AS BIGINT) AS hamming FROM part")
def _(spark, d):
    found = MarkerEngine(spark, ["tag16h5"]).detect(scenes(spark, d))
    return out(found, "image_id", "id", "hamming")


@query("pose_markers")
def _(spark, d):
    engine = MarkerEngine(spark, ["tag16h5"])
    sizes = spark.createDataFrame([("tag16h5", 0.16)], "family string, tagsize double")
    poses = engine.pose(engine.detect(scenes(spark, d)), sizes, 600, 600, 64, 64)
    return poses.select("image_id", "id", *(F.round(F.get("t", F.lit(k)), 4).alias(n) for k, n in enumerate(("tx", "ty", "tz"))))


@query("homography_solve", "SELECT p_partkey AS id, CAST(1000 AS BIGINT) AS checked FROM part")
def _(spark, d):
    """Four-point homographies, solved for each part and checked by projecting the unit square: 1000 where all four
    corners are met."""
    import pandas as pd

    from ..operators.detect import SQUARE, homography, project

    def solve(batches):
        import numpy as np

        for b in batches:
            ok = []
            for k in b.id:
                q = SQUARE * (20 + k % 7) + np.array(((k % 3, 1), (2, k % 5), (k % 4, 3), (1, k % 2)))
                ok.append(1000 if np.abs(project(homography(SQUARE, q), SQUARE) - q).max() < 1e-6 else 0)
            yield pd.DataFrame({"id": b.id, "checked": ok})

    return v.table(spark, d, "part").select(F.col("p_partkey").alias("id")).mapInPandas(solve, "id long, checked long")
