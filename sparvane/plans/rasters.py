"""Queries of the image kernels over 8x8 rasters that are made from vectors, with SQL that computes the same from pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources import images
from .relational import _t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def rasters(spark, sf_dir) -> DataFrame:
    """(img_id, height, width, rgb): a pixel's channels are bytes of three places of a vector."""
    byte = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 4096) % 256).cast("int"))
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("img_id"), byte.alias("v"))
    places = F.array(*[F.lit(p) for i in range(1, 65) for p in (i - 1, i * 5 % 64, i * 11 % 64)])
    rgb = F.transform(places, lambda p: F.lpad(F.hex(F.get("v", p)), 2, "0"))
    return e.select("img_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(F.array_join(rgb, "")).alias("rgb"))


_PX = """v AS (SELECT vec_id::INTEGER AS img_id, list_transform(embedding, lambda x: CAST(floor(abs(x::DOUBLE) * 4096) AS BIGINT) % 256) AS v FROM embeddings),
px AS (SELECT img_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, v[i] AS r, v[(i * 5) % 64 + 1] AS g, v[(i * 11) % 64 + 1] AS b FROM v, range(1, 65) t(i)),
lu AS (SELECT *, (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 AS k FROM px)"""
_HSV = """t0 AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM px),
t1 AS (SELECT *, CASE WHEN top = low THEN 0 WHEN top = r THEN (g - b)::DOUBLE / (top - low) WHEN top = g THEN 2 + (b - r)::DOUBLE / (top - low) ELSE 4 + (r - g)::DOUBLE / (top - low) END / 6 AS sec FROM t0),
hs AS (SELECT img_id, y, x, r, g, b, CAST(floor((sec - floor(sec)) * 255) AS BIGINT) AS h, CASE WHEN top > 0 THEN CAST(floor((top - low)::DOUBLE / top * 255) AS BIGINT) ELSE 0 END AS s, top AS v FROM t1)"""
_GRAD = """gr AS (SELECT a.img_id, a.y, a.x, CASE WHEN a.x BETWEEN 1 AND 6 THEN e.k / 255.0::DOUBLE - w.k / 255.0::DOUBLE ELSE 0 END AS gx, CASE WHEN a.y BETWEEN 1 AND 6 THEN s.k / 255.0::DOUBLE - n.k / 255.0::DOUBLE ELSE 0 END AS gy
 FROM lu a LEFT JOIN lu e ON e.img_id = a.img_id AND e.y = a.y AND e.x = a.x + 1 LEFT JOIN lu w ON w.img_id = a.img_id AND w.y = a.y AND w.x = a.x - 1
 LEFT JOIN lu s ON s.img_id = a.img_id AND s.x = a.x AND s.y = a.y + 1 LEFT JOIN lu n ON n.img_id = a.img_id AND n.x = a.x AND n.y = a.y - 1),
ga AS (SELECT *, sqrt(gx * gx + gy * gy) AS m, CASE WHEN degrees(atan2(gy, gx)) < 0 THEN degrees(atan2(gy, gx)) + 360 ELSE degrees(atan2(gy, gx)) END AS a FROM gr)"""


def _rows(sql: str, digits: int = 6) -> str:
    """Values as they are kept: 32-bit, rounded, zeros left out. sql gives img_id, pos and x."""
    return f"SELECT img_id, pos, round(x::FLOAT::DOUBLE, {digits}) AS x FROM ({sql}) WHERE round(x::FLOAT::DOUBLE, {digits}) <> 0"


def _vectors(df: DataFrame, kernel, digits: int = 6) -> DataFrame:
    own = images.extract(df, kernel).select("img_id", F.posexplode("vec").alias("pos", "x"))
    return own.select("img_id", "pos", F.round(F.col("x").cast("double"), digits).alias("x")).filter("x <> 0")


@query(f"WITH {_PX} SELECT img_id, CAST(y * 8 + x AS INTEGER) AS pos, k::DOUBLE AS x FROM lu WHERE k <> 0")
def raster_luma(spark, sf_dir):
    """Grey levels by rounded integer weights."""
    return _vectors(rasters(spark, sf_dir), lambda r: r.gray.ravel())


@query(f"WITH {_PX}, {_HSV}, c AS (SELECT img_id, 0 AS ch, h // 16 AS b FROM hs UNION ALL SELECT img_id, 1, s // 16 FROM hs UNION ALL SELECT img_id, 2, v // 16 FROM hs) {_rows('SELECT img_id, CAST(ch * 16 + b AS INTEGER) AS pos, count(*) / (192 + 1e-8::DOUBLE) AS x FROM c GROUP BY ALL')}")
def raster_hsv_histogram(spark, sf_dir):
    """Three channels of 16 bins."""
    return _vectors(rasters(spark, sf_dir), K.hsv_histogram)


@query(f"WITH {_PX}, {_HSV} {_rows('SELECT img_id, CAST((h // 16) * 16 + (s // 64) * 4 + v // 64 AS INTEGER) AS pos, count(*) / (64 + 1e-8::DOUBLE) AS x FROM hs GROUP BY ALL')}")
def raster_joint_hsv(spark, sf_dir):
    """16 hues by 4 saturations by 4 values."""
    return _vectors(rasters(spark, sf_dir), K.joint_hsv)


_AROUND = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))
_CODE = " + ".join(f"CASE WHEN l[((y + {8 - dy}) % 8) * 8 + (x + {8 - dx}) % 8 + 1] >= l[y * 8 + x + 1] THEN {1 << i} ELSE 0 END" for i, (dy, dx) in enumerate(_AROUND))


@query(f"WITH {_PX}, li AS (SELECT img_id, list(k ORDER BY y, x) AS l FROM lu GROUP BY img_id), co AS (SELECT img_id, {_CODE} AS code FROM px JOIN li USING (img_id)) {_rows('SELECT img_id, CAST(code // 4 AS INTEGER) AS pos, count(*) / (64 + 1e-8::DOUBLE) AS x FROM co GROUP BY ALL')}")
def raster_lbp(spark, sf_dir):
    """I8: eight neighbours around the image's edges, 64 bins."""
    return _vectors(rasters(spark, sf_dir), K.wrapped_lbp)


@query(f"WITH {_PX}, {_GRAD} {_rows('SELECT img_id, CAST(least(35, floor(a / 10)) AS INTEGER) AS pos, sum(m) / (any_value(t) + 1e-8::DOUBLE) AS x FROM (SELECT *, sum(m) OVER (PARTITION BY img_id) AS t FROM ga) GROUP BY 1, 2')}")
def raster_orientation(spark, sf_dir):
    """36 orientations weighted by the gradient."""
    return _vectors(rasters(spark, sf_dir), K.orientation_36)


_HOG = "SELECT img_id, CAST(((y // 2) * 4 + x // 2) * 9 + least(8, floor((a % 180) / 20)) AS INTEGER) AS pos, sum(m) AS w FROM ga GROUP BY 1, 2"


@query(f"WITH {_PX}, {_GRAD}, ho AS ({_HOG}) {_rows('SELECT img_id, pos, w / (sqrt(sum(w * w) OVER (PARTITION BY img_id)) + 1e-8::DOUBLE) AS x FROM ho')}")
def raster_hog(spark, sf_dir):
    """A grid of 4x4 cells by 9 unsigned orientations."""
    return _vectors(rasters(spark, sf_dir), K.hog)


def _window(source: str, name: str, size: int, erode: bool) -> str:
    r = size // 2
    test = f"= {size * size}" if erode else "> 0"
    return f"{name} AS (SELECT a.img_id, a.y, a.x, coalesce(sum(n.on_), 0) {test} AS m, CAST(coalesce(sum(n.on_), 0) {test} AS INTEGER) AS on_ FROM {source} a LEFT JOIN {source} n ON n.img_id = a.img_id AND abs(n.y - a.y) <= {r} AND abs(n.x - a.x) <= {r} GROUP BY a.img_id, a.y, a.x)"


_MASK = f"m0 AS (SELECT img_id, y, x, CAST(k >= 96 AS INTEGER) AS on_ FROM lu), {_window('m0', 'm1', 3, True)}, {_window('m1', 'm2', 3, False)}, {_window('m2', 'm3', 5, False)}, {_window('m3', 'm4', 5, True)}"


@query(f"WITH {_PX}, {_MASK} SELECT img_id, CAST(y * 8 + x AS INTEGER) AS pos, 1.0::DOUBLE AS x FROM m4 WHERE m")
def raster_mask(spark, sf_dir):
    """A mask opened by 3x3, then closed by 5x5; nothing lies outside the image."""
    return _vectors(rasters(spark, sf_dir), lambda r: K.cleaned(r.gray >= 96).astype(float).ravel())


_HU = """c AS (SELECT img_id, sum(on_) + 1e-12::DOUBLE AS n, sum(on_ * x) / (sum(on_) + 1e-12::DOUBLE) AS cx, sum(on_ * y) / (sum(on_) + 1e-12::DOUBLE) AS cy FROM m0 GROUP BY img_id),
d AS (SELECT img_id, n, on_, x - cx AS dx, y - cy AS dy FROM m0 JOIN c USING (img_id)),
mu AS (SELECT img_id, any_value(n) AS n, sum(on_ * dx * dx) AS m20, sum(on_ * dy * dy) AS m02, sum(on_ * dx * dy) AS m11, sum(on_ * dx * dx * dx) AS m30, sum(on_ * dy * dy * dy) AS m03, sum(on_ * dx * dx * dy) AS m21, sum(on_ * dx * dy * dy) AS m12 FROM d GROUP BY img_id),
e AS (SELECT img_id, m20 / (n ** 2 + 1e-12) AS e20, m02 / (n ** 2 + 1e-12) AS e02, m11 / (n ** 2 + 1e-12) AS e11, m30 / (n ** 2.5 + 1e-12) AS e30, m03 / (n ** 2.5 + 1e-12) AS e03, m21 / (n ** 2.5 + 1e-12) AS e21, m12 / (n ** 2.5 + 1e-12) AS e12 FROM mu),
hu AS (SELECT img_id, unnest([0, 1, 2]) AS pos, unnest([e20 + e02, (e20 - e02) ** 2 + 4 * e11 ** 2, (e30 - 3 * e12) ** 2 + (3 * e21 - e03) ** 2]) AS x FROM e)"""


@query(f"WITH {_PX}, m0 AS (SELECT img_id, y, x, CAST(k >= 96 AS INTEGER) AS on_ FROM lu), {_HU} {_rows('SELECT * FROM hu', 8)}")
def raster_hu(spark, sf_dir):
    """Three moment invariants of a binary shape."""
    return _vectors(rasters(spark, sf_dir), lambda r: K.hu_moments(r.gray >= 96), 8)


_TOP = """ce AS (SELECT img_id, (r // 32) * 64 + (g // 32) * 8 + b // 32 AS cell, count(*) AS n FROM px GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY n DESC, cell) - 1 AS p FROM ce),
t3 AS (SELECT img_id, p, n / (64 + 1e-8::DOUBLE) AS share, (cell // 64) * 32 + 16 AS r, (cell // 8) % 8 * 32 + 16 AS g, cell % 8 * 32 + 16 AS b, p AS y, 0 AS x FROM rk WHERE p < 3)"""


@query(f"WITH {_PX}, {_TOP}, {_HSV.replace('FROM px', 'FROM t3')}, j AS (SELECT hs.img_id, hs.y AS p, h, s, v, share FROM hs JOIN t3 ON t3.img_id = hs.img_id AND t3.p = hs.y), l AS (SELECT img_id, unnest([p * 4, p * 4 + 1, p * 4 + 2, p * 4 + 3])::INTEGER AS pos, unnest([h / 255.0::DOUBLE, s / 255.0::DOUBLE, v / 255.0::DOUBLE, share]) AS x FROM j) {_rows('SELECT * FROM l')}")
def raster_dominant(spark, sf_dir):
    """The three fullest cells of an 8x8x8 cube, as HSV with their shares."""
    return _vectors(rasters(spark, sf_dir), lambda r: K.dominant_colours(r, exact=False)[:12])


_LAB = """ln AS (SELECT img_id, CASE WHEN r / 255.0::DOUBLE > 0.04045 THEN ((r / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 ELSE r / 255.0::DOUBLE / 12.92 END AS r, CASE WHEN g / 255.0::DOUBLE > 0.04045 THEN ((g / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 ELSE g / 255.0::DOUBLE / 12.92 END AS g, CASE WHEN b / 255.0::DOUBLE > 0.04045 THEN ((b / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 ELSE b / 255.0::DOUBLE / 12.92 END AS b FROM px),
xyz AS (SELECT img_id, (0.412453::DOUBLE * r + 0.357580::DOUBLE * g + 0.180423::DOUBLE * b) / 0.95047 AS x, 0.212671::DOUBLE * r + 0.715160::DOUBLE * g + 0.072169::DOUBLE * b AS y, (0.019334::DOUBLE * r + 0.119193::DOUBLE * g + 0.950227::DOUBLE * b) / 1.08883 AS z FROM ln),
f AS (SELECT img_id, CASE WHEN x > 0.008856 THEN cbrt(x) ELSE 7.787 * x + 16 / 116.0::DOUBLE END AS x, CASE WHEN y > 0.008856 THEN cbrt(y) ELSE 7.787 * y + 16 / 116.0::DOUBLE END AS y, CASE WHEN z > 0.008856 THEN cbrt(z) ELSE 7.787 * z + 16 / 116.0::DOUBLE END AS z FROM xyz),
ch AS (SELECT img_id, unnest([0, 1, 2]) AS c, unnest([116 * y - 16, 500 * (x - y), 200 * (y - z)]) AS v FROM f),
st AS (SELECT img_id, c, avg(v) AS m, stddev_pop(v) AS sd FROM ch GROUP BY ALL),
mo AS (SELECT img_id, c, any_value(m) AS m, any_value(sd) AS sd, avg(((v - m) / sd) ** 3) * sqrt(64.0::DOUBLE * 63) / 62 AS sk, 63.0::DOUBLE / (62 * 61) * (65 * (avg(((v - m) / sd) ** 4) - 3) + 6) AS ku FROM ch JOIN st USING (img_id, c) GROUP BY ALL),
l AS (SELECT img_id, unnest([c * 4, c * 4 + 1, c * 4 + 2, c * 4 + 3])::INTEGER AS pos, unnest([m, sd, sk, ku]) AS x FROM mo)"""


@query(f"WITH {_PX}, {_LAB} {_rows('SELECT * FROM l', 3)}")
def raster_lab_moments(spark, sf_dir):
    """Mean, deviation, corrected skew and kurtosis of L*a*b*."""
    return _vectors(rasters(spark, sf_dir), K.lab_moments, 3)


_WEIGHT = """d AS (SELECT j, i, (i + 0.5 - (j + 0.5) * 8 / 5) / (8 / 5.0::DOUBLE) AS d FROM range(0, 5) a(j), range(0, 8) b(i)),
w AS (SELECT j, i, sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) AS w FROM d WHERE abs(d) < 3), wn AS (SELECT j, i, w / sum(w) OVER (PARTITION BY j) AS w FROM w)"""


@query(f"WITH {_PX}, {_WEIGHT}, c AS (SELECT img_id, y, x, unnest([0, 1, 2]) AS ch, unnest([r, g, b]) AS v FROM px), o AS (SELECT img_id, ny.j AS y, nx.j AS x, ch, sum(v * ny.w * nx.w) AS s FROM c JOIN wn ny ON ny.i = c.y JOIN wn nx ON nx.i = c.x GROUP BY ALL) SELECT img_id, CAST((y * 5 + x) * 3 + ch AS INTEGER) AS pos, greatest(0, least(255, round_even(s, 0))) AS x FROM o WHERE round_even(s, 0) > 0")
def raster_resize(spark, sf_dir):
    """Antialiased resampling by Lanczos windows."""
    return _vectors(rasters(spark, sf_dir), lambda r: K.resize(r.rgb, 5, 5, lanczos=True).ravel())


@query(f"WITH {_PX}, c AS (SELECT img_id, y, 7 - x AS x, unnest([0, 1, 2]) AS ch, unnest([r, g, b]) AS v FROM px) SELECT img_id, CAST((y * 8 + x) * 3 + ch AS INTEGER) AS pos, v::DOUBLE AS x FROM c WHERE v <> 0")
def raster_crop(spark, sf_dir):
    """A box that reaches beyond the image is clamped to it, and mirrored."""
    box = {"x": -2.5, "y": -1.0, "w": 12.0, "h": 11.5}
    own = rasters(spark, sf_dir).withColumns({k: F.lit(v) for k, v in box.items()}).withColumn("hflip", F.lit(True))
    return _vectors(images.cropped(own, 8), lambda r: r.rgb.ravel())


@query(f"WITH {_PX}, c AS (SELECT img_id, y - 2 AS y, x, unnest([0, 1, 2]) AS ch, unnest([r, g, b]) AS v FROM px WHERE x < 5 AND y >= 2) SELECT img_id, CAST((y * 5 + x) * 3 + ch AS INTEGER) AS pos, v::DOUBLE AS x FROM c WHERE v <> 0")
def raster_part(spark, sf_dir):
    """A part's box, cut to whole numbers inside the image."""
    return _vectors(rasters(spark, sf_dir), lambda r: r.crop((-3.4, 2.7, 5.9, 99)).rgb.ravel())


@query(f"WITH {_PX}, k AS (SELECT img_id, list(struct_pack(r := r, g := g, b := b) ORDER BY y, x) AS l FROM px GROUP BY img_id), c AS (SELECT img_id, i, l[CAST(trunc(i * 63 / 11.0::DOUBLE) AS INTEGER) + 1] AS p FROM k, range(0, 12) t(i)), o AS (SELECT img_id, CAST(i * 3 + unnest([0, 1, 2]) AS INTEGER) AS pos, unnest([p.r, p.g, p.b])::DOUBLE AS x FROM c) SELECT * FROM o WHERE x <> 0")
def raster_spread(spark, sf_dir):
    """Rows at even distances, first and last among them."""
    return _vectors(rasters(spark, sf_dir), lambda r: K.spread_rows(r.rgb.reshape(-1, 3), 12).ravel())


# offsets of eight points on a circle of radius 1, from the right and up, as (down, right)
_CIRCLE = ((0.0, 1.0), (-0.70711, 0.70711), (-1.0, 0.0), (-0.70711, -0.70711), (0.0, -1.0), (0.70711, -0.70711), (1.0, 0.0), (0.70711, 0.70711))


def _at(dy: int, dx: int) -> str:
    """A neighbour's grey level, 0 outside the image."""
    return f"CASE WHEN y + {dy} BETWEEN 0 AND 7 AND x + {dx} BETWEEN 0 AND 7 THEN l[(y + {dy}) * 8 + x + {dx} + 1] ELSE 0 END"


def _bit(dy: float, dx: float) -> str:
    fy, fx = int(np.floor(dy)), int(np.floor(dx))
    ty, tx = f"{dy - fy!r}::DOUBLE", f"{dx - fx!r}::DOUBLE"
    row = lambda i: f"((1 - {tx}) * ({_at(fy + i, fx)}) + {tx} * ({_at(fy + i, fx + 1)}))"
    return f"CASE WHEN (1 - {ty}) * {row(0)} + {ty} * {row(1)} - k >= 0 THEN 1 ELSE 0 END"


_UNIFORM = f"""li AS (SELECT img_id, list(k ORDER BY y, x) AS l FROM lu GROUP BY img_id), bi AS (SELECT img_id, [{", ".join(_bit(*p) for p in _CIRCLE)}] AS b FROM lu JOIN li USING (img_id)),
co AS (SELECT img_id, CASE WHEN list_sum(list_transform(range(1, 9), lambda i: abs(b[i] - b[i % 8 + 1]))) <= 2 THEN list_sum(b) ELSE 9 END AS code FROM bi),
sc AS (SELECT img_id, CAST(floor(least(255, code / (max(code) OVER (PARTITION BY img_id) + 1e-8::DOUBLE) * 255)) AS INTEGER) AS pos FROM co)"""


@query(f"WITH {_PX}, {_UNIFORM} {_rows('SELECT img_id, pos, count(*) / (64 + 1e-8::DOUBLE) AS x FROM sc GROUP BY ALL')}")
def raster_uniform_lbp(spark, sf_dir):
    """Rotation-invariant uniform patterns of eight interpolated points on a circle."""
    return _vectors(rasters(spark, sf_dir), lambda r: K.uniform_lbp(r.gray, 1))


@query(f"""WITH {_PX}, t AS (SELECT DISTINCT img_id, k AS t FROM lu), c AS (SELECT t.img_id, t, sum(CASE WHEN k <= t THEN 1 ELSE 0 END)::DOUBLE AS n1, sum(CASE WHEN k > t THEN 1 ELSE 0 END)::DOUBLE AS n2, sum(CASE WHEN k <= t THEN k ELSE 0 END)::DOUBLE AS s1, sum(CASE WHEN k > t THEN k ELSE 0 END)::DOUBLE AS s2 FROM t JOIN lu ON lu.img_id = t.img_id GROUP BY ALL),
r AS (SELECT img_id, t, row_number() OVER (PARTITION BY img_id ORDER BY n1 * n2 * (s1 / n1 - s2 / n2) ** 2 DESC, t) AS r FROM c WHERE n2 > 0) SELECT img_id, 0::INTEGER AS pos, t::DOUBLE AS x FROM r WHERE r = 1 AND t <> 0""")
def raster_otsu(spark, sf_dir):
    """The grey level that parts two classes best."""
    return _vectors(rasters(spark, sf_dir), lambda r: np.array([K.otsu(r.gray)]))


def _ratio(test: str) -> str:
    return f"avg(CASE WHEN {test} THEN 1.0::DOUBLE ELSE 0 END)"


_VIVID = "(s / 255.0::DOUBLE >= 0.20 AND v / 255.0::DOUBLE >= 0.15)"
_HUE = "((h * (360.0::DOUBLE / 255.0::DOUBLE)) % 360)"
_SHARES = {f"cattr_color_{n}_ratio": _ratio(f"{_VIVID} AND " + (f"{_HUE} >= {a} AND {_HUE} < {b}" if a < b else f"({_HUE} >= {a} OR {_HUE} < {b})")) for n, (a, b) in K.HUES.items()}
_SHARES |= {
    "cattr_sat_mean": "avg(s / 255.0::DOUBLE)", "cattr_val_mean": "avg(v / 255.0::DOUBLE)", "cattr_color_white_ratio": _ratio("s / 255.0::DOUBLE < 0.20 AND v / 255.0::DOUBLE >= 0.80"),
    "cattr_color_gray_ratio": _ratio("s / 255.0::DOUBLE < 0.20 AND NOT v / 255.0::DOUBLE < 0.20 AND v / 255.0::DOUBLE < 0.80"), "cattr_color_black_ratio": _ratio("v / 255.0::DOUBLE < 0.20"),
}
_KEPT = [*_SHARES, "cattr_symmetry_lr", "cattr_grad_anisotropy", "cattr_texture_entropy"]


@query(f"""WITH {_PX}, {_HSV}, {_GRAD}, a AS (SELECT img_id, {", ".join(f"{q} AS {n}" for n, q in _SHARES.items())} FROM hs GROUP BY img_id),
sy AS (SELECT l.img_id, 1 - avg(abs(l.k / 255.0::DOUBLE - r.k / 255.0::DOUBLE)) AS cattr_symmetry_lr FROM lu l JOIN lu r ON r.img_id = l.img_id AND r.y = l.y AND r.x = 7 - l.x WHERE l.x < 4 GROUP BY 1),
an AS (SELECT img_id, abs(avg(abs(gx)) - avg(abs(gy))) / (avg(abs(gx)) + avg(abs(gy)) + 1e-8) AS cattr_grad_anisotropy FROM ga GROUP BY 1),
te AS (SELECT img_id, -sum(n / 64.0::DOUBLE * log2(n / 64.0::DOUBLE + 1e-12)) AS cattr_texture_entropy FROM (SELECT img_id, k // 8 AS bin, count(*) AS n FROM lu GROUP BY ALL) GROUP BY 1)
SELECT img_id, {", ".join(f"round({n}::FLOAT::DOUBLE, 5) AS {n}" for n in _KEPT)} FROM a JOIN sy USING (img_id) JOIN an USING (img_id) JOIN te USING (img_id)""")
def raster_attributes(spark, sf_dir):
    """Colour shares, symmetry, anisotropy, texture entropy."""
    wide = images.tier1(rasters(spark, sf_dir))
    return wide.select("img_id", *[F.round(n, 5).alias(n) for n in _KEPT])


_MEANS, _VARS, _SHARE = ((0.25, 0.5, 0.4), (0.7, 0.45, 0.6)), ((0.05, 0.08, 0.06), (0.07, 0.04, 0.09)), (0.4, 0.6)


def _log(k: int) -> str:
    own = " + ".join(f"(({c} - {m}::DOUBLE) ** 2 / {v}::DOUBLE + ln(2 * pi() * {v}::DOUBLE))" for c, m, v in zip("rgb", _MEANS[k], _VARS[k], strict=True))
    return f"ln({_SHARE[k]}::DOUBLE) - 0.5 * ({own})"


_FISHER = f"""p AS (SELECT img_id, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM px), q0 AS (SELECT *, {_log(0)} AS l0, {_log(1)} AS l1 FROM p),
q AS (SELECT img_id, r, g, b, 1 / (1 + exp(l1 - l0)) AS w0, 1 / (1 + exp(l0 - l1)) AS w1 FROM q0),
z AS (SELECT img_id, {", ".join(f"sum(w{k} * ({c} - {_MEANS[k][i]}::DOUBLE)) / sqrt({_VARS[k][i]}::DOUBLE + 1e-8) / 64 AS a{k}{i}, sum(w{k} * (({c} - {_MEANS[k][i]}::DOUBLE) ** 2 / ({_VARS[k][i]}::DOUBLE + 1e-8) - 1)) / sqrt(2.0::DOUBLE) / 64 AS d{k}{i}" for k in (0, 1) for i, c in enumerate("rgb"))} FROM q GROUP BY img_id),
y AS (SELECT img_id, list_transform([{", ".join([f"a{k}{i}" for k in (0, 1) for i in range(3)] + [f"d{k}{i}" for k in (0, 1) for i in range(3)])}], lambda t: sign(t) * sqrt(abs(t) + 1e-8)) AS y FROM z),
l AS (SELECT img_id, CAST(i - 1 AS INTEGER) AS pos, y[i] / (sqrt(list_dot_product(y, y)) + 1e-8) AS x FROM y, range(1, 13) t(i))"""


@query(f"WITH {_PX}, {_FISHER} {_rows('SELECT * FROM l', 5)}")
def raster_fisher(spark, sf_dir):
    """I18, M3's use: Fisher vector of pixels under a fixed mixture of two components."""
    mixture = K.Mixture(np.array(_SHARE), np.array(_MEANS), np.array(_VARS))
    return _vectors(rasters(spark, sf_dir), lambda r: K.fisher_vector(r.rgb.reshape(-1, 3) / 255.0, mixture), 5)
