"""Queries that run the annotation sources and the posture filter over tables in their form, made from the fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import fitting
from ..sources import annotations
from . import posture
from .relational import _t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_PART_IDS = (7, 2, 11, 14, 8, 13, 9)  # of line numbers 1 to 7
_NAMES = ("has_shape::perching-like", "has_size::small", "has_pose::sitting", "has_pose::still", "has_bill::long", "has_eye::red", "has_tail::forked")
_BLOCKED = ("00001_1-URGENT.png", "00002_1-URGENT.png", "00003_5-LOW.png", "00007_2-HIGH.png", "00012_5-LOW.png", "00016_5-LOW.png")


def tables(spark, sf_dir) -> dict[str, DataFrame]:
    """Images are orders, classes nations, landmarks and attributes the lines of an order."""
    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    img, key = F.col("o_orderkey").cast("int").alias("img_id"), F.col("o_orderkey")
    line = li.groupBy(F.col("l_orderkey").cast("int").alias("img_id"), "l_linenumber")
    seen = F.max((F.col("l_returnflag") != "A").cast("int")).alias("visible")
    t = {
        "images": o.select(img, F.concat(F.lit("a/b/"), "o_orderpriority", F.lit(".png")).alias("filepath")),
        "labels": o.select(img, (F.col("o_custkey") % 25).cast("int").alias("class_id")),
        "classes": _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("class_id"), F.col("n_name").alias("class_name")),
        "boxes": o.select(img, (key % 7).cast("double").alias("x"), F.lit(5.0).alias("y"), (40 + key % 20).cast("double").alias("width"), F.when(key % 50 == 0, 0.0).otherwise((30 + key % 25).cast("double")).alias("height")),
        "split": o.select(img, (key % 2).cast("int").alias("is_train")),
        "parts": line.agg((F.max("l_extendedprice") / 2000).alias("x"), F.max("l_quantity").alias("y"), seen).select("img_id", F.element_at(F.array(*map(F.lit, _PART_IDS)), F.col("l_linenumber")).alias("part_id"), "x", "y", "visible", F.col("l_linenumber").alias("source_at")),
        "attribute_labels": line.agg(F.max((F.col("l_tax") > 0.02).cast("int")).alias("is_present"), (F.max(F.col("l_suppkey") % 4) + 1).cast("int").alias("certainty_id")).select("img_id", F.col("l_linenumber").alias("attr_id"), "is_present", "certainty_id"),
        "attributes": spark.createDataFrame(list(enumerate(_NAMES, 1)), "attr_id int, attr_name string"),
    }
    return t | {"master": annotations.master(t)}


_MASTER = """m AS (SELECT o_orderkey::INTEGER AS img_id, 'a/b/' || o_orderpriority || '.png' AS filepath, (o_custkey % 25)::INTEGER AS class_id, n_name AS class_name, (o_orderkey % 7)::DOUBLE AS x, 5.0::DOUBLE AS y, (40 + o_orderkey % 20)::DOUBLE AS width,
 CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE 30 + o_orderkey % 25 END::DOUBLE AS height, (o_orderkey % 2)::INTEGER AS is_train FROM orders JOIN nation ON n_nationkey = o_custkey % 25)"""
_PARTS = f"p AS (SELECT l_orderkey::INTEGER AS img_id, {list(_PART_IDS)}[l_linenumber] AS part_id, max(l_extendedprice) / 2000 AS x, max(l_quantity) AS y, max(CASE WHEN l_returnflag <> 'A' THEN 1 ELSE 0 END) AS visible FROM lineitem GROUP BY l_orderkey, l_linenumber)"
_SEEN = """s AS (SELECT img_id, bool_or(part_id IN (8, 12)) AS leg, bool_or(part_id IN (9, 13)) AS wing, bool_or(part_id = 7) AS le, bool_or(part_id = 11) AS re, bool_or(part_id = 2) AS beak, bool_or(part_id = 14) AS tail,
 max(x) FILTER (part_id = 2) AS xb, max(y) FILTER (part_id = 2) AS yb, max(x) FILTER (part_id = 14) AS xt, max(y) FILTER (part_id = 14) AS yt, max(y) FILTER (part_id = 8) AS yl, max(x) FILTER (part_id = 9) AS xw, max(x) FILTER (part_id = 13) AS xv FROM p WHERE visible = 1 GROUP BY img_id),
att AS (SELECT DISTINCT img_id FROM (SELECT l_orderkey::INTEGER AS img_id, l_linenumber AS a, max(CASE WHEN l_tax > 0.02 THEN 1 ELSE 0 END) AS f, max(l_suppkey % 4) + 1 AS c FROM lineitem GROUP BY ALL) WHERE a IN (1, 3) AND f = 1 AND c >= 3)"""
_SCORED = f"""{_MASTER}, {_PARTS}, {_SEEN}, f AS (SELECT m.*, width / nullif(height, 0) AS bbox_ratio, coalesce(leg, false) AS leg_visible_any, coalesce(wing, false) AS wing_visible_any, coalesce(le, false) AS left_eye_visible, coalesce(re, false) AS right_eye_visible,
 coalesce(beak, false) AS beak_visible, coalesce(tail, false) AS tail_visible, att.img_id IS NOT NULL AS attr_perching, xb > xt AS own_right,
 CASE WHEN xb IS NOT NULL AND xt IS NOT NULL AND height > 0 THEN abs(xb - xt) / width ELSE -1 END AS dx, CASE WHEN yb IS NOT NULL AND yt IS NOT NULL AND height > 0 THEN abs(yb - yt) / height ELSE -1 END AS dy,
 CASE WHEN yl IS NOT NULL AND height > 0 THEN (yl - y) / height ELSE -1 END AS ly, CASE WHEN xw IS NOT NULL AND xv IS NOT NULL THEN abs(xw - xv) / width ELSE -1 END AS ws
 FROM m LEFT JOIN s USING (img_id) LEFT JOIN att USING (img_id)),
g AS (SELECT *, coalesce(bbox_ratio <= 2.0, false) AS bbox_perching, coalesce(attr_perching AND leg_visible_any AND left_eye_visible <> right_eye_visible AND beak_visible AND tail_visible AND bbox_ratio <= 1.7 AND dx >= 0.55 AND dy BETWEEN 0.26 AND 0.45 AND ly >= 0.62, false) AS strict FROM f)"""


@query(f"WITH {_MASTER} SELECT * FROM m")
def master_join(spark, sf_dir):
    """The five annotation tables as one, by the library's own join."""
    return tables(spark, sf_dir)["master"]


_FLAGS = "attr_perching, leg_visible_any, wing_visible_any, left_eye_visible, right_eye_visible, beak_visible, tail_visible, bbox_perching"


@query(f"WITH {_SCORED} SELECT img_id, round(bbox_ratio, 6) AS bbox_ratio, round(width * height, 6) AS bbox_area, round(dx, 6) AS beak_tail_dx_norm, round(dy, 6) AS beak_tail_dy_norm, round(ly, 6) AS leg_y_norm_max, round(ws, 6) AS wing_span_norm, {_FLAGS}, strict AS likely_perching FROM g")
def posture_scored(spark, sf_dir):
    """Geometry, flags, offsets and the strict predicate."""
    t = tables(spark, sf_dir)
    s = posture.scored(t["master"], t["attribute_labels"], t["parts"], posture.attribute_ids(t["attributes"]))
    numbers = ("bbox_ratio", "bbox_area", "beak_tail_dx_norm", "beak_tail_dy_norm", "leg_y_norm_max", "wing_span_norm")
    return s.select("img_id", *[F.round(c, 6).alias(c) for c in numbers], *_FLAGS.split(", "), "likely_perching")


@query(f"WITH {_SCORED} SELECT 'all' AS policy, img_id FROM g WHERE strict UNION ALL SELECT 'attributes', img_id FROM g WHERE attr_perching UNION ALL SELECT 'box', img_id FROM g WHERE bbox_perching")
def posture_policies(spark, sf_dir):
    """Which predicate decides follows from what the tables hold."""
    t = tables(spark, sf_dir)
    ids = posture.attribute_ids(t["attributes"])
    given = {"all": (t["attribute_labels"], t["parts"]), "attributes": (t["attribute_labels"], t["parts"].limit(0)), "box": (t["attribute_labels"].limit(0), t["parts"])}
    out = None
    for name, (labels, parts) in given.items():
        one = posture.scored(t["master"], labels, parts, ids).filter("likely_perching").select(F.lit(name).alias("policy"), "img_id")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_SCORED}, k AS (SELECT *, printf('%05d_%s', img_id, split_part(filepath, '/', -1)) AS filename FROM g WHERE bbox_perching), mj AS (SELECT class_id, avg(CASE WHEN own_right THEN 1.0 ELSE 0.0 END) >= 0.5 AS most FROM g WHERE own_right IS NOT NULL GROUP BY 1)
SELECT img_id, class_id, filename, coalesce(NOT own_right, NOT most, false) AS hflip FROM k LEFT JOIN mj USING (class_id) WHERE filename NOT IN {_BLOCKED}""")
def posture_facing(spark, sf_dir):
    """Kept rows without blocked names, and whether they are mirrored."""
    t = tables(spark, sf_dir)
    s = posture.scored(t["master"], t["attribute_labels"].limit(0), t["parts"], [])
    kept = posture.selected(s, spark.createDataFrame([(b,) for b in _BLOCKED], "f string"), least=1)
    return posture.facing(kept, t["parts"], t["master"]).select("img_id", "class_id", "filename", "hflip")


@query(f"""WITH {_MASTER} SELECT img_id, round(width / height, 6) AS bbox_ratio FROM
(SELECT * FROM m ORDER BY CASE WHEN height > 0 THEN width / height END NULLS LAST, img_id LIMIT 300)""")
def posture_relaxed(spark, sf_dir):
    """Too few likely rows and relaxing allowed: the smallest ratios instead."""
    t = tables(spark, sf_dir)
    s = posture.scored(t["master"], t["attribute_labels"], t["parts"].limit(0), []).withColumn("likely_perching", F.lit(False))
    return posture.selected(s, least=10, relax=True, relaxed=300).select("img_id", F.round("bbox_ratio", 6).alias("bbox_ratio"))


_GROUP = " ".join(f"WHEN part_id IN ({', '.join(map(str, ids))}) THEN '{name}'" for name, ids in K.PARTS.items())
_DEFAULT = ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in K.BOXES.items())


@query(f"""WITH {_MASTER}, {_PARTS}, c AS (SELECT CASE {_GROUP} END AS part, (p.x - m.x) / width * 224 AS px, (p.y - m.y) / height * 224 AS py FROM p JOIN m USING (img_id) WHERE visible = 1 AND height > 1e-6),
b AS (SELECT part, avg(px) AS mx, avg(py) AS my, greatest(16, 1.8 * stddev_pop(px)) AS sx, greatest(16, 1.8 * stddev_pop(py)) AS sy FROM c WHERE part IS NOT NULL GROUP BY part),
z AS (SELECT part, least(greatest(trunc(mx - sx), 0), 223) AS x0, least(greatest(trunc(my - sy), 0), 223) AS y0, trunc(mx + sx) AS x1, trunc(my + sy) AS y1 FROM b),
d(part, a, b, c, e) AS (VALUES {_DEFAULT})
SELECT part, coalesce(x0, a)::INTEGER AS x0, coalesce(y0, b)::INTEGER AS y0, CASE WHEN x0 IS NULL THEN c ELSE least(greatest(x1, x0 + 1), 224) END::INTEGER AS x1, CASE WHEN y0 IS NULL THEN e ELSE least(greatest(y1, y0 + 1), 224) END::INTEGER AS y1 FROM d LEFT JOIN z USING (part)""")
def part_boxes(spark, sf_dir):
    """Each part's box in crop coordinates, the default where it is never seen."""
    t = tables(spark, sf_dir)
    place = t["master"].select("img_id", F.col("x").alias("bbox_x"), F.col("y").alias("bbox_y"), F.col("width").alias("bbox_w"), F.col("height").alias("bbox_h"))
    boxes = fitting.fit_boxes(t["parts"], place)
    return spark.createDataFrame([(k, *map(int, v)) for k, v in boxes.items()], "part string, x0 int, y0 int, x1 int, y1 int")


@query(f"WITH {_MASTER} SELECT img_id, filepath, class_id FROM m WHERE class_id IN (SELECT class_id FROM m WHERE img_id % 9 = 0 AND class_id < 7)")
def fit_pool(spark, sf_dir):
    """All images of the classes that a kept set holds."""
    master = tables(spark, sf_dir)["master"]
    return annotations.fit_pool(master, master.filter("img_id % 9 = 0 and class_id < 7")).select("img_id", "filepath", "class_id")
