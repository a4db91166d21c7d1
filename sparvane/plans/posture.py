"""The posture filter over a master table, its landmarks and attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches_any, output_name
from ..operators import relational as R

# Keywords of the attribute signal, landmark ids and limits of the predicate.
KEYWORDS = ("perch", "perching", "sitting", "fly", "flying", "flight", "upright")
EYES, BEAK, TAIL, LEGS, WINGS = (7, 11), 2, 14, (8, 12), (9, 13)
MOST_RATIO, LEAST_DX, DY, LEAST_LEG_Y, MOST_BOX_RATIO = 1.7, 0.55, (0.26, 0.45), 0.62, 2.0


def attribute_ids(names: DataFrame) -> list[int]:
    return [r[0] for r in names.filter(matches_any(F.col("attr_name"), KEYWORDS)).select("attr_id").orderBy("attr_id").collect()]


def _visible(parts: DataFrame) -> DataFrame:
    """Visible landmarks with their order as `_at`: source_at where the table has it, else the order in which the rows come."""
    return parts.filter("visible = 1").withColumn("_at", F.col("source_at") if "source_at" in parts.columns else F.monotonically_increasing_id())


def scored(master: DataFrame, attribute_labels: DataFrame, parts: DataFrame, ids: list[int]) -> DataFrame:
    """master with geometry, visibility flags, offsets and likely_perching.

    All landmarks come from one aggregate of the visible parts; of a landmark given twice the last one in the source counts. Which predicate decides
    depends on the data: attributes and landmarks, attributes alone, or the box ratio.
    """
    seen = _visible(parts)
    n = F.col("part_id")
    flags = {"leg_visible_any": n.isin(*LEGS), "wing_visible_any": n.isin(*WINGS), "left_eye_visible": n == EYES[0], "right_eye_visible": n == EYES[1], "beak_visible": n == BEAK, "tail_visible": n == TAIL}
    picks = {f"{axis}{i}": (n == i, F.col(axis)) for i in (BEAK, TAIL, *LEGS, *WINGS) for axis in ("x", "y")}
    marks = R.flags_and_last(seen, "img_id", flags, {f"_{k}": pick for k, pick in picks.items()}, "_at")
    hits = attribute_labels.filter(F.col("attr_id").isin(ids) & (F.col("is_present") == 1) & (F.col("certainty_id") >= 3)).select("img_id").distinct().withColumn("attr_perching", F.lit(True))
    out = master.join(marks, "img_id", "left").join(hits, "img_id", "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in [*flags, "attr_perching"]})
    out = out.withColumns({
        "bbox_ratio": R.ratio(F.col("width"), F.col("height")),
        "bbox_area": F.col("width") * F.col("height"),
        "beak_tail_dx_norm": R.normalized_offset(F.col(f"_x{BEAK}"), F.col(f"_x{TAIL}"), F.when(F.col("height") > 0, F.col("width"))),
        "beak_tail_dy_norm": R.normalized_offset(F.col(f"_y{BEAK}"), F.col(f"_y{TAIL}"), F.when(F.col("width") > 0, F.col("height"))),
        "leg_y_norm_max": R.largest_offset([F.col(f"_y{i}") for i in LEGS], F.col("y"), F.col("height")),
        "wing_span_norm": R.normalized_offset(F.col(f"_x{WINGS[0]}"), F.col(f"_x{WINGS[1]}"), F.col("width")),
    })
    out = out.withColumn("bbox_perching", F.coalesce(F.col("bbox_ratio") <= MOST_BOX_RATIO, F.lit(False)))
    side = F.col("left_eye_visible") != F.col("right_eye_visible")
    strict = (
        F.col("attr_perching") & F.col("leg_visible_any") & side & F.col("beak_visible") & F.col("tail_visible") & (F.col("bbox_ratio") <= MOST_RATIO)
        & (F.col("beak_tail_dx_norm") >= LEAST_DX) & F.col("beak_tail_dy_norm").between(*DY) & (F.col("leg_y_norm_max") >= LEAST_LEG_Y)
    )
    if hits.isEmpty():
        test = F.col("bbox_perching")
    else:
        test = F.col("attr_perching") if parts.isEmpty() else strict
    return out.withColumn("likely_perching", F.coalesce(test, F.lit(False))).drop(*[f"_{k}" for k in picks])


def selected(scores: DataFrame, blocked: DataFrame | None = None, least: int = 500, relax: bool = False, relaxed: int = 8000) -> DataFrame:
    """Likely rows without blocked file names. With relax, the smallest box ratios instead where fewer than `least` are likely."""
    likely = scores.filter("likely_perching").withColumn("filename", output_name(F.col("img_id"), F.col("filepath")))
    if blocked is not None:
        likely = R.exclude(likely, "filename", blocked)
    if not relax or likely.limit(least).count() >= least:
        return likely
    return R.smallest(scores, "bbox_ratio", "img_id", max(least, relaxed)).withColumn("filename", output_name(F.col("img_id"), F.col("filepath")))


def facing(selected: DataFrame, parts: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """selected with hflip, which turns every image to the right.

    An image faces right where its beak is right of its tail; without these landmarks its
    class's majority in `pool` (by default selected) decides, and without that nothing is turned.
    """
    n = F.col("part_id")
    seen = _visible(parts)
    own = R.last_value_per_key(seen, "img_id", {"_b": (n == BEAK, F.col("x")), "_t": (n == TAIL, F.col("x"))}, "_at").select("img_id", (F.col("_b") > F.col("_t")).alias("_right"))
    every = (selected if pool is None else pool).select("img_id", "class_id").join(own, "img_id")
    most = R.majority(every, "class_id", F.col("_right"), "_most")
    marked = selected.join(own, "img_id", "left").join(most, "class_id", "left")
    return marked.withColumn("hflip", F.coalesce(~F.col("_right"), ~F.col("_most"), F.lit(False))).drop("_right", "_most")
