"""String functions over columns: slugs, keyword groups, file names, progress lines."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slugify(text: Column, default: str = "attr") -> Column:
    """Lower-case, runs of anything but a-z and 0-9 as one underscore, none at the ends; `default` if nothing is left."""
    slug = F.btrim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def attribute_label(attr_id: Column, name: Column) -> Column:
    return F.format_string("attr_%03d__%s", attr_id, slugify(name))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def output_name(img_id: Column, path: Column) -> Column:
    """Five digits at least, never cut (lpad would cut a sixth), and the file's own name."""
    return F.format_string("%05d_%s", img_id, basename(path))


def short_class(name: Column) -> Column:
    """What follows the last dot, underscores as spaces."""
    return F.replace(F.element_at(F.split(name, r"\."), -1), F.lit("_"), F.lit(" "))


def matches_any(text: Column, keywords: Sequence[str]) -> Column:
    """Whether any keyword stands in the text, in whatever case; false for null."""
    return F.coalesce(text.rlike("(?i)" + "|".join(map(re.escape, keywords))), F.lit(False))


def keyword_groups(names: DataFrame, key: str, text: str, groups: dict[str, Sequence[str]]) -> DataFrame:
    """(group, ids): sorted ids of the names that a group's keywords match."""
    hit = F.explode(F.filter(F.array(*[F.when(matches_any(F.col(text), words), F.lit(g)) for g, words in groups.items()]), lambda x: x.isNotNull()))
    return names.select(key, hit.alias("group")).groupBy("group").agg(F.array_sort(F.collect_set(key)).alias("ids"))


def contains_fold(text: Column, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit(needle.lower())), F.lit(False))


def numbers(text: str, kind: type = float) -> list:
    """A comma-separated list; blanks are passed over."""
    return [kind(x) for x in map(str.strip, text.split(",")) if x]


def progress(line: Column) -> Column:
    """struct(percent, done, total, rate, eta) read from a progress line; parts it lacks are null."""
    number = lambda pattern, kind: F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).cast(kind)
    return F.struct(
        number(r"(\d{1,3})%", "int").alias("percent"), number(r"(\d+)/\d+", "long").alias("done"), number(r"\d+/(\d+)", "long").alias("total"),
        number(r"([0-9.]+)\s*it/s", "double").alias("rate"), F.nullif(F.regexp_extract(line, r"<([0-9:]+)", 1), F.lit("")).alias("eta"),
    )
