"""Mixing sources to target weights.

Every document gets a hash-random key; documents are sorted by it within their source,
distributed prefix sums of word counts follow that order, and each source is cut at its
exact budget of words, after as many whole epochs as the budget holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import copies_of, guarded, materialize, prefix_sums

WORD = r"[^\x20\x09-\x0D]+"
_KEYS = 1 << 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(doc_id: Column, text: Column, seed: str) -> Column:
    """Uniform in [0, 2**60)."""
    digest = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))), F.lit(seed)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """One row per source: source, n_docs, source_size, target, epochs, rest.

    Sources in code-point order, null last, weigh weights[0], weights[1], ... in rotation.
    Targets share `share` times all words by weight, none above `repeats` times its
    source's words; what exceeds that goes to the others by weight. That is a water level
    L with target = min(repeats * size, L * weight): sources full at the level come first
    in order of size / weight, and L is what they leave over the weight that remains.
    A row of `sizes` stands for `copies` documents where it has that column. A source without words gets target 0. `epochs` whole passes and `rest` words of one
    more make up floor(target). Needs share <= repeats.
    """
    if share > repeats:
        raise ValueError("share must not exceed repeats")
    if "copies" not in sizes.columns:
        sizes = sizes.withColumn("copies", F.lit(1))
    per = sizes.groupBy("source").agg(F.sum("copies").alias("n_docs"), F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    ranked = per.withColumn("_at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weigh = F.element_at(F.array(*map(F.lit, weights)), (F.col("_at") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weigh.cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("_w"), "_at")
    full = order.rowsBetween(Window.unboundedPreceding, -1)
    left = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(Window.partitionBy()) - repeats * F.coalesce(F.sum("source_size").over(full), F.lit(0))) / F.sum("_w").over(left)
    cap = (repeats * F.col("source_size")).cast("double")
    levels = ranked.withColumn("_level", level.cast("double")).withColumn("_open", F.col("_level") * F.col("_w") < cap)
    # the level with the sources before it full is right for the first source that it leaves open; later ones get less
    water = F.max(F.when(F.col("_open"), F.col("_level"))).over(Window.partitionBy())
    target = F.when(water.isNull() | (cap <= water * F.col("_w")), cap).otherwise(water * F.col("_w"))
    out = levels.withColumn("target", target).drop("_at", "_w", "_level", "_open")
    words = F.floor("target").cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    return out.withColumn("epochs", F.floor(words / size).cast("long")).withColumn("rest", words - F.col("epochs") * size)


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, epochs, rest, before, taken), one row for each row of docs.

    `before` is the number of the source's words ahead of the document, `taken` the words
    that the mix takes of it, repeats counted. Null or empty texts have size 0 and add
    nothing. A null source is a source; null doc_ids and repeated rows are documents like
    any other (equal rows are interchangeable, so reruns agree). No rows give no rows.
    The order is md5(doc_id:md5(text):seed), then doc_id and text digest.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    sized = materialize(sized.groupBy("source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    targets = source_targets(sized, weights, share, repeats).withColumnRenamed("source", "_source")
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_rank", F.col("key") / _KEYS).withColumn("_words", F.col("size") * F.col("copies"))
    rows = prefix_sums(rows, ["source"], [F.col("key"), F.col("doc_id")], "_words", "_rank", "n_docs", "before").drop("_rank", "n_docs", "_words")
    rows = copies_of(rows, "copies", "_copy")
    rows = rows.withColumn("before", F.col("before") + F.col("_copy") * F.col("size")).drop("_copy", "copies")
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return rows.withColumn("taken", F.col("epochs") * F.col("size") + last)


def _cut(rows: DataFrame) -> DataFrame:
    """One row per source: epochs and the place at which its last, partial epoch ends."""
    open_ = F.col("before") < F.col("rest")
    per = rows.groupBy("source").agg(
        F.first("epochs").alias("_epochs"),
        F.max(F.when(open_, F.struct("key", "doc_id", "before"))).alias("_last"),
        F.first("rest").alias("_rest"),
    ).withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("key").eqNullSafe(F.col("_last.key")) & F.col("doc_id").eqNullSafe(F.col("_last.doc_id"))
    ties = rows.join(per, same, "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("_ties"), F.min("before").alias("_from")).withColumnRenamed("source", "_t")
    return per.join(ties, F.col("_source").eqNullSafe(F.col("_t")), "left").drop("_t")


def mixture(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, most_sources: int = 10_000) -> DataFrame:
    """The mixed documents themselves: docs' columns, a row for each time that a document is taken.

    Each whole epoch gives every document of the source once; the last, partial epoch
    gives those before the cut, and the one on the cut with the words up to it. Documents
    without words come in each epoch that passes their place. The cuts, a row per source,
    are broadcast up to `most_sources` sources and joined by shuffle beyond that.
    """
    docs, named = guarded(docs, ("doc_id", "text", "source", "n_chars"))
    cuts = materialize(_cut(mix(docs, seed, weights, share, repeats)), "mix-cuts")
    n, ties = cuts.agg(F.count(F.lit(1)), F.max("_ties")).first()
    size, digest = word_count(F.col("text")), _key(F.col("doc_id"), F.col("text"), seed)
    side = F.broadcast(cuts) if n <= most_sources else cuts
    rows = docs.withColumn("_key", digest).join(side, docs["source"].eqNullSafe(F.col("_source")))
    last, key, doc_id = F.col("_last"), F.col("_key"), F.col("doc_id")
    tie = F.coalesce(key == last["key"], F.lit(False)) & doc_id.eqNullSafe(last["doc_id"])
    ahead = F.coalesce((key < last["key"]) | ((key == last["key"]) & ((doc_id < last["doc_id"]) | (doc_id.isNull() & last["doc_id"].isNotNull()))), F.lit(False))
    rows = rows.withColumn("_tie", tie).withColumn("_ahead", ahead)
    if (ties or 0) > 1:  # equal rows on the cut: the first of them, whichever, are taken
        at = rows.filter("_tie").withColumn("_n", F.row_number().over(Window.partitionBy("_source").orderBy("_key")) - 1)
        rows = rows.filter("not _tie").withColumn("_n", F.lit(0)).unionByName(at)
    else:
        rows = rows.withColumn("_n", F.lit(0))
    left = F.col("_rest") - F.col("_from") - F.col("_n") * size
    part = F.when(F.col("_ahead"), size).when(F.col("_tie"), F.greatest(F.lit(0), F.least(size, left)))
    more = F.col("_ahead") | (F.col("_tie") & (left > 0))
    rows = rows.withColumn("_part", part).withColumn("_size", size).withColumn("_more", more)
    copies = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_epochs").cast("int"))))
    copies = copies.filter((F.col("_copy") < F.col("_epochs")) | F.col("_more"))
    short = (F.col("_copy") == F.col("_epochs")) & (F.col("_part") < F.col("_size"))
    start = F.concat_ws("", F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0)), F.lit(1), F.col("_part").cast("int")))
    copies = copies.withColumn("text", F.when(short, start).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        copies = copies.withColumn("n_chars", F.when(short, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return named(copies)
