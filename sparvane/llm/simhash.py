"""SimHash near-duplicates: fingerprints, a segment-popcount embedding, a grid join, components.

A fingerprint's 64 bits are 32 segments of two bits; the counts of set bits in them embed
it in {0,1,2}^32, where Manhattan distance is at most Hamming distance. For links at up to
3 differing bits the segments are dealt into 6 groups: at most 3 groups can differ, so two
linked points share the cell that some 3 whole groups make. Each point is put into its
C(6,3) = 20 cells; within a cell Manhattan distance is tested first, then the exact one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, guarded, materialize, ship
from .words import SPACED, words

SEED, WIDTH = 42, 3
_ODD = np.uint64(0x5555555555555555)


def _bits(data: bytes) -> np.ndarray:
    """Counts of set bits, place by place from the lowest, over the hashes of a text's shingles; then their number."""
    own = words(data, SPACED)
    if not own:
        return np.zeros(65, np.int64)
    line = b" ".join(own)
    if len(own) < WIDTH:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
        starts = np.concatenate(([0], ends[: -WIDTH])).tolist()
        digest, seed = xxhash.xxh64_intdigest, SEED
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, (ends[WIDTH - 1 :] - 1).tolist(), strict=True)]
    total = np.zeros(65, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        total[:64] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    total[64] = len(hashes)
    return total


def fingerprint(data: bytes) -> int:
    bits = _bits(data)
    value = np.packbits(bits[:64] * 2 > bits[64], bitorder="little").view("<u8")[0]
    return int(value)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        prints = np.array([fingerprint(texts[i].as_py() or b"") for i in range(len(batch))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(prints.view(np.int64))], ["doc_id", "digest", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fp), one row for each row of docs: fp the 64 bits as a signed long, digest a hash of the text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    return rows.mapInArrow(_fingerprints, "doc_id long, digest long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """The 32 popcounts of two-bit segments, two bits each in one word."""
    return fp - ((fp >> np.uint64(1)) & _ODD)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of embedded points: |x - y| of values 0..2, summed over the segments.

    Differing values differ by 2 where one is 0 (00) and the other 2 (10), else by 1.
    """
    d = a ^ b
    low, high = d & _ODD, (d >> np.uint64(1)) & _ODD
    # 00/10: only the high bit differs, by 2; 01/10: both differ, by 1; 00/01: the low one, by 1
    return np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low)


def cell_masks(most: int = 3, groups: int | None = None) -> list[int]:
    """The segments that a cell fixes, as bit masks, for links at up to `most` differing bits."""
    groups = groups or 2 * most
    part = [sum(3 << 2 * s for s in range(32) if s % groups == g) for g in range(groups)]
    return [sum(part[g] for g in kept) for kept in itertools.combinations(range(groups), groups - most)]


def _forest(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect all that links within a cell connect, at most len(fp) - 1 of them.

    Whatever has been reached leaves the rest at once, so a dense cell takes few rounds.
    """
    links: list[tuple[int, int]] = []
    rest, points = fp.copy(), embed(fp)
    limit = np.uint8(most)
    while len(rest) > 1:
        front, front_at = [rest[0]], [points[0]]
        rest, points = rest[1:], points[1:]
        while front and len(rest):
            one, at = front.pop(), front_at.pop()
            near = np.flatnonzero(manhattan(points, at) <= limit)
            if len(near):
                near = near[np.bitwise_count(rest[near] ^ one) <= limit]
            if len(near):
                links += [(int(one), int(x)) for x in rest[near]]
                front += list(rest[near])
                front_at += list(points[near])
                keep = np.ones(len(rest), bool)
                keep[near] = False
                rest, points = rest[keep], points[keep]
    return links


def _between(a: np.ndarray, b: np.ndarray, most: int) -> list[tuple[int, int]]:
    """For each of a, its links to b that join something new: a forest over the two blocks."""
    links: list[tuple[int, int]] = []
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    points = embed(b)
    for one in a:
        near = np.flatnonzero(manhattan(points, embed(one)) <= most)
        for x in b[near[np.bitwise_count(b[near] ^ one) <= most]]:
            u, v = root(int(one)), root(int(x))
            if u != v:
                parent[u] = v
                links.append((int(one), int(x)))
    return links


def _links(most: int):
    def find(batches):
        """Rows come sorted by (cell, mask, left, right, side); a group is a cell, or a pair of a large cell's blocks."""
        held: list[pa.RecordBatch] = []

        def groups(table):
            key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("cell", "mask", "left", "right")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            return [0, *cuts.tolist(), key.shape[1]]

        def done(table, cuts):
            fp, side = table.column("fp").to_numpy().view(np.uint64), table.column("side").to_numpy()
            links = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2:
                    continue
                if side[b - 1] == 0:
                    links += _forest(fp[a:b], most)
                else:
                    cut = a + int(np.searchsorted(side[a:b], 1))
                    links += _between(fp[a:cut], fp[cut:b], most)
            pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            cuts = groups(table)
            if len(cuts) > 2:
                last = cuts[-2]
                yield done(table.slice(0, last).combine_chunks(), cuts[:-1])
                held = table.slice(last).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield done(table, groups(table))

    return find


def links(prints: DataFrame, most: int = 3, block: int = 20_000) -> DataFrame:
    """(u, v): links of distinct fingerprints that connect exactly what all links connect.

    prints has one row per distinct fp. A cell of more than `block` points is cut into
    blocks by hash; pairs of blocks are compared in tasks of their own, so that a task's rows stay
    bounded however many points meet in a cell, and no link is left out.
    """
    ship(prints.sparkSession)
    masks = cell_masks(most)
    # the embedding in SQL: of bits h and l, the count's high bit is h & l, its low bit h ^ l
    odd, down = F.lit(int(_ODD)), F.shiftrightunsigned("fp", 1)
    both, one = F.col("fp").bitwiseAND(down).bitwiseAND(odd), F.col("fp").bitwiseXOR(down).bitwiseAND(odd)
    point = F.shiftleft(both, 1).bitwiseOR(one)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    cells = prints.select("fp", point.alias("p")).select("fp", "p", F.posexplode(F.array(*[F.lit(m) for m in signed])).alias("mask", "m"))
    cells = cells.select(F.col("p").bitwiseAND(F.col("m")).alias("cell"), F.col("mask").cast("int").alias("mask"), "fp")
    large = cells.groupBy("cell", "mask").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    large = materialize(large.select("cell", "mask", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "simhash-large")
    rows = cells.select("cell", "mask", F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(0).alias("side"), "fp")
    if not large.isEmpty():
        small = rows.join(large, ["cell", "mask"], "left_anti")
        cut = cells.join(large, ["cell", "mask"]).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("b"), o).alias("left"), F.greatest(F.col("b"), o).alias("right"), (F.col("b") > o).cast("int").alias("side")))
        spread = cut.select("cell", "mask", F.explode(pairs).alias("x"), "fp").select("cell", "mask", "x.left", "x.right", "x.side", "fp")
        rows = small.unionByName(spread)
    keys = ["cell", "mask", "left", "right"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "side")
    return rows.mapInArrow(_links(most), "u long, v long")


def components(edges: DataFrame, least: str = "x") -> DataFrame:
    """(node, root) for every node of edges (u, v), root the smallest node it reaches.

    Alternates large-star and small-star steps (each node hands its larger, then its
    smaller neighbours to the smallest it knows) until nothing changes. Each step is cut off by a table in the
    shared folder.
    """
    norm = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = materialize(norm(edges), "components")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(norm(large), "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").filter("v <> m").unionByName(low.select(F.col("u").alias("v"), "m"))
        last, now = now, materialize(norm(small.select(F.col("v").alias("u"), F.col("m").alias("v"))), "components")
        discard(last, large)
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == mark:
            break
        mark = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _named(docs: DataFrame, most: int, block: int) -> DataFrame:
    """(doc_id, digest, fp, component_id, root) for each row; root is a fingerprint of the component."""
    prints = materialize(fingerprints(docs), "simhash")
    per = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    groups = components(links(per, most, block)).withColumnRenamed("node", "fp")
    # a component is named by its least doc_id, whatever the order of its fingerprints
    roots = per.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(roots.join(names, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, most: int = 3, block: int = 20_000) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs.

    Null and empty texts and texts of white space have fingerprint zero and link like any
    other. component_id is the smallest doc_id that links reach; null where only rows
    without doc_id are reached. Equal rows get equal results; no rows give none.
    """
    named = _named(docs, most, block)
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, most: int = 3, block: int = 20_000) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null last), then of the least text hash."""
    docs, renamed = guarded(docs, ("doc_id", "text"))
    named = materialize(_named(docs, most, block).select("root", "doc_id", "digest"), "simhash-named")
    kept = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("k"), F.count(F.lit(1)).alias("_n"))
    kept = materialize(kept.select(F.col("k.doc_id").alias("_id"), F.col("k.digest").alias("_digest"), "_n"), "simhash-kept")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_digest"))
    out = docs.join(kept.select("_id", "_digest"), same, "left_semi")
    again = named.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_semi")
    if not again.isEmpty():  # rows of one id and one text are one document
        out = out.withColumn("_digest", F.xxhash64("text")).dropDuplicates(["doc_id", "_digest"]).drop("_digest")
    return renamed(out)
