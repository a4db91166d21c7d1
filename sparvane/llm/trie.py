"""Prefix trie of conversations: merged partial tries, then a bottom-up rollup.

A prefix is named by a fingerprint that can be put together from parts: turns' digests are
the digits of a number to a fixed base, modulo a prime of 127 bits. So partitions work
through their own turns, and a conversation that goes on from one partition to the next takes
up the number of what lay before, however long it is.

Each partition combines its turns into node tables. Tables are merged by node, those of `FAN` partitions to one
at a time, until one is left. The lists of conversations that end at a node are merged as sorted
runs of their text, of which only nodes that span partitions need more than one. Sums over
subtrees come in log2(depth) rounds: after round k a node has the sums of all within
2^k levels below it and points 2^k levels up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, ship
from .words import SPACED, pieces

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"conversation prefix").digest()[:15], "big")
ROOT = bytes(16)
FAN = 16
_HELD_NODES = 100_000
_CHUNK = 1 << 16


def digit(role: str, text: str) -> int:
    """A turn as a digit; the role's length keeps the two apart."""
    r = role.encode()
    h = hashlib.sha256(len(r).to_bytes(8, "big") + r)
    h.update(text.encode())
    return 1 + int.from_bytes(h.digest()[:16], "big") % (PRIME - 1)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn: each one's digit, words and place among its partition's turns of the conversation."""
    part, conv, at = TaskContext.get().partitionId(), None, -1
    first = True
    for batch in batches:
        convs, places, digits, words = batch.column("conv_id").to_pylist(), [], [], []
        for own, role, text in zip(convs, batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            at = at + 1 if own == conv and not first else 0
            conv, first = own, False
            places.append(at)
            digits.append(digit(role, text).to_bytes(16, "big"))
            words.append(sum(map(len, pieces(text.encode(), SPACED))))
        n = len(convs)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([part] * n, pa.int32()), pa.array(places, pa.int64()), pa.array(digits, pa.binary()), pa.array(words, pa.int64())], ["conv_id", "part", "at", "digit", "words"])


def number_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digit, words) for each row of conversations (conv_id, turn, role, text); pos counts from 0.

    Turns go by turn, null first, ties by role and text; null roles and texts are empty; repeated rows are turns of their own.
    Rows are dealt by ranges, so that a large conversation spans partitions; where it goes on, the partitions before are counted
    ahead of it, in a table of a row for each partition at most.
    """
    ship(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(32))).sortWithinPartitions("conv_id", "turn", "role", "text")
    turns = materialize(dealt.mapInArrow(_turns, "conv_id long, part int, at long, digit binary, words long"), "trie-turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = turns.groupBy("part", "conv_id").agg(F.count("*").alias("_n")).select(F.col("part").alias("_part"), F.col("conv_id").alias("_conv"), F.sum("_n").over(before).alias("_ahead")).filter("_ahead > 0")
    placed = turns.join(F.broadcast(ahead), (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    out = materialize(placed.select("conv_id", (F.col("at") + F.coalesce("_ahead", F.lit(0))).alias("pos"), "digit", "words"), "trie-numbered")
    discard(turns)
    return out


def base_of(conv_id: Column, group: int = 20) -> Column:
    """The conversation whose first turns a conversation takes over."""
    return conv_id - conv_id % group


def taken_turns(conv_id: Column, most: int = 4) -> Column:
    """How many turns it takes over: the unsigned crc32 of its decimal id modulo `most`."""
    return F.crc32(conv_id.cast("string").cast("binary")) % most


def rebuild(turns: DataFrame, convs: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, pos, digit, words) of the rebuilt conversations: the first turns of the base, then a conversation's own after as many.

    A null conv_id is a conversation without a base that keeps all its turns.
    """
    heads = turns.filter((F.col("pos") < most - 1) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("_base"), "pos", "digit", "words")
    taking = convs.select("conv_id", base_of(F.col("conv_id"), group).alias("_base"), taken_turns(F.col("conv_id"), most).alias("_taken")).filter("_taken > 0")
    head = taking.join(heads, "_base").filter(F.col("pos") < F.col("_taken")).select("conv_id", "pos", "digit", "words")
    own = turns.filter(F.col("conv_id").isNull() | (F.col("pos") >= taken_turns(F.col("conv_id"), most)))
    return head.unionByName(own)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place: the number that a partition's turns of the conversation make up to here and before here, and whether it is the last of them."""
    part, value, at = TaskContext.get().partitionId(), 0, 0
    held: tuple | None = None  # the row before: only the next one tells whether it is a last one
    for batch in batches:
        out = []
        for conv, digit, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digit", "words")), strict=True):
            if held and held[0] == conv:
                out.append((*held, False))
            else:
                if held:
                    out.append((*held, True))
                value = at = 0
            before, value, at = value, (value * BASE + int.from_bytes(digit, "big")) % PRIME, at + 1
            held = (conv, part, at, before.to_bytes(16, "big"), value.to_bytes(16, "big"), words)
        yield _chain_rows(out)
    yield _chain_rows([(*held, True)] if held else [])


_CHAIN = "conv_id long, part int, at long, before binary, value binary, words long, is_last boolean"


def _chain_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "part", "at", "before", "value", "words", "is_last"])


def _ahead(rows: list) -> dict:
    """(part, conv_id) -> turns ahead, their number, whether the conversation ends there: for conversations of more than one partition.

    rows: a conversation's last row of each partition, sorted by conversation and partition.
    """
    out, conv, n, value, last = {}, object(), 0, 0, None
    for r in rows:
        if r.conv_id != conv:
            conv, n, value = r.conv_id, 0, 0
        elif last is not None:
            out[last] = (*out[last][:2], False)
        out[r.part, conv] = (n, value, True)
        n, value, last = n + r.at, (value * pow(BASE, r.at, PRIME) + int.from_bytes(r.value, "big")) % PRIME, (r.part, conv)
    return out


def _partial(shared):
    """Partial tries: each row gives its node, and the end of its conversation if it is the last one. A node's rows of a task become one, whatever their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, part = shared.value, TaskContext.get().partitionId()
        nodes: dict[bytes, list] = {}

        def table(rows: dict[bytes, list], ends: list[tuple[bytes, int | None]]) -> pa.RecordBatch:
            keys, pad = [*rows, *(k for k, _ in ends)], [None] * len(ends)
            columns = [pa.array([*(v[i] for v in rows.values()), *pad], kind) for i, kind in enumerate((pa.binary(), *[pa.int64()] * 4))]
            own = pa.array([None] * len(rows) + [c for _, c in ends], pa.int64())
            flags = pa.array([False] * len(rows) + [True] * len(ends), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *columns, flags, own, pa.array([part] * len(keys), pa.int32())], ["node", "parent", "depth", "words", "conv_id", "n_convs", "is_end", "end_conv", "part"])

        for batch in batches:
            ends = []
            for conv, p, at, before, value, words, is_last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "at", "before", "value", "words", "is_last")), strict=True):
                n, value_ahead, closes = ahead.get((p, conv), (0, 0, True))
                if n:
                    before, value = (((value_ahead * pow(BASE, k, PRIME) + int.from_bytes(x, "big")) % PRIME).to_bytes(16, "big") for k, x in ((at - 1, before), (at, value)))
                found = nodes.get(value)
                if found is None:
                    nodes[value] = [before, n + at, words, conv, 1]
                else:
                    found[4] += 1
                    if found[3] is None or conv is not None and conv < found[3]:
                        found[3] = conv
                if is_last and closes:
                    ends.append((value, conv))
            full = nodes if len(nodes) >= _HELD_NODES else {}
            yield table(full, ends)
            if full:
                nodes = {}
        yield table(nodes, [])

    return run


_PARTIAL = "node binary, parent binary, depth long, words long, conv_id long, n_convs long, is_end boolean, end_conv long, part int"


def merge(tables: DataFrame, parts: int) -> DataFrame:
    """One row a node: partitions' tables are merged by node, FAN to one at a time. What a node's name settles goes with it as part of the key."""
    key = ["node", "parent", "depth", "words"]

    def sums(keys: list[str]) -> DataFrame:
        return tables.groupBy(*keys).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))

    while parts > FAN:
        tables, parts = tables.withColumn("part", F.expr(f"part div {FAN}")), -(-parts // FAN)
        tables = sums([*key, "part"])
    return sums(key)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and conversation: text of about _CHUNK bytes at a time, each with its place."""
    part, seq = TaskContext.get().partitionId(), 0
    node, text, size = None, [], 0
    for batch in batches:
        out = []
        for own, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if own != node or size >= _CHUNK:
                if text:
                    out.append((node, part, seq, ",".join(text)))
                    seq += 1
                node, text, size = own, [], 0
            text.append("" if conv is None else str(conv))
            size += len(text[-1]) + 1
        yield _run_rows(out)
    yield _run_rows([(node, part, seq, ",".join(text))] if text else [])


def _run_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["node", "part", "seq", "run"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and place: the SHA-256 of a node's runs, comma-joined, as a stream."""
    node, h = None, None

    def row():
        return [(node, h.hexdigest())]

    for batch in batches:
        out = []
        for own, run in zip(batch.column("node").to_pylist(), batch.column("run").to_pylist(), strict=True):
            if own != node:
                if h:
                    out += row()
                node, h = own, hashlib.sha256(run.encode())
            else:
                h.update(b"," + run.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], ["node", "ends_sha256"])
    out = row() if h else []
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], ["node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id) rows: ids ascending, null first and written as nothing, comma-joined.

    Ranges of node and id sort and join the ids on all machines. A digest runs over its node's list in
    order, so the runs of text, not the rows, pass one task, which holds one at a time.
    """
    runs = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_runs, "node binary, part int, seq long, run string")
    return runs.repartition("node").sortWithinPartitions("node", "part", "seq").select("node", "run").mapInArrow(_digest, "node binary, ends_sha256 string")


def rollup(nodes: DataFrame) -> DataFrame:
    """nodes with n_children, n_leaves and saved_tokens, by doubling: each round adds what a node's pointers from below bring and doubles the pointers."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    start = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    table = materialize(start.select("*", F.when(F.col("depth") > 0, F.col("parent")).alias("up"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), "trie-rollup")
    reach = 1
    while reach <= deepest:
        below = table.filter("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        farther = table.filter("up IS NOT NULL").select(F.col("node").alias("_at"), F.col("up").alias("_up"))
        # a node of depth `reach` points at the root, which points nowhere: only deeper ones look farther
        out = table.withColumn("_seek", F.when(F.col("depth") > reach, F.col("up"))).join(farther, F.col("_seek") == F.col("_at"), "left").join(below, "node", "left")
        out = out.select(*[c for c in table.columns if c not in ("up", "n_leaves", "saved_tokens")], F.col("_up").alias("up"), (F.col("n_leaves") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("_saved", F.lit(0))).alias("saved_tokens"))
        out = materialize(out, "trie-rollup")
        discard(table)
        table, reach = out, 2 * reach
    return table


def prefix_trie(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """A row for each prefix of the rebuilt conversations: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations has conv_id, turn, role, text, and whatever else. How turns are ordered, and what nulls mean, is in number_turns and
    rebuild; a null conv_id counts as a member and is nobody's smallest member while there is another. The root's parent is null. No rows
    give no nodes, not even a root.
    """
    spark = conversations.sparkSession
    turns = number_turns(conversations)
    convs = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")), "trie-convs")
    dealt = rebuild(turns, convs, group, most).repartitionByRange("conv_id", "pos").sortWithinPartitions("conv_id", "pos")
    chain = materialize(dealt.mapInArrow(_chain, _CHAIN), "trie-chain")
    discard(turns)

    # a conversation's last row of each partition; those of conversations in several come to the driver, two rows a partition at most
    tails = chain.filter("is_last").select("conv_id", "part", "at", "value")
    several = tails.groupBy(F.col("conv_id").alias("_conv")).count().filter("count > 1")
    ahead = _ahead(sorted(tails.join(several, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi").collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.part)))
    partial = materialize(chain.mapInArrow(_partial(spark.sparkContext.broadcast(ahead)), _PARTIAL), "trie-partial")
    discard(chain)

    parts = 1 + (partial.agg(F.max("part")).first()[0] or 0)
    root = convs.groupBy().agg(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    merged = materialize(merge(partial.filter(~F.col("is_end")), parts).unionByName(root), "trie-nodes")
    nodes = rollup(merged)
    discard(merged)
    turnless = convs.filter(F.col("conv_id").isNotNull() & (F.col("n_turns") <= taken_turns(F.col("conv_id"), most)))
    turnless = turnless.join(convs.select(F.col("conv_id").alias("_base")), base_of(F.col("conv_id"), group) == F.col("_base"), "left_anti")
    ends = partial.filter("is_end").select("node", F.col("end_conv").alias("conv_id")).unionByName(turnless.select(F.lit(ROOT).alias("node"), "conv_id"))

    above = nodes.select(F.col("node").alias("_node"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(above, F.col("parent") == F.col("_node"), "left").join(end_digests(ends), "node", "left")
    nobody = hashlib.sha256().hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))
