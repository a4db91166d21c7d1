"""Chat formatting by token-level assembly.

Header and text of each turn are encoded apart from each other and spliced between reserved
ids that no text can give, so a text can't open or close a turn. Control strings inside
texts are escaped too, reversibly, so that the decoded text is as safe as the ids. Places
in a conversation and the spans under the loss mask are prefix sums of the segments' lengths.

A turn reads  <|im_start|>role\\ntext<|im_end|>\\n  with the two control strings as one id each.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, ship
from .encoding import encoder

START, END = "<|im_start|>", "<|im_end|>"
_OPENS, _OPENED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No <| remains: one backslash more goes between the signs, however many are there."""
    return _OPENS.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _OPENED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Escaped, and on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def _encode(definition, loss_roles: tuple[str, ...]):
    """Rows come sorted by conversation and turn; `at` counts the ids of the conversation's turns before, within the partition."""

    def run(batches):
        tool = encoder(definition.value, controls=False)
        base, part = tool.tokenizer.get_vocab_size(), TaskContext.get().partitionId()
        opens, line = np.array([base], np.int32), tool.encode(pa.array(["\n"]))[0].astype(np.int32)
        closes = np.concatenate(([base + 1], line)).astype(np.int32)
        headers: dict[str, np.ndarray] = {}
        conv, at = None, 0
        for batch in batches:
            roles, convs = [r or "" for r in batch.column("role").to_pylist()], batch.column("conv_id").to_pylist()
            texts, ends = encoder(definition.value, controls=False).encode(pa.array([escape(t or "") for t in batch.column("text").to_pylist()], pa.string()))
            texts = texts.astype(np.int32)
            for r in set(roles).difference(headers):
                headers[r] = tool.encode(pa.array([escape_role(r) + "\n"]))[0].astype(np.int32)
            parts, places, first, size, lengths = [], [], [], [], []
            for own, role, a, b in zip(convs, roles, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if own != conv:
                    conv, at = own, 0
                head = headers[role]
                parts += [opens, head, texts[a:b], closes]
                places.append(at)
                first.append(1 + len(head))
                size.append(b - a if role in loss_roles else 0)
                lengths.append(1 + len(head) + b - a + len(closes))
                at += lengths[-1]
            stops = np.cumsum([0, *lengths]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
            numbers = [pa.array(x, pa.int64()) for x in (places, lengths, first, size)]
            columns = [batch.column("conv_id"), pa.array(np.full(len(convs), part, np.int32)), pa.ListArray.from_arrays(pa.array(stops), pa.array(flat)), *numbers]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "ids", "at", "n_ids", "text_at", "n_loss"])

    return run


def format_chat(turns: DataFrame, tokenizer: str, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, start, ids, loss_start, loss_end), a row for each turn, over a table of the shared folder.

    start is the turn's first place in its conversation; ids [loss_start, loss_end) of the
    conversation are under the loss mask (nothing where the two are equal). Turns go by
    turn, nulls first, ties by role and text; equal turns repeat. Null texts and roles are
    empty; a null conv_id is a conversation. No rows give none. Ids above the tokenizer's
    vocabulary stand for the control strings: its size for the start of a turn, then its end.

    Turns are dealt by ranges of conversation, turn, role and a text's first characters, so a large
    conversation spans partitions. Lengths are summed within a partition as it is encoded, then
    over a conversation's partitions: only one that goes on from the partition before
    has ids ahead of it there, so the table of those, which is broadcast, has a row for each partition at most.
    """
    spark = turns.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(32))).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, part int, ids array<int>, at long, n_ids long, text_at long, n_loss long"
    coded = materialize(dealt.mapInArrow(_encode(definition, loss_roles), schema), "chat-turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = coded.groupBy("part", "conv_id").agg(F.sum("n_ids").alias("_n")).select(F.col("part").alias("_part"), F.col("conv_id").alias("_conv"), F.sum("_n").over(before).alias("_ahead"))
    ahead = materialize(ahead.filter("_ahead > 0"), "chat-ahead")
    placed = coded.join(F.broadcast(ahead), (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    start = F.col("at") + F.coalesce("_ahead", F.lit(0))
    first = start + F.col("text_at")
    return placed.select("conv_id", start.alias("start"), "ids", first.alias("loss_start"), (first + F.col("n_loss")).alias("loss_end"))


def _read(definition):
    def run(batches):
        tool = encoder(definition.value, controls=False)
        base = tool.tokenizer.get_vocab_size()
        line = len(tool.encode(pa.array(["\n"]))[0])
        empty = True
        conv = turns = said = loss = loss_chars = chars = None

        def row():
            return pa.RecordBatch.from_pylist([{"conv_id": conv, "n_turns": turns, "turns_sha256": said.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}], _DIGEST)

        for batch in batches:
            lists = batch.column("ids")
            ids, cuts = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            cuts = (cuts - cuts[0]).tolist()
            text_of = encoder(definition.value, controls=False).texts(ids)
            for i, (conv_id, start, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "start", "loss_start", "loss_end")), strict=True)):
                first, end = cuts[i], cuts[i + 1]
                if empty or conv_id != conv:
                    if not empty:
                        yield row()
                    empty, conv, turns, said, loss, loss_chars, chars = False, conv_id, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                if ids[first] != base or ids[end - 1 - line] != base + 1:
                    raise ValueError("a turn without its control ids")
                role, _, text = text_of(first + 1, end - 1 - line).partition("\n")
                chars += len(START) + len(role) + 1 + len(text) + len(END) + 1
                said.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                if b > a:
                    own = unescape(text_of(first + a - start, first + b - start))
                    loss.update(own.encode())
                    loss_chars += len(own)
                turns += 1
        if not empty:
            yield row()

    return run


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation, what its ids say: turns, loss text, lengths and digests.

    A digest runs over a conversation in order, so its turns pass one task, as a stream
    that holds one turn at a time.
    """
    spark: SparkSession = formatted.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "start").mapInArrow(_read(definition), schema)
