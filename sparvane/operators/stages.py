"""Stages of runs from their log lines: the state of each stage, from a table or a stream, in whatever order lines come."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import progress

#: percent of a stage that has begun and told no more
BEGUN = 5


@dataclass(frozen=True)
class Stage:
    """`begins` is in a line that starts the stage, which ends those named in `ends`; `advances` is in a line of its progress, `done` in one that ends it."""

    name: str
    begins: str | None = None
    advances: str | None = None
    done: str | None = None
    ends: tuple[str, ...] = ()


ROWS = "run {run}, stage string, status string, percent double, started {at}, ended {at}, done long, total long, rate double, eta string"


def updates(lines: DataFrame, stages: Sequence[Stage], finish: str, failure: str) -> DataFrame:
    """(run, at, place, stage, kind, percent, done, total, rate, eta): what each line says of which stage; place orders what one line says.

    A line counts for the first of `stages` whose text it holds. kind is running, done, `begin` (running, and the run's current stage from here), `finish` (all
    stages but failed ones are done) or `fail` (the current stage has failed); the last two name no stage.
    """
    line = F.trim("line")
    has = lambda text: F.contains(line, F.lit(text))
    p = progress(line)
    none = F.lit(None)

    def row(place: int, stage: str | None, kind: Column | str, told: bool = False) -> Column:
        value = {"percent": p["percent"].cast("double"), "done": p["done"], "total": p["total"], "rate": p["rate"], "eta": p["eta"]} if told else {"percent": none.cast("double"), "done": none.cast("long"), "total": none.cast("long"), "rate": none.cast("double"), "eta": none.cast("string")}
        return F.struct(F.lit(place).alias("place"), F.lit(stage).cast("string").alias("stage"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), *[v.alias(k) for k, v in value.items()])

    said = None
    for s in stages:
        cases = []
        if s.begins:
            cases.append((has(s.begins), [*(row(i, e, "done") for i, e in enumerate(s.ends)), row(len(s.ends), s.name, "begin")]))
        if s.advances:
            cases.append((has(s.advances), [row(0, s.name, F.when(p["percent"] >= 100, F.lit("done")).otherwise(F.lit("running")), True)]))
        if s.done:
            cases.append((has(s.done), [row(0, s.name, "done")]))
        for test, rows in cases:
            said = F.when(test, F.array(*rows)) if said is None else said.when(test, F.array(*rows))
    said = said.when(has(finish), F.array(row(0, None, "finish")))
    failed = F.when(has(failure), F.array(row(100, None, "fail")))
    both = F.concat(F.coalesce(said, F.array_except(F.array(row(0, None, "none")), F.array(row(0, None, "none")))), F.coalesce(failed, F.array_except(F.array(row(0, None, "none")), F.array(row(0, None, "none")))))
    return lines.select("run", "at", F.inline(both))


def track(lines: DataFrame, stages: Sequence[Stage], finish: str, failure: str) -> DataFrame:
    """(run, stage, status, percent, started, ended, done, total, rate, eta): the state of every stage of each run after all lines (run, at, line).

    at orders a run's lines, so they may lie in any order. status is pending, running, done or error; percent is the last one told, 100 for an end that tells
    none and for what is done in the end, 5 for a start, at most 100. started is the first line of the stage, ended the line that ended it or in which it failed. Whatever a stage says
    counts once in an aggregate; only the few lines that begin a stage or tell a failure are ordered by run, to know which stage it was that failed.
    """
    said = updates(lines, stages, finish, failure)
    order = F.struct("at", "place")
    marks = said.filter(F.col("kind").isin("begin", "fail"))
    current = F.last(F.when(F.col("kind") == "begin", F.col("stage")), True).over(Window.partitionBy("run").orderBy("at", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    failed = marks.withColumn("stage", current).filter("kind = 'fail' AND stage IS NOT NULL")
    own = said.filter(~F.col("kind").isin("finish", "fail")).unionByName(failed)
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    told = F.coalesce(F.when(F.col("percent").isNotNull(), F.least(F.col("percent"), F.lit(100.0))), F.when(F.col("kind") == "done", F.lit(100.0)))
    per = own.groupBy("run", "stage").agg(
        F.max_by("kind", order).alias("kind"), F.max(order).alias("_last"), F.max_by(told, F.when(told.isNotNull(), order)).alias("percent"), F.min("at").alias("started"), *map(known, ("done", "total", "rate", "eta")),
    )
    finished = said.filter("kind = 'finish'").groupBy("run").agg(F.max(order).alias("_finish"))
    runs = lines.select("run").distinct()
    names = F.explode(F.array(*[F.lit(s.name) for s in stages]))
    every = runs.select("run", names.alias("stage")).join(per, ["run", "stage"], "left").join(finished, "run", "left")
    # all is done at the end but what has failed, unless a stage was told of after it
    closed = F.col("_finish").isNotNull() & (F.col("_last").isNull() | ((F.col("_finish") > F.col("_last")) & (F.col("kind") != "fail") & (F.col("kind") != "done")))
    status = F.when(closed, "done").when(F.col("kind").isNull(), "pending").when(F.col("kind") == "fail", "error").when(F.col("kind") == "done", "done").otherwise("running")
    percent = F.when(closed, 100.0).otherwise(F.coalesce("percent", F.when(F.col("kind").isNotNull(), F.lit(float(BEGUN))), F.lit(0.0)))
    ended = F.when(closed, F.col("_finish.at")).when(F.col("kind").isin("done", "fail"), F.col("_last.at"))
    return every.select("run", "stage", status.alias("status"), percent.alias("percent"), "started", ended.alias("ended"), "done", "total", "rate", "eta")


def _fold(state: dict, rows: pd.DataFrame) -> None:
    """Add a run's updates to its state: for each stage the first and last of each thing told, and the lines that begin stages or fail."""
    for r in rows.itertuples(index=False):
        at = [r.at, r.place]
        if r.kind == "finish":
            state["finish"] = max(state["finish"] or at, at)
        elif r.kind == "fail":
            state["fails"].append(at)
        else:
            if r.kind == "begin":
                state["begins"].append([*at, r.stage])
            s = state["stages"].setdefault(r.stage, {"last": at, "kind": r.kind, "started": r.at, "told": {}})
            s["started"] = min(s["started"], r.at)
            if at >= s["last"]:
                s["last"], s["kind"] = at, r.kind
            percent = min(float(r.percent), 100.0) if not pd.isna(r.percent) else 100.0 if r.kind == "done" else None
            for name, x in (("percent", percent), *((n, getattr(r, n)) for n in ("done", "total", "rate", "eta"))):
                if x is not None and not pd.isna(x) and at >= s["told"].get(name, [at])[0]:
                    s["told"][name] = [at, x if isinstance(x, str) else float(x)]


def _rows(run: object, state: dict, names: Sequence[str]) -> pd.DataFrame:
    kinds = {n: (s["kind"], s["last"]) for n, s in state["stages"].items()}
    started = {n: s["started"] for n, s in state["stages"].items()}
    for at in sorted(state["fails"]):
        begun = max((b for b in state["begins"] if b[:2] <= at), default=None)
        if begun:
            name = begun[2]
            started[name] = min(started[name], at[0])
            if at >= kinds[name][1]:
                kinds[name] = ("fail", at)
    out = []
    for n in names:
        kind, last = kinds.get(n, (None, None))
        told = {k: v[1] for k, v in state["stages"].get(n, {"told": {}})["told"].items()}
        closed = state["finish"] is not None and (kind is None or (state["finish"] > last and kind not in ("fail", "done")))
        status = "done" if closed or kind == "done" else {None: "pending", "fail": "error"}.get(kind, "running")
        percent = 100.0 if closed else told.get("percent", float(BEGUN) if kind else 0.0)
        ended = state["finish"][0] if closed else last[0] if kind in ("done", "fail") else None
        whole = lambda k: None if told.get(k) is None else int(told[k])  # noqa: B023, E731
        out.append((run, n, status, percent, started.get(n), ended, whole("done"), whole("total"), told.get("rate"), told.get("eta")))
    frame = pd.DataFrame(out, columns=["run", "stage", "status", "percent", "started", "ended", "done", "total", "rate", "eta"])
    return frame.astype({"started": "Int64", "ended": "Int64", "done": "Int64", "total": "Int64"})


def track_stream(lines: DataFrame, stages: Sequence[Stage], finish: str, failure: str) -> DataFrame:
    """track over a stream of (run, at long, line): after each micro-batch all stages of the runs that it told of.

    Lines may come in any order. A run's state is what was last told of each stage, and its lines that begin stages or tell failures. The latest
    rows of a run are those that track gives for the lines so far.
    """
    said, names = updates(lines, stages, finish, failure), [s.name for s in stages]
    kind = dict(lines.dtypes)["run"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = json.loads(state.get[0]) if state.exists else {"finish": None, "fails": [], "begins": [], "stages": {}}
        for b in batches:
            _fold(own, b)
        state.update((json.dumps(own),))
        yield _rows(key[0], own, names)

    return said.groupBy("run").applyInPandasWithState(step, ROWS.format(run=kind, at="long"), "state string", "update", GroupStateTimeout.NoTimeout)
