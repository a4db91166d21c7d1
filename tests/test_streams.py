import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparvane.operators import retrieval, stages
from sparvane.operators.store import Store
from sparvane.streaming import prototypes

STAGES = [
    stages.Stage("read", begins="STEP 1:"), stages.Stage("crop", begins="STEP 2:", done="[OK] cropped", ends=("read",)),
    stages.Stage("features", begins="STEP 3:", ends=("crop",)), stages.Stage("tier one", advances="Tier 1 -"), stages.Stage("tier two", advances="Tier 2 -"),
    stages.Stage("index", begins="STEP 4:", ends=("features", "tier one", "tier two")),
]
END, FAILURE = "ALL DONE", "Traceback (most recent call last):"


def plain(lines):
    """The state of each stage of a run by working through its lines in order."""
    names = [s.name for s in STAGES]
    out = {n: {"status": "pending", "percent": 0.0, "started": None, "ended": None, "told": {}} for n in names}
    current = None

    def mark(n, status, at, percent=None):
        s = out[n]
        s["started"] = at if s["started"] is None else s["started"]
        s["status"], s["ended"] = status, at if status in ("done", "error") else None
        if percent is not None:
            s["percent"], s["set"] = min(percent, 100.0), True
        elif status == "done":
            s["percent"], s["set"] = 100.0, True
        elif status == "running" and not s.get("set"):
            s["percent"] = 5.0

    for at, line in sorted(lines):
        for s in STAGES:
            if s.begins and s.begins in line:
                for e in s.ends:
                    mark(e, "done", at)
                mark(s.name, "running", at)
                current = s.name
                break
            if s.advances and s.advances in line:
                p, frac, speed = line.split("%")[0].split()[-1], line.split("| ")[1].split(" ")[0], line.split(", ")[1].split("it/s")[0]
                mark(s.name, "done" if int(p) >= 100 else "running", at, float(p))
                out[s.name]["told"] = {"done": int(frac.split("/")[0]), "total": int(frac.split("/")[1]), "rate": float(speed), "eta": line.split("<")[1].split(",")[0]}
                break
            if s.done and s.done in line:
                mark(s.name, "done", at)
                break
        else:
            if END in line:
                for n in names:
                    if out[n]["status"] in ("running", "pending"):
                        out[n]["status"], out[n]["ended"] = "done", at
        if FAILURE in line and current:
            mark(current, "error", at)
    return {(n, s["status"], 100.0 if s["status"] == "done" else s["percent"], s["started"], s["ended"], *(s["told"].get(k) for k in ("done", "total", "rate", "eta"))) for n, s in out.items()}


def logs(seed):
    rng = random.Random(seed)
    out = {}
    for run in range(12):
        lines, at = [], 0
        for s in STAGES:
            if rng.random() < 0.15:
                break
            for _ in range(rng.randint(1, 3)):
                at += rng.randint(1, 9)
                if s.begins and rng.random() < 0.8:
                    lines.append((at, f"  {s.begins} {s.name}"))
                elif s.advances:
                    p = rng.choice([0, 7, 42, 99, 100])
                    lines.append((at, f"{s.advances} x:  {p}%|##| {p * 3}/300 [00:08<00:{rng.randint(10, 59)}, {rng.randint(1, 40)}.5it/s]"))
                else:
                    lines.append((at, rng.choice(["noise", "[OK] cropped: 9", FAILURE, "  File x"])))
        if rng.random() < 0.6:
            lines.append((at + 5, END))
        if rng.random() < 0.3:
            lines.append((at + 9, FAILURE))
        out[f"run{run}"] = lines or [(1, "nothing")]
    return out


def told(rows):
    out = {}
    for r in rows:
        out.setdefault(r.run, set()).add((r.stage, r.status, r.percent, r.started, r.ended, r.done, r.total, r.rate, r.eta))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stages_of_runs(spark, seed):
    runs = logs(seed)
    rows = [(run, at, line) for run, lines in runs.items() for at, line in lines]
    random.Random(seed).shuffle(rows)
    got = told(stages.track(spark.createDataFrame(rows, "run string, at long, line string").repartition(3), STAGES, END, FAILURE).collect())
    assert got == {run: plain(lines) for run, lines in runs.items()}
    assert stages.track(spark.createDataFrame([], "run string, at long, line string"), STAGES, END, FAILURE).count() == 0


@pytest.mark.parametrize("pieces", [1, 4])
def test_a_stream_of_lines_in_any_order_ends_as_the_table(spark, tmp_path, pieces):
    runs = logs(9)
    rows = [(run, at, line) for run, lines in runs.items() for at, line in lines]
    random.Random(4).shuffle(rows)
    for i in range(pieces):
        spark.createDataFrame(rows[i::pieces], "run string, at long, line string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("run string, at long, line string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    latest = {}

    def take(batch, number):
        latest.update(told(batch.collect()))

    stages.track_stream(stream, STAGES, END, FAILURE).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)
    spoken = {r for r, lines in runs.items() if lines != [(1, "nothing")]}
    assert {k: v for k, v in latest.items() if k in spoken} == {run: plain(lines) for run, lines in runs.items() if run in latest}


@pytest.mark.parametrize("pieces", [1, 5])
def test_prototypes_of_a_stream_are_those_of_the_table(spark, tmp_path, pieces):
    rng = np.random.default_rng(1)
    rows = [(i, 1e6 + i, (rng.normal(size=4) + 3 * (i % 3)).tolist(), [None, 1, 2][i % 3] if i % 2 else 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, t double, embedding array<double>, label int").withColumn("at", F.timestamp_seconds("t")).drop("t")
    for i in range(pieces):
        df.filter(F.col("id") % pieces == i).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):  # started again, it finds nothing new
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        prototypes.keep(prototypes.running_moments(stream, parts=3), store, f"file://{tmp_path}/check").awaitTermination(120)
    got = {r.label: r for r in prototypes.prototypes(store).collect()}
    want = {r.label: r for r in retrieval.prototypes(df.filter("label is not null")).collect()}
    assert set(got) == {None, 1, 2} and sum(r.n for r in got.values()) == 300
    for label, r in want.items():
        x = np.array([v for _, _, v, own in rows if own == label])
        assert got[label].n == r.n and got[label].prototype == pytest.approx(r.prototype) and got[label].variance == pytest.approx(x.var(axis=0).tolist())
    versions = store.versions()
    assert len(versions) >= pieces + 1
    store.change(spark.createDataFrame([], store.read().schema), stream=("prototypes", 0))
    assert store.versions() == versions  # a batch that is in already
