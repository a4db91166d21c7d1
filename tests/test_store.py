import pytest
from pyspark.sql import functions as F

from sparvane.operators.store import Conflict, Store
from sparvane.sources import annotations


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.create(spark.createDataFrame([(i, f"{i}.jpg", [float(i), 1.0]) for i in (9, 2, 5, 7)], "id long, filename string, embedding array<double>"), 4)
    return s


def rows(df):
    return sorted((r.id, r.filename, r.idx) for r in df.collect())


def test_changes_keep_indices(spark, store):
    assert rows(store.read()) == [(2, "2.jpg", 0), (5, "5.jpg", 1), (7, "7.jpg", 2), (9, "9.jpg", 3)]
    more = spark.createDataFrame([(5, "new.jpg", [0.0, 0.0]), (1, "1.jpg", [1.0, 1.0]), (30, "30.jpg", [2.0, 2.0])], "id int, filename string, embedding array<double>")
    store.change(more, spark.createDataFrame([(7,), (1000,)], "id long"))
    assert rows(store.read()) == [(1, "1.jpg", 4), (2, "2.jpg", 0), (5, "new.jpg", 1), (9, "9.jpg", 3), (30, "30.jpg", 5)]
    assert len(rows(store.read(1))) == 4  # the old snapshot is still there
    store.change(spark.createDataFrame([(7, "back.jpg", None)], "id long, filename string, embedding array<double>"))
    assert (7, "back.jpg", 6) in rows(store.read())  # a deleted id comes anew
    store.change()
    assert store.versions() == [1, 2, 3, 4] and len(rows(store.read())) == 6


def test_a_crash_before_the_manifest_leaves_the_old_snapshot(spark, store, monkeypatch):
    before = rows(store.read())
    monkeypatch.setattr(Store, "_publish", lambda self, new: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        store.change(spark.createDataFrame([(2, "lost.jpg", [0.0])], "id long, filename string, embedding array<double>"))
    monkeypatch.undo()
    assert rows(store.read()) == before and store.versions() == [1]
    assert store.vacuum() == 1 and rows(store.read()) == before  # only the lost change's bucket


def test_of_two_writers_one_gets_a_conflict(spark, store):
    late = store.snapshot()
    store.change(deletes=spark.createDataFrame([(2,)], "id long"))
    with pytest.raises(Conflict):
        store._publish(type(late)(late.version + 1, late.schema, late.buckets, late.next_idx))
    assert [r[0] for r in rows(store.read())] == [5, 7, 9]


def test_a_change_writes_only_touched_buckets(spark, store):
    before = store.snapshot().buckets
    after = store.change(deletes=spark.createDataFrame([(2,)], "id long")).buckets
    assert sum(before[b] != after[b] for b in before) == 1


def test_a_lookup_reads_its_bucket_alone(spark, store):
    found = store.lookup([5])
    assert rows(found) == [(5, "5.jpg", 1)] and len(found.inputFiles()) < len(store.read().inputFiles())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,5)" in plan or "In(id, [5])" in plan
    assert "Exchange" not in plan and store.lookup([4]).count() == 0


def test_a_repeated_batch_counts_once(spark, store):
    row = lambda name: spark.createDataFrame([(2, name, [0.0])], "id long, filename string, embedding array<double>")
    store.change(row("first"), stream=("s", 0))
    store.change(row("again"), stream=("s", 0))
    assert (2, "first", 0) in rows(store.read()) and store.versions() == [1, 2]
    store.change(row("next"), stream=("s", 1))
    assert (2, "next", 0) in rows(store.read()) and store.snapshot().streams == {"s": 1}


def test_vacuum_keeps_what_is_named(spark, store):
    for i in range(3):
        store.change(spark.createDataFrame([(2, f"v{i}", [0.0])], "id long, filename string, embedding array<double>"))
    assert store.vacuum(2) > 0 and store.versions() == [3, 4]
    assert (2, "v1", 0) in rows(store.read(3)) and (2, "v2", 0) in rows(store.read())
    with pytest.raises(FileNotFoundError):
        store.read(1)


@pytest.mark.parametrize("size", ["64m", "2k", "300"])
def test_the_last_row_in_the_source_wins_whatever_the_splits(spark, tmp_path, size):
    """A landmark given many times over two files, read in 1 to dozens of splits, filtered and shuffled before it is used."""
    from sparvane.operators.relational import last_value_per_key

    for name, start in (("a", 0), ("b", 400)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{i % 3} {i % 2} {start + i}.5 0.0 1\n" for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = annotations.scan(spark, f"file://{tmp_path}", annotations.SCHEMAS["parts"][1], "at")
        assert size == "64m" or got.rdd.getNumPartitions() > 6
        mixed = got.filter("x > 3").repartition(5, "y", "x").filter(F.col("part_id") == 1)
        last = last_value_per_key(mixed, "img_id", {"x": (F.col("visible") == 1, F.col("x"))}, "at")
        assert sorted(map(tuple, last.collect())) == [(i, max(400.5 + j for j in range(400) if j % 3 == i and j % 2 == 1)) for i in range(3)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_replaced_under_their_path_change_the_state(spark, tmp_path):
    from sparvane.sources import images

    for name, size in (("a", 5), ("b", 9)):
        (tmp_path / f"{name}.txt").write_text("x" * size)
    photos = spark.read.text(f"file://{tmp_path}")
    before = images.state(photos)
    assert before == images.state(photos) and before[0] == 2 and images.state(spark.range(3)) == ()
    (tmp_path / "b.txt").write_text("y" * 10)
    assert images.state(photos) != before


def test_a_report_of_the_whole_build(spark):
    import numpy as np

    from sparvane.plans import reports

    rng = np.random.default_rng(0)
    rows = [(i, i % 3, f"{i % 3:03d}.Some_Bird", i % 2, float(i % 3 + rng.normal() * 0.01), float(rng.random()), float(rng.random() / 2), float(i % 3)) for i in range(90)]
    both = spark.createDataFrame(rows, "img_id int, class_id int, class_name string, is_train int, cattr_hu1 double, cattr_color_green_ratio double, cattr_centroid_y double, cattr_val_mean double")
    meta, tier1 = both.select("img_id", "class_id", "class_name", "is_train"), both.drop("class_id", "class_name", "is_train")
    assert reports.dataset_summary(meta).first().asDict() == {"images": 90, "classes": 3, "train": 45, "test": 45, "mean": 30.0, "least": 30, "most": 30}
    assert reports.dataset_summary(meta.limit(0)).first().images == 0
    info = reports.information(tier1, meta)
    assert reports.difference_attributes(info) == ["cattr_hu1", "cattr_color_green_ratio"]  # what tells of the picture alone is left out
    assert reports.similarity_attributes(tier1.columns) == ["cattr_hu1", "cattr_color_green_ratio", "cattr_val_mean"]
    text = reports.feature_report(meta, tier1, {"tier3": spark.createDataFrame([([0.0] * 7,)], "vec array<double>")})
    assert all(x in text for x in ("Attributes for difference", "| cattr_hu1 |", "| tier3 | 7 |", "Classes by cattr_centroid_y", "| difference | 2 |"))
