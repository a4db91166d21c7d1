from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparvane.config import SPEEDS, Config
from sparvane.plans import build, posture
from sparvane.sources import annotations, images, tables
from sparvane.streaming import vectors as stream


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Twelve photos of two classes with all landmarks that the strict predicate wants."""
    d = tmp_path_factory.mktemp("photos")
    (d / "attributes").mkdir()
    (d / "parts").mkdir()
    n = range(1, 13)
    files = {
        "images.txt": [f"{i} a/p{i}.png" for i in n], "image_class_labels.txt": [f"{i} {1 + i % 2}" for i in n], "classes.txt": ["1 001.Red_Bird", "2 002.Blue_Bird"],
        "bounding_boxes.txt": [f"{i} 4 4 40 40" for i in n], "train_test_split.txt": [f"{i} {i % 2}" for i in n], "attributes.txt": ["1 has_shape::perching-like", "2 has_size::small"],
        "attributes/image_attribute_labels.txt": [f"{i} 1 1 {3 if i != 12 else 2} 1.5" for i in n],
        "parts/part_locs.txt": [f"{i} {p} {x} {y} {v}" for i in n for p, x, y, v in ((2, 40, 20, 1), (14, 10, 34, 1), (8, 20, 40, 1), (7, 38, 12, 1), (11, 0, 0, 0))],
    }
    for name, lines in files.items():
        (d / name).write_text("\n".join(lines) + "\n")
    return str(d)


@pytest.fixture(scope="module")
def photos(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(1, 13):
        img = rng.integers(0, 60, (48, 48, 3)).astype(np.uint8)
        img[8:36, 8:36, 2 * (i % 2)] = 220
        rows.append((f"a/p{i}.png", 48, 48, img.tobytes()))
    return spark.createDataFrame(rows, "filepath string, height int, width int, rgb binary")


def test_strict_predicate(spark, root):
    t = annotations.load(spark, root)
    ids = posture.attribute_ids(t["attributes"])
    rows = {r.img_id: r for r in posture.scored(t["master"], t["attribute_labels"], t["parts"], ids).collect()}
    assert ids == [1] and rows[1].likely_perching and not rows[12].likely_perching  # certainty below 3
    assert rows[1].beak_tail_dx_norm == pytest.approx(0.75) and rows[1].leg_y_norm_max == pytest.approx(0.9) and rows[1].wing_span_norm == -1.0
    assert rows[1].left_eye_visible and not rows[1].right_eye_visible


def test_policy_follows_the_data(spark, root):
    t = annotations.load(spark, root)
    none = t["attribute_labels"].limit(0)
    assert posture.scored(t["master"], none, t["parts"], [1]).filter("likely_perching").count() == 12
    assert posture.scored(t["master"], t["attribute_labels"], t["parts"].limit(0), [1]).filter("likely_perching").count() == 11


def test_blocklist_and_relaxed_fallback(spark, root):
    t = annotations.load(spark, root)
    s = posture.scored(t["master"], t["attribute_labels"], t["parts"], [1])
    blocked = spark.createDataFrame([("00001_p1.png",)], "f string")
    assert posture.selected(s, blocked, least=1).count() == 10
    assert posture.selected(s, blocked, least=11, relaxed=5).count() == 10 and posture.selected(s, blocked, least=11, relax=True, relaxed=5).count() == 11
    assert not any(r.hflip for r in posture.facing(posture.selected(s, least=1), t["parts"]).collect())  # beaks are right of tails already
    left = t["parts"].withColumn("x", -F.col("x")).filter("img_id <> 1")
    assert all(r.hflip for r in posture.facing(posture.selected(s, least=1), left, t["master"]).collect())  # the first by its class


def test_missing_file_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="images.txt"):
        annotations.load(spark, str(tmp_path))


def test_build_and_search(spark, root, photos, tmp_path):
    config = Config(root=root, min_images=3, dims=(6, 5, 6), speed="fast", stat_rows=8)
    out = build.build(spark, config, photos, str(tmp_path))
    assert out["metadata"].count() == 11 == out["tier1"].count() == out["tier3"].count() == out["tier2"].count() == out["fused"].count()
    row = out["tier2"].first()
    assert len(row.parts) == 5 and len(row.parts[0]) == 184 and np.linalg.norm(row.embedding) == pytest.approx(1, abs=1e-4)
    hits = build.search(out["store"], k=3).collect()
    assert [h["rank"] for h in hits] == [1, 2, 3] and hits[0].id == 1
    assert out["prototypes"].count() == 2 and "species" in build.report(out["metadata"])
    # the pool holds every photo of the kept classes, one more than is kept; statistics come from about 8 of them
    found = {p.name.rsplit("-", 1)[0]: p for p in tmp_path.iterdir()}
    sizes = {n: spark.read.parquet(str(p)).count() for n, p in found.items()}
    assert sizes["pool"] == 12 and sizes["crops"] == 11 and 7 <= sizes["pool-sample"] <= 8 and sizes["pool-tier2"] == sizes["pool-sample"]
    # the same again makes nothing; other settings make only what depends on them
    made = []
    real = build.Steps.__call__

    def watched(self, *a):
        out = real(self, *a)
        made.extend(self.made)
        self.made.clear()
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(build.Steps, "__call__", watched)
        build.build(spark, config, photos, str(tmp_path))
        assert made == []
        build.build(spark, replace(config, weights=(1.0, 1.0, 1.0)), photos, str(tmp_path))
        assert made == ["fused"]
        made.clear()
        build.build(spark, replace(config, stat_rows=0), photos, str(tmp_path))
        assert made == ["pool-sample", "pool-tier1", "pool-tier2", "pool-tier3", "fused"]
        made.clear()
        fewer = build.build(spark, config, photos, str(tmp_path), ["00001_p1.png"])
        assert "metadata" in made and "tier2" in made and fewer["metadata"].count() == 10
        made.clear()
        build.build(spark, replace(config, rebuild=("tier3",)), photos, str(tmp_path))
        assert made == ["tier3"]


def test_zscores_come_from_the_pool(spark):
    frame = lambda rows: spark.createDataFrame([(i, [float(x)]) for i, x in enumerate(rows)], "img_id int, vec array<double>")
    out = build.fused({"t1": frame([1, 2])}, {"t1": 1.0}, pool={"t1": frame([0, 10])}).orderBy("img_id").collect()
    assert [r.vec[0] for r in out] == pytest.approx([-0.8, -0.6])
    assert [r.vec[0] for r in build.fused({"t1": frame([1, 2])}, {"t1": 1.0}).orderBy("img_id").collect()] == pytest.approx([-1, 1])


def test_bad_image_is_skipped(spark):
    good, bad = (1, 8, 8, bytes(8 * 8 * 3)), (2, 8, 8, b"short")
    df = spark.createDataFrame([good, bad], images.FLAT)
    assert [r.img_id for r in images.tier3(df).collect()] == [1]


def test_image_source_turns_bgr(spark, tmp_path):
    import struct
    import zlib

    rows = b"".join(b"\0" + bytes([200, 10, 30] * 4) for _ in range(4))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 4, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    (tmp_path / "x.png").write_bytes(png)
    (tmp_path / "bad.png").write_bytes(b"no image")
    r = images.read_images(spark, str(tmp_path), "*.png").collect()
    assert len(r) == 1 and r[0].rgb[:3] == bytes([200, 10, 30])
    assert images.list_files(spark, str(tmp_path), "*.png").count() == 2


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    tables.write_csv(df, f"{tmp_path}/c")
    assert tables.header(spark, f"{tmp_path}/c") == ["x", "y"] and tables.read_csv(spark, f"{tmp_path}/c", "x int, y string").count() == 2
    assert tables.markdown(df, "T", 1).endswith("The first 1 rows.\n") and "1" in tables.summary_json(df)


def test_vector_stream(spark, tmp_path):
    spark.createDataFrame([(1, [3.0, 4.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/in")
    q = stream.append(stream.vector_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(60)
    assert [round(x, 3) for x in spark.read.parquet(f"{tmp_path}/out").first().embedding] == [0.6, 0.8]
    assert spark.read.parquet(f"{tmp_path}/out").filter(F.col("vec_id") == 1).count() == 1


def test_config():
    c = Config.from_env({"SPARVANE_SPEED": "odd", "SPARVANE_REUSE": "0", "SPARVANE_FIT_ROWS": "7", "SPARVANE_RELAX": "on", "SPARVANE_REBUILD": "tier1, fused"})
    assert c.profile == SPEEDS["balanced"] and not c.reuse and c.fit_rows == 7 and c.relax and c.rebuild == ("tier1", "fused")
