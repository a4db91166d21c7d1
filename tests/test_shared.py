import os
import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from sparvane import shared
from sparvane.ship import ship


def test_tables_go_with_their_scope(spark):
    kept = shared.materialize(spark.range(3), "kept")
    with shared.scratch(spark):
        inner = shared.materialize(spark.range(5), "inner")
        out = shared.materialize(inner.filter("id > 1"), "out")
        assert out.count() == 3
        paths = [re.sub("^file:", "", x._sparvane_path).replace("//", "/") for x in (inner, out)]
        assert all(map(os.path.exists, paths))
    assert not any(map(os.path.exists, paths)) and kept.agg(F.count("*")).first()[0] == 3
    shared.discard(kept)
    assert not os.path.exists(re.sub("^file:", "", kept._sparvane_path).replace("//", "/"))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})
        sparkContext = Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_path(Session(), "x")


def test_threads_ship_the_package_once(spark, monkeypatch):
    ship(spark)
    sent = []
    monkeypatch.setattr(spark.sparkContext, "addPyFile", sent.append)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: ship(spark), range(8)))
    assert sent == []
