"""The package on the Python workers."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HERE = Path(__file__).resolve().parent
_MARK = "_sparvane_shipped"
_lock = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once a context, whichever threads ask, through the driver's file server.

    Workers that find it already (installed, or on PYTHONPATH) find the same modules.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")  # ten thousand wide rows would be a batch without it
    sc = spark.sparkContext
    with _lock:  # a local property would be a thread's own, and a second archive of the name is refused
        if getattr(sc, _MARK, False):
            return
        archive = os.path.join(tempfile.mkdtemp(prefix="sparvane"), "sparvane.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(_HERE.rglob("*.py")):
                z.write(p, str(p.relative_to(_HERE.parent)))
        sc.addPyFile(archive)
        setattr(sc, _MARK, True)
