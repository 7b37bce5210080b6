"""Session factory, and the shipping of this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(name: str = "civicframe", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; what the cluster has set is kept."""
    builder = SparkSession.builder.appName(name)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship_active() -> None:
    """``ship`` for functions of columns, which know no session of their own."""
    if spark := SparkSession.getActiveSession():
        ship(spark)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a context, so that Python operators run wherever it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_civicframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), "civicframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    sc._civicframe_shipped = True
