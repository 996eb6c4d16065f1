"""A session with the settings that the operators are tested under."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": partitions, "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = SparkSession.builder.master(master).appName("rangeloom").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, where their Python can't be expected to find it: neither on PYTHONPATH nor in the working directory."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in on_path or Path.cwd() == root or getattr(context, "_rangeloom_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "rangeloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in (root / "rangeloom").rglob("*.py"):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(target))
    context._rangeloom_shipped = True
