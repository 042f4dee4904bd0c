"""Sessions: settings for local runs, and the package on the workers' path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))


def local(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, as the tests and the benchmark use it."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidegate")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for each application, so that functions of its
    modules are found there whatever the workers' path is."""
    context = spark.sparkContext
    if getattr(context, "_tidegate_shipped", False):
        return
    where = tempfile.mkdtemp(prefix="tidegate-")
    path = os.path.join(where, "tidegate_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(ROOT):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tidegate", os.path.relpath(full, ROOT)))
    context.addPyFile(path)
    context._tidegate_shipped = True
