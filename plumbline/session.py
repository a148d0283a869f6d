"""One place that states the session settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "plumbline", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings above; the cluster's own launch options win for everything else."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session's executors, once per application.

    Spark hands the archive out itself, so executors need neither the repository nor a shared path.
    """
    context = spark.sparkContext
    with _SHIPPING:
        # two archives of one name would not pass for the same file
        if context.applicationId in _SHIPPED:
            return
        root = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="plumbline-"), "plumbline.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("plumbline", os.path.relpath(path, root)))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()
