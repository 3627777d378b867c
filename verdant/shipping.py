"""Sends this package to the executors' Python, once per Spark application."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Python functions that are made after this call run on executors that don't have the package installed."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(root):  # imported from what was shipped
        return
    path = os.path.join(tempfile.mkdtemp(prefix="verdant-ship-"), "verdant.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("verdant", os.path.relpath(full, root)))
    context.addPyFile(path)
    _sent.add(context.applicationId)
