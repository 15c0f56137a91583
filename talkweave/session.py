"""What every session needs: the package's code on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_talkweave_shipped", None) == sc.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, target = tempfile.mkstemp(prefix="talkweave-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("talkweave", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._talkweave_shipped = sc.applicationId


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name where driver and executors can both write: below ``spark.checkpoint.dir``,
    which a cluster must set; a local session may go without and gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="talkweave-")
    return f"{base.rstrip('/')}/talkweave/{name}-{uuid.uuid4().hex}"
