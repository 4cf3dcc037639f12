"""What queries need of the session they run in."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where the session names none, a temporary one is set if it runs on this machine alone, as in
    tests; on a cluster that is an error, as executors elsewhere couldn't read it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = sc.getConf().get("spark.checkpoint.dir")
        if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark reads, if it is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def ship(spark: SparkSession) -> None:
    """Make this package known to Python workers that don't find it by themselves."""
    root = Path(__file__).resolve().parents[2]
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    sc = spark.sparkContext
    if any(p and Path(p).resolve() == root for p in known) or getattr(sc, "_tesserix_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="tesserix-")) / "tesserix.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "tesserix").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(archive))
    sc._tesserix_shipped = True
