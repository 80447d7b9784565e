"""Make this package importable on every executor."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ensure_package(spark: SparkSession) -> None:
    """Send the package's sources to the executors once for each application.

    A worker that can import the package already (from ``PYTHONPATH``) prefers that copy.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="cairn-")) / "cairn_sources.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(path))
    atexit.register(shutil.rmtree, path.parent, True)
    _shipped.add(app)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names, set for the session.

    Only a session on one machine may go without, as in tests: it gets a temporary folder.
    """
    base = spark.sparkContext.getCheckpointDir()
    if base is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            base = tempfile.mkdtemp(prefix="cairn-")
            atexit.register(shutil.rmtree, base, True)
        spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext.getCheckpointDir()
