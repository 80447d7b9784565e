"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.ship import ensure_package


#: Rows that go to a Python worker at once. Texts are long, so 10,000 of them take too much memory.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a scale-factor folder, by whatever path Spark can read."""
    ensure_package(spark)
    if spark.conf.get(BATCH) == "10000":  # Spark's default; a user's own setting stays
        spark.conf.set(BATCH, "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, n: int) -> Column:
    """``crc32`` of the id as text, modulo ``n``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so that a task holds few texts at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def release() -> None:
    """Give memory that Python and Arrow have freed back to the system; workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and once it has ended and its variables are gone, ``release``."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


class Scratch:
    """Tables written to the shared checkpoint folder, which cut lineage and survive lost executors.

    The folder is the one that the session names in ``spark.checkpoint.dir``. Only a session on
    one machine may go without, as in tests; it gets a temporary folder. Elsewhere that would be
    a folder that other machines can't see, so it is an error. Tables go when ``drop`` is called
    or when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            master = spark.sparkContext.master
            if not re.fullmatch(r"local(\[.*\])?", master):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-"))
            base = spark.sparkContext.getCheckpointDir()
        self.root = f"{base}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.drop)

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a frame that reads it back."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Let shuffle files of finished queries go now, not when the driver happens to collect its garbage."""
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, n: int | None = None) -> None:
        """Delete table number ``n``, or all of them."""
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.root if n is None else f"{self.root}/{n}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone, and its files with it or left to the cluster's own cleaning
            return
