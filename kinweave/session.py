"""Session settings the engine relies on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was measured and is at most this large.
BROADCAST_BYTES = 32 << 20

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    # What a Python worker and its task hold of a table at once.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Set what the operators need on an existing session and let Python workers find this package."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark


def small_methods(spark: SparkSession) -> None:
    """From now on, plans whose generated method is beyond what the JVM compiles (8,000 bytes) run operator by operator
    in small methods; interpreted, one such method took 8 times as long."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def new_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("kinweave")
    for key, value in (SETTINGS | {"spark.ui.enabled": "false"} | conf).items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is named and the master is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no shared folder; executors can't share a local one")
    own = f"file://{tempfile.mkdtemp(prefix='kinweave-')}"
    spark.sparkContext.setCheckpointDir(own)
    return own


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs_path(spark, path)
    fs.delete(target, True)


@atexit.register
def _delete_at_exit() -> None:
    try:
        Scratch.sweep(set())
    except Exception:  # the session is already gone
        pass


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    #: Folders that have not been deleted yet.
    live: dict[str, SparkSession] = {}

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/kinweave/{uuid.uuid4().hex}"
        self.saved: dict[int, tuple[DataFrame, str]] = {}
        self.live[self.base] = spark

    @classmethod
    def sweep(cls, keep: set[str]) -> None:
        """Delete all folders but those kept: what a finished step has left."""
        for base in [b for b in cls.live if b not in keep]:
            _delete(cls.live.pop(base), base)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.saved)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.saved[id(out)] = out, path
        return out

    def bytes(self, df: DataFrame) -> int:
        fs, target = _fs_path(self.spark, self.saved[id(df)][1])
        return fs.getContentSummary(target).getLength()

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            _delete(self.spark, self.saved[id(df)][1])

    @staticmethod
    def large(df: DataFrame) -> DataFrame:
        """A side that grows with the corpus: always a shuffle join, so plans are alike at every size."""
        return df.hint("merge")

    def small(self, df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
        """The saved table, marked for broadcast if its measured size is within the limit.

        Files are compressed, so the limit is taken at a quarter of their size; beyond it
        the plan stays a shuffle join, whose skewed partitions AQE splits."""
        return F.broadcast(df) if self.bytes(df) * 4 <= limit else df.hint("merge")
