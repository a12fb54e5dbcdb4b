"""Session settings the library relies on."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folder of the innermost :func:`scratch` block, if any.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)

#: Runtime SQL settings.  UTC keeps TIMESTAMP_NTZ <-> epoch arithmetic an identity;
#: the adaptive settings let Spark split the skewed side of any shuffle join, also
#: where that costs one more exchange; dynamic overwrite is what makes the chunk
#: dataset re-openable record by record; chunks placed by (recording, block) are joined by
#: chunk where they lie.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a session that somebody else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, app: str = "pulseweave") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    return configure(builder.getOrCreate())


def shuffle_count(spark: SparkSession) -> int:
    """Partitions of a shuffle, before adaptive execution merges any."""
    default = spark.conf.get("spark.sql.shuffle.partitions")
    return int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", default) or default)


def shared_directory(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it.

    Only a session without one (a local test) gets a temporary folder of its own.
    """
    directory = spark.conf.get("spark.checkpoint.dir", None)
    if directory is None:
        checkpoint_dir = spark.sparkContext.getCheckpointDir()
        if checkpoint_dir is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pulseweave-"))
            checkpoint_dir = spark.sparkContext.getCheckpointDir()
        directory = checkpoint_dir
    return directory


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A block whose intermediate tables are deleted when it ends.

    What is built inside reads them lazily, so results have to be written, or kept by
    ``materialize(df, keep=True)``, before the block ends.  Blocks nest.
    """
    folder = posixpath.join(shared_directory(spark), f"scratch-{uuid.uuid4().hex}")
    before = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(before)
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Ends the lineage of what several later steps read, survives lost executors, and
    tells the planner the true size: a join with a small result is then broadcast
    from the start, and the large side is never shuffled.  Inside a :func:`scratch` block the
    table goes with the block, unless it is to ``keep``.
    """
    folder = None if keep else _scratch.get()
    path = posixpath.join(folder or shared_directory(df.sparkSession), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
