"""Session settings, shared scratch space and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Hash joins on student, item or order keys may meet one key with a large share of the rows, so
# adaptive execution has to be allowed to split a skewed side even when that adds a shuffle.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A finished query's shuffle files go at once, not when the driver next collects garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cohortlens")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options this library relies on in a session made elsewhere.

    They stay set: results are lazy, and need them when they are run.
    """
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def settings(spark: SparkSession, some: dict[str, str]) -> Iterator[None]:
    """Runtime options for what is run inside."""
    before = {key: spark.conf.get(key, None) for key in some}
    for key, value in some.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own; on a cluster a missing
    setting is an error, because a machine-local folder is lost with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="cohortlens-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from the written rows.

    Unlike a checkpointed RDD the table is written in one pass, is read column by column, and has a
    known size, so later joins broadcast it exactly when it is small enough.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# What results of each session still lean on, until release() is called for it.
_SCRATCH: dict[str, list[str]] = defaultdict(list)
_HELD: dict[str, list[DataFrame]] = defaultdict(list)


def _name_of(spark: SparkSession) -> str:
    return f"{spark.sparkContext.applicationId} {spark._jsparkSession.sessionUUID()}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in shared storage for a table written and read back; ``release`` removes it."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH[_name_of(spark)].append(path)
    return path


def drop_step(df: DataFrame) -> None:
    """Remove a table of ``cut_lineage`` that nothing reads any more, such as a loop's state before the last."""
    spark = df.sparkSession
    context = spark.sparkContext
    mine = _SCRATCH[_name_of(spark)]
    for name in {"/".join(f.split("/")[:-1]) for f in df.inputFiles()}:
        last = name.rsplit("/", 1)[-1]
        for path in [m for m in mine if m.rsplit("/", 1)[-1] == last]:
            mine.remove(path)
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def hold(df: DataFrame) -> DataFrame:
    """Keep rows for the many passes of a fit; lost blocks are computed again. ``release`` lets go."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _HELD[_name_of(df.sparkSession)].append(kept)
    return kept


def release(spark: SparkSession) -> None:
    """Let go of held rows and remove the scratch tables of results that have been consumed.

    Results are lazy, so only the caller knows when: every frame made before this call is spent.
    """
    for kept in _HELD.pop(_name_of(spark), []):
        kept.unpersist()
    context = spark.sparkContext
    for name in _SCRATCH.pop(_name_of(spark), []):
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 2)
