"""Session set-up and lineage cutting shared by the library, tests and bench."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

CHECKPOINT_DIR_CONF = "spark.checkpoint.dir"


def build_session(
    app_name: str = "demandflow",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with adaptive execution on and UTC time.

    `shuffle_partitions` is left to the cluster's setting when not given; adaptive
    execution then coalesces small partitions and splits skewed ones.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Checkpoints go with the last reference to them; otherwise each run leaves full copies.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Recording the Python call site of every column slows long expressions noticeably.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: Folders of the cuts made inside the current `temporary_cuts` block.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, one of its own only for a local run without it."""
    shared = spark.conf.get(CHECKPOINT_DIR_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR_CONF} to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set(CHECKPOINT_DIR_CONF, shared)
    return shared


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: keeps partitions and their order, but also the size estimate of the plan it ends.

    For a table that is read by partition, or whose rows hold long arrays, of which a parquet reader would decode
    thousands at a time; elsewhere, and in every loop, `cut_lineage`.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read from there.

    Plans above start from files, so joins see measured sizes; the estimate that a checkpoint inherits from
    its plan would grow with each round of a loop. Partitions and their order are not kept. The files stay
    until the cluster clears `spark.checkpoint.dir`, unless made inside `temporary_cuts`.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    # Columns go by position, since names may clash; a column without a type has no values to write.
    names = [f"c{i}" for i in range(len(df.columns))]
    untyped = [isinstance(f.dataType, NullType) for f in df.schema.fields]
    placed = df.toDF(*names)
    if any(untyped):
        placed = placed.withColumns({n: F.col(n).cast("string") for n, u in zip(names, untyped) if u})
    placed.write.parquet(folder)
    if (made := _MADE.get()) is not None:
        made.append(folder)
    back = spark.read.schema(placed.schema).parquet(folder)
    if any(untyped):
        back = back.withColumns({n: F.lit(None) for n, u in zip(names, untyped) if u})
    return back.toDF(*df.columns)


@contextmanager
def temporary_cuts() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the cuts made inside the block at its end, but for those made by the function it yields.

    What leaves the block must be made by that function, or read none of the deleted ones.
    """
    made: list[str] = []
    outer = _MADE.get()
    token = _MADE.set(made)
    spark = None

    def keep(df: DataFrame) -> DataFrame:
        nonlocal spark
        spark = df.sparkSession
        inner = _MADE.set(outer)
        try:
            return cut_lineage(df)
        finally:
            _MADE.reset(inner)

    try:
        yield keep
    finally:
        _MADE.reset(token)
        spark = spark or SparkSession.getActiveSession()
        for folder in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
