"""Cutting lineage in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the setting is absent, a local session (as in tests) gets a
    folder of its own until it ends; a cluster must name one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="chronostrata-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder: later reads survive the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Files a core that ``few`` leaves, so that cores stay busy, and the bytes from which it leaves more of them.
FILES_A_CORE, FILE_BYTES = 2, 32 << 20


def few(df: DataFrame, size: int = 0) -> DataFrame:
    """df in at most FILES_A_CORE partitions for each core, or one for every FILE_BYTES of ``size`` (what it is
    expected to hold) if these are more: every partition of a table that is written is a file, rows or none, and
    on a local file system without Hadoop's native library each file starts processes that set modes.
    Neighbouring partitions are read one after another by a task; nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(min(1 << 30, max(FILES_A_CORE * cores, -(-size // FILE_BYTES))))


RELEASED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_large(df: DataFrame) -> DataFrame:
    """``cut`` for what came through a large exchange: its files are deleted once the rows are written, and
    not whenever the driver happens to collect its garbage."""
    spark = df.sparkSession
    before = spark.conf.get(RELEASED, "false")
    spark.conf.set(RELEASED, "true")  # read when a plan is made: the select makes one
    try:
        return cut(df.select("*"))
    finally:
        spark.conf.set(RELEASED, before)


_shipped: set[str] = set()
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application: their Python imports it in tasks.

    Batches that go to Python are held to BATCH_BYTES, so that long texts do not add up to thousands of
    rows times their length in a worker.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="chronostrata-")) / f"{package.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)
