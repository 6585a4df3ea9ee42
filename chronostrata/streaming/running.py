"""Streams over tables, run to their end."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MOST_FILES = 64


def work_folder(spark: SparkSession) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names; a local session may have its own."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        shared = tempfile.mkdtemp(prefix="chronostrata-streams-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4()}"


def streamed(spark: SparkSession, path: str, files: int = MOST_FILES) -> DataFrame:
    """A Parquet table as a stream of at most ``files`` files a batch."""
    name = path.rstrip("/")
    pattern = f"{name[:-1]}[{name[-1]}]"  # a source of one file must be a pattern
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(pattern)


def drained(stream: DataFrame) -> DataFrame:
    """What a stream delivers until its source is read: written as Parquet, exactly once, and read again."""
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession)
    schema = stream.schema
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")
