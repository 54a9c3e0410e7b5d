"""Replaying a bounded table as a stream: files in a shared folder, read once to their end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.sources.sinks import shared_path
from tidemark.streaming.ordered import rocks_state


def replay(rows: DataFrame, job: Callable[[DataFrame], DataFrame], mode: str = "append", batch: Column | None = None, batches: int = 1) -> DataFrame:
    """The rows that a streaming job puts out until its input ends. With ``batch`` (a number below ``batches``), rows
    come in so many folders, each with a run of the job of its own, which goes on from the checkpoint of the one before."""
    base = shared_path(rows.sparkSession, "replay")

    def start(stream: DataFrame):
        return job(stream).writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out")

    _run(rows, start, base, batch, batches)
    return rows.sparkSession.read.parquet(f"{base}/out")


def replay_batches(rows: DataFrame, write: Callable[[DataFrame, int], None], batch: Column | None = None, batches: int = 1) -> None:
    """Hands the micro-batches of the rows, as in ``replay``, to ``write(batch, number)``."""
    _run(rows, lambda stream: stream.writeStream.foreachBatch(write), shared_path(rows.sparkSession, "replay"), batch, batches)


def _run(rows: DataFrame, start: Callable[[DataFrame], DataStreamWriter], base: str, batch: Column | None, batches: int) -> None:
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    given = rows.withColumn("_batch", F.lit(0) if batch is None else batch).where(F.col("_batch").between(0, batches - 1))
    given.write.partitionBy("_batch").parquet(f"{base}/given")
    files = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{base}/in/none"))
    with rocks_state(spark):
        for k in range(batches):
            if files.exists(path(f"{base}/given/_batch={k}")):
                files.rename(path(f"{base}/given/_batch={k}"), path(f"{base}/in/{k}"))
            sink = start(spark.readStream.schema(rows.schema).parquet(f"{base}/in/*"))
            sink.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
