"""Incremental file ingest with Structured Streaming.

New files in a folder are picked up ``batch_size`` at a time (``maxFilesPerTrigger``). The stream carries
file names only; each micro-batch checks its files, reads the good ones by their own headers,
and writes bars to ``<table>/epoch=<id>`` with overwrite, so a retried batch replaces its own
output instead of duplicating it. The checkpoint remembers which files were taken, so a
later run only reads new files. Every batch also writes one row to a log table.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from barspark.operators.scores import add_states, states
from barspark.schema import BAR_SCHEMA
from barspark.sources.files import check_files
from barspark.sources.readers import load

LOG_SCHEMA = "epoch long, files long, loaded long, failed long, errors array<string>, rows long, seconds double, finished_at timestamp"
FORMATS = ("txt", "csv", "json", "parquet")


def ingest_files(spark: SparkSession, src: str, table_path: str, checkpoint: str, fmt: str = "csv",
                 batch_size: int = 100, log_path: str | None = None, states_path: str | None = None) -> int:
    """Ingest every file not yet taken from ``src``; returns the number of files loaded.

    Files that fail the header check are skipped and named in the log with the reason. With ``states_path`` each
    loaded file also leaves its quality state there (see ``operators.scores``), for scores that need no second reading of the table.
    """
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported stream format: {fmt}")
    files = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", batch_size)
             .option("recursiveFileLookup", True).load(src).select("path", "length"))
    total = 0

    def write_batch(batch: DataFrame, epoch: int) -> None:
        nonlocal total
        t0 = time.time()
        taken = batch.select("path", "length").collect()  # at most batch_size names
        bad, known = check_files(spark, [r["path"] for r in taken], fmt)
        good = sorted(r["path"] for r in taken if r["path"] not in bad)
        bars = load(spark, good, fmt, **known) if good else spark.createDataFrame([], BAR_SCHEMA)
        seen = Observation()
        (bars.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
         .parquet(f"{table_path.rstrip('/')}/epoch={epoch}"))
        if states_path and good:
            add_states(states(load(spark, good, fmt, with_source=True, **known), "_source"), states_path, epoch)
        total += len(good)
        if log_path:
            row = [(int(epoch), len(taken), len(good), len(bad), [f"{p}: {e}" for p, e in sorted(bad.items())],
                    int(seen.get["rows"]), float(time.time() - t0), None)]
            (spark.createDataFrame(row, LOG_SCHEMA).withColumn("finished_at", F.current_timestamp())
             .write.mode("overwrite").parquet(f"{log_path.rstrip('/')}/epoch={epoch}"))

    q = (files.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return total


def ingest_summary(spark: SparkSession, log_path: str, total_files: int | None = None) -> DataFrame:
    """Totals over the batch log (S12): batches, files taken, loaded and failed, rows, seconds, file rate,
    percent done and the remaining time at that rate when ``total_files`` is known."""
    log = spark.read.parquet(log_path)
    s = log.agg(F.count(F.lit(1)).alias("batches"), F.sum("files").alias("files"), F.sum("loaded").alias("loaded"),
                F.sum("failed").alias("failed"), F.sum("rows").alias("rows"), F.sum("seconds").alias("seconds"))
    s = s.withColumn("files_per_second", F.when(F.col("seconds") > 0, F.col("files") / F.col("seconds")))
    if total_files:
        s = (s.withColumn("percent", F.round(F.col("files") * 100.0 / F.lit(total_files), 2))
             .withColumn("eta_seconds", (F.lit(total_files) - F.col("files")) / F.col("files_per_second")))
    return s
