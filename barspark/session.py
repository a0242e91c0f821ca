"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def get_spark(master: str | None = None, app: str = "barspark",
              shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the settings the library assumes.

    On a cluster pass ``master=None`` and size ``shuffle_partitions`` so one
    shuffle partition stays in the 100–200 MB range at the target volume.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Session settings that results depend on (safe to call repeatedly).

    Bar timestamps are zone-less (``TIMESTAMP_NTZ``); text is parsed through the
    session zone, so it is pinned to UTC to keep wall-clock values unchanged.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Spark lists many folders by one task each, up to 10,000 of a few milliseconds; some tasks a core will do
    if spark.conf.get(LISTING_TASKS, "10000") == "10000":
        spark.conf.set(LISTING_TASKS, str(8 * spark.sparkContext.defaultParallelism))
    return spark


def file_tasks(spark: SparkSession) -> int:
    """Tasks for work that is measured in files rather than bytes; given as a number, Spark does not join them."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only when the session has none and runs in local mode (a test on one machine) is a
    temporary folder registered; on a cluster a missing setting is an error, as a
    machine-local folder is not visible to the executors.
    """
    try:
        sc = spark.sparkContext
        base = sc.getCheckpointDir()
    except Exception:  # noqa: BLE001 - sessions without a SparkContext handle
        sc, base = None, None
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if sc is not None and not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
            base = tempfile.mkdtemp(prefix="barspark-ckpt-")
        if sc is not None:
            sc.setCheckpointDir(base)
            base = sc.getCheckpointDir() or base
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/barspark-scratch/{name}-{uuid.uuid4().hex}"


def written(df, name: str):
    """``df`` as a table under the scratch folder, for small tables that several plans start from."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
