"""Stooq text files: one tab-separated file per ticker, header first (the layout of a bulk download)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.schema import STOOQ_COLUMNS
from barspark.session import file_tasks
from barspark.sources.lines import write_lines
from barspark.sources.listing import known_store


def write_stooq_text(raw: DataFrame, path: str, by: str = "<TICKER>", order: Sequence[str] = ("seq",),
                     columns: Sequence[str] = tuple(STOOQ_COLUMNS), sep: str = "\t") -> None:
    """Write raw Stooq rows as ``.txt`` files, one folder and file per ``by`` value.

    Rows are hash-partitioned by ticker and sorted (``order``); tasks write the files (``lines.write_lines``). The number of files,
    not that of bytes, is the work. In a store that pyarrow does not know, Spark's partitioned text write does it.
    """
    line = F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])
    okeys = [f"_o{i}" for i in range(len(order))]
    data = raw.select(F.col(f"`{by}`").alias("_part"), line.alias("value"), *[F.col(f"`{o}`").alias(k) for k, o in zip(okeys, order)])
    if known_store(path):
        write_lines(data, path, "_part", sep.join(columns), okeys, ".txt")
        return
    data = data.select("_part", F.lit(1).alias("_h"), *okeys, "value")
    heads = (raw.select(F.col(f"`{by}`").alias("_part")).distinct()
             .select("_part", F.lit(0).alias("_h"),
                     *[F.lit(None).cast(raw.schema[o].dataType).alias(k) for k, o in zip(okeys, order)],
                     F.lit(sep.join(columns)).alias("value")))
    (data.unionByName(heads).repartition(file_tasks(raw.sparkSession), "_part").sortWithinPartitions("_part", "_h", *okeys)
     .select("_part", "value").write.mode("overwrite").partitionBy("_part").text(path))
