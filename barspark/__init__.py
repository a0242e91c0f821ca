"""barspark: OHLCV bar preparation expressed as Spark DataFrame plans.

Every public function takes and returns DataFrames; Spark plans, partitions and
shuffles the work. Sub-packages:

* ``sources``   – readers, writers, file discovery, Arrow IPC data source
* ``functions`` – small Column helpers (numeric coercion, Stooq timestamps, paths)
* ``operators`` – standardise, clean, filter, page, profile, indicators, sampling, features
* ``plans``     – end-to-end jobs (load → clean → balance → dedupe → save, reports)
* ``streaming`` – incremental file ingest with Structured Streaming
"""

from barspark.schema import BAR_COLUMNS, BAR_SCHEMA, NUMERIC_COLUMNS  # noqa: F401
from barspark.session import get_spark, scratch_path  # noqa: F401

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions that tasks run are sent by value, so executors need no copy of this package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
