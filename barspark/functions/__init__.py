from barspark.functions.columns import (  # noqa: F401
    base_name, file_extension, file_stem, numeric, parent_dir, stooq_timestamp,
)
