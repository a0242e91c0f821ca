"""File listings, headers and validation.

One listing by tasks gives names, sizes and times (``listing.files_below``); headers are the first line of each text file, read from its start
in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.functions.columns import file_extension
from barspark.schema import EXTENSION_FORMATS, STOOQ_REQUIRED
from barspark.session import written
from barspark.sources.headers import BOM, first_lines, header_names, opens_array, separator
from barspark.sources.listing import files_below, inspected, name_pattern


def list_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """``path, length, modification_time, extension, format`` of every file under ``root`` (S10), zero-byte files too.

    Files with an unknown extension get a NULL ``format``; filter on it to keep supported files only.
    """
    files = files_below(spark, root)
    if pattern:
        files = files.where(F.regexp_extract("path", "([^/]*)$", 1).rlike(f"^(?s:{name_pattern(pattern)})$"))
    fmt = F.create_map(*[x for k, v in EXTENSION_FORMATS.items() for x in (F.lit(k), F.lit(v))])
    return (files.withColumn("extension", file_extension(F.col("path")))
            .withColumn("format", F.element_at(fmt, F.col("extension"))))


def supported_files(spark: SparkSession, root: str) -> DataFrame:
    return list_files(spark, root).filter(F.col("format").isNotNull())


def missing_names(names: Column, required: Sequence[str]) -> Column:
    return F.array_except(F.array(*[F.lit(r) for r in required]), names)


def discover_stooq_files(spark: SparkSession, root: str, pattern: str = "*.txt", rule: str = "header") -> DataFrame:
    """Stooq text files under ``root``.

    ``rule="header"``: the first line carries every required Stooq name (``missing`` lists
    the absent ones). ``rule="ticker"``: the simpler test that ``<TICKER>`` appears in the
    first line.
    """
    fmt = F.create_map(*[x for k, v in EXTENSION_FORMATS.items() for x in (F.lit(k), F.lit(v))])
    found = inspected(spark, root, pattern).where("length > 0").withColumn("format", F.element_at(fmt, F.col("extension")))
    found = found.select("path", "length", "modification_time", "extension", "format", "header").withColumn(
        "missing", missing_names(header_names(F.coalesce("header", F.lit(""))), STOOQ_REQUIRED))
    if rule == "ticker":
        return found.withColumn("is_stooq", F.coalesce(F.col("header").contains("<TICKER>"), F.lit(False)))
    if rule != "header":
        raise ValueError(f"unknown discovery rule {rule!r}")
    return found.withColumn("is_stooq", F.size("missing") == 0)


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:(//)?", "")


def validate_files(spark: SparkSession, candidates: DataFrame, root: str) -> DataFrame:
    """Verdict per candidate file (V1, V2): ``path, format, valid, error``.

    ``candidates`` holds ``path`` and the declared ``format``; ``root`` is the folder
    listed to find them. Checks in order: file missing, zero bytes, extension not
    matching the format, required header names absent (txt: the Stooq names;
    csv: ``ticker, timestamp, close``; json lines: the keys of the first record).
    """
    found = written(inspected(spark, root), "inspected")
    files = found.select(_plain(F.col("path")).alias("_p"), "length", "extension", "header")
    cand = candidates.select(F.col("path"), F.col("format"), _plain(F.col("path")).alias("_p"))
    return verdicts(cand.join(files, "_p", "left").join(_array_keys(found.where(F.col("path").rlike("(?s)[.]json$"))), "_p", "left")).select("path", "format", "valid", "error")


def verdicts(files: DataFrame) -> DataFrame:
    """``files`` (``format``, the declared one, and ``length, extension, header, keys`` as found) with ``error`` and ``valid``."""
    from barspark.sources.readers import required_columns
    fmt_ext = F.create_map(*[x for k, v in EXTENSION_FORMATS.items() for x in (F.lit(k), F.lit(v))])
    head = F.coalesce(F.trim(F.regexp_replace("header", "^" + BOM, "")), F.lit(""))
    # the keys of the first record; text that is no JSON object has none
    names = F.when(F.col("format") == "json", F.when(head.startswith("["), F.col("keys")).otherwise(F.json_object_keys(head)))
    names = names.otherwise(header_names(head))
    req = F.when(F.col("format") == "txt", F.array(*[F.lit(c) for c in required_columns("txt")])) \
        .when(F.col("format").isin("csv", "json"), F.array(*[F.lit(c) for c in required_columns("csv")])) \
        .otherwise(F.array().cast("array<string>"))
    miss = F.array_except(req, F.coalesce(names, F.array().cast("array<string>")))
    error = (F.when(F.col("length").isNull(), F.lit("File not found"))
             .when(F.col("length") == 0, F.lit("File is empty"))
             .when(F.element_at(fmt_ext, F.col("extension")) != F.col("format"),
                   F.format_string("Invalid file format: extension %s does not match %s",
                                   F.col("extension"), F.col("format")))
             .when((F.col("format") == "json") & names.isNull(), F.lit("Invalid JSON"))
             .when(F.size(miss) > 0, F.concat(F.lit("Missing required columns: "), F.array_join(miss, ", "))))
    return files.withColumn("error", error).withColumn("valid", F.col("error").isNull())


def checked(spark: SparkSession, root: str, fmt: str, pattern: str | None = None) -> DataFrame:
    """``path, length, valid, error, sep, names, array`` of the files under ``root`` that match ``pattern``, all declared to be ``fmt``: one listing
    and one look at each header give the verdict and the layout to read by."""
    files = inspected(spark, root, pattern).withColumn("format", F.lit(fmt))
    if fmt == "json":
        files = files.withColumn("_p", _plain(F.col("path"))).join(_array_keys(inspected(spark, root, "*.json")), "_p", "left")
    else:
        files = files.withColumn("keys", F.lit(None).cast("array<string>"))
    head = F.col("header")
    return verdicts(files).select("path", "length", "valid", "error", separator(head).alias("sep"), header_names(head).alias("names"), opens_array(head).alias("array"))


def _array_keys(found: DataFrame) -> DataFrame:
    """``_p, keys``: the required names that records of each JSON array file among inspected ones hold; NULL keys where the text is no JSON."""
    from barspark.sources.readers import required_columns
    spark = found.sparkSession
    need = required_columns("json")
    files = [r["path"] for r in found.where(opens_array(F.col("header"))).select("path").collect()]
    if not files:
        return spark.createDataFrame([], "_p string, keys array<string>")
    rows = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").schema(
        ", ".join(f"`{c}` string" for c in need) + ", _bad string").json(files)
    from barspark.sources.headers import plain_path
    seen = rows.groupBy(_plain(plain_path(F.col("_metadata.file_path"))).alias("_p")).agg(
        *[F.max(F.col(f"`{c}`").isNotNull()).alias(f"has{i}") for i, c in enumerate(need)], F.max(F.col("_bad").isNotNull()).alias("bad"))
    keys = F.filter(F.array(*[F.when(F.col(f"has{i}"), F.lit(c)) for i, c in enumerate(need)]), lambda x: x.isNotNull())
    return seen.select("_p", F.when(~F.col("bad"), keys).alias("keys"))


def columns_verdict(spark: SparkSession, root: str, pattern: str, need: Sequence[str], empty: str = "File is empty") -> DataFrame:
    """``path, valid, error`` of the files that match ``pattern``: empty ones and those without the ``need`` columns."""
    return needs_columns(inspected(spark, root, pattern), need, empty).select("path", "valid", "error")


def needs_columns(files: DataFrame, need: Sequence[str], empty: str = "File is empty") -> DataFrame:
    """Inspected files with ``valid, error``: against empty ones and those without the ``need`` columns."""
    miss = missing_names(header_names(F.coalesce("header", F.lit(""))), need)
    error = (F.when(F.col("length") == 0, F.lit(empty))
             .when(F.size(miss) > 0, F.concat(F.lit("Missing columns: "), F.array_join(miss, ", "))))
    return files.withColumn("error", error).withColumn("valid", F.col("error").isNull())


def check_files(spark: SparkSession, paths: Sequence[str], fmt: str) -> tuple[dict[str, str], dict]:
    """Known files of a batch (V1): reasons against those that do not carry the required names, by path, and what to
    pass to ``readers.load`` for the others, so that it need not look at them again."""
    from barspark.sources.readers import known_files, required_columns
    need = required_columns(fmt)
    if not need or not paths:
        return {}, {}
    head = F.col("header")
    first = F.trim(F.regexp_replace(head, "^" + BOM, ""))
    keys = F.when(first.startswith("["), F.array(*[F.lit(c) for c in need])).otherwise(F.json_object_keys(first)) if fmt == "json" else header_names(first)
    rows = first_lines(spark, paths).select("path", keys.alias("keys"), separator(head).alias("sep"), header_names(head).alias("names"), opens_array(head).alias("array")).collect()
    plain = lambda path: path[7:] if path.startswith("file://") else path[5:] if path.startswith("file:") else path
    found = {plain(r["path"]): r for r in rows}
    bad, good = {}, []
    for path in paths:
        r = found.get(plain(path))
        if r is None:
            bad[path] = "File is empty"
        elif r["keys"] is None:
            bad[path] = "Invalid JSON"
        elif missing := [c for c in need if c not in r["keys"]]:
            bad[path] = "Missing required columns: " + ", ".join(missing)
        else:
            good.append(r)
    return bad, known_files(fmt, good)
