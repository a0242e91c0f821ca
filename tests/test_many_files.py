"""Work that is measured in files, arrays or pairs: spread over tasks, and the same rows as before."""

import gzip
import json
import os
from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barspark.operators import correlation as corr, profile as pf
from barspark.plans.report import clean_folder, quality_report, timestamp_report
from barspark.schema import STOOQ_COLUMNS
from barspark.sources import files as fl, lines, listing as ls, readers as rd, sinks as sk
from barspark.sources.stooq_text import write_stooq_text


def stooq(spark, tickers=40):
    rows = [(t, "5", f"202401{d + 1:02}", "93000", "1.5", "2", "1", "x" if d == 2 else "1.25", "", "0", d) for t in [*(f"U{k}" for k in range(tickers)), "a/b c%", None] for d in range(4)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in STOOQ_COLUMNS) + ", seq long").repartition(3)


def test_files_by_tasks(spark, tmp_dir, monkeypatch):
    """Few bytes in many files keep their tasks; folders are named as Spark names them; the header is first."""
    seen = []
    monkeypatch.setattr("barspark.sources.stooq_text.write_lines", lambda *a: seen.append(1) or lines.write_lines(*a))
    raw = stooq(spark)
    write_stooq_text(raw, f"{tmp_dir}/x")
    assert seen
    files = [os.path.join(at, f) for at, _, fs in os.walk(f"{tmp_dir}/x") for f in fs if f.endswith(".txt")]
    assert len(files) == 42 and len({os.path.basename(f).split("-")[1] for f in files}) > 5
    assert {"_part=a%2Fb c%25", "_part=__HIVE_DEFAULT_PARTITION__"} < set(os.listdir(f"{tmp_dir}/x"))
    for f in files:
        text = open(f).read().split("\n")
        assert text[0] == "\t".join(STOOQ_COLUMNS) and [r.split("\t")[2] for r in text[1:-1]] == ["20240101", "20240102", "20240103", "20240104"]


def test_lines_are_read_as_scanned(spark, tmp_dir, monkeypatch):
    write_stooq_text(stooq(spark), f"{tmp_dir}/tab")
    write_stooq_text(stooq(spark, 3), f"{tmp_dir}/comma", sep=",", columns=[c for c in reversed(STOOQ_COLUMNS) if c != "<PER>"])
    open(f"{tmp_dir}/odd.txt", "wb").write("﻿\r\n <TICKER> ,<DATE>\r\n\r\n\"q, \"\"x\"\"\" ,20240101,more\rno end".encode())
    read = lambda: rd.read_stooq_raw(spark, tmp_dir, with_source=True, recursive=True, glob="*.txt")
    exp = sorted(map(str, read().collect()))
    monkeypatch.setattr(lines, "MANY", 0)
    df = read()
    assert "FileScan csv" not in df._jdf.queryExecution().toString() and sorted(map(str, df.collect())) == exp
    bars, _ = rd.load_with_skips(spark, f"{tmp_dir}/tab", "txt")
    assert bars.count() == rd.read_stooq(spark, f"{tmp_dir}/tab", recursive=True, glob="*.txt").count()


@pytest.mark.parametrize("end", [b"\n", b"\r\n", b"\r"])
def test_ranges_lose_no_line(tmp_dir, monkeypatch, end):
    path = f"{tmp_dir}/x.txt"
    exp = [b"head"] + [b"r" * (k % 23) + b"%d" % k for k in range(500)]
    open(path, "wb").write(end.join(exp) + (end if len(end) > 1 else b""))
    size = os.path.getsize(path)
    for step in (1, 2, 7, 64, 1000, size):
        monkeypatch.setattr(lines, "RANGE", step)
        got = [x for at in range(0, size, step) for x in lines._read(path, at, min(at + step, size))]
        assert [x for x in got if x] == exp


def test_driver_lists_the_top_only(spark, tmp_dir, monkeypatch):
    for k in range(50):
        os.makedirs(f"{tmp_dir}/good/p={k}")
        open(f"{tmp_dir}/good/p={k}/a.txt", "w").write("1")
    asked, real = [], ls._entries
    monkeypatch.setattr(ls, "_entries", lambda *a: asked.append(a) or real(*a))
    assert ls.files_below(spark, tmp_dir).count() == 50 and len(asked) == 1


def test_arrays_are_bounded(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(sk, "ARRAY_RECORDS", 7)
    df = spark.range(45).selectExpr("concat('T', id) ticker", "cast(id as double) close").coalesce(2)
    sk.save(df, tmp_dir, "json_array")
    docs = [json.load(open(f"{tmp_dir}/{f}")) for f in os.listdir(tmp_dir) if f.endswith(".txt") and os.path.getsize(f"{tmp_dir}/{f}")]
    assert max(map(len, docs)) == 7 and sorted(r["close"] for d in docs for r in d) == [float(k) for k in range(45)]
    assert rd.read_json(spark, tmp_dir).count() == 45


def test_arrays_are_read_once(spark, tmp_dir):
    """The store is not asked again for each number."""
    df = spark.range(3000).selectExpr("concat('T', id) ticker", "timestamp_ntz'2024-01-01' timestamp", "id / 7 open", "id / 3 close", "id / 9 vol")
    sk.save(df.coalesce(1), tmp_dir, "json_array")
    size = sum(os.path.getsize(f"{tmp_dir}/{f}") for f in os.listdir(tmp_dir) if f.startswith("part"))

    def read_so_far():
        return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics() if s.getScheme() == "file")

    bars = rd.read_json(spark, tmp_dir)
    before = read_so_far()
    assert sorted((r.ticker, r.open, r.close) for r in bars.collect()) == sorted((r.ticker, r.open, r.close) for r in df.collect())
    assert size <= read_so_far() - before < 3 * size


@pytest.mark.parametrize("whole", [512 << 20, 0])
@pytest.mark.parametrize("split", ["128m", "64"])
def test_arrays_are_read_as_by_spark(spark, tmp_dir, monkeypatch, whole, split):
    """Arrays of any layout, broken ones too, also where Spark splits their files."""
    one, two = ('{"ticker":%s,"open":%s,"high":"7.50","format":"f\\n"}' % x for x in (('"ä€"', "1.10"), ("1.10", "123456789012345678901234567890")))
    texts = {"line": f"[{one},{two}]", "pretty": f"[\r\n  {one},\r\n\r\n  {two}\r\n]\r\n", "bom": f"\ufeff[{one}]", "none": "[]", "numbers": '[{"ticker":"n","open":1e400,"close":-0.0,"vol":true},{"open":{"z":1.10},"low":[1, 2.50]}]',
             "cut": f"[{one},\n{two}"[:-9], "open": f"[{one},\n{two}\n", "more": f"[{one}] [{two}]", "odd": f"[null,{one},5]", "control": f"[{one}]".replace("f\\n", "f\x01")}
    for name, text in texts.items():
        open(f"{tmp_dir}/{name}.json", "wb").write(text.encode())
    open(f"{tmp_dir}/bytes.json", "wb").write(b'[{"ticker":"\xff\xc3","open":2.50}]')
    with gzip.open(f"{tmp_dir}/packed.json.gz", "wb") as f:
        f.write(texts["line"].encode())
    monkeypatch.setattr(rd, "WHOLE", whole)
    monkeypatch.setattr(rd, "conform_schema", lambda df, keep: df)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        for name in sorted(os.listdir(tmp_dir)):
            path = f"{tmp_dir}/{name}"
            exp = spark.read.option("multiLine", True).schema(rd.STRING_BARS).json(path).withColumn("timestamp", F.try_to_timestamp("timestamp"))
            got = rd.read_json(spark, path, with_source=True, shapes={True: [path]})
            assert [r._source.rsplit("/", 1)[1] for r in got.collect()] == [name] * exp.count()
            assert sorted(map(str, got.drop("_source").collect())) == sorted(map(str, exp.collect())), name
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pairs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(corr, "BAND", 2)
    rows = [(f"T{t:02}", d, float((t * 7 + d * d) % 11)) for t in range(40) for d in range(12) if (t + d) % 3]
    df = spark.createDataFrame(rows, "ticker string, date int, value double")
    out = corr.ticker_correlation(df, least=3, tile=4, chunk=5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("FlatMapGroupsInArrow")]
    exp = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0]}
    got = out.collect()
    assert len(got) == len({(r.ticker_a, r.ticker_b) for r in got}) and {(r.ticker_a, r.ticker_b) for r in got} == exp


def test_tickers_travel_packed(spark, monkeypatch):
    """A row a ticker and band goes to the tasks, not one a date, and the input is evaluated once."""
    rows = [(f"T{t:02}", d, float((t * 7 + d * d) % 11)) for t in range(40) for d in range(12) if (t + d) % 3]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    def arrived(*_):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = sum(b.num_rows for b in batches)
            yield pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array(["b"]), pa.array([n], pa.int64()), pa.array([None], pa.float64())], ["ticker_a", "ticker_b", "dates", "correlation"])
        return run

    monkeypatch.setattr(corr, "_bands", arrived)
    df = spark.createDataFrame(rows, "ticker string, date int, value double").mapInArrow(counted, "ticker string, date int, value double")
    got = [r.dates for r in corr.ticker_correlation(df, tile=4).collect()]
    bands = next(b for b in range(1, 41) if b * (b + 1) // 2 >= len(got))
    assert len(got) == bands * (bands + 1) // 2 and sum(got) == 40 * bands
    assert read.value == len(rows)


def test_keys_without_an_order_in_arrow(spark):
    """Keys that Arrow does not compare travel as rows a date, with the same pairs."""
    rows = [(f"T{t:02}", d, float((t * 7 + d * d) % 11)) for t in range(9) for d in range(12) if (t + d) % 3]
    df = spark.createDataFrame(rows, "ticker string, date int, value double")
    plain = corr.ticker_correlation(df, least=3, tile=4, chunk=5).collect()
    keyed = corr.ticker_correlation(df.withColumn("ticker", F.struct("ticker")), least=3, tile=4, chunk=5).collect()
    assert sorted((r.ticker_a[0], r.ticker_b[0], r.dates, r.correlation) for r in keyed) == sorted(map(tuple, plain)) and len(plain) == 36


def test_cleaned_folder_by_tasks(spark, tmp_dir, monkeypatch):
    write_stooq_text(stooq(spark, 30), f"{tmp_dir}/in")
    seen = []
    monkeypatch.setattr("barspark.plans.report.write_lines", lambda *a: seen.append(1) or lines.write_lines(*a))
    clean_folder(spark, f"{tmp_dir}/in", f"{tmp_dir}/out", as_of="2025-01-01")
    back = spark.read.option("header", True).csv(f"{tmp_dir}/out")
    assert seen and back.count() == 32 * 3 and back.columns[-1] == "source_file"


@pytest.fixture
def many_files(spark, tmp_dir, monkeypatch):
    """A folder of good and bad files that counts as very many, and the rows that the driver gets while a test runs."""
    write_stooq_text(stooq(spark, 60), f"{tmp_dir}/good")
    write_stooq_text(stooq(spark, 60), f"{tmp_dir}/bad", columns=[c for c in STOOQ_COLUMNS if c not in ("<DATE>", "<CLOSE>")])
    frame, got = type(spark.range(1)), []
    real = frame.collect
    monkeypatch.setattr(lines, "MANY", 10)
    monkeypatch.setattr(frame, "collect", lambda df: got.append(real(df)) or got[-1])
    monkeypatch.setattr(frame, "toLocalIterator", lambda df, *a: iter(df.collect()))
    return tmp_dir, got


def test_rollup_lists_once(spark, many_files):
    root, _ = many_files
    out = pf.directory_rollup(fl.list_files(spark, root, "*.txt").withColumn("path", fl._plain("path")), root)
    # tasks open the folder twice on the way down and once below: one listing
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3
    got = {(r["group_kind"], r["group"]): r.files for r in out.collect()}
    assert got["total", ""] == got["extension", ".txt"] == 124 and got["directory", "bad/_part=U7"] == 1 and len(got) == 126


def test_load_keeps_paths_out_of_the_driver(spark, many_files):
    root, got = many_files
    bars, skipped = rd.load_with_skips(spark, root, "txt")
    assert max(map(len, got)) < 10
    assert bars.count() == 62 * 3 and skipped.where("error = 'Missing required columns: <DATE>, <CLOSE>' and path like '%/bad/%'").count() == 62
    with pytest.raises(ValueError, match="/bad/"):
        rd.load_with_skips(spark, root, "txt", strict=True)


def test_scan_keeps_paths_out_of_the_driver(spark, many_files):
    root, got = many_files
    raw = rd.read_stooq_raw(spark, root, with_source=True, recursive=True, glob="*.txt")
    assert max(map(len, got)) < 10
    assert raw.count() == 2 * 62 * 4 and raw.where("`<DATE>` is null").count() == 62 * 4 and raw.select("_source").distinct().count() == 124


def test_lengths_of_the_listing_are_used(spark, many_files, monkeypatch):
    root, _ = many_files
    monkeypatch.setattr(lines, "RANGE", 64)
    seen = ls.files_below(spark, f"{root}/good")
    rows = lines.data_lines(spark, seen.select("path", "length"))
    exp = lines.data_lines(spark, [r.path for r in seen.collect()])
    assert rows.count() == 62 * 4 and sorted(map(str, rows.collect())) == sorted(map(str, exp.collect()))


def test_reports_keep_paths_out_of_the_driver(spark, many_files):
    root, got = many_files
    files = quality_report(spark, root, as_of="2025-01-01")["files"]
    report = timestamp_report(spark, root, as_of="2025-01-01")
    assert max(map(len, got)) < 10
    # the rows are a table already: no figure reads the files again
    assert "MapInArrow" not in report["files"]._jdf.queryExecution().toString()
    assert {(r.records, r.trading_days) for r in files.collect()} == {(4, 4)} and files.count() == 62
    s = report["summary"].first()
    assert (s.total_files, s.processed_files, s.files_with_errors) == (124, 62, 62) and str(s.latest_date) == "2024-01-04 09:30:00"
    assert report["errors"].count() == 62 and report["files"].where("rows = 4 and invalid_dates = 0").count() == 62


def test_validation_lists_once(spark, many_files, monkeypatch):
    root, got = many_files
    asked, real = [], ls.files_below
    monkeypatch.setattr(ls, "files_below", lambda *a: asked.append(a) or real(*a))
    open(f"{root}/good/a.json", "w").write('[{"ticker": "A", "close": 1}]')
    cands = ls.files_below(spark, root).select("path", F.when(F.col("path").endswith("json"), "json").otherwise("txt").alias("format"))
    asked.clear()
    out = {(r.valid, r.error): r["count"] for r in fl.validate_files(spark, cands, root).groupBy("valid", "error").count().collect()}
    assert len(asked) == 1
    assert out == {(True, None): 62, (False, "Missing required columns: <DATE>, <CLOSE>"): 62, (False, "Missing required columns: timestamp"): 1}
