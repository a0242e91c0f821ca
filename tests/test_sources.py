"""Readers, sinks, file checks and incremental ingest on small hand-made files."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from barspark.sources import files as fl
from barspark.sources import readers as rd
from barspark.sources import sinks as sk
from barspark.streaming.ingest import ingest_files, ingest_summary


def _conversion_rows():
    # the 10-row conversion pair: Open 100..109, High = Open+5, Low = Open-5, Close = Open+2
    return [(dt.datetime(2024, 1, 1 + i), 100.0 + i, 105.0 + i, 95.0 + i, 102.0 + i, 1_000_000) for i in range(10)]


def test_conversion_pair_csv_and_json_array(spark, tmp_dir):
    csv = os.path.join(tmp_dir, "conv.csv")
    with open(csv, "w") as fh:
        fh.write("ticker,timestamp,open,high,low,close,vol\n")
        for d, o, h, lo, c, v in _conversion_rows():
            fh.write(f"TEST,{d:%Y-%m-%d},{o},{h},{lo},{c},{v}\n")
    js = os.path.join(tmp_dir, "conv.json")
    with open(js, "w") as fh:
        json.dump([{"ticker": "TEST", "timestamp": f"{d:%Y-%m-%dT%H:%M:%S.000}", "open": o, "high": h, "low": lo,
                    "close": c, "vol": v} for d, o, h, lo, c, v in _conversion_rows()], fh)
    a = rd.load(spark, csv).orderBy("timestamp").collect()
    b = rd.load(spark, js).orderBy("timestamp").collect()
    assert len(a) == len(b) == 10
    assert [r["close"] for r in a] == [102.0 + i for i in range(10)] == [r["close"] for r in b]
    assert a[0]["timestamp"] == b[0]["timestamp"] == dt.datetime(2024, 1, 1)


def test_detect_format():
    assert rd.detect_format("/x/a.TXT") == "txt" and rd.detect_format("a.feather") == "feather"
    with pytest.raises(ValueError):
        rd.detect_format("a.xlsx")


@pytest.mark.parametrize("fmt", ["csv", "txt", "json", "json_array", "parquet", "feather"])
def test_roundtrip(spark, tmp_dir, fmt):
    rows = [("T", d, o, h, lo, c, float(v), 0.0, "test") for d, o, h, lo, c, v in _conversion_rows()]
    df = spark.createDataFrame(rows, "ticker string, timestamp timestamp_ntz, open double, high double, low double, "
                                     "close double, vol double, openint double, format string")
    out = os.path.join(tmp_dir, fmt)
    sk.save(df, out, fmt)
    back = rd.read_csv(spark, out) if fmt == "txt" else rd.load(spark, out, fmt)
    assert sorted(back.collect()) == sorted(df.collect())


def test_stooq_tab_and_comma(spark, tmp_dir):
    for sep, name in (("\t", "a.txt"), (",", "b.txt")):
        p = os.path.join(tmp_dir, name)
        with open(p, "w") as fh:
            fh.write("﻿" if sep == "," else "")
            fh.write(sep.join(["<TICKER>", "<PER>", "<DATE>", "<TIME>", "<OPEN>", "<HIGH>", "<LOW>", "<CLOSE>",
                               "<VOL>", "<OPENINT>"]) + "\n")
            fh.write(sep.join(["AAA", "D", "20240102", "0", "1", "2", "0.5", "1.5", "10", "0"]) + "\n")
        out = rd.read_stooq(spark, p).first()
        assert out["close"] == 1.5 and out["timestamp"] == dt.datetime(2024, 1, 2)


def _stooq_file(path, rows=1, header=True, cols=None):
    cols = cols or ["<TICKER>", "<PER>", "<DATE>", "<TIME>", "<OPEN>", "<HIGH>", "<LOW>", "<CLOSE>", "<VOL>",
                    "<OPENINT>"]
    with open(path, "w") as fh:
        if header:
            fh.write(",".join(cols) + "\n")
        for i in range(rows):
            fh.write(",".join(["AAA", "D", f"202401{10 + i}", "0", "1", "2", "0.5", "1.5", "10", "0"][:len(cols)])
                     + "\n")


def test_validate_and_skip(spark, tmp_dir):
    root = os.path.join(tmp_dir, "feed")
    os.makedirs(root)
    _stooq_file(os.path.join(root, "good.txt"), 3)
    _stooq_file(os.path.join(root, "noclose.txt"), 2, cols=["<TICKER>", "<PER>", "<DATE>", "<TIME>", "<OPEN>"])
    open(os.path.join(root, "empty.txt"), "w").close()
    _stooq_file(os.path.join(root, "header_only.txt"), 0)
    cands = spark.createDataFrame([(os.path.join(root, n), "txt") for n in
                                   ("good.txt", "noclose.txt", "empty.txt", "header_only.txt", "missing.txt")]
                                  + [(os.path.join(root, "good.txt"), "csv")], "path string, format string")
    v = {(os.path.basename(r["path"]), r["format"]): r for r in fl.validate_files(spark, cands, root).collect()}
    assert v[("good.txt", "txt")]["valid"] and v[("header_only.txt", "txt")]["valid"]
    assert v[("missing.txt", "txt")]["error"] == "File not found"
    assert v[("empty.txt", "txt")]["error"] == "File is empty"
    assert v[("noclose.txt", "txt")]["error"].startswith("Missing required columns: ")
    assert "does not match" in v[("good.txt", "csv")]["error"]
    bars, skipped = rd.load_with_skips(spark, root, "txt")
    assert bars.count() == 3
    assert {os.path.basename(r["path"]) for r in skipped.collect()} == {"noclose.txt", "empty.txt"}
    with pytest.raises(ValueError):
        rd.load_with_skips(spark, root, "txt", strict=True)
    found = {os.path.basename(r["path"]): r["is_stooq"] for r in fl.discover_stooq_files(spark, root).collect()}
    assert found == {"good.txt": True, "noclose.txt": False, "header_only.txt": True}
    loose = {os.path.basename(r["path"]): r["is_stooq"]
             for r in fl.discover_stooq_files(spark, root, rule="ticker").collect()}
    assert loose == {"good.txt": True, "noclose.txt": True, "header_only.txt": True}


def test_table_sinks(spark, tmp_dir):
    rows = [("T", dt.datetime(2024, 1, 1), 1.0)]
    df = spark.createDataFrame(rows, "ticker string, timestamp timestamp, close double")
    sk.save_table(df, "bars_t1", fmt="test", path=os.path.join(tmp_dir, "t1"))
    sk.save_table(df.union(df), "bars_t1", if_absent=True)  # kept as it is
    t = rd.read_table(spark, "bars_t1")
    assert t.count() == 1 and t.first()["format"] == "test" and t.columns[-1] == "format"


def test_ingest_only_new_files(spark, tmp_dir):
    src, table, ckpt, log = (os.path.join(tmp_dir, n) for n in ("src", "table", "ckpt", "log"))
    os.makedirs(src)

    def write(i):
        with open(os.path.join(src, f"f{i}.csv"), "w") as fh:
            fh.write("ticker,timestamp,close\n")
            fh.write(f"T{i},2024-01-0{i + 1} 00:00:00,{i}.5\n")

    for i in range(5):
        write(i)
    assert ingest_files(spark, src, table, ckpt, "csv", batch_size=2, log_path=log) == 5
    assert spark.read.parquet(table).count() == 5
    write(5)
    with open(os.path.join(src, "bad.csv"), "w") as fh:
        fh.write("ticker,timestamp,open\nB,2024-01-01,1\n")
    with open(os.path.join(src, "turned.csv"), "w") as fh:
        fh.write("close\ttimestamp\tticker\n9.5\t2024-01-09 00:00:00\tT9\n")
    assert ingest_files(spark, src, table, ckpt, "csv", batch_size=2, log_path=log) == 2
    got = {r["ticker"]: r["close"] for r in spark.read.parquet(table).collect()}
    assert got == {**{f"T{i}": i + 0.5 for i in range(6)}, "T9": 9.5}
    s = ingest_summary(spark, log, total_files=8).first()
    assert (s["batches"], s["files"], s["loaded"], s["failed"], s["rows"], s["percent"]) == (5, 8, 7, 1, 7, 100.0)
    errors = [e for r in spark.read.parquet(log).collect() for e in r["errors"]]
    assert len(errors) == 1 and errors[0].endswith("bad.csv: Missing required columns: close")


def test_cli_load_and_convert(spark, tmp_dir):
    from barspark.__main__ import main
    root = os.path.join(tmp_dir, "cli")
    os.makedirs(root)
    _stooq_file(os.path.join(root, "aaa.txt"), 4)
    assert main(["load", root]) == 0
    out = os.path.join(tmp_dir, "cli_out")
    assert main(["convert", os.path.join(root, "aaa.txt"), out, "--from", "txt", "--to", "parquet"]) == 0
    assert rd.read_parquet(spark, out).count() == 4


def test_ingest_stooq_text(spark, tmp_dir):
    src, table, ckpt = (os.path.join(tmp_dir, n) for n in ("src", "table", "ckpt"))
    os.makedirs(src)
    for i in range(3):
        with open(os.path.join(src, f"t{i}.txt"), "w") as fh:
            fh.write("\t".join(["<TICKER>", "<PER>", "<DATE>", "<TIME>", "<OPEN>", "<HIGH>", "<LOW>", "<CLOSE>",
                                "<VOL>", "<OPENINT>"]) + "\n")
            fh.write("\t".join([f"T{i}", "D", "20240102", "93000", "1", "2", "0.5", "1.5", "10", "0"]) + "\n")
            fh.write("\t".join([f"T{i}", "D", "20241302", "0", "1", "2", "0.5", "1.5", "10", "0"]) + "\n")
    ingest_files(spark, src, table, ckpt, "txt", batch_size=1)
    out = spark.read.parquet(table)
    assert out.count() == 3 and out.filter(F.col("timestamp") == dt.datetime(2024, 1, 2, 9, 30)).count() == 3


def test_arrow_ipc_stream_and_files(spark, tmp_dir):
    import pyarrow as pa
    d = os.path.join(tmp_dir, "ipc")
    os.makedirs(d)
    t = pa.table({"ticker": ["A", "B"], "close": [1.0, 2.0]})
    with pa.OSFile(os.path.join(d, "a.feather"), "wb") as sink, pa.ipc.new_file(sink, t.schema) as w:
        w.write_table(t)
    with pa.OSFile(os.path.join(d, "b.arrow"), "wb") as sink, pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    out = rd.read_feather(spark, d)
    assert out.count() == 4 and out.columns[0] == "ticker" and out.filter(F.col("open").isNull()).count() == 4


def test_quality_report(spark, tmp_dir):
    from barspark.plans.report import quality_report
    root = os.path.join(tmp_dir, "rep")
    os.makedirs(root)
    _stooq_file(os.path.join(root, "aaa.us.txt"), 5)
    _stooq_file(os.path.join(root, "hdr.txt"), 0)
    open(os.path.join(root, "zero.txt"), "w").close()
    _stooq_file(os.path.join(root, "bad.txt"), 2, cols=["<TICKER>", "<DATE>"])
    rep = quality_report(spark, root, as_of="2030-01-01")
    files = rep["files"].collect()
    assert [(r["ticker"], r["records"], r["gap_count"]) for r in files] == [("aaa", 5, 0)]
    reasons = sorted((os.path.basename(r["source"]), r["reason"]) for r in rep["skipped"].collect())
    assert reasons == [("hdr.txt", "Empty CSV file (no data rows)"), ("zero.txt", "Empty file (0 bytes)")]
    kinds = {os.path.basename(r["source"]): r["kind"] for r in rep["issues"].collect()}
    assert kinds == {"bad.txt": "invalid_file"}
    classes = {r["size_class"]: r["files"] for r in rep["size_classes"].collect()}
    assert classes == {"very_small": 1, "empty": 2}


def test_ticker_from_file_name(spark, tmp_dir):
    p = os.path.join(tmp_dir, "msft.us.txt")
    _stooq_file(p, 2)
    with open(p) as fh:
        lines = fh.read().splitlines()
    with open(p, "w") as fh:  # blank the <TICKER> values
        fh.write("\n".join([lines[0]] + ["," + ln.split(",", 1)[1] for ln in lines[1:]]) + "\n")
    assert {r["ticker"] for r in rd.read_stooq(spark, p).collect()} == {None}
    assert {r["ticker"] for r in rd.read_stooq(spark, p, ticker_from_file=True).collect()} == {"msft"}


def test_cli_prepare_and_report(spark, tmp_dir, capsys):
    from barspark.__main__ import main
    root = os.path.join(tmp_dir, "cli2")
    os.makedirs(root)
    _stooq_file(os.path.join(root, "aaa.txt"), 5)
    _stooq_file(os.path.join(root, "bbb.txt"), 3)
    with open(os.path.join(root, "bbb.txt")) as fh:
        text = fh.read().replace("AAA,", "BBB,")
    with open(os.path.join(root, "bbb.txt"), "w") as fh:
        fh.write(text)
    out = os.path.join(tmp_dir, "prepared")
    assert main(["prepare", root, out, "--from", "txt", "--target", "4", "--min", "2"]) == 0
    assert rd.read_parquet(spark, out).count() == 7  # aaa balanced to 4, bbb kept whole
    assert main(["report", root, "--as-of", "2030-01-01"]) == 0
    assert '"total_files": 2' in capsys.readouterr().out


def test_files_of_several_layouts(spark, tmp_dir):
    d = os.path.join(tmp_dir, "mixed dir+1")  # a name that is percent-encoded in file paths
    os.makedirs(d)
    files = {
        "a.txt": "<TICKER>\t<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<VOL>\nAAA\t20240102\t0\t1\t2\t0.5\t1.5\t10\n",
        "b.txt": "<CLOSE>,<HIGH>,<LOW>,<OPEN>,<VOL>,<TIME>,<DATE>,<TICKER>\n1.5,2,0.5,1,10,0,20240102,BBB\n",
        "c.txt": "\ufeffticker, date ,time,Open,HIGH,low,close,vol,per\nCCC,20240102,0,1,2,0.5,1.5,10,D\n",
    }
    for name, text in files.items():
        with open(os.path.join(d, name), "w", encoding="utf-8") as fh:
            fh.write(text)
    rows = rd.read_stooq(spark, d, with_source=True, glob="*.txt").collect()
    assert sorted((r["ticker"], r["open"], r["high"], r["low"], r["close"], r["vol"], r["openint"]) for r in rows) == [
        (t, 1.0, 2.0, 0.5, 1.5, 10.0, None) for t in ("AAA", "BBB", "CCC")]
    bars, skipped = rd.load_with_skips(spark, d, "txt")
    assert {r["ticker"] for r in bars.collect()} == {"AAA", "BBB"}
    assert [os.path.basename(r["path"]) for r in skipped.collect()] == ["c.txt"]  # loading wants the names as they are


def test_json_checks(spark, tmp_dir):
    d = os.path.join(tmp_dir, "json")
    os.makedirs(d)
    pad = "x" * 70_000
    files = {
        "long.json": json.dumps({"pad": pad, "ticker": "A"}) + "\n",
        "good.json": "\n" + json.dumps({"pad": pad, "ticker": "A", "timestamp": "2024-01-02", "close": 1.5}) + "\n" + json.dumps({"ticker": "A", "timestamp": "2024-01-03", "close": 2.5}) + "\n",
        "array.json": json.dumps([{"ticker": "B", "timestamp": "2024-01-02", "close": 3.5}], indent=1),
        "few.json": json.dumps([{"ticker": "B"}]),
        "text.json": "this is not json\n",
        "broken.json": "[{\"ticker\": \"B\",\n",
    }
    for name, text in files.items():
        with open(os.path.join(d, name), "w") as fh:
            fh.write(text)
    bars, skipped = rd.load_with_skips(spark, d, "json")
    assert sorted((r["ticker"], r["close"]) for r in bars.collect()) == [("A", 1.5), ("A", 2.5), ("B", 3.5)]
    why = {os.path.basename(r["path"]): r["error"] for r in skipped.collect()}
    assert why == {"long.json": "Missing required columns: timestamp, close", "few.json": "Missing required columns: timestamp, close",
                   "text.json": "Invalid JSON", "broken.json": "Invalid JSON"}


def test_feather_write_that_fails_leaves_nothing(spark, tmp_dir):
    from barspark.sources.arrow_ipc import FORMAT_NAME, PENDING, register
    register(spark)
    out = os.path.join(tmp_dir, "f")
    df = spark.range(100).repartition(4)
    df.write.format(FORMAT_NAME).mode("overwrite").save(out)
    with pytest.raises(Exception):
        df.select(F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id")).write.format(FORMAT_NAME).mode("append").save(out)
    assert spark.read.format(FORMAT_NAME).load(out).count() == 100 and not os.path.exists(os.path.join(out, PENDING))
    with pytest.raises(ValueError):
        sk.save(df, out, "feather", partition_by=["id"])


def test_timestamp_report(spark, tmp_dir):
    from barspark.plans.report import timestamp_report
    d = os.path.join(tmp_dir, "ts")
    os.makedirs(d)
    with open(os.path.join(d, "a.csv"), "w") as fh:
        fh.write("ticker,timestamp,close\n" + "".join(f"A,{t},1\n" for t in ("2024-01-01", "bad", "2030-01-01", "", "x", "y", "z", "w")))
    with open(os.path.join(d, "b.csv"), "w") as fh:
        fh.write("close\ttimestamp\n1\t2023-05-05 10:00:00\n")
    with open(os.path.join(d, "c.csv"), "w") as fh:
        fh.write("ticker,close\nA,1\n")
    open(os.path.join(d, "d.csv"), "w").close()
    rep = timestamp_report(spark, d, stooq=False, as_of="2025-01-01")
    files = {os.path.basename(r["source"]): r for r in rep["files"].collect()}
    assert (files["a.csv"]["rows"], files["a.csv"]["invalid_dates"], files["a.csv"]["first_invalid_rows"], files["a.csv"]["future_dates"]) == (8, 6, "1,3,4,5,6", 1)
    assert files["b.csv"]["invalid_dates"] == 0 and files["b.csv"]["first_invalid_rows"] is None
    assert {os.path.basename(r["path"]): r["error"] for r in rep["errors"].collect()} == {"c.csv": "Missing columns: timestamp", "d.csv": "Empty file"}
    s = rep["summary"].first()
    assert (s["total_files"], s["processed_files"], s["files_with_errors"], s["earliest_date"]) == (4, 2, 2, dt.datetime(2023, 5, 5, 10))


def test_large_arrow_files_are_split(spark, tmp_dir, monkeypatch):
    import pyarrow as pa
    from barspark.sources import arrow_ipc
    path = os.path.join(tmp_dir, "a.feather")
    t = pa.table({"ticker": [f"T{i}" for i in range(1000)], "close": [float(i) for i in range(1000)]})
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, t.schema) as w:
        w.write_table(t, max_chunksize=100)
    monkeypatch.setattr(arrow_ipc, "SPLIT_BYTES", os.path.getsize(path) // 4)
    parts = arrow_ipc._Reader(path).partitions()
    assert len(parts) > 2 and [(p.first, p.last) for p in parts][0] == (0, parts[0].last) and parts[-1].last == 10
    rows = [b for p in parts for b in arrow_ipc._Reader(path).read(p)]
    assert pa.Table.from_batches(rows).equals(t)


def test_listing_on_a_store_that_only_spark_reads(spark, tmp_dir):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.feed.link./in", f"file://{tmp_dir}")
    os.makedirs(os.path.join(tmp_dir, "feed", "_hidden"))
    _stooq_file(os.path.join(tmp_dir, "feed", "good.txt"), 3)
    for name in ("empty.txt", "_hidden/x.txt", ".y.txt"):
        open(os.path.join(tmp_dir, "feed", name), "w").close()
    root = "viewfs://feed/in/feed"
    listed = {os.path.basename(r["path"]): r["length"] for r in fl.list_files(spark, root, "*.txt").collect()}
    assert set(listed) == {"good.txt", "empty.txt"} and listed["empty.txt"] == 0 < listed["good.txt"]
    bars, skipped = rd.load_with_skips(spark, root, "txt")
    assert bars.count() == 3 and [(os.path.basename(r["path"]), r["error"]) for r in skipped.collect()] == [("empty.txt", "File is empty")]


def test_feather_commit_broken_off_anywhere(tmp_dir, monkeypatch):
    """After each single change of an overwrite or an append the folder shows the old or the new rows, and the next write mends it."""
    import pyarrow as pa
    import pyarrow.ipc as ipc

    from barspark.sources import arrow_ipc as ai

    class Broken(Exception):
        pass

    def rows(folder):
        out = []
        for f in ai._files(folder):
            with pa.memory_map(f) as m:
                out += ipc.open_file(m).read_all().column(0).to_pylist()
        return sorted(out)

    def write(folder, values, overwrite):
        w = ai._Writer(folder, overwrite)
        done = [w.write(iter([pa.record_batch([pa.array([v])], ["x"])])) for v in values]
        w.commit([*done, None, w.write(iter([]))])

    real, left = ai._step, [0]

    def step(action, *args):
        if left[0] == 0:
            raise Broken
        left[0] -= 1
        real(action, *args)

    for overwrite in (True, False):
        new = [3, 4, 5] if overwrite else [1, 2, 3, 4, 5]
        seen = []
        for k in range(12):
            folder = os.path.join(tmp_dir, f"{overwrite}{k}")
            write(folder, [1, 2], True)
            monkeypatch.setattr(ai, "_step", step)
            left[0] = k
            try:
                write(folder, [3, 4, 5], overwrite)
                broken = False
            except Broken:
                broken = True
            monkeypatch.setattr(ai, "_step", real)
            assert rows(folder) == (new if k else [1, 2])
            seen.append(broken)
            write(folder, [9], False)
            assert rows(folder) == sorted([9, *(new if k else [1, 2])]) and not os.path.exists(os.path.join(folder, ai.JOURNAL))
        assert seen[0] and seen[3] and not seen[-1]
    w = ai._Writer(os.path.join(tmp_dir, "aborted"), True)
    w.write(iter([pa.record_batch([pa.array([1])], ["x"])]))
    w.abort([])
    assert rows(os.path.join(tmp_dir, "aborted")) == [] and not os.path.exists(os.path.join(tmp_dir, "aborted", ai.PENDING))
