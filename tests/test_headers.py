"""First lines and listings: bytes read, line ends, compression, deep folders, one look at a folder."""

import gzip
import io
import os

import pytest
from pyspark.sql import functions as F

from barspark.plans.report import clean_folder, quality_report
from barspark.sources import files as fl, headers as hd, listing as ls
from barspark.sources.readers import load_with_skips

STOOQ = "<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>\n"


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


@pytest.mark.parametrize("raw,line", [
    (b"a,b\n1,2\n", "a,b"), (b"\n \n\r\n a \r\n1", " a "), (b"a\rb", "a"), (b"\xef\xbb\xbf\nx", "x"), (b"", None), (b" \n\n", None), (b"no end", "no end"),
    (b"\t\nx\n", "\t"), (b"\xff\xfex\n", "��x"), (b"a" * 200_000 + b"\nb", "a" * 200_000), ("é\r\n".encode(), "é")])
@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_first_line(raw, line, block):
    if block == 1 and len(raw) > 1000:
        block = 1000
    assert ls.first_line(io.BytesIO(raw).read, block) == line


def test_bytes_read_do_not_grow_with_the_file():
    for size in (1 << 20, 1 << 24):
        stream = Counted(b"ticker,timestamp,close\n" + b"x" * size)
        assert ls.first_line(stream.read) == "ticker,timestamp,close" and stream.taken <= ls.HEAD_BLOCK


def test_headers_of_large_and_packed_files(spark, tmp_dir):
    with open(f"{tmp_dir}/large.csv", "w") as f:
        f.write("\n\na,b\n")
        f.write("1,2\n" * 3_000_000)
    with gzip.open(f"{tmp_dir}/packed.csv.gz", "wt") as f:
        f.write("c\td\n1\t2\n")
    open(f"{tmp_dir}/blank.csv", "w").write("\n\n")
    os.mkdir(f"{tmp_dir}/sub dir")
    open(f"{tmp_dir}/sub dir/é+%20.csv", "w").write("e\n")
    got = {os.path.basename(r.path): r.header for r in hd.first_lines(spark, [tmp_dir], recursive=True).collect()}
    assert got == {"large.csv": "a,b", "packed.csv.gz": "c\td", "é+%20.csv": "e"}
    slow = {os.path.basename(r.path): r.header for r in hd.text_first_lines(spark, [tmp_dir], recursive=True).collect()}
    assert got == slow
    # the plan of the first lines scans no text
    plan = hd.first_lines(spark, [tmp_dir], recursive=True)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "content" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_listing_by_tasks(spark, tmp_dir):
    """More folders than the driver lists by itself, empty files, hidden ones, odd names."""
    want = {}
    for k in range(40):
        d = f"{tmp_dir}/d{k % 5}/e{k}/f"
        os.makedirs(d)
        for n, text in ((f"a{k}.csv", "x" * k), (".hidden.csv", "h"), ("_SUCCESS", ""), ("b c.txt", "y")):
            open(f"{d}/{n}", "w").write(text)
        want[f"{d}/a{k}.csv"], want[f"{d}/b c.txt"] = k, 1
    os.makedirs(f"{tmp_dir}/_temporary/0")
    open(f"{tmp_dir}/_temporary/0/z.csv", "w").write("z")
    open(f"{tmp_dir}/top.json", "w").write("{}")
    want[f"{tmp_dir}/top.json"] = 2
    rows = fl.list_files(spark, tmp_dir).collect()
    assert {r.path.removeprefix("file:"): r.length for r in rows} == want
    assert all(abs(r.modification_time.timestamp() - os.path.getmtime(r.path.removeprefix("file:"))) < 2 for r in rows)
    plan = ls.files_below(spark, tmp_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan  # folders are dealt out
    assert {os.path.basename(r.path) for r in fl.list_files(spark, tmp_dir, "a1{0,2}.*").collect()} == {"a10.csv", "a12.csv"}
    assert [r.length for r in fl.list_files(spark, f"{tmp_dir}/top.json").collect()] == [2]
    with pytest.raises(Exception):
        fl.list_files(spark, f"{tmp_dir}/nowhere").collect()


def test_hadoop_listing_agrees(spark, tmp_dir):
    """What the driver lists through Hadoop for stores unknown to pyarrow."""
    os.makedirs(f"{tmp_dir}/a/_hidden")
    for n in ("a/x.csv", "a/_hidden/y.csv", "z.txt"):
        open(f"{tmp_dir}/{n}", "w").write("1")
    here = {p.replace("file:/", "/").replace("//", "/"): n for p, n, _ in ls._hadoop_files(spark, tmp_dir)}
    assert here == {r.path.removeprefix("file:"): r.length for r in ls.files_below(spark, tmp_dir).collect()}
    assert not ls.known_store("viewfs://store/in")


def test_name_patterns():
    import re
    ok = lambda g, n: re.fullmatch(f"(?s:{ls.name_pattern(g)})", n) is not None
    assert ok("*.txt", "a.txt") and not ok("*.txt", "a.txt2") and ok("*.{txt,csv}", "x.csv") and ok("[ab]?.c+", "az.c+") and not ok("[!ab].c", "a.c") and ok("a,b", "a,b")


def test_load_with_skips_looks_once(spark, tmp_dir, monkeypatch):
    for k in range(6):
        open(f"{tmp_dir}/good{k}.txt", "w").write((STOOQ if k % 2 else STOOQ.replace(",", "\t")) + ("A,5,20240101,0,1,2,0,1,5,0\n" if k % 2 else "A\t5\t20240101\t0\t1\t2\t0\t1\t5\t0\n"))
    open(f"{tmp_dir}/bad.txt", "w").write("x,y\n1,2\n")
    open(f"{tmp_dir}/empty.txt", "w").close()
    looks = []
    real = ls.files_below
    monkeypatch.setattr(ls, "files_below", lambda *a: looks.append("list") or real(*a))
    monkeypatch.setattr(hd, "first_lines", lambda *a, **k: looks.append("first lines"))
    bars, skipped = load_with_skips(spark, tmp_dir, "txt")
    assert bars.count() == 6 and bars.where("close = 1.0").count() == 6
    assert {os.path.basename(r.path): r.error.split(":")[0] for r in skipped.collect()} == {"bad.txt": "Missing required columns", "empty.txt": "File is empty"}
    assert looks == ["list"]
    with pytest.raises(ValueError):
        load_with_skips(spark, tmp_dir, "txt", strict=True)


def test_files_by_folder():
    a, b = ["a"], ["b"]
    found = [hd.Layout(",", a, ["file:/r/x/1", "file:/r/x/2", "file:/r/y/z/3", "file:/r/m/4", "file:/r/m/n/5"]), hd.Layout("\t", b, ["file:/r/y/w/6", "file:/r/m/7", "file:/r/8"])]
    out = hd.by_folder("/r", found, ["file:/r/m/n/bad"])
    assert [k.paths for k in out] == [["file:/r/m/4", "file:/r/m/n/5", "file:/r/x", "file:/r/y/z"], ["file:/r/8", "file:/r/m/7", "file:/r/y/w"]]
    assert hd.by_folder("file:///r/", [hd.Layout(",", a, ["file:/r/x/1", "file:/r/2"])], [])[0].paths == ["file:/r"]
    assert hd.by_folder("s3://k/r", [hd.Layout(",", a, ["s3://k/r/x/1"])], ["s3://k/r/y/2"])[0].paths == ["s3://k/r/x"]


def test_file_that_arrives_meanwhile(spark, tmp_dir, monkeypatch):
    """Between the look and the read a file of another layout joins a folder: only the files looked at are read."""
    from barspark.sources import readers
    for k in range(3):
        os.makedirs(f"{tmp_dir}/a", exist_ok=True)
        open(f"{tmp_dir}/a/{k}.txt", "w").write(STOOQ + "A,5,20240101,0,1,2,0,1,5,0\n")
    real = readers.by_folder

    def late(*args):
        open(f"{tmp_dir}/a/late.txt", "w").write("x\ty\n1\t2\n")
        return real(*args)

    monkeypatch.setattr(readers, "by_folder", late)
    bars, _ = load_with_skips(spark, tmp_dir, "txt")
    assert bars.count() == 3 and {os.path.basename(f) for f in bars.inputFiles()} == {"0.txt", "1.txt", "2.txt"}


def test_report_by_path_and_cleaning_of_equal_names(spark, tmp_dir):
    """Without a key of the caller, two files of one name in two folders stay two."""
    for k, folder in enumerate(("us", "uk")):
        os.mkdir(f"{tmp_dir}/{folder}")
        open(f"{tmp_dir}/{folder}/same name.txt", "w").write(STOOQ + f"A,5,2024010{k + 2},0,1,2,0.5,1,5,0\n" * (k + 1))
    open(f"{tmp_dir}/us/only header.txt", "w").write(STOOQ)
    r = quality_report(spark, tmp_dir, as_of="2024-02-01")
    assert {x.source.rsplit("/", 2)[1]: x.records for x in r["files"].collect()} == {"us": 1, "uk": 2}
    assert [os.path.basename(x.source) for x in r["skipped"].collect()] == ["only header.txt"]
    clean_folder(spark, tmp_dir, f"{tmp_dir}-out", as_of="2024-02-01")
    out = spark.read.option("header", True).csv(f"{tmp_dir}-out").groupBy("source_file").count().collect()
    assert {x.source_file: x["count"] for x in out} == {"us/same name.txt": 1, "uk/same name.txt": 2}
