"""Command line: ``python -m barspark <task> ...`` (§3 E).

Tasks: ``load`` (read files, print row count and skipped files), ``convert`` (any
format → any format), ``preprocess`` (scale numeric columns), ``prepare`` (date range,
balance, dedupe, NULL drop, save) and ``report`` (per-file quality report).
"""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="barspark")
    sub = ap.add_subparsers(dest="task", required=True)
    ld = sub.add_parser("load")
    ld.add_argument("root")
    ld.add_argument("--format", default="txt")
    cv = sub.add_parser("convert")
    cv.add_argument("src")
    cv.add_argument("dst")
    cv.add_argument("--from", dest="src_fmt")
    cv.add_argument("--to", dest="dst_fmt")
    pp = sub.add_parser("preprocess")
    pp.add_argument("src")
    pp.add_argument("dst")
    pp.add_argument("--method", default="minmax")
    pr = sub.add_parser("prepare")
    pr.add_argument("src")
    pr.add_argument("dst")
    pr.add_argument("--from", dest="src_fmt")
    pr.add_argument("--to", dest="dst_fmt", default="parquet")
    pr.add_argument("--start")
    pr.add_argument("--end")
    pr.add_argument("--target", type=int)
    pr.add_argument("--min", dest="minimum", type=int)
    pr.add_argument("--drop-nulls", action="store_true")
    rp = sub.add_parser("report")
    rp.add_argument("root")
    rp.add_argument("--as-of")
    for q in (ld, rp):
        q.add_argument("--out", help="folder for the whole tables as JSON lines")
    ap.add_argument("--master")
    args = ap.parse_args(argv)

    from barspark.session import get_spark
    spark = get_spark(args.master)
    if args.task == "load":
        from barspark.sources.readers import load_with_skips
        bars, skipped = load_with_skips(spark, args.root, args.format)
        if args.out:
            skipped.write.mode("overwrite").json(f"{args.out}/skipped")
        print(json.dumps({"rows": bars.count(), "skipped": [r.asDict() for r in skipped.collect()]}))
    elif args.task == "convert":
        from barspark.sources.sinks import convert
        convert(spark, args.src, args.dst, args.src_fmt, args.dst_fmt)
    elif args.task == "preprocess":
        from barspark.plans.prepare import preprocess_file
        preprocess_file(spark, args.src, args.dst, method=args.method)
    elif args.task == "prepare":
        from barspark.plans.prepare import prepare_files
        prepare_files(spark, args.src, args.dst, args.src_fmt, args.dst_fmt, start=args.start, end=args.end,
                      target=args.target, minimum=args.minimum, drop_null_rows=args.drop_nulls)
    elif args.task == "report":
        from barspark.plans.report import quality_report
        rep = quality_report(spark, args.root, args.as_of)
        print(json.dumps({k: v for k, v in rep["summary"].first().asDict().items()}, default=str))
        if args.out:
            for name, table in rep.items():
                table.write.mode("overwrite").json(f"{args.out}/{name}")
        else:
            for r in rep["issues"].toLocalIterator():
                print(json.dumps(r.asDict(), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
