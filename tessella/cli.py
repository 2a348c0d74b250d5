"""Command line: compress or restore a folder, generate text, run an experiment matrix, list queries."""

from __future__ import annotations

import argparse
import itertools
import time

from tessella.operators.chunking import ChunkParams
from tessella.plans import compress as plans
from tessella.session import get_spark
from tessella.sources import archives, files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compress", help="archive each file of a folder")
    u = sub.add_parser("restore", help="restore the archives of a folder")
    for q in (c, u):
        q.add_argument("-i", "--input", required=True)
        q.add_argument("-o", "--output", required=True)
        q.add_argument("-t", "--threads", default="*")
    c.add_argument("-w", "--codec", choices=("gzip", "bzip2", "none"), default="gzip")
    c.add_argument("--window", type=int, default=32)
    c.add_argument("-v", "--verbose", action="store_true")
    g = sub.add_parser("generate", help="write synthetic text")
    g.add_argument("-o", "--output", required=True)
    g.add_argument("--lines", type=int, default=1000)
    g.add_argument("--pattern", choices=files.PATTERNS, default="RAND")
    m = sub.add_parser("matrix", help="time compression over windows, codecs and repetitions")
    m.add_argument("-i", "--input", required=True)
    m.add_argument("--windows", type=int, nargs="+", default=[32, 1024, 2048])
    m.add_argument("--codecs", nargs="+", default=["gzip"])
    m.add_argument("--repeat", type=int, default=3)
    m.add_argument("-o", "--output", required=True)
    sub.add_parser("queries", help="list the registered queries")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.command == "queries":
        from tessella import catalogue

        print("\n".join(sorted(catalogue.queries())))
        return 0
    spark = get_spark("tessella-cli", getattr(a, "threads", "*"))
    if a.command == "compress":
        found = files.scan_files(spark, a.input)
        made, flagged = plans.compress(found, plans.CompressPlan(ChunkParams(window=a.window), codec=a.codec))
        archives.register(spark)
        made.join(found.select("file_idx", "file_name"), "file_idx").select("file_name", "archive").write.format("ddp").option("path", a.output).mode("append").save()
        if a.verbose:
            print(plans.report(made, flagged))
    elif a.command == "restore":
        archives.decode_folder(spark, a.input).write.mode("overwrite").parquet(a.output)
    elif a.command == "generate":
        files.synthetic_text(spark, a.lines, a.pattern).orderBy("line_no").select("line").write.mode("overwrite").text(a.output)
    else:
        rows = []
        for window, codec, n in itertools.product(a.windows, a.codecs, range(a.repeat)):
            began = time.time()
            made, _ = plans.compress(files.scan_files(spark, a.input), plans.CompressPlan(ChunkParams(window=window), codec=codec))
            size = made.selectExpr("coalesce(sum(bytes_in), 0) as b", "coalesce(sum(octet_length(archive)), 0) as o").first()
            took = time.time() - began
            rows.append((window, codec, n, took, size.b, size.o, size.b / took))
        spark.createDataFrame(rows, "window int, codec string, repetition int, seconds double, bytes_in long, bytes_out long, bytes_per_second double").coalesce(1).write.mode("overwrite").option("header", "true").csv(a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
