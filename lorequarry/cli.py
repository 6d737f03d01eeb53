"""Command line: extract, discover, export, report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions.text import HIGH, MEDIUM
from .plans import engine


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="lorequarry")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract", help="units from the files of a folder that are new or changed")
    e.add_argument("source")
    e.add_argument("--confidence-high", type=float, default=HIGH)
    e.add_argument("--confidence-medium", type=float, default=MEDIUM)
    d = sub.add_parser("discover", help="tasks from units")
    d.add_argument("--cluster-threshold", type=float, default=0.5)
    d.add_argument("--merge-threshold", type=float, default=0.85)
    x = sub.add_parser("export", help="files for others")
    x.add_argument("-f", "--formats", default=",".join(engine.FORMATS))
    x.add_argument("--whole-files", action="store_true", help="a file a format, through this process, instead of folders that executors write")
    x.add_argument("--approved-only", action="store_true")
    x.add_argument("--bundle", help="also a ZIP of all files, which are whole ones then")
    r = sub.add_parser("report", help="JSON files: the units, their summary, what is to be reviewed and why, and proposed classes")
    for q in (e, d, x, r):
        q.add_argument("-c", "--corpus", default="default")
        q.add_argument("-o", "--output", default="output")
        q.add_argument("--concepts", help="Parquet of the ontology")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("lorequarry").getOrCreate()
    store = engine.Store(spark, f"{a.output}/{a.corpus}")
    concepts = spark.read.parquet(a.concepts) if a.concepts else None
    tell = lambda stage, state, share: print(f"{share:4.0%} {stage} {state}")
    if a.command == "extract":
        units = engine.extract(spark, a.source, store, concepts, a.confidence_high, a.confidence_medium, progress=tell)
        print(f"{units.count()} units")
    elif a.command == "discover":
        print(f"{engine.discover(spark, store, concepts, a.cluster_threshold, a.merge_threshold, progress=tell).count()} tasks")
    elif a.command == "report":
        for k, v in engine.reports(store, f"{a.output}/{a.corpus}-export").items():
            print(f"{k}: {v}")
    else:
        paths = engine.export(spark, store, f"{a.output}/{a.corpus}-export", tuple(a.formats.split(",")), a.approved_only, whole_files=a.whole_files or bool(a.bundle))
        if a.bundle:
            paths["bundle"] = engine.bundle(paths, a.bundle)
        for k, v in paths.items():
            print(f"{k}: {v}")


if __name__ == "__main__":
    main()
