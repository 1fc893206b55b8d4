"""python -m cyclemill ingest | clean | merge | export | compact | tidy | report | ask. Exit 0, 1 if nothing worked, 2 for wrong use."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from cyclemill.config import ConfigError, load_config
from cyclemill.metrics import Measured
from cyclemill.operators.analyses import Session
from cyclemill.plans.execution import execute
from cyclemill.plans.planning import REPORTS, canned, route, with_level_check
from cyclemill.plans.report import write
from cyclemill.result import ERROR
from cyclemill.sources.raw import RawError
from cyclemill.sources.store import EventStore, StoreError, clean_to_csv


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cyclemill")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("ingest", help="raw day-files into a store")
    p.add_argument("raw", nargs="+")
    p.add_argument("--store", required=True)
    p.add_argument("--machine", required=True)
    p = sub.add_parser("clean", help="the events of a raw file or folder as CSV")
    p.add_argument("raw")
    p.add_argument("into")
    p = sub.add_parser("merge", help="stores into one")
    p.add_argument("store")
    p.add_argument("sources", nargs="+")
    p = sub.add_parser("compact", help="a store without duplicates")
    p.add_argument("store")
    p.add_argument("into")
    p = sub.add_parser("tidy", help="a store's segments into one, and what no snapshot needs any more dropped")
    p.add_argument("store")
    p.add_argument("--keep", type=int, default=10, help="snapshots to keep")
    p.add_argument("--hours", type=float, default=24.0, help="age of what is dropped, at least")
    p = sub.add_parser("export", help="a range of a store as one sorted Parquet folder")
    p.add_argument("store")
    p.add_argument("into")
    p.add_argument("--since")
    p.add_argument("--until")
    for name in ("report", "ask"):
        p = sub.add_parser(name)
        p.add_argument("what", **({"choices": REPORTS} if name == "report" else {}))
        p.add_argument("--config")
        p.add_argument("--period")
        p.add_argument("--out", default="reports")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if not e.code else 2
    spark = spark or SparkSession.builder.appName("cyclemill").getOrCreate()
    try:
        if args.command == "ingest":
            store = EventStore(spark, args.store)
            for path in args.raw:
                refused: dict[str, str] = {}
                with Measured() as took:
                    counts = store.ingest(path, args.machine, refused=refused)
                print(took.line(counts["valid"] + counts["skipped"], file=path, **counts, events=store.snapshot().segments[-1].rows, refused=refused))
        elif args.command == "clean":
            with Measured() as took:
                counts = clean_to_csv(spark, args.raw, args.into)
            print(took.line(counts["valid"] + counts["skipped"], file=args.raw, **counts))
        elif args.command == "merge":
            print(json.dumps({"failed": EventStore(spark, args.store).merge(args.sources)}))
        elif args.command == "compact":
            print(json.dumps({"rows": EventStore(spark, args.store).compact(args.into).count()}))
        elif args.command == "tidy":
            store = EventStore(spark, args.store)
            print(json.dumps({"rows": store.tidy().segments[0].rows, "dropped": len(store.vacuum(args.keep, args.hours))}))
        elif args.command == "export":
            print(json.dumps({"rows": EventStore(spark, args.store).export(args.into, args.since, args.until)}))
        else:
            cfg = load_config(args.config)
            plan = canned(args.what, args.period) if args.command == "report" else with_level_check(route(args.what, args.period), args.period)
            store = EventStore(spark, cfg.store_path)
            version = store.snapshot().version or None  # events and their readings of one snapshot
            run = execute(Session(cfg, store.read(version=version), store.readings(version)), plan)
            print(write(run, args.out))
            return int(all(r.status == ERROR for r in run.results))
    except ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    except (RawError, StoreError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
