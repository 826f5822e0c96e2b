"""Command line: ``python -m tidemark experiment|research|check-inputs|datasets|market|collect ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from .plans import collect, experiment, research
from .plans import config as C
from .session import build_session, ship
from .sources import files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    sub = parser.add_subparsers(dest="command", required=True)
    e = sub.add_parser("experiment")
    e.add_argument("--config", default="configs/experiment.yaml")
    e.add_argument("--models", default="configs/models.yaml")
    e.add_argument("--datasets", default="configs/datasets.yaml")
    e.add_argument("--model-key")
    e.add_argument("--dataset-key")
    e.add_argument("--run-id")
    e.add_argument("--dry-run", action="store_true", default=None)
    for name in ("research", "check-inputs"):
        r = sub.add_parser(name)
        r.add_argument("--config", default="configs/research.yaml")
        r.add_argument("--prices", required=True)
        r.add_argument("--run-id")
        r.add_argument("--model-key")
        r.add_argument("--dataset-key")
    for name in ("datasets", "market"):  # what the files of a configuration hold
        c = sub.add_parser(name)
        c.add_argument("--config", default=f"configs/{name}.yaml")
        c.add_argument("--root", default=".")
    c = sub.add_parser("collect")
    c.add_argument("--config", default="configs/scrapers.yaml")
    c.add_argument("--root", default=".")
    c.add_argument("--site")
    c.add_argument("--cron", action="store_true", help="the window that the state leaves")
    c.add_argument("--since")
    c.add_argument("--until")
    c.add_argument("--build", action="store_true", help="merge the sites' records into the corpus afterwards")
    args = parser.parse_args(argv)
    if args.command == "collect" and (bool(args.since and args.until) == args.cron or bool(args.since) != bool(args.until)):
        parser.error("either --cron or --since and --until")
    spark = ship(build_session())
    if args.command == "collect":
        plan = collect.collection(C.load(args.config, collect.VERSION), args.root, args.site)
        since, until = collect.window(spark, plan) if args.cron else (args.since, args.until)
        added = collect.run(spark, plan, since, until, use_state=args.cron)
        print(json.dumps({"since": since, "until": until, "added": added, "corpus": collect.build_corpus(spark, plan) if args.build else None}))
        return 0
    if args.command == "datasets":
        report = experiment.check_datasets(spark, C.datasets(C.load(args.config), args.root))
        print(json.dumps(report, ensure_ascii=False, indent=2, default=str))
        return int(any("error" in r for r in report.values()))
    if args.command == "market":
        asked = C.market(C.load(args.config), args.root)
        rows = files.read_prices(spark, asked.path, asked.columns, asked.reader)
        print(json.dumps(rows.agg(F.count("*").alias("rows"), F.count_distinct("ticker").alias("tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date")).first().asDict(), default=str))
        return 0
    if args.command == "experiment":
        plan = C.experiment_plan(C.load(args.config), C.load(args.models), C.load(args.datasets), model_keys=args.model_key, dataset_keys=args.dataset_key, dry_run=args.dry_run, run=args.run_id)
        summary = experiment.run(spark, plan)
        print(json.dumps(summary, ensure_ascii=False, indent=2, default=str))
        return int(summary["status"] not in ("success",))
    plan = C.research_plan(C.load(args.config), args.prices, args.run_id, args.model_key, args.dataset_key)
    if args.command == "check-inputs":
        errors, warnings = research.check_inputs(spark, plan)
        print("\n".join([*(f"error: {x}" for x in errors), *(f"warning: {x}" for x in warnings)]) or "ready")
        return int(bool(errors))
    print(json.dumps(research.run(spark, plan), ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
