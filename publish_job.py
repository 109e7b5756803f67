"""Publish one report run: spark-submit publish_job.py --facts PATH --root PATH [--report-ts ISO]"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trailmetrics.operators.contracts import ContractViolation
from trailmetrics.plans.history import open_current
from trailmetrics.plans.publish import Batch, PublishedRun, client_root, publish_clients, publish_run
from trailmetrics.sources.facts import read_facts


def main(arguments: list[str] | None = None) -> PublishedRun | Batch:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--facts", required=True, help="Parquet table of failures")
    parser.add_argument("--root", required=True, help="folder of the run history")
    parser.add_argument("--report-ts", help="ISO-8601 instant; now if left out")
    parser.add_argument("--tz", default="UTC", help="time zone of days and day windows")
    clients = parser.add_mutually_exclusive_group()
    clients.add_argument("--client", help="report on this client of the facts alone")
    clients.add_argument("--all-clients", action="store_true", help="a run for each client of the facts, in one pass")
    args = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO)

    spark = SparkSession.builder.appName("trailmetrics publish").getOrCreate()
    facts, root = read_facts(spark, args.facts), args.root
    if args.client is not None:
        facts = facts.where(F.col("client") == args.client)
        if facts.isEmpty():
            parser.error(f"no facts of client {args.client!r}")
        root = client_root(root, args.client)
    if args.all_clients:
        batch = publish_clients(spark, facts, root, args.report_ts, tz=args.tz)
        if batch.broken:  # the other clients are published
            raise ContractViolation("; ".join(f"{client}: {said}" for client, said in sorted(batch.broken.items())))
        return batch
    run = publish_run(spark, facts, root, args.report_ts, tz=args.tz)
    open_current(spark, root)
    return run


if __name__ == "__main__":
    main()
