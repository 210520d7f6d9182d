"""Commands: ``python -m ledgerline.cli <command> --tables FOLDER``. Each is a thin call of the library."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import model
from .operators import diff, handlers, report
from .sources import guard, sinks


def stored(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that a folder has, each a file or folder named like the table."""
    fs, _ = sinks.file_system(spark, folder)
    there = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}.parquet"))
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in model.TABLES if there(n)}


def info(spark: SparkSession, a: argparse.Namespace) -> int:
    for name, df in sorted(stored(spark, a.tables).items()):
        print(f"{name}\t{df.count()}")
    return guard.OK


def show_report(spark: SparkSession, a: argparse.Namespace) -> int:
    print(sinks.report_json(report.summary(stored(spark, a.tables))))
    return guard.OK


def pages(spark: SparkSession, a: argparse.Namespace) -> int:
    t = stored(spark, a.tables)
    found = report.list_pages(t["doc_document"], t["doc_page"], a.status, a.template, a.margin_below, a.ties, a.rotated)
    for r in found.select("source", "status", "template_name").limit(a.limit).collect():
        print(r.source, r.status, r.template_name or "-", sep="\t")
    return guard.OK


def run_query(spark: SparkSession, a: argparse.Namespace) -> int:
    from .plans import catalog

    catalog.QUERIES[a.name](spark, a.tables).write.mode("error").parquet(a.out)
    return guard.OK


def orphans(spark: SparkSession, a: argparse.Namespace) -> int:
    found = diff.orphans(stored(spark, a.tables)).collect()
    print(json.dumps({r["table"]: r["n"] for r in found}))
    return guard.exit_code(0, 0, differences=len(found))


def regress(spark: SparkSession, a: argparse.Namespace) -> int:
    """Two reports' differences beyond a tolerance; there are none if a change left everything as it was."""
    one, other = (report.summary(stored(spark, f)).selectExpr("section", "key", "CAST(n AS double) AS value") for f in (a.tables, a.other))
    rows = diff.flat_diff(one, other, ["section", "key"], a.tolerance).collect()
    for r in rows:
        print(r.section, r.key, r.before, r.after, r.kind, sep="\t")
    return guard.exit_code(0, 0, differences=len(rows))


def checks(spark: SparkSession, a: argparse.Namespace) -> int:
    for r in handlers.check_summary(stored(spark, a.tables)["xcheck_usage"]).orderBy("check_kind", "result").collect():
        print(r.check_kind, r.result, r.n, sep="\t")
    return guard.OK


COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace], int]] = {"info": info, "report": show_report, "pages": pages, "query": run_query, "orphans": orphans, "regress": regress, "checks": checks}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerline")
    sub = p.add_subparsers(dest="command", required=True)
    own = {n: sub.add_parser(n) for n in COMMANDS}
    for c in own.values():
        c.add_argument("--tables", required=True)
    for flag in ("--status", "--template"):
        own["pages"].add_argument(flag)
    own["pages"].add_argument("--margin-below", type=float)
    own["pages"].add_argument("--limit", type=int, default=1000)
    for flag in ("--ties", "--rotated"):
        own["pages"].add_argument(flag, action="store_true")
    own["query"].add_argument("--name", required=True)
    own["query"].add_argument("--out", required=True)
    own["regress"].add_argument("--other", required=True)
    own["regress"].add_argument("--tolerance", type=float, default=0.01)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    session = spark or SparkSession.builder.appName("ledgerline").getOrCreate()
    try:
        return COMMANDS[a.command](session, a)
    except Exception as e:  # a command's failure is its message and code, without secrets
        print(guard.message(e), file=sys.stderr)
        return guard.FAILED


if __name__ == "__main__":
    sys.exit(main())
