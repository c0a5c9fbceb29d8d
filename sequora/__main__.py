"""Command line: python -m sequora make|list|delete|export|query."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from sequora.plans import catalog
from sequora.sources import sinks, tables
from sequora.sources.datasets import Datasets


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sequora")
    p.add_argument("--base", default="datasets", help="directory of the datasets")
    sub = p.add_subparsers(dest="command", required=True)
    make = sub.add_parser("make", help="a dataset from FASTA and a table of acc and ranks")
    make.add_argument("name")
    make.add_argument("fasta")
    make.add_argument("lineages")
    make.add_argument("--ranks", nargs="+", default=["phylum", "class", "order", "family", "genus", "species"])
    make.add_argument("--note", default="")
    sub.add_parser("list", help="names and sizes")
    sub.add_parser("delete").add_argument("name")
    export = sub.add_parser("export", help="a dataset as FASTA and a table")
    export.add_argument("name")
    export.add_argument("path")
    query = sub.add_parser("query", help="a registered query, written as a report")
    query.add_argument("query", choices=sorted(catalog.QUERIES))
    query.add_argument("tables", help="directory of the tables")
    query.add_argument("path")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("sequora").getOrCreate()
    sets = Datasets(spark, a.base)
    if a.command == "make":
        lineages = spark.read.csv(a.lineages, header=True)
        ranks = [r for r in a.ranks if r in lineages.columns]
        print(json.dumps(sets.make(a.name, tables.fasta(spark, a.fasta), lineages.select("acc", *ranks), ranks, a.note)))
    elif a.command == "list":
        for n in sets.names():
            print(json.dumps(sets.manifest(n)))
    elif a.command == "delete":
        sets.delete(a.name)
    elif a.command == "export":
        sets.export(a.name, a.path)
    else:
        sinks.write_report(catalog.QUERIES[a.query](spark, a.tables), a.path)


if __name__ == "__main__":
    main()
