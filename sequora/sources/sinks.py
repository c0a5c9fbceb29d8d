"""Writers: FASTA files and delimited reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_fasta(sequences: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(acc, seq) as FASTA, a file per partition; null sequences are empty."""
    sequences.select(F.concat(F.lit(">"), "acc", F.lit("\n"), F.coalesce("seq", F.lit(""))).alias("value")).write.mode(mode).text(path)


def write_report(report: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """A report with a header line, in the partitions it has."""
    report.write.mode(mode).csv(path, sep=sep, header=True)
