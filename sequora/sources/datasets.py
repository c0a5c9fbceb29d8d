"""A directory of named reference datasets: sequences, lineages and a manifest each."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks


class Datasets:
    """Datasets below a base directory on any file system that Spark reads.

    A dataset counts as made once its manifest is there; it is written last, and removed first.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _at(self, name: str, part: str = "") -> str:
        if not re.fullmatch(r"[\w.-]+", name) or name.strip(".") == "":
            raise ValueError(f"not a name of a dataset: {name!r}")
        return f"{self.base}/{name}/{part}".rstrip("/")

    def has(self, name: str) -> bool:
        fs, p = self._fs(self._at(name, "manifest"))
        return fs.exists(p)

    def _known(self, name: str) -> str:
        if not self.has(name):
            raise ValueError(f"no dataset named {name!r}")
        return name

    def make(self, name: str, sequences: DataFrame, lineages: DataFrame, ranks: list[str], note: str = "") -> dict:
        """Writes (acc, seq) and (acc, one column per rank); returns the manifest."""
        if self.has(name):
            raise ValueError(f"the dataset {name!r} is there already")
        sequences.write.mode("overwrite").parquet(self._at(name, "sequences"))
        lineages.write.mode("overwrite").parquet(self._at(name, "lineages"))
        n = self.sequences_at(name).count()
        taxa = self.spark.read.parquet(self._at(name, "lineages")).agg(*[F.count_distinct(r).alias(r) for r in ranks]).first().asDict() if ranks else {}
        manifest = {"name": name, "sequences": n, "taxa": taxa, "ranks": ranks, "note": note}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(self._at(name, "manifest"))
        return manifest

    def sequences_at(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(name, "sequences"))

    def sequences(self, name: str) -> DataFrame:
        return self.sequences_at(self._known(name))

    def lineages(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(self._known(name), "lineages"))

    def manifest(self, name: str) -> dict:
        return json.loads(self.spark.read.text(self._at(self._known(name), "manifest")).first()[0])

    def names(self) -> list[str]:
        fs, p = self._fs(self.base)
        if not fs.exists(p):
            return []
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if re.fullmatch(r"[\w.-]+", n) and self.has(n))

    def delete(self, name: str) -> None:
        for part in ("manifest", ""):
            fs, p = self._fs(self._at(self._known(name) if part else name, part))
            fs.delete(p, True)

    def export(self, name: str, path: str) -> None:
        """FASTA of the sequences and a delimited table of the lineages below path."""
        sinks.write_fasta(self.sequences(name), f"{path}/sequences")
        sinks.write_report(self.lineages(name), f"{path}/lineages")
