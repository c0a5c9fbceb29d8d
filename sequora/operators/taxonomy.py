"""Taxonomy trees and lineage tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unfold(tree: DataFrame) -> DataFrame:
    """(taxid, ancestor, rank) for every node and each node above it, itself included, the root left out.

    A join per level of the tree: ranks are few, and a level is a narrow table.
    """
    nodes = tree.where("taxid <> parent")
    up = nodes.select(F.col("taxid").alias("ancestor"), F.col("parent").alias("next"), "rank")
    out = step = nodes.select("taxid", F.col("taxid").alias("ancestor"), "rank", "parent")
    for _ in range(50):
        step = step.select("taxid", F.col("parent").alias("ancestor")).join(up, "ancestor").select("taxid", "ancestor", "rank", F.col("next").alias("parent"))
        if step.isEmpty():
            break
        out = out.union(step)
    return out.select("taxid", "ancestor", "rank")


def lineage_table(unfolded: DataFrame, ranks: list[str]) -> DataFrame:
    """(taxid, one column per rank), null where unknown."""
    return unfolded.groupBy("taxid").pivot("rank", ranks).agg(F.first("ancestor"))


def rollup_counts(unfolded: DataFrame, records: DataFrame) -> DataFrame:
    """(taxid, n): records of a node and all below it; records: (taxid)."""
    return unfolded.join(records.groupBy("taxid").agg(F.count("*").alias("k")), "taxid").groupBy("ancestor").agg(F.sum("k").alias("n")).withColumnRenamed("ancestor", "taxid")


def without_orphans(lineage: DataFrame, ranks: list[str]) -> DataFrame:
    """A null rank makes all lower ranks null."""
    ok, out = F.lit(True), {}
    for r in ranks:
        ok = ok & F.col(r).isNotNull()
        out[r] = F.when(ok, F.col(r))
    return lineage.withColumns(out)


def guide_of(wide: DataFrame, ranks: list[str]) -> DataFrame:
    """(name, parent, rank) of every name in adjacent rank columns; the highest hang on 'root'."""
    pairs = [F.struct(F.col(r).alias("name"), (F.col(ranks[i - 1]) if i else F.lit("root")).alias("parent"), F.lit(r).alias("rank")) for i, r in enumerate(ranks)]
    return wide.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").where("name is not null").distinct()


def prefix_codes(names: list[str]) -> list[str]:
    """The shortest prefix of each name that no other one starts with (the whole name if there is none)."""
    out = []
    for n in names:
        size = next((i for i in range(1, len(n) + 1) if sum(m.startswith(n[:i]) for m in names) == 1), len(n))
        out.append(n[:size])
    return out


def line_codes(guide: DataFrame, depth: int = 20) -> DataFrame:
    """(name, code): codes of siblings, joined by dots along the path from the root, level by level."""

    def siblings(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name")
        return pdf.assign(own=prefix_codes(pdf["name"].tolist()))[["name", "parent", "own"]]

    own = guide.select("name", "parent").groupBy("parent").applyInPandas(siblings, "name string, parent string, own string").cache()
    out = level = own.where("parent = 'root'").select("name", F.col("own").alias("code"))
    for _ in range(depth):
        level = own.join(level.select(F.col("name").alias("parent"), "code"), "parent").select("name", F.concat_ws(".", "code", "own").alias("code"))
        if level.isEmpty():
            break
        out = out.union(level)
    return out
