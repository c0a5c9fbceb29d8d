"""Confusion counts, scores and their summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, real, pred, n); calls: (by, real, pred), -1 for no prediction."""
    return calls.where("real is not null").groupBy(*(by or []), "real", "pred").agg(F.count("*").alias("n"))


def scores(conf: DataFrame, by: list[str] | None = None, legacy_accuracy: bool = False) -> DataFrame:
    """(by, taxon, tp, fp, fn, acc, prc, rec, f1) of every real or predicted taxon, from one confusion table."""
    by, n, zero = by or [], F.col("n").cast("bigint"), F.lit(0).cast("bigint")

    def of(taxon, *counts):
        return F.struct(F.col(taxon).cast("bigint").alias("taxon"), *[c.alias(k) for k, c in zip(("tp", "p", "r"), counts, strict=True)])

    real, pred = of("real", F.when(F.col("real") == F.col("pred"), n).otherwise(zero), zero, n), of("pred", zero, n, zero)
    # the table is read once, since all that makes it would run again for a second use
    both = conf.select(*by, F.explode(F.when(F.col("pred") != -1, F.array(real, pred)).otherwise(F.array(real))).alias("_x"))
    t = both.groupBy(*by, F.col("_x.taxon").alias("taxon")).agg(*[F.sum(f"_x.{c}").alias(c) for c in ("tp", "p", "r")])
    t = t.withColumn("total", F.sum("r").over(Window.partitionBy(*by)))  # every count has one real taxon
    tp, p, r = F.col("tp"), F.col("p"), F.col("r")
    good = tp if legacy_accuracy else F.col("total") - p - r + 2 * tp
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return t.select(*by, "taxon", "tp", (p - tp).alias("fp"), (r - tp).alias("fn"), (good / F.col("total")).alias("acc"), ratio(tp, p).alias("prc"), ratio(tp, r).alias("rec"), ratio(2 * tp, p + r).alias("f1"))


def cross_entropy(support):
    """Loss of the real taxon's support: -ln within [e^-10, 1]; an absent support costs 10."""
    return -F.log(F.least(F.greatest(F.coalesce(support, F.lit(0.0)), F.lit(math.exp(-10))), F.lit(1.0)))
