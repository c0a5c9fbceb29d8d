"""Queries on taxonomy trees and lineage tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sequora.operators import taxonomy as X
from sequora.sources import tables as T

from .registry import query

RANKS = ["region", "nation", "customer"]


@query("SELECT taxid, ancestor, rank FROM up", "tree up", recursive=True)
def unfold_lineage(spark, d):
    return X.unfold(T.tree(spark, d))


@query("SELECT taxid, max(CASE WHEN rank = 'region' THEN ancestor END) AS region, max(CASE WHEN rank = 'nation' THEN ancestor END) AS nation, max(CASE WHEN rank = 'customer' THEN ancestor END) AS customer FROM up GROUP BY taxid", "tree up", recursive=True)
def lineage_table(spark, d):
    return X.lineage_table(X.unfold(T.tree(spark, d)), RANKS)


@query("SELECT seq, coalesce(genus, family, ord) AS taxid FROM lin", "lin")
def lowest_taxid(spark, d):
    lin = T.lineage(T.alignment(spark, d, 1))
    return lin.select("seq", F.coalesce("genus", "family", "order").alias("taxid"))


@query("SELECT seq, ord AS \"order\", CASE WHEN seq % 13 <> 0 THEN family END AS family, CASE WHEN seq % 13 <> 0 THEN genus END AS genus FROM lin", "lin")
def expand_guide(spark, d):
    lin = T.lineage(T.alignment(spark, d, 1)).withColumn("family", F.when(F.col("seq") % 13 != 0, F.col("family")))
    return X.without_orphans(lin, ["order", "family", "genus"]).select("seq", "order", "family", "genus")


@query("SELECT DISTINCT family AS name, 'root' AS parent, 'family' AS rank FROM wide UNION SELECT genus, family, 'genus' FROM wide UNION SELECT species, genus, 'species' FROM wide", "wide")
def guide_from_wide(spark, d):
    return X.guide_of(T.wide_taxonomy(spark, d), ["family", "genus", "species"])


@query("SELECT count(DISTINCT ord) AS \"order\", count(DISTINCT family) AS family, count(DISTINCT genus) AS genus FROM lin", "lin")
def rank_counts(spark, d):
    return T.lineage(T.alignment(spark, d, 1)).agg(*[F.countDistinct(r).alias(r) for r in ("order", "family", "genus")])


@query("SELECT ancestor AS taxid, CAST(sum(k) AS BIGINT) AS n FROM up JOIN (SELECT 100000 + o_custkey AS taxid, count(*) AS k FROM orders GROUP BY ALL) USING (taxid) GROUP BY ancestor", "tree up", recursive=True)
def tax_rollup(spark, d):
    return X.rollup_counts(X.unfold(T.tree(spark, d)), T.table(spark, d, "orders").select((100000 + F.col("o_custkey")).alias("taxid")))


@query("SELECT c_nationkey, CASE WHEN min(c_mktsegment) = max(c_mktsegment) THEN min(c_mktsegment) END AS segment, min(taxid) AS first FROM (SELECT *, 100000 + c_custkey AS taxid FROM customer) GROUP BY c_nationkey")
def consensus_taxonomy(spark, d):
    c = T.table(spark, d, "customer").withColumn("taxid", 100000 + F.col("c_custkey"))
    return c.groupBy("c_nationkey").agg(F.when(F.min("c_mktsegment") == F.max("c_mktsegment"), F.min("c_mktsegment")).alias("segment"), F.min("taxid").alias("first"))


@query("SELECT taxid, parent FROM tree WHERE taxid NOT IN (SELECT parent FROM tree)", "tree")
def leaves(spark, d):
    t = T.tree(spark, d)
    return t.join(t.select(F.col("parent").alias("taxid")).distinct(), "taxid", "left_anti").select("taxid", "parent")


@query()
def lincode(spark, d):
    return X.line_codes(X.guide_of(T.wide_taxonomy(spark, d), ["family", "genus", "species"]))
