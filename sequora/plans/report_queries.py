"""Queries on votes, reports by rank and learning summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sequora.operators import neighbours as N
from sequora.sources import tables as T

from .classification import _counts, _lin, _near, _ranked
from .concept_queries import _FINE, _ONE, _STYP, _SUP, _fine, _single, _supplier_types, _types
from .registry import CTE, query


@query("SELECT q, r, round((hi + 4 - d4) * 1.0 / (hi + 4), 6) AS rara FROM near", "cells lin dist rk near")
def weights_rara(spark, d):
    """Weights that fall from distance 0 to one beyond the last orbital."""
    far = F.max("d4").over(Window.partitionBy("q")) + 4
    return _near(spark, d).select("q", "r", F.round((far - F.col("d4")) / far, 6).alias("rara"))


@query("SELECT q, CASE WHEN nx = n THEN -1 ELSE genus END AS pred, n AS votes FROM (SELECT q, genus, n, row_number() OVER (PARTITION BY q ORDER BY n DESC, genus) AS rn, lead(n) OVER (PARTITION BY q ORDER BY n DESC, genus) AS nx FROM (SELECT q, genus, count(*) AS n FROM rk JOIN lin ON rk.r = lin.seq WHERE place <= 3 AND genus IS NOT NULL GROUP BY ALL)) WHERE rn = 1", "cells lin dist rk")
def majority_vote(spark, d):
    near = N.each_taxon(_counts(spark, d, 3, "neighbour"), "genus")
    votes = near.groupBy("q", "genus").agg(F.sum("n").alias("n"))
    return N.winner(votes, ["q"], "genus", "n").withColumnRenamed("support", "votes")


_BY_RANK = "rs AS (SELECT q, rank, taxon, round(sum(w), 6) AS s FROM (SELECT q, w, unnest(['family', 'genus']) AS rank, unnest([l.family, l.genus]) AS taxon FROM near JOIN lin l ON near.r = l.seq) WHERE taxon IS NOT NULL GROUP BY ALL), rw AS (SELECT q, rank, CASE WHEN nx = s THEN -1 ELSE taxon END AS pred, s FROM (SELECT *, row_number() OVER g AS rn, lead(s) OVER g AS nx FROM rs WINDOW g AS (PARTITION BY q, rank ORDER BY s DESC, taxon)) WHERE rn = 1)"


@query(f"WITH {', '.join(CTE[c] for c in ('cells', 'lin', 'dist', 'rk', 'near'))}, {_BY_RANK} SELECT q, max(CASE WHEN rank = 'family' THEN pred END) AS family, max(CASE WHEN rank = 'family' THEN s END) AS family_support, max(CASE WHEN rank = 'genus' THEN pred END) AS genus, max(CASE WHEN rank = 'genus' THEN s END) AS genus_support FROM rw GROUP BY q")
def winner_report(spark, d):
    """The winner and its support at each rank, a row per query."""
    lin = _lin(spark, d).select(F.col("seq").alias("r"), "family", "genus").unpivot("r", ["family", "genus"], "rank", "taxon").where("taxon is not null")
    near = _ranked(spark, d).join(lin, "r")
    win = N.winner(N.support(near, ["q", "rank"], "taxon"), ["q", "rank"], "taxon", "w")
    wide = win.groupBy("q").pivot("rank", ["family", "genus"]).agg(F.first("pred").alias("p"), F.first("support").alias("s"))
    return wide.select("q", F.col("family_p").alias("family"), F.col("family_s").alias("family_support"), F.col("genus_p").alias("genus"), F.col("genus_s").alias("genus_support"))


@query("SELECT a, b, w, CAST(sum(differ) OVER (PARTITION BY a, b ORDER BY w) AS BIGINT) AS upto FROM (SELECT x.seq AS a, y.seq AS b, x.site // 16 AS w, count(*) FILTER (x.code <> y.code) AS differ FROM cells x JOIN cells y ON x.site = y.site AND x.label = y.label AND x.seq < y.seq GROUP BY ALL)", "cells")
def cumulative_distance(spark, d):
    """Differing sites of pairs of one label, added up over windows of 16 sites."""
    p = N.packed(T.alignment(spark, d), "p", 64).select("label", "seq", *[F.col(f"p_{x}")[0].alias(f"{x}1") for x in "kcb"])
    pairs = N.in_blocks(p, p.select("label", F.col("seq").alias("b"), *[F.col(f"{x}1").alias(f"{x}2") for x in "kcb"]), 8, ["label"]).where("seq < b")
    k, c, b = (F.col(f"{x}1").bitwiseXOR(F.col(f"{x}2")) for x in "kcb")
    differ = k.bitwiseOR(c).bitwiseOR(b)  # a bit per site, so a sum counts bits
    upto = F.array(*[F.bit_count(differ.bitwiseAND(F.lit((1 << 16 * (w + 1)) - 1 if w < 3 else -1).cast("bigint"))).cast("bigint") for w in range(4)])
    return pairs.select(F.col("seq").alias("a"), "b", F.posexplode(upto).alias("w", "upto")).withColumn("w", F.col("w").cast("bigint"))


@query("SELECT type, bin, count(*) AS taxa FROM (SELECT g.genus, CAST(t.type AS BIGINT) AS type, CAST(CASE WHEN count(typ.site) = 0 THEN 0 ELSE (count(typ.site) - 1) // 5 + 1 END AS BIGINT) AS bin FROM (SELECT DISTINCT genus FROM typ) g CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS type) t LEFT JOIN typ ON typ.genus = g.genus AND typ.type = t.type GROUP BY g.genus, t.type) GROUP BY type, bin", "cells lin mask typ")
def type_bins(spark, d):
    """Taxa by how many sites of a type they have, in bins of five; none is a bin of its own."""
    per = _types(spark, d).groupBy("genus").agg(*[F.count_if(F.col("type") == t).alias(str(t)) for t in range(5)])
    n = per.unpivot("genus", [str(t) for t in range(5)], "type", "n")
    bins = F.when(F.col("n") == 0, 0).otherwise(F.floor((F.col("n") - 1) / 5) + 1).cast("bigint")
    return n.groupBy(F.col("type").cast("bigint").alias("type"), bins.alias("bin")).agg(F.count("*").alias("taxa"))


@query(f"WITH {_SUP}, {_STYP} SELECT genus, CASE WHEN count(*) FILTER (type = 1) > 0 THEN 'full' WHEN count(*) FILTER (type = 2) > 0 THEN 'partial' ELSE 'no' END AS status FROM fy GROUP BY genus")
def solved_status(spark, d):
    """Whether a taxon has a site of values of its own alone, of some of its own, or none."""
    t = _supplier_types(spark, d).groupBy("genus").agg(F.count_if(F.col("type") == 1).alias("one"), F.count_if(F.col("type") == 2).alias("two"))
    return t.select("genus", F.when(F.col("one") > 0, "full").when(F.col("two") > 0, "partial").otherwise("no").alias("status"))


@query(f"WITH {CTE['cells']}, {_FINE}, {_ONE} SELECT fine.seq, fine.genus FROM fine JOIN sv ON fine.genus = sv.genus AND fine.site = sv.site GROUP BY ALL HAVING count(*) FILTER (fine.code > 0) = count(*)")
def complete_members(spark, d):
    """Members of a taxon whose codes are known at all its single-value sites."""
    c = _fine(spark, d).join(_single(spark, d).select("genus", "site"), ["genus", "site"])
    return c.groupBy("seq", "genus").agg(F.count_if(F.col("code") > 0).alias("k"), F.count("*").alias("n")).where("k = n").select("seq", "genus")
