"""Queries on codes, coverage, filters, entropy and collapse."""

from __future__ import annotations

from pyspark.sql import functions as F

from sequora.functions import codes as C
from sequora.operators import intervals as I
from sequora.operators import sites as S
from sequora.sources import tables as T

from .registry import query

L = F.lit


def _long(*cols):
    return [F.col(c).cast("bigint").alias(c) for c in cols]


@query(r"SELECT doc_id, translate(regexp_replace(lower(text), '[^acgtunrykmswbdhv-]', '', 'g'), 'acgtunrykmswbdhv-', '12344000000000000') AS codes FROM documents")
def encode_bases(spark, d):
    return T.table(spark, d, "documents").select("doc_id", C.encode(C.bases(F.col("text"))).alias("codes"))


@query(r"SELECT doc_id, translate(reverse(regexp_replace(lower(text), '[^acgtunrykmswbdhv-]', '', 'g')), 'acgtunrykmswbdhv-', '43211000000000000') AS codes FROM documents")
def revcomp_encode(spark, d):
    return T.table(spark, d, "documents").select("doc_id", C.encode_reverse(C.bases(F.col("text"))).alias("codes"))


@query(r"SELECT doc_id, CAST(length(regexp_replace(regexp_replace(lower(text), '[^acgtunrykmswbdhv-]', '', 'g'), '[^-]', '', 'g')) AS BIGINT) AS gaps, CAST(length(regexp_replace(lower(text), '[^acgtunrykmswbdhv-]', '', 'g')) AS BIGINT) AS width FROM documents WHERE length(regexp_replace(regexp_replace(lower(text), '[^acgtunrykmswbdhv-]', '', 'g'), '[^-]', '', 'g')) < 0.2 * length(regexp_replace(lower(text), '[^acgtunrykmswbdhv-]', '', 'g'))")
def gap_filter(spark, d):
    s = C.bases(F.col("text"))
    rows = T.table(spark, d, "documents").select("doc_id", (F.length(s) - F.length(F.replace(s, L("-"), L("")))).cast("bigint").alias("gaps"), F.length(s).cast("bigint").alias("width"))
    return rows.where(F.col("gaps") < 0.2 * F.col("width"))


@query("SELECT seq, count(*) FILTER (code = 0) AS missing FROM cells GROUP BY seq HAVING count(*) FILTER (code = 0) <= 0.05 * count(*)", "cells")
def row_missing_filter(spark, d):
    return S.known_rows(T.cells(spark, d), 0.05).select(*_long("seq", "missing"))


@query("SELECT site, count(*) FILTER (code = 0) AS missing FROM cells WHERE seq IN (SELECT seq FROM cells GROUP BY seq HAVING count(*) FILTER (code = 0) <= 0.05 * count(*)) GROUP BY site HAVING count(*) FILTER (code = 0) <= 0.05 * count(*)", "cells")
def col_missing_filter(spark, d):
    return S.known_sites(T.cells(spark, d), 0.05, 0.05).select(*_long("site", "missing"))


@query("SELECT site, count(*) FILTER (code > 0) AS coverage FROM cells GROUP BY site", "cells")
def coverage(spark, d):
    return S.coverage(T.cells(spark, d)).select(*_long("site", "coverage"))


@query("SELECT site, round(c * 1.0 / max(c) OVER (), 6) AS normal FROM (SELECT site, count(*) FILTER (code > 0) AS c FROM cells GROUP BY site)", "cells")
def coverage_norm(spark, d):
    return S.coverage(T.cells(spark, d)).select(*_long("site"), F.round("normal", 6).alias("normal"))


@query("SELECT site, round(n, 6) AS normal FROM (SELECT site, c * 1.0 / max(c) OVER () AS n FROM (SELECT site, count(*) FILTER (code > 0) AS c FROM cells GROUP BY site)) WHERE n >= 0.97", "cells")
def coverage_sites(spark, d):
    return S.coverage(T.cells(spark, d)).where("normal >= 0.97").select(*_long("site"), F.round("normal", 6).alias("normal"))


@query("SELECT qseqid, line, s AS start, e AS \"end\", CAST(orient AS BIGINT) AS orient FROM nm", "m nm")
def match_filter(spark, d):
    return I.normalised(T.matches(spark, d), 0.005).select(*_long("qseqid", "line", "start", "end", "orient"))


@query("SELECT min(s) AS lower, max(e) AS upper, count(DISTINCT qseqid) AS n FROM nm", "m nm")
def bounds(spark, d):
    m = I.normalised(T.matches(spark, d), 0.005)
    return m.agg(F.min("start").cast("bigint").alias("lower"), F.max("end").cast("bigint").alias("upper"), F.countDistinct("qseqid").alias("n"))


@query("SELECT site, CAST(sum(x) OVER (ORDER BY site) AS BIGINT) AS coverage FROM (SELECT site, sum(x) AS x FROM (SELECT s AS site, 1 AS x FROM nm UNION ALL SELECT e, -1 FROM nm) GROUP BY site)", "m nm")
def interval_coverage(spark, d):
    return S.interval_coverage(I.normalised(T.matches(spark, d), 0.005)).select(*_long("site", "coverage"))


@query("SELECT qseqid, site, arg_max(line, line) AS code FROM (SELECT qseqid, line, s + unnest(range(e - s)) AS site FROM nm) GROUP BY qseqid, site", "m nm")
def matrix_assembly(spark, d):
    m = I.normalised(T.matches(spark, d), 0.005).select("qseqid", F.col("line").alias("qstart"), "start", F.array_repeat(F.col("line"), (F.col("end") - F.col("start")).cast("int")).alias("codes"))
    return I.assembled(m).select(*_long("qseqid", "site", "code"))


@query("SELECT CAST(i AS BIGINT) AS w, CAST(trunc(i * 48.0 / 5) AS BIGINT) AS start, CAST(trunc(i * 48.0 / 5) AS BIGINT) + 16 AS \"end\" FROM range(6) t(i)")
def sliding_windows(spark, d):
    return S.windows_table(spark, S.sliding(64, 16, 8))


@query("SELECT w, count(*) AS n FROM (SELECT w, seq FROM (SELECT i AS w, CAST(trunc(i * 48.0 / 5) AS BIGINT) AS st FROM range(6) t(i)) JOIN cells ON site >= st AND site < st + 16 GROUP BY w, seq HAVING count(*) FILTER (code = 0) <= 0.05 * count(*)) GROUP BY w", "cells")
def window_coverage(spark, d):
    w = F.broadcast(S.windows_table(spark, S.sliding(64, 16, 8)))
    per = T.cells(spark, d).join(w, (F.col("site") >= F.col("start")) & (F.col("site") < F.col("end"))).groupBy("w", "seq").agg(F.count_if(F.col("code") == 0).alias("m"), F.count("*").alias("k"))
    return per.where(F.col("m") <= 0.05 * F.col("k")).groupBy("w").agg(F.count("*").alias("n"))


@query("SELECT seq, string_agg(CAST(code AS VARCHAR), '' ORDER BY site) AS codes FROM cells WHERE site >= 8 AND site < 24 GROUP BY seq", "cells")
def window_slice(spark, d):
    return T.alignment(spark, d).select("seq", F.array_join(F.slice("codes", 9, 16), "").alias("codes"))


@query("SELECT seq, string_agg(CAST(code AS VARCHAR), '' ORDER BY site) AS codes FROM cells WHERE site IN (1, 5, 9, 33, 60) GROUP BY seq", "cells")
def column_list(spark, d):
    return T.alignment(spark, d).select("seq", F.array_join(F.transform(F.array(*[L(s) for s in (1, 5, 9, 33, 60)]), lambda s: F.get("codes", s)), "").alias("codes"))


@query("SELECT site FROM cells WHERE site >= 4 AND site < 50 AND label < 5 GROUP BY site HAVING count(*) FILTER (code > 0) >= 0.95 * count(*) INTERSECT SELECT site FROM cells WHERE label >= 5 GROUP BY site HAVING count(*) FILTER (code > 0) >= 0.95 * count(*)", "cells")
def site_overlap(spark, d):
    c = T.cells(spark, d)

    def usable(x):
        return x.groupBy("site").agg(F.count_if(F.col("code") > 0).alias("k"), F.count("*").alias("n")).where(F.col("k") >= 0.95 * F.col("n")).select("site")

    return usable(c.where("site >= 4 and site < 50 and label < 5")).intersect(usable(c.where("label >= 5"))).select(*_long("site"))


@query("SELECT site, round(h, 6) AS h, known FROM h", "cells h")
def site_entropy(spark, d):
    return S.entropy(S.code_counts(T.cells(spark, d), ["site"]), ["site"]).select(*_long("site"), F.round("h", 6).alias("h"), *_long("known"))


@query("SELECT site, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS h FROM (SELECT site, code, count(*) AS n FROM cells GROUP BY ALL) GROUP BY site", "cells")
def site_entropy_all(spark, d):
    return S.entropy(S.code_counts(T.cells(spark, d), ["site"]), ["site"], missing=True).select(*_long("site"), F.round("h", 6).alias("h"))


@query("SELECT site, round((2 - h) / 2, 6) AS information FROM h", "cells h")
def site_information(spark, d):
    return S.entropy(S.code_counts(T.cells(spark, d), ["site"]), ["site"]).select(*_long("site"), F.round((2 - F.col("h")) / 2, 6).alias("information"))


def _labelled(spark, d, n_sites=None):
    c = T.cells(spark, d, n_sites)
    lin = T.lineage(T.table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("seq"), F.col("label").cast("bigint").alias("label")))
    return c.join(lin, "seq")


@query("SELECT genus, site, round(h, 6) AS h FROM ht", "cells lin ht")
def taxon_entropy(spark, d):
    c = _labelled(spark, d).where("genus is not null")
    return S.entropy(S.code_counts(c, ["genus", "site"]), ["genus", "site"]).select(*_long("genus", "site"), F.round("h", 6).alias("h"))


@query("SELECT genus, site, round(ht.h - h.h, 6) AS diff FROM ht JOIN h USING (site)", "cells lin h ht")
def entropy_difference(spark, d):
    return S.select_sites(_labelled(spark, d), "genus", 10**9).select(*_long("genus", "site"), "diff")


@query("SELECT genus, site, diff, rank FROM sel", "cells lin h ht sel")
def select_sites(spark, d):
    return S.select_sites(_labelled(spark, d), "genus", 10).select(*_long("genus", "site"), "diff", *_long("rank"))


@query("SELECT site, CAST(CASE WHEN r <= 5 THEN 5 ELSE 10 END AS BIGINT) AS level FROM (SELECT site, min(rank) AS r FROM sel GROUP BY site)", "cells lin h ht sel")
def site_levels(spark, d):
    return S.levels(S.select_sites(_labelled(spark, d), "genus", 10), [5, 10]).select(*_long("site", "level"))


@query("SELECT level, CAST(sum(n) OVER (ORDER BY level) AS BIGINT) AS sites FROM (SELECT level, count(*) AS n FROM (SELECT CASE WHEN min(rank) <= 5 THEN 5 ELSE 10 END AS level FROM sel GROUP BY site) GROUP BY level)", "cells lin h ht sel")
def sites_report(spark, d):
    from pyspark.sql import Window

    lv = S.levels(S.select_sites(_labelled(spark, d), "genus", 10), [5, 10]).groupBy("level").agg(F.count("*").alias("n"))
    return lv.select("level", F.sum("n").over(Window.orderBy("level")).alias("sites"))


@query("SELECT site, round(sum(t * (log2(t) - s / t)) / sum(t), 6) AS gain FROM (SELECT site, code, sum(n) AS t, sum(n * log2(n)) AS s FROM (SELECT site, code, genus, count(*) AS n FROM cells JOIN lin USING (seq) WHERE genus IS NOT NULL GROUP BY ALL) GROUP BY site, code) GROUP BY site", "cells lin")
def conditional_entropy(spark, d):
    return S.conditional_entropy(_labelled(spark, d), "genus").select(*_long("site"), F.round("gain", 6).alias("gain"))


def _by_window(spark, d):
    """Every sequence once for each of 16 windows of 4 sites."""
    a, w = T.alignment(spark, d), F.explode(F.sequence(L(0).cast("bigint"), L(15).cast("bigint")))
    return a.select("seq", "label", "codes", w.alias("w")).withColumn("codes", F.slice("codes", (4 * F.col("w") + 1).cast("int"), L(4)))


@query("SELECT w, codes, rep, n FROM br", "cells aln4 br")
def exact_collapse(spark, d):
    return S.collapse(_by_window(spark, d), ["w"]).select("w", F.array_join("codes", "").alias("codes"), *_long("rep", "n"))


@query("SELECT w, codes, rep, n, missing FROM kept", "cells aln4 br kept")
def containment_collapse(spark, d):
    return S.full_collapse(_by_window(spark, d), 0.5, ["w"]).select("w", F.array_join("codes", "").alias("codes"), *_long("rep", "n", "missing"))


@query("SELECT aln4.w, seq, coalesce(rep, -1) AS branch FROM aln4 LEFT JOIN kept ON aln4.w = kept.w AND aln4.codes = kept.codes", "cells aln4 br kept")
def branch_map(spark, d):
    aln = _by_window(spark, d)
    return S.members(aln, S.full_collapse(aln, 0.5, ["w"]), ["w"]).select(*_long("w", "seq", "branch"))


@query("SELECT w, branch, ord AS \"order\", CASE WHEN ord IS NOT NULL THEN family END AS family, CASE WHEN ord IS NOT NULL AND family IS NOT NULL THEN genus END AS genus, coalesce(CASE WHEN ord IS NOT NULL AND family IS NOT NULL THEN genus END, CASE WHEN ord IS NOT NULL THEN family END, ord) AS lowest FROM (SELECT kept.w, kept.rep AS branch, CASE WHEN min(ord) = max(ord) THEN min(ord) END AS ord, CASE WHEN min(family) = max(family) THEN min(family) END AS family, CASE WHEN min(genus) = max(genus) AND count(genus) = count(*) THEN min(genus) END AS genus FROM aln4 JOIN kept USING (w, codes) JOIN lin USING (seq) GROUP BY kept.w, kept.rep)", "cells lin aln4 br kept")
def collapsed_consensus(spark, d):
    aln = _by_window(spark, d)
    m = S.members(aln, S.full_collapse(aln, 0.5, ["w"]), ["w"]).where("branch <> -1").join(T.lineage(T.alignment(spark, d, 1)), "seq")
    return S.consensus(m, ["order", "family", "genus"], by=["w"]).select(*_long("w", "branch", "order", "family", "genus", "lowest"))


@query("SELECT CAST(i AS BIGINT) AS w, coalesce(n, 0) AS branches, CASE WHEN coalesce(n, 0) < 130 THEN 'too few branches' END AS reason FROM range(16) t(i) LEFT JOIN (SELECT w, count(*) AS n FROM kept GROUP BY w) ON i = w", "cells aln4 br kept")
def rejected_windows(spark, d):
    """Windows whose sequences collapse to too few branches."""
    w = spark.range(16).withColumnRenamed("id", "w")
    n = S.full_collapse(_by_window(spark, d), 0.5, ["w"]).groupBy("w").agg(F.count("*").alias("branches"))
    return w.join(n, "w", "left").select("w", F.coalesce("branches", L(0)).alias("branches")).withColumn("reason", F.when(F.col("branches") < 130, "too few branches"))


@query()
def mesas(spark, d):
    return I.mesas(S.interval_coverage(I.normalised(T.matches(spark, d), 0.005)))
