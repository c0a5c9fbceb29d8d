"""Queries on joins, sets, deduplication and intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sequora.operators import intervals as I
from sequora.sources import tables as T

from .registry import query


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def lookup_join(spark, d):
    o, c, n = (T.table(spark, d, x) for x in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE upper(c_mktsegment) IN ('BUILDING', 'MACHINERY'))")
def semi_membership(spark, d):
    c = T.table(spark, d, "customer").where(F.upper("c_mktsegment").isin("BUILDING", "MACHINERY"))
    o = T.table(spark, d, "orders")
    return o.join(c, o.o_custkey == c.c_custkey, "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_either_key(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = T.table(spark, d, "customer").where("c_acctbal > 5000")
    li = T.table(spark, d, "lineitem").where("l_quantity > 45")
    a = o.join(c, o.o_custkey == c.c_custkey, "left_semi")
    b = o.join(li, o.o_orderkey == li.l_orderkey, "left_semi")
    return a.union(b).distinct().select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 250000)")
def anti_missing(spark, d):
    c, o = T.table(spark, d, "customer"), T.table(spark, d, "orders").where("o_totalprice > 250000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")



@query("SELECT r.qseqid AS r, r.line AS r_line, q.qseqid AS q, q.line AS q_line, greatest(r.s, q.s) AS start, least(r.e, q.e) AS \"end\" FROM nm r JOIN nm q ON r.s <= q.e AND r.e >= q.s AND least(r.e, q.e) - greatest(r.s, q.s) >= 8 WHERE r.orient = 1 AND q.orient = -1 AND r.evalue = 0 AND q.evalue = 0", "m nm")
def interval_overlap(spark, d):
    m = I.normalised(T.matches(spark, d), 0.005).where("evalue = 0").withColumn("id", F.struct("qseqid", "line"))
    got = I.overlaps(m.where("orient = 1"), m.where("orient = -1"), 8, 8)
    return got.select(F.col("r.qseqid").alias("r"), F.col("r.line").alias("r_line"), F.col("q.qseqid").alias("q"), F.col("q.line").alias("q_line"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query("SELECT a.qseqid, a.line, w.i AS w FROM nm a JOIN (SELECT i, i * 10 AS s, i * 10 + 25 AS e FROM range(5) t(i)) w ON w.s <= a.s AND a.e <= w.e", "m nm")
def interval_containment(spark, d):
    m = I.normalised(T.matches(spark, d), 0.005).withColumn("id", F.struct("qseqid", "line"))
    w = spark.createDataFrame([(i, i * 10, i * 10 + 25) for i in range(5)], "id bigint, start int, end int")
    return I.inside(m, w, 10).select(F.col("small.qseqid").alias("qseqid"), F.col("small.line").alias("line"), F.col("large").alias("w"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, event_id) AS rn FROM events) WHERE rn = 1")
def source_priority_dedupe(spark, d):
    return T.last_first(T.table(spark, d, "events"), ["user_id"], [F.when(F.col("event_type") == "error", 0).otherwise(1), "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_type FROM events WHERE value > 50 UNION SELECT user_id, event_type FROM events WHERE event_type = 'error'")
def merge_distinct(spark, d):
    e = T.table(spark, d, "events")
    return e.where("value > 50").select("user_id", "event_type").union(e.where("event_type = 'error'").select("user_id", "event_type")).distinct()


@query("SELECT event_type AS src, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT o_orderstatus FROM orders) GROUP BY ALL")
def union_all(spark, d):
    return T.table(spark, d, "events").select(F.col("event_type").alias("src")).union(T.table(spark, d, "orders").select("o_orderstatus")).groupBy("src").agg(F.count("*").alias("n"))


@query("SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE value > 90")
def set_intersect(spark, d):
    e = T.table(spark, d, "events")
    return e.where("event_type = 'error'").select("user_id").intersect(e.where("value > 90").select("user_id"))


@query("SELECT user_id FROM events EXCEPT SELECT user_id FROM events WHERE value > 200")
def set_except(spark, d):
    e = T.table(spark, d, "events")
    return e.select("user_id").subtract(e.where("value > 200").select("user_id"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def first_per_group(spark, d):
    return T.last_first(T.table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_n_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return T.table(spark, d, "orders").withColumn("rn", F.row_number().over(w).cast("bigint")).where("rn <= 3").select("o_custkey", "o_orderkey", "rn")


@query("SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS joined FROM orders GROUP BY o_custkey")
def concat_group(spark, d):
    g = T.table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("x"))
    return g.select("o_custkey", F.array_join("x.o_orderstatus", "").alias("joined"))


@query("SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 50 AS chunk FROM customer")
def chunk_assign(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return T.table(spark, d, "customer").select("c_custkey", F.floor((F.row_number().over(w) - 1) / 50).cast("bigint").alias("chunk"))


@query("SELECT n_name, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 9000 GROUP BY ALL) ON n_nationkey = s_nationkey")
def outer_fill(spark, d):
    s = T.table(spark, d, "supplier").where("s_acctbal > 9000").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    n = T.table(spark, d, "nation")
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT CAST(coalesce(l.k, f.k) AS BIGINT) AS id, coalesce(l.name, f.name) AS name FROM (SELECT n_nationkey + 100 AS k, n_name AS name FROM nation WHERE n_regionkey <> 2) l FULL JOIN (SELECT n_nationkey + 900 AS k, n_name AS name FROM nation WHERE n_nationkey > 5) f ON l.name = f.name")
def remap_by_name(spark, d):
    n = T.table(spark, d, "nation")
    lead = n.where("n_regionkey <> 2").select((F.col("n_nationkey") + 100).alias("k"), F.col("n_name").alias("name"))
    foll = n.where("n_nationkey > 5").select((F.col("n_nationkey") + 900).alias("fk"), F.col("n_name").alias("name"))
    return lead.join(foll, "name", "full").select(F.coalesce("k", "fk").cast("bigint").alias("id"), "name")


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def totals_rollup(spark, d):
    g = T.table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))
    return g.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "n", "level")


@query("SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY c_nationkey")
def pivot_counts(spark, d):
    g = T.table(spark, d, "customer").groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).count()
    return g.select("c_nationkey", F.coalesce("BUILDING", F.lit(0)).alias("building"), F.coalesce("MACHINERY", F.lit(0)).alias("machinery"))


@query("SELECT site, coverage - lag(coverage, 1, 0) OVER (ORDER BY site) AS step FROM (SELECT o_orderkey % 1000 AS site, count(*) AS coverage FROM orders GROUP BY ALL)")
def neighbour_steps(spark, d):
    c = T.table(spark, d, "orders").groupBy((F.col("o_orderkey") % 1000).alias("site")).agg(F.count("*").alias("coverage"))
    return c.select("site", (F.col("coverage") - F.lag("coverage", 1, 0).over(Window.orderBy("site"))).alias("step"))


@query("SELECT doc_id, split_part(source || '.' || CAST(doc_id % 3 + 1 AS VARCHAR), '.', 1) AS acc, CASE WHEN doc_id % 4 = 0 THEN '1' ELSE split_part(source || '.' || CAST(doc_id % 3 + 1 AS VARCHAR), '.', 2) END AS version FROM documents")
def accession_version(spark, d):
    full = F.when(F.col("doc_id") % 4 == 0, F.col("source")).otherwise(F.concat_ws(".", "source", (F.col("doc_id") % 3 + 1).cast("string")))
    parts = F.split(full, "[.]")
    return T.table(spark, d, "documents").select("doc_id", parts[0].alias("acc"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).alias("version"))


@query("SELECT source AS marker, count(*) AS n, count(quality) AS labelled, CAST(coalesce(sum(quality), 0) AS BIGINT) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def marker_split(spark, d):
    j = T.table(spark, d, "documents").select("doc_id", "source").join(T.table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy(F.col("source").alias("marker")).agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).cast("bigint").alias("good"))
