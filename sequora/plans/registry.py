"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}

#: Derived tables in DuckDB SQL; a query names the ones that it needs.
CTE = {
    "cells": "cells AS (SELECT CAST(vec_id AS BIGINT) AS seq, CAST(s AS BIGINT) AS site, CAST(CASE WHEN abs(v) < 0.01 THEN 0 WHEN v < -0.085 THEN 1 WHEN v < 0 THEN 2 WHEN v < 0.085 THEN 3 ELSE 4 END AS BIGINT) AS code, CAST(label AS BIGINT) AS label FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS s FROM embeddings))",
    "lin": "lin AS (SELECT CAST(vec_id AS BIGINT) AS seq, CAST(1 + floor(label / 6) AS BIGINT) AS ord, CAST(10 + floor(label / 2) AS BIGINT) AS family, CASE WHEN vec_id % 17 <> 0 THEN CAST(100 + label AS BIGINT) END AS genus FROM embeddings)",
    "tree": "tree AS (SELECT CAST(1 AS BIGINT) AS taxid, CAST(1 AS BIGINT) AS parent, 'root' AS rank UNION ALL SELECT 10 + r_regionkey, 1, 'region' FROM region UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey, 'nation' FROM nation UNION ALL SELECT 100000 + c_custkey, 100 + c_nationkey, 'customer' FROM customer)",
    "up": "up AS (SELECT taxid, taxid AS ancestor, rank, parent FROM tree WHERE taxid <> parent UNION ALL SELECT up.taxid, t.taxid, t.rank, t.parent FROM up JOIN tree t ON up.parent = t.taxid WHERE t.taxid <> t.parent)",
    "m": "m AS (SELECT CAST(l_orderkey AS BIGINT) AS qseqid, CAST(l_linenumber AS BIGINT) AS line, CAST(trunc(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity + l_linenumber * 3 ELSE l_quantity END) AS BIGINT) AS sstart, CAST(trunc(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE l_quantity + l_linenumber * 3 END) AS BIGINT) AS send, l_discount / 10 AS evalue FROM lineitem)",
    "nm": "nm AS (SELECT *, least(sstart, send) - 1 AS s, greatest(sstart, send) AS e, CASE WHEN sstart > send THEN -1 ELSE 1 END AS orient FROM m WHERE evalue <= 0.005)",
    "wide": "wide AS (SELECT CAST(p_partkey AS BIGINT) AS acc, p_type AS family, p_type || '|' || p_brand AS genus, p_type || '|' || p_brand || '|' || p_name AS species FROM part)",
    "aln4": "aln4 AS (SELECT seq, site // 4 AS w, string_agg(CAST(code AS VARCHAR), '' ORDER BY site) AS codes, count(*) FILTER (code = 0) AS missing FROM cells GROUP BY seq, site // 4)",
    "br": "br AS (SELECT w, codes, min(seq) AS rep, count(*) AS n, min(missing) AS missing FROM aln4 GROUP BY w, codes)",
    "kept": "kept AS (SELECT * FROM br b WHERE missing <= 2 AND NOT EXISTS (SELECT 1 FROM br a WHERE a.w = b.w AND a.missing < b.missing AND regexp_matches(a.codes, '^' || replace(b.codes, '0', '.') || '$')))",
    "dist": "dist AS (SELECT a.seq AS q, b.seq AS r, sum(CASE WHEN a.code = 0 OR b.code = 0 THEN 5 WHEN a.code = b.code THEN 0 WHEN (a.code + b.code) % 2 = 0 THEN 4 ELSE 8 END)::BIGINT AS d4 FROM cells a JOIN cells b ON a.site = b.site AND a.seq <> b.seq GROUP BY a.seq, b.seq)",
    "rk": "rk AS (SELECT *, dense_rank() OVER (PARTITION BY q ORDER BY d4) AS orbit, rank() OVER (PARTITION BY q ORDER BY d4) AS place FROM dist)",
    "near": "near AS (SELECT n.*, lin.genus, CASE WHEN hi = lo THEN 1.0 ELSE (hi - d4) * 1.0 / (hi - lo) END AS w, CASE WHEN hi = lo THEN 1.0 ELSE (hi - d4) * 1.0 / (hi - lo) * (hi + lo) / (hi + d4) END AS d FROM (SELECT *, min(d4) OVER (PARTITION BY q) AS lo, max(d4) OVER (PARTITION BY q) AS hi FROM rk WHERE orbit <= 3) n JOIN lin ON n.r = lin.seq)",
    "sup": "sup AS (SELECT q, genus, count(*) AS n, avg(d4 / 4.0) AS mean_d, stddev_pop(d4 / 4.0) AS std_d, sum(1.0) AS u, sum(w) AS w, sum(d) AS d FROM near WHERE genus IS NOT NULL GROUP BY q, genus)",
    "win": "win AS (SELECT q, CASE WHEN nx = s THEN -1 ELSE genus END AS pred, s FROM (SELECT q, genus, round(w, 6) AS s, row_number() OVER (PARTITION BY q ORDER BY round(w, 6) DESC, genus) AS rn, lead(round(w, 6)) OVER (PARTITION BY q ORDER BY round(w, 6) DESC, genus) AS nx FROM sup) WHERE rn = 1)",
    "conf": "conf AS (SELECT genus AS real, pred, count(*) AS n FROM win JOIN lin ON win.q = lin.seq WHERE genus IS NOT NULL GROUP BY ALL)",
    "sc": "sc AS (SELECT taxon, sum(tp) AS tp, sum(p) AS p, sum(r) AS r, any_value(total) AS total FROM (SELECT real AS taxon, CASE WHEN real = pred THEN n ELSE 0 END AS tp, 0 AS p, n AS r FROM conf UNION ALL SELECT pred, 0, n, 0 FROM conf WHERE pred <> -1), (SELECT sum(n) AS total FROM conf) GROUP BY taxon)",
    "mask": "own AS (SELECT genus, site, code, count(*) AS n FROM cells JOIN lin USING (seq) WHERE genus IS NOT NULL GROUP BY ALL), tot AS (SELECT site, code, sum(n) AS t FROM own GROUP BY ALL), mask AS (SELECT genus, site, coalesce(bit_or(CASE WHEN n > 0 THEN 1 << code END), 0)::BIGINT AS inside, coalesce(bit_or(CASE WHEN t > n THEN 1 << code END), 0)::BIGINT AS outside FROM (SELECT g.genus, tot.site, tot.code, t, coalesce(n, 0) AS n FROM tot CROSS JOIN (SELECT DISTINCT genus FROM own) g LEFT JOIN own ON own.genus = g.genus AND own.site = tot.site AND own.code = tot.code) GROUP BY genus, site)",
    "typ": "typ AS (SELECT *, (inside & ~outside) AS mine, (inside & outside) AS shared, CAST(CASE WHEN bit_count(inside | outside) <= 1 THEN 0 WHEN bit_count(inside & ~outside) > 0 AND bit_count(inside & outside) = 0 THEN 1 WHEN bit_count(inside & ~outside) > 0 THEN 2 WHEN bit_count(inside & outside) <= 1 THEN 3 ELSE 4 END AS BIGINT) AS type FROM mask)",
    "h": "h AS (SELECT site, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h, sum(n)::BIGINT AS known FROM (SELECT site, code, count(*) AS n FROM cells WHERE code > 0 GROUP BY ALL) GROUP BY site)",
    "ht": "ht AS (SELECT genus, site, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT genus, site, code, count(*) AS n FROM cells JOIN lin USING (seq) WHERE code > 0 AND genus IS NOT NULL GROUP BY ALL) GROUP BY genus, site)",
    "sel": "sel AS (SELECT * FROM (SELECT genus, site, round(ht.h - h.h, 6) AS diff, row_number() OVER (PARTITION BY genus ORDER BY round(ht.h - h.h, 6) ASC NULLS LAST, site) AS rank FROM ht JOIN h USING (site)) WHERE rank <= 10)",
}


def query(body: str | None = None, ctes: str = "", recursive: bool = False):
    """Registers the function under its name; body: DuckDB SQL that follows the named derived tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if body:
            names = ctes.split()
            SQL[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(CTE[n] for n in names) + "\n" if names else "") + body
        return f

    return add
