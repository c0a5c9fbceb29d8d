"""Signals of taxa: greedy telling sites, a matrix of scores, value combinations, and rules that a query may fit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a chunk of bitmaps; most blocks of taxa, and rows for each; stands for no taxon or code.
CHUNK, SPREAD, ROWS, NONE = 4096, 32, 8192, -(1 << 63)


def single_values(cells: DataFrame, taxon: str, least_known: float = 0.0) -> DataFrame:
    """(taxon, site, code) where a taxon has one known value and a share of at least `least_known` of its rows knows it."""
    g = cells.where(F.col(taxon).isNotNull()).groupBy(taxon, "site").agg(F.min(F.when(F.col("code") > 0, F.col("code"))).alias("code"), F.max("code").alias("most"), F.count_if(F.col("code") > 0).alias("known"), F.count("*").alias("n"))
    return g.where((F.col("code") == F.col("most")) & (F.col("known") >= F.lit(least_known) * F.col("n"))).select(taxon, "site", "code")


def bitmaps(cells: DataFrame, taxon: str, n_chunks: int) -> DataFrame:
    """(chunk, site, code, bits): a bit for each row of a chunk that has the code at the site, in whole 64-bit words.

    Code null: a bit for each row that has the site at all. Site null: the taxon of each row, as 64-bit numbers.
    """

    def index(t: pa.Table) -> pa.Table:
        seq, own, site, code = (t[c].combine_chunks().fill_null(NONE).to_numpy() for c in ("seq", "own", "site", "code"))
        rows, at = np.unique(seq, return_inverse=True)
        n = -(-len(rows) // 64) * 64
        taxa = np.full(n, NONE)
        taxa[at] = own
        out = [(None, None, taxa.astype("<i8").tobytes())]
        order = np.lexsort((code, site))
        at, site, code = at[order], site[order], code[order]
        for several in (False, True):
            cuts = np.flatnonzero(np.r_[True, (site[1:] != site[:-1]) | (several & (code[1:] != code[:-1])), True])
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                bits = np.zeros(n, bool)
                bits[at[lo:hi]] = True
                out.append((int(site[lo]), int(code[lo]) if several else None, np.packbits(bits, bitorder="little").tobytes()))
        cols = [pa.array([t["chunk"][0].as_py()] * len(out), pa.int32()), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary())))]
        return pa.table(cols, ["chunk", "site", "code", "bits"])

    long = [F.col(c).cast("bigint").alias(a) for c, a in (("seq", "seq"), (taxon, "own"), ("site", "site"), ("code", "code"))]
    dealt = cells.where("seq is not null and site is not null").select(F.pmod(F.xxhash64(F.col("seq").cast("bigint")), F.lit(n_chunks)).cast("int").alias("chunk"), *long)
    return dealt.groupBy("chunk").applyInArrow(index, "chunk int, site long, code long, bits binary")


def greedy_signal(cells: DataFrame, signs: DataFrame, taxon: str) -> DataFrame:
    """(concept, step, site, code, left): the site that the fewest other rows agree with, then again among those left.

    Ends when no other row is left or when no site rejects one. signs: (taxon, site, code). Rows meet taxa as bitmaps, a bit for
    each row and code, which are sent to every block of taxa: rows and taxa are never paired, and what is shuffled grows with the rows.
    """
    n = cells.agg(F.approx_count_distinct("seq")).first()[0]
    chunks, blocks = max(1, -(-n // CHUNK)), min(SPREAD, max(1, n // ROWS))
    want = signs.select(F.col(taxon).cast("bigint").alias("concept"), F.col("site").cast("bigint").alias("site"), F.col("code").cast("bigint").alias("want"))
    known = bitmaps(cells, taxon, chunks).withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = want.withColumn("_x", F.pmod(F.xxhash64("concept"), F.lit(blocks)).cast("int"))

    def solve(known: pa.Table, want: pa.Table) -> pa.Table:
        rules: dict[int, dict[int, int]] = {}
        for t, site, code in zip(*(want[c].to_pylist() for c in ("concept", "site", "want")), strict=True):
            rules.setdefault(t, {})[site] = code
        need = {(s, c) for own in rules.values() for site, code in own.items() for s, c in ((site, code), (site, None))}
        cols = [known[c].to_pylist() for c in ("chunk", "site", "code")]
        size = {chunk: len(bits.as_buffer()) // 512 for chunk, site, bits in zip(cols[0], cols[1], known["bits"], strict=True) if site is None}
        first, words = {}, 0
        for chunk in sorted(size):
            first[chunk], words = words, words + size[chunk]
        taxa, maps = np.full(64 * words, NONE), {}
        for chunk, site, code, bits in zip(*cols, known["bits"], strict=True):
            lo = first[chunk]
            if site is None:
                taxa[64 * lo : 64 * (lo + size[chunk])] = np.frombuffer(bits.as_buffer(), "<i8")
            elif (site, code) in need:
                if (site, code) not in maps:
                    maps[site, code] = np.zeros(words, np.uint64)
                maps[site, code][lo : lo + size[chunk]] = np.frombuffer(bits.as_buffer(), "<u8")
        none, order, out = np.zeros(words, np.uint64), np.argsort(taxa, kind="stable"), []
        taxa = taxa[order]
        for t, own in sorted(rules.items()):
            rest = np.bitwise_or.reduce([maps.get((s, None), none) for s in own])
            mine = order[np.searchsorted(taxa, t) : np.searchsorted(taxa, t, "right")]
            np.bitwise_and.at(rest, mine >> 6, ~(np.uint64(1) << (mine & 63).astype(np.uint64)))
            agree = {s: maps.get((s, own[s]), none) for s in sorted(own)}
            left, step = int(np.bitwise_count(rest).sum()), 0
            while left and agree:
                site, fewest = min(((s, int(np.bitwise_count(rest & m).sum())) for s, m in agree.items()), key=lambda x: x[1])
                if fewest == left:
                    break
                rest, left, step = rest & agree.pop(site), fewest, step + 1
                out.append((t, step, site, own[site], left))
                some = np.flatnonzero(rest)
                if 2 * len(some) < len(rest):  # words without a row that is left
                    rest, agree = rest[some], {s: m[some] for s, m in agree.items()}
        return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], ["concept", "step", "site", "code", "left"])

    return known.groupBy("_x").cogroup(dealt.groupBy("_x")).applyInArrow(solve, "concept bigint, step bigint, site bigint, code bigint, left bigint")


def complete(cells: DataFrame, signs: DataFrame, taxon: str) -> DataFrame:
    """(seq, taxon): members whose codes are known at every site of their taxon's signs."""
    c = cells.join(signs.select(taxon, "site").distinct(), [taxon, "site"])
    return c.groupBy("seq", taxon).agg(F.min("code").alias("least")).where("least > 0").select("seq", taxon)


def vertical(cells: DataFrame, taxon: str) -> DataFrame:
    """Greedy signal over the single-value sites that every member knows."""
    return greedy_signal(cells, single_values(cells, taxon, 1.0), taxon)


def horizontal(cells: DataFrame, taxon: str) -> DataFrame:
    """Greedy signal over all single-value sites; taxa without a member that knows them all have none."""
    signs = single_values(cells, taxon)
    return greedy_signal(cells, signs.join(complete(cells, signs, taxon), taxon, "left_semi"), taxon)


def solved_members(cells: DataFrame, signal: DataFrame, taxon: str) -> DataFrame:
    """(seq, taxon): members with a known code at every site of their taxon's signal."""
    return complete(cells, signal.select(F.col("concept").alias(taxon), "site"), taxon)


def score_matrix(distinct: DataFrame, signs: DataFrame, scores: DataFrame, taxon: str) -> DataFrame:
    """(site, code, score): the greatest score that any taxon gives a value.

    Values of a taxon alone (distinct: taxon, site, code) score its `info`; single values (signs) 1, or its `ns`
    at sites where no other taxon has a single value. scores: (taxon, ns, info).
    """
    own = distinct.join(scores, taxon).select("site", "code", F.col("info").alias("score"))
    uses = signs.withColumn("_n", F.count("*").over(Window.partitionBy("site")))
    one = uses.join(scores, taxon).select("site", "code", F.when(F.col("_n") == 1, F.col("ns")).otherwise(F.lit(1.0)).alias("score"))
    return own.unionByName(one).groupBy("site", "code").agg(F.max("score").alias("score"))


def combinations(cells: DataFrame, taxon: str) -> DataFrame:
    """(taxon, sites, codes, n): distinct rows of codes over the sites where a taxon has several known values."""
    several = cells.where(F.col(taxon).isNotNull() & (F.col("code") > 0)).groupBy(taxon, "site").agg(F.min("code").alias("a"), F.max("code").alias("b")).where("a < b").select(taxon, "site")
    rows = cells.join(several, [taxon, "site"]).groupBy("seq", taxon).agg(F.array_sort(F.collect_list(F.struct("site", "code"))).alias("x"))
    return rows.groupBy(taxon, F.col("x.site").alias("sites"), F.col("x.code").alias("codes")).agg(F.count("*").alias("n"))


def signal(cells: DataFrame, matrix: DataFrame, signs: DataFrame, combos: DataFrame, taxon: str) -> DataFrame:
    """(seq, concept, signal): scores of a row's codes at single-value sites that agree, and of the combination that agrees best."""
    scored = cells.select("seq", "site", "code").join(matrix, ["site", "code"])
    single = scored.join(signs.select(F.col(taxon).alias("concept"), "site", "code"), ["site", "code"]).groupBy("seq", "concept").agg(F.sum("score").alias("s"))
    numbered = combos.select(F.col(taxon).alias("concept"), F.xxhash64("sites", "codes").alias("combo"), F.explode(F.arrays_zip("sites", "codes")).alias("x"))
    numbered = numbered.select("concept", "combo", F.col("x.sites").alias("site"), F.col("x.codes").alias("code"))
    several = scored.join(numbered, ["site", "code"]).groupBy("seq", "concept", "combo").agg(F.sum("score").alias("s")).groupBy("seq", "concept").agg(F.max("s").alias("s"))
    return single.unionByName(several).groupBy("seq", "concept").agg(F.sum("s").alias("signal"))


def compatible(cells: DataFrame, rules: DataFrame, taxon: str) -> DataFrame:
    """(seq, concept) whose codes fit every rule of a taxon; a missing code fits any. rules: (taxon, site, allowed)."""
    r = rules.select(F.col(taxon).alias("concept"), "site", "allowed")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("code").cast("int"))
    fits = (F.col("code") == 0) | (F.col("allowed").bitwiseAND(bit) != 0)
    return cells.select("seq", "site", "code").join(r, "site").groupBy("seq", "concept").agg(F.bool_and(fits).alias("fits")).where("fits").select("seq", "concept")


def verdict(sequences: DataFrame, fitting: DataFrame) -> DataFrame:
    """(seq, n, verdict): the one taxon that fits, 'Unclear' if several do, 'Unknown' if none does."""
    n = fitting.groupBy("seq").agg(F.count("*").alias("n"), F.min("concept").alias("concept"))
    both = sequences.select("seq").distinct().join(n, "seq", "left")
    text = F.when(F.col("n") == 1, F.col("concept").cast("string")).when(F.col("n") > 1, "Unclear").otherwise("Unknown")
    return both.select("seq", F.coalesce("n", F.lit(0)).alias("n"), text.alias("verdict"))


def learning_status(members: DataFrame, confirmed: DataFrame, fitting: DataFrame, taxon: str) -> DataFrame:
    """(taxon, members, outsiders, confirmed, compatible, status) from members (seq, taxon), confirmed members and outsiders that fit (seq, concept).

    Full: all members confirmed or no outsider fits; Partial: some confirmed or some outsiders rejected; else No.
    """
    total = members.select(F.count("*").alias("total"))
    c = confirmed.groupBy(taxon).agg(F.count("*").alias("confirmed"))
    f = fitting.groupBy(F.col("concept").alias(taxon)).agg(F.count("*").alias("compatible"))
    t = members.where(F.col(taxon).isNotNull()).groupBy(taxon).agg(F.count("*").alias("members")).crossJoin(total)  # one row
    t = t.join(c, taxon, "left").join(f, taxon, "left").na.fill(0, ["confirmed", "compatible"]).withColumn("outsiders", F.col("total") - F.col("members"))
    full = (F.col("confirmed") == F.col("members")) | (F.col("compatible") == 0)
    partial = (F.col("confirmed") > 0) | (F.col("compatible") < F.col("outsiders"))
    return t.select(taxon, "members", "outsiders", "confirmed", "compatible", F.when(full, "Full").when(partial, "Partial").otherwise("No").alias("status"))
