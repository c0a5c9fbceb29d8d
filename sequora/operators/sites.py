"""Operators on alignments: filters, coverage, entropy, site selection, collapse.

Statistics work on the long form (seq, site, code), with one shuffle on small keys after a
partial aggregate; pairwise work uses arrays. Code 0 is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sliding(length: int, size: int, step: int) -> list[tuple[int, int, int]]:
    """(window, start, end): ceil((length - size) / step) windows spread evenly."""
    if size >= length or step > size or step <= 0:
        raise ValueError("a window must be shorter than the alignment and no shorter than the step")
    n = -(-(length - size) // step)
    return [(i, s, s + size) for i, s in enumerate(int(i * (length - size) / (n - 1)) if n > 1 else 0 for i in range(n))]


def custom(length: int, starts: list[int], ends: list[int]) -> list[tuple[int, int, int]]:
    if len(starts) != len(ends) or any(a >= b or a < 0 or b > length for a, b in zip(starts, ends, strict=False)):
        raise ValueError("starts and ends must pair up, in order and within the alignment")
    return [(i, a, b) for i, (a, b) in enumerate(zip(starts, ends, strict=True))]


def windows_table(spark: SparkSession, windows: list[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame(windows, "w bigint, start bigint, end bigint")


def known_rows(cells: DataFrame, most: float) -> DataFrame:
    """(seq) whose share of missing codes is at most `most`."""
    return cells.groupBy("seq").agg(F.count_if(F.col("code") == 0).alias("missing"), F.count("*").alias("n")).where(F.col("missing") <= F.lit(most) * F.col("n")).select("seq", "missing")


def known_sites(cells: DataFrame, most_row: float, most_site: float) -> DataFrame:
    """(site, missing) that pass, judged over the rows that pass first."""
    kept = cells.join(known_rows(cells, most_row).select("seq"), "seq", "left_semi")
    return kept.groupBy("site").agg(F.count_if(F.col("code") == 0).alias("missing"), F.count("*").alias("n")).where(F.col("missing") <= F.lit(most_site) * F.col("n")).select("site", "missing")


def coverage(cells: DataFrame) -> DataFrame:
    """(site, coverage, normal): known codes, and as a share of the greatest."""
    c = cells.groupBy("site").agg(F.count_if(F.col("code") > 0).alias("coverage"))
    top = c.agg(F.max("coverage").alias("top"))
    return c.crossJoin(F.broadcast(top)).select("site", "coverage", (F.col("coverage") / F.col("top")).alias("normal"))


def interval_coverage(intervals: DataFrame) -> DataFrame:
    """(site, coverage) of half-open [start, end), from +1 and -1 events summed per site."""
    events = intervals.select(F.explode(F.array(F.struct(F.col("start").alias("site"), F.lit(1).alias("x")), F.struct(F.col("end").alias("site"), F.lit(-1).alias("x")))).alias("e")).groupBy("e.site").agg(F.sum("e.x").alias("x"))
    return events.select("site", F.sum("x").over(Window.orderBy("site")).alias("coverage"))


def entropy(counts: DataFrame, by: list[str], missing: bool = False) -> DataFrame:
    """(by, h, known): entropy in bits of the codes; infinite where all are missing. counts: (by, code, n)."""
    n = F.when(F.lit(missing) | (F.col("code") > 0), F.col("n")).otherwise(0)
    total = counts.groupBy(*by).agg(F.sum(n).alias("known"), F.sum(F.when(n > 0, n * F.log2(n)).otherwise(0.0)).alias("s"))
    h = F.when(F.col("known") > 0, F.log2("known") - F.col("s") / F.col("known")).otherwise(F.lit(float("inf")))
    return total.select(*by, h.alias("h"), "known")


def code_counts(cells: DataFrame, by: list[str]) -> DataFrame:
    return cells.groupBy(*by, "code").agg(F.count("*").alias("n"))


def select_sites(cells: DataFrame, taxon: str, most: int) -> DataFrame:
    """(taxon, site, diff, rank): sites by entropy within the taxon less entropy over all, lowest first."""
    all_h = entropy(code_counts(cells, ["site"]), ["site"]).select("site", F.col("h").alias("h_all"))
    own = entropy(code_counts(cells.where(F.col(taxon).isNotNull()), [taxon, "site"]), [taxon, "site"])
    diff = own.join(all_h, "site").select(taxon, "site", F.round(F.col("h") - F.col("h_all"), 6).alias("diff"))
    return diff.withColumn("rank", F.row_number().over(Window.partitionBy(taxon).orderBy(F.asc_nulls_last("diff"), "site"))).where(F.col("rank") <= most)


def levels(selected: DataFrame, steps: list[int]) -> DataFrame:
    """(site, level): the least number of sites per taxon at which a site comes in."""
    least = selected.groupBy("site").agg(F.min("rank").alias("r"))
    level = F.coalesce(*[F.when(F.col("r") <= s, F.lit(s)) for s in sorted(steps)])
    return least.select("site", level.cast("bigint").alias("level")).where("level is not null")


def conditional_entropy(cells: DataFrame, taxon: str) -> DataFrame:
    """(site, gain): entropy of the taxon given the site's code."""
    c = cells.where(F.col(taxon).isNotNull()).groupBy("site", "code", taxon).agg(F.count("*").alias("n"))
    per = c.groupBy("site", "code").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return per.groupBy("site").agg((F.sum(F.col("t") * (F.log2("t") - F.col("s") / F.col("t"))) / F.sum("t")).alias("gain"))


def collapse(aln: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, codes, rep, n, missing): equal rows (of a window or other key) as one, represented by the least."""
    return aln.groupBy(*(by or []), "codes").agg(F.min("seq").alias("rep"), F.count("*").alias("n")).withColumn("missing", F.size(F.filter("codes", lambda c: c == 0)).cast("bigint"))


def contained(branches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, rep) of branches whose known sites all equal those of a more complete one.

    Rows meet on the positions they know: every missing pattern of a branch (few distinct
    ones) is laid over the more complete branches, so the join is by equality, not by pairs.
    """
    by, mask = by or [], F.transform("codes", lambda c: c > 0)
    gaps = branches.where("missing > 0").withColumn("mask", mask)
    patterns = gaps.select(*by, "mask", "missing").distinct()
    more = branches.select(*by, "codes", F.col("missing").alias("m"))
    over = (more.join(patterns, by) if by else more.crossJoin(patterns)).where("m < missing")
    over = over.select(*by, "mask", F.zip_with("codes", "mask", lambda c, k: F.when(k, c).otherwise(F.lit(0))).alias("codes")).distinct()
    return gaps.join(over, [*by, "mask", "codes"], "left_semi").select(*by, "rep")


def full_collapse(aln: DataFrame, most_missing: float, by: list[str] | None = None) -> DataFrame:
    """Branches that are kept: few enough missing sites, and contained in no other (of their key)."""
    b = collapse(aln, by).where(F.col("missing") <= F.lit(most_missing) * F.size("codes"))
    return b.join(contained(b, by), [*(by or []), "rep"], "left_anti")


def members(aln: DataFrame, branches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, seq, branch): the kept branch of each row, -1 for rows that were absorbed or left out."""
    by = by or []
    own = branches.select(*by, "codes", F.col("rep").alias("branch"))
    return aln.select(*by, "seq", "codes").join(own, [*by, "codes"], "left").select(*by, "seq", F.coalesce("branch", F.lit(-1)).alias("branch"))


def consensus(members: DataFrame, ranks: list[str], skip_unknown: bool = False, by: list[str] | None = None) -> DataFrame:
    """(by, branch, one column per rank, lowest): ids that all members share, down to the first rank where they don't."""
    by = by or []
    g = members.groupBy(*by, "branch").agg(*[F.when((F.min(r) == F.max(r)) & (F.lit(skip_unknown) | (F.count(r) == F.count("*"))), F.min(r)).alias(r) for r in ranks])
    kept, out = F.lit(True), []
    for r in ranks:
        ok = F.col(r).isNotNull() if not skip_unknown else F.col(r).isNotNull() | F.lit(True)
        kept = kept & ok
        out.append(F.when(kept, F.col(r)).alias(r))
    g = g.select(*by, "branch", *out)
    return g.withColumn("lowest", F.coalesce(*[F.col(r) for r in reversed(ranks)]))
