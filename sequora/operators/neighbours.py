"""Distances, orbitals, supports and winners of nearest-neighbour classification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sequora.functions.codes import cost_table, packed_distance, planes, weights

#: Most queries and references of a block, least blocks of queries (of 256 rows or more); queries and references that a product takes at once; tallies that are held before they are added up.
QUERIES, REFERENCES, SPREAD, ROWS, COLUMNS, HELD = 8192, 131072, 32, 128, 8192, 2_000_000


def packed(aln: DataFrame, prefix: str, n_sites: int, codes: str = "codes") -> DataFrame:
    """Adds the three bit planes of the codes as columns with a prefix."""
    k, c, b = planes(F.col(codes), n_sites)
    return aln.withColumns({f"{prefix}_k": k, f"{prefix}_c": c, f"{prefix}_b": b})


def in_blocks(left: DataFrame, right: DataFrame, blocks: int, on: list[str] | None = None) -> DataFrame:
    """All pairs of two tables (of equal values of `on`), met by equality on a grid of blocks, so that the work is dealt evenly.

    Each row goes to one block and is sent to every block of the other side: blocks * (rows of both) rows are shuffled.
    """
    on, n = on or [], F.lit(blocks)
    spread = F.explode(F.sequence(F.lit(0), n - 1))
    a = left.withColumn("_x", F.pmod(F.xxhash64(*left.columns), n).cast("int")).withColumn("_y", spread)
    b = right.withColumn("_y", F.pmod(F.xxhash64(*right.columns), n).cast("int")).withColumn("_x", spread)
    return a.join(b, [*on, "_x", "_y"]).drop("_x", "_y")


def distances(queries: DataFrame, references: DataFrame, n_sites: int, loo: bool = True, cost: dict[tuple[int, int], float] | None = None, blocks: int = 8) -> DataFrame:
    """(q, r, d4): four times the distance of every query to every other reference, of all pairs in a grid of blocks.

    Rows are packed into bit planes first, so a pair costs a few machine words per 64 sites. cost: see packed_distance.
    """
    q = packed(queries, "q", n_sites).select(F.col("seq").alias("q"), "q_k", "q_c", "q_b")
    r = packed(references, "r", n_sites).select(F.col("seq").alias("r"), "r_k", "r_c", "r_b")
    pairs = in_blocks(q, r, blocks)
    return (pairs.where("q <> r") if loo else pairs).select("q", "r", packed_distance("q", "r", n_sites, cost).alias("d4"))


def ranked(dist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds orbit (rank of the distinct distance) and place (rank among neighbours)."""
    w = Window.partitionBy(*(by or ["q"])).orderBy("d4")
    return dist.withColumns({"orbit": F.dense_rank().over(w), "place": F.rank().over(w)})


def neighbours(dist: DataFrame, k: int, criterion: str = "orbit", by: list[str] | None = None) -> DataFrame:
    """Neighbours in the k nearest orbitals, or in those that hold the k nearest neighbours, with u, w and d weights."""
    by = by or ["q"]
    kept = ranked(dist, by).where(F.col("orbit" if criterion == "orbit" else "place") <= k)
    span = Window.partitionBy(*by)
    kept = kept.withColumns({"first": F.min("d4").over(span), "last": F.max("d4").over(span)})
    return kept.withColumns(weights(F.col("d4"), F.col("first"), F.col("last"))).drop("first", "last")


def _least(d: np.ndarray, k: int, orbits: bool) -> np.ndarray:
    """(rows, k): the k least values of each row in order, each once if orbits; infinite where there are fewer."""
    if not orbits:
        few = np.sort(np.partition(d, min(k, d.shape[1]) - 1, 1)[:, :k], 1)
    else:
        few = np.full((len(d), k), np.inf, d.dtype)
        few[:, 0] = d.min(1)
        for j in range(1, k):
            few[:, j] = np.where(d > few[:, j - 1 : j], d, np.inf).min(1)
    return np.pad(few, ((0, 0), (0, k - few.shape[1])), constant_values=np.inf)


class _Block:
    """References of a block as a matrix, whose product with one-hot queries gives distances."""

    def __init__(self, ids, codes, taxa, cost: np.ndarray, k: int, orbits: bool, loo: bool):
        order = np.argsort(ids, kind="stable")
        self.ids, self.k, self.orbits, self.loo = ids[order], k, orbits, loo
        rest = cost - cost[0, 0]
        self.live = np.flatnonzero(rest.any(1))
        self.base, self.far = np.float32(cost[0, 0] * codes.shape[1]), int(cost.max()) * codes.shape[1] + 1
        self.right = np.concatenate([rest[x].astype(np.float32)[codes[order]] for x in self.live], 1).T.copy() if len(self.live) else None
        if taxa is not None:
            self.names, self.taxa = np.unique(taxa[order], return_inverse=True)
        self.tally = taxa is not None

    def distances(self, left, q, lo, hi):
        d = left @ self.right[:, lo:hi] + self.base if self.right is not None else np.full((len(q), hi - lo), self.base)
        if self.loo:
            own = np.searchsorted(self.ids, q, "left"), np.searchsorted(self.ids, q, "right")
            for i in np.flatnonzero((own[0] < np.minimum(own[1], hi)) & (own[1] > lo)):
                d[i, max(own[0][i] - lo, 0) : own[1][i] - lo] = np.inf
        return d

    def search(self, q, codes):
        """(place in q, d4, reference) of all that may be among the nearest, or (place in q, d4, taxon, how many)."""
        left = np.concatenate([codes == x for x in self.live], 1).astype(np.float32) if len(self.live) else None
        least, held, size = np.full((len(q), self.k), np.inf, np.float32), [], 0
        for lo in range(0, len(self.ids), COLUMNS):
            hi = min(lo + COLUMNS, len(self.ids))
            d = self.distances(left, q, lo, hi)
            if lo == 0:
                least = _least(d, self.k, self.orbits)
            # an infinite bound takes all but a query itself
            at = np.flatnonzero(d <= np.minimum(least[:, -1:], np.float32(3e38)))
            row, col = np.divmod(at, hi - lo)
            x = d.ravel()[at]
            if lo and len(row):
                least = self.lower(least, row, x)
            held.append(self.added(self.key(row, x, self.taxa[lo + col])) if self.tally else (row.astype(np.int32), x, (lo + col).astype(np.int32)))
            size += len(held[-1][0])
            if self.tally and size > HELD:
                held = [self.within(self.added(*(np.concatenate(c) for c in zip(*held, strict=True))), least)]
                size = len(held[0][0])
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        if self.tally:
            key, n = self.within(self.added(*cols), least)
            return *self.parts(key), n
        near = cols[1] <= least[cols[0], -1]
        return tuple(c[near] for c in cols)

    def lower(self, least, row, x):
        """The bounds with the new values."""
        old = np.isfinite(least)
        v = np.sort(np.r_[np.nonzero(old)[0] * self.far + least[old].astype(np.int64), row * self.far + x.astype(np.int64)])
        if self.orbits:
            v = v[np.r_[True, v[1:] != v[:-1]]]
        r, v = np.divmod(v, self.far)
        place = np.arange(len(r)) - np.searchsorted(r, np.arange(len(least)))[r]
        out, few = np.full_like(least, np.inf), place < self.k
        out[r[few], place[few]] = v[few]
        return out

    # a tally's key is one number: place in q, distance, taxon

    def key(self, row, x, taxon):
        return (row * self.far + x.astype(np.int64)) * len(self.names) + taxon

    def parts(self, key):
        rest, taxon = np.divmod(key, len(self.names))
        return *np.divmod(rest, self.far), taxon

    def within(self, tallies, least):
        row, x, _ = self.parts(tallies[0])
        near = x <= least[row, -1]
        return tuple(c[near] for c in tallies)

    @staticmethod
    def added(key, n=None):
        """Equal keys as one, with their number."""
        if n is None:
            return np.unique(key, return_counts=True)
        key, at = np.unique(key, return_inverse=True)
        return key, np.bincount(at, n, len(key)).astype(np.int64)


def nearest(queries: DataFrame, references: DataFrame, n_sites: int, k: int, criterion: str = "orbit", by: list[str] | None = None, taxon: str | None = None, loo: bool = True, cost: dict[tuple[int, int], float] | None = None) -> DataFrame:
    """(by, q, r, d4) of pairs (of equal numbers `by`) that can be among a query's neighbours (see neighbours): all of those, and few others.

    With a taxon (a column of numbers of the references): (by, q, d4, n, taxa, counts), all neighbours of a distance as a row
    (or a few, to be added up), their number, their taxa and the number of each. All pairs are compared, block by block as products of matrices, and a block keeps its own nearest alone, so that
    what is shuffled doesn't grow with the pairs. Four times every cost must be a whole number.
    """
    by, orbits = by or [], criterion == "orbit"
    fours = 4 * np.array([[(cost or cost_table())[x, y] for y in range(5)] for x in range(5)], float)
    if (fours % 1).any() or fours.max() * n_sites >= 1 << 24 or fours.min() < 0:
        raise ValueError("four times every cost must be a whole number from 0, and no distance beyond 2^24")

    def most(df):
        return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0

    nq = most(queries)
    x = max(1, -(-nq // QUERIES), min(SPREAD, -(-nq // 256)))
    y = max(1, -(-most(references) // REFERENCES))
    codes = F.transform(F.sequence(F.lit(0), F.lit(n_sites - 1)), lambda i: F.coalesce(F.get("codes", i), F.lit(0)).cast("tinyint")).alias("codes")

    def dealt(df, is_query, own, n, other, m):
        to = F.pmod(F.xxhash64("seq"), F.lit(n)).cast("int").alias(own)
        t = F.col(taxon).cast("bigint") if taxon and not is_query else F.lit(None).cast("bigint")
        return df.where("seq is not null and codes is not null").select(*[F.col(c).cast("bigint").alias(c) for c in by], to, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), F.lit(is_query).alias("_query"), F.col("seq").cast("bigint").alias("seq"), codes, t.alias("_taxon"))

    rows = dealt(references, False, "_y", y, "_x", x).unionByName(dealt(queries, True, "_x", x, "_y", y))
    key, size = [*by, "_x", "_y"], len(by)
    unknown = -(1 << 63)

    def run(batches):
        now, block, held = None, None, []
        for b in batches:
            keys = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(key) + 1)]
            ids = b.column(len(key) + 1).to_numpy()
            own = b.column(len(key) + 2).flatten().to_numpy().reshape(-1, n_sites)
            taxa = b.column(len(key) + 3).fill_null(unknown).to_numpy()
            ends = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in keys])) + 1
            for lo, hi in zip(np.r_[0, ends], np.r_[ends, len(ids)], strict=True):
                group = tuple(int(c[lo]) for c in keys[:-1])
                if group != now:
                    now, block, held = group, None, []
                if not keys[-1][lo]:
                    held.append((ids[lo:hi].copy(), own[lo:hi].copy(), taxa[lo:hi].copy()))
                    continue
                if not held and block is None:
                    continue  # no reference
                if held:
                    i, c, t = (np.concatenate(z) for z in zip(*held, strict=True))
                    block, held = _Block(i, c, t if taxon else None, fours, k, orbits, loo), []
                for a in range(lo, hi, ROWS):
                    z = min(a + ROWS, hi)
                    row, d, *more = block.search(ids[a:z], own[a:z])
                    # a row's tallies stand together
                    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (d[1:] != d[:-1])]) if taxon and len(row) else np.arange(len(row))
                    for s in range(0, len(first), 100_000):
                        e = first[s : s + 100_000]
                        cols = [*[pa.array(np.full(len(e), g)) for g in group[:size]], pa.array(ids[a:z][row[e]])]
                        d4 = pa.array(d[e].astype(np.int64))
                        if taxon:
                            stop = first[s + 100_000] if s + 100_000 < len(first) else len(row)
                            at, name, n = pa.array(np.r_[e, stop] - e[0], pa.int32()), block.names[more[0][e[0] : stop]], more[1][e[0] : stop]
                            lists = pa.ListArray.from_arrays(at, pa.array(name, mask=name == unknown)), pa.ListArray.from_arrays(at, pa.array(n))
                            yield pa.RecordBatch.from_arrays([*cols, d4, pa.array(np.add.reduceat(n, e - e[0])), *lists], [*by, "q", "d4", "n", "taxa", "counts"])
                        else:
                            yield pa.RecordBatch.from_arrays([*cols, pa.array(block.ids[more[0][e]]), d4], [*by, "q", "r", "d4"])

    types = "".join(f"`{c}` long, " for c in by) + "q long, " + ("d4 long, n long, taxa array<long>, counts array<long>" if taxon else "r long, d4 long")
    return rows.repartition(*key).sortWithinPartitions(*key, "_query").mapInArrow(run, types)


def neighbour_counts(counts: DataFrame, k: int, criterion: str = "orbit", by: list[str] | None = None) -> DataFrame:
    """neighbours, of rows that stand for n neighbours each."""
    by = by or ["q"]
    w = Window.partitionBy(*by).orderBy("d4")
    at = F.dense_rank().over(w) if criterion == "orbit" else 1 + F.coalesce(F.sum("n").over(w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = counts.withColumn("at", at).where(F.col("at") <= k).drop("at")
    span = Window.partitionBy(*by)
    kept = kept.withColumns({"first": F.min("d4").over(span), "last": F.max("d4").over(span)})
    return kept.withColumns(weights(F.col("d4"), F.col("first"), F.col("last"))).drop("first", "last")


def each_taxon(counts: DataFrame, taxon: str) -> DataFrame:
    """A row for each known taxon of rows with taxa and counts, n being its own."""
    x = F.explode(F.arrays_zip("taxa", "counts")).alias("_x")
    rest = [c for c in counts.columns if c not in ("taxa", "counts", "n")]
    return counts.select(*rest, x).select(*rest, F.col("_x.taxa").alias(taxon), F.col("_x.counts").alias("n")).where(F.col(taxon).isNotNull())


def support_counts(near: DataFrame, by: list[str], taxon: str) -> DataFrame:
    """support, of rows with taxa and counts."""
    t = each_taxon(near, taxon).groupBy(*by, taxon).agg(F.sum(F.col("n") * F.col("d4")).alias("_s"), F.sum(F.col("n") * F.col("d4") * F.col("d4")).alias("_ss"), *[F.sum(F.col("n") * F.col(x)).alias(x) for x in "uwd"], F.sum("n").alias("n"))
    n, s = F.col("n"), F.col("_s")
    return t.select(*by, taxon, "n", (s / n / 4).alias("mean_d"), (F.sqrt(n * F.col("_ss") - s * s) / n / 4).alias("std_d"), *"uwd")


def support(near: DataFrame, by: list[str], taxon: str) -> DataFrame:
    """Per group and taxon: neighbours, mean and population deviation of distance, sums of the weights."""
    return near.where(F.col(taxon).isNotNull()).groupBy(*by, taxon).agg(F.count("*").alias("n"), F.avg(F.col("d4") / 4).alias("mean_d"), F.stddev_pop(F.col("d4") / 4).alias("std_d"), *[F.sum(x).alias(x) for x in "uwd"])


def softmax(supports: DataFrame, by: list[str], columns: tuple = ("u", "w", "d")) -> DataFrame:
    """Adds the softmax of each support within its group."""
    w = Window.partitionBy(*by)
    tops = supports.withColumns({f"_{c}": F.exp(F.col(c) - F.max(c).over(w)) for c in columns})
    return tops.withColumns({f"softmax_{c}": F.col(f"_{c}") / F.sum(f"_{c}").over(w) for c in columns}).drop(*[f"_{c}" for c in columns])


def winner(supports: DataFrame, by: list[str], taxon: str, column: str) -> DataFrame:
    """(by, taxon, support): the taxon of strictly the greatest support; -1 on a tie."""
    rounded = supports.withColumn("_s", F.round(column, 6))
    w = Window.partitionBy(*by).orderBy(F.desc("_s"), taxon)
    top = rounded.withColumns({"_rn": F.row_number().over(w), "_next": F.lead("_s").over(w)}).where("_rn = 1")
    return top.select(*by, F.when(F.col("_next") == F.col("_s"), F.lit(-1)).otherwise(F.col(taxon)).cast("bigint").alias("pred"), F.col("_s").alias("support"))
