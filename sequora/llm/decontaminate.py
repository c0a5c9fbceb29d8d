"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

A window can only be similar to an item if enough of its places hold a word shingle of that
item, so windows of an item's size are laid at all starts, in steps of one word, where the
number of such places can reach the threshold, whatever their order; no other window could pass.
Windows and items get 128-bit SimHash fingerprints of their shingles. Candidates are the pairs of one
size within the Hamming radius: the bits are shared out among blocks, fingerprints within radius
2 * blocks - 1 differ by at most one bit in some block, and items are listed under every value that is one bit or
less from a block of theirs, so that an equality join finds all of them. Candidates are verified by exact similarity of their
shingles, weighted by how often each occurs. Equal windows are fingerprinted and verified once.

At the threshold of 75 per cent, fingerprints are 22 bits apart on average; the radius of 39 loses, in a simulation, at most 0.03 per cent of
the pairs that are exactly at the threshold and practically none above it (a test measures recall).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, written

#: Blocks that share out 128 bits. Anchors (item, size, shingle) that are broadcast: 28 bytes each. Keys of texts that are: 8 bytes each.
BLOCKS, BROADCAST, KEYS = 20, 200_000, 2_000_000
RADIUS = 2 * BLOCKS - 1
WHITE = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    return F.split(F.btrim(F.lower(text), F.lit(WHITE)), GAP, -1)


def shingles_of(words: str, n: int = 5) -> Column:
    """64-bit hashes of n words in a row; none of fewer words."""
    each = F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, n)]))
    return F.when(F.size(words) < n, F.array().cast("array<bigint>")).otherwise(F.slice(each, 1, F.size(words) - (n - 1)))


def window_shingles(words: str, n: int) -> Column:
    """Sorted shingles of n words; of fewer words, all of them are one."""
    whole = reduce(lambda rest, k: F.when(F.size(words) == k, F.array(F.xxhash64(*[F.get(words, F.lit(i)) for i in range(k)]))).otherwise(rest), range(1, n), shingles_of(words, n))
    return F.sort_array(whole)


def fingerprint(shingles: str) -> Column:
    """SimHash of the shingles, each counted as often as it occurs: two longs."""

    def half(hashes):
        return F.expr(f"aggregate(transform(aggregate({hashes}, array_repeat(0, 64), (s, h) -> transform(s, (x, b) -> x + cast(shiftright(h, b) & 1L as int))), (x, b) -> if(2 * x > size({shingles}), shiftleft(1L, b), 0L)), 0L, (a, x) -> a | x)")

    return F.array(half(shingles), half(f"transform({shingles}, h -> xxhash64(h))"))


def block_values(finger: str) -> list[tuple[Column, int]]:
    """(value, bits) of the blocks of the two longs of a fingerprint."""
    out = []
    for half in (0, 1):
        cuts = [64 * j // (BLOCKS // 2) for j in range(BLOCKS // 2 + 1)]
        out += [(F.shiftrightunsigned(F.col(finger)[half], a).bitwiseAND(F.lit((1 << (b - a)) - 1)), b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


def block_keys(finger: str, near: bool = False) -> Column:
    """(block, value) of every block; near: also of the values that are one bit from it."""
    keys = []
    for j, (value, bits) in enumerate(block_values(finger)):
        keys += [F.struct(F.lit(j).alias("block"), v.alias("value")) for v in [value, *([value.bitwiseXOR(F.lit(1 << k)) for k in range(bits)] if near else [])]]
    return F.array(*keys)


def apart(a: str, b: str) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])) + F.bit_count(F.col(a)[1].bitwiseXOR(F.col(b)[1]))


def numbered(shingles: str) -> Column:
    """Sorted shingles made different by how many equal ones stand before them: sets that count repeats."""
    return F.transform(shingles, lambda x, i: F.xxhash64(x, i + 1 - F.array_position(shingles, x)))


def few(rows: DataFrame, found: DataFrame, key: str, how: str) -> DataFrame:
    """rows in (left_semi) or not in (left_anti) a written table of distinct keys, which is broadcast up to KEYS of them, so that rows aren't shuffled."""
    return rows.join(F.broadcast(found) if found.count() <= KEYS else found, key, how)


def starts_of(places: str, size: str, total: str, n: int, per_cent: int) -> Column:
    """Starts of the windows that hold enough of the sorted places for per_cent; total: words of the text."""
    gram = F.least(F.col(size), F.lit(n))
    own = F.least(F.col(size), F.col(total)) - (gram - 1)
    need = F.ceil(per_cent * (F.col(size) - (gram - 1) + own) / (100 + per_cent)).cast("int")
    last = F.greatest(F.lit(0), F.col(total) - F.col(size))

    def run(x, j):
        # x is the first place within: starts after the place before it, and late enough to hold the last one needed
        lo = F.greatest(F.lit(0), F.coalesce(F.get(places, j - 1) + 1, F.lit(0)), F.get(places, j + need - 1) - own + 1)
        hi = F.least(x, last)
        return F.when(F.get(places, j + need - 1).isNotNull() & (lo <= hi), F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(places, run))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 5, per_cent: int = 75) -> DataFrame:
    """(id, item, start, n_words, similarity): documents with a window like an item, its best window by first word.

    Similar: 100 * (sum of least counts) >= per_cent * (sum of greatest counts) over n-word
    shingles of the lower-cased words. An item of fewer than n words is one shingle, so only equal words match it.
    Items without words and null texts match nothing. A document shorter than an item is one window; one of fewer
    than n words can only hold items of its own length. Rows of one id are
    judged apart and give one row; null ids are kept as null. Other columns are ignored.
    Either table empty: no rows.
    """
    it = items.select(F.col(item_col).alias("item"), words_of(F.col(item_text).cast("string")).alias("iw")).where(F.array_join("iw", "") != "")
    it = it.withColumn("size", F.size("iw")).withColumn("ish", window_shingles("iw", n)).withColumn("iset", numbered("ish"))
    it = written(it.select("item", "size", "ish", "iset", F.xxhash64("iw").alias("ik"), fingerprint("ish").alias("ifinger")), "items")
    anchors = written(it.select("ik", "size", F.explode("ish").alias("shingle")).distinct(), "anchors")
    if anchors.count() <= BROADCAST:
        anchors = F.broadcast(anchors)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    keys = {"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), F.col("text"))}
    cut = rows.select(*[v.alias(k) for k, v in keys.items()], words_of(F.col("text")).alias("w"))

    def places(gram):
        # the outer form: the inner one would have the optimiser repeat the split below it for each element
        return cut.select("k1", "k2", F.size("w").alias("n"), shingles_of("w", gram).alias("sh")).select("k1", "k2", "n", F.posexplode_outer("sh").alias("pos", "shingle"))

    short = [r["size"] for r in it.where(F.col("size") < n).select("size").distinct().collect()]  # fewer than n
    hits = reduce(DataFrame.union, map(places, [n, *sorted(short)])).join(anchors, "shingle").groupBy("k1", "k2", "ik", "size", "n").agg(F.sort_array(F.collect_set("pos")).alias("hits"))
    laid = hits.select("k1", "k2", "size", F.explode(starts_of("hits", "size", "n", n, per_cent)).alias("start"))
    at = written(laid.distinct(), "windows")

    by_text = at.groupBy("k1", "k2").agg(F.collect_list(F.struct("size", "start")).alias("windows"))
    # texts without a window stay where they are; of those with one, a single copy is shuffled, and cut
    some = few(rows.withColumns(keys), at.select("k1").distinct(), "k1", "left_semi")
    held = some.select("k1", "k2", "text").dropDuplicates(["k1", "k2"]).join(by_text, ["k1", "k2"]).select("k1", "k2", words_of(F.col("text")).alias("w"), "windows")
    wins = held.select("k1", "k2", F.explode_outer(F.transform("windows", lambda x: F.struct(x["size"].alias("size"), x["start"].alias("start"), F.slice("w", x["start"] + 1, x["size"]).alias("w")))).alias("x")).select("k1", "k2", "x.*")
    wins = wins.withColumn("sh", window_shingles("w", n)).select("k1", "k2", "size", "start", "sh", F.xxhash64("sh").alias("c1"), F.xxhash64(F.lit(1), F.col("sh")).alias("c2"))
    wins = written(wins, "laid")

    contents = wins.select("size", "c1", "c2", "sh").dropDuplicates(["size", "c1", "c2"])
    contents = written(contents.select("size", "c1", "c2", fingerprint("sh").alias("finger"), numbered("sh").alias("set")), "fingers")
    w = contents.select("size", "c1", "c2", "finger", F.explode(block_keys("finger")).alias("b")).select("*", "b.block", "b.value")
    i = it.select("ik", "size", "ifinger", F.explode(block_keys("ifinger", near=True)).alias("b")).select("*", "b.block", "b.value").drop("b")
    near = w.join(i, ["size", "block", "value"]).where(apart("finger", "ifinger") <= RADIUS).select("size", "c1", "c2", "ik").distinct()
    both = F.size(F.array_intersect("set", "iset"))
    found = near.join(contents.drop("finger"), ["size", "c1", "c2"]).join(it.select("item", "ik", "iset"), "ik").select("size", "c1", "c2", "item", both.alias("both"), (F.size("set") + F.size("iset") - both).alias("any"))
    found = written(found.where(100 * F.col("both") >= per_cent * F.col("any")), "similar")
    top = F.max(F.struct((F.col("both") / F.col("any")).alias("similarity"), (-F.col("start")).alias("s"), "size")).alias("m")
    texts = written(wins.drop("sh").join(found, ["size", "c1", "c2"]).groupBy("k1", "k2", "item").agg(top), "texts")
    best = some.select("id", "k1", "k2").join(texts, ["k1", "k2"]).groupBy("id", "item").agg(F.max("m").alias("m"))
    return best.select("id", "item", (-F.col("m.s")).alias("start"), F.col("m.size").alias("n_words"), F.col("m.similarity").alias("similarity"))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the window that is most like it."""
    out = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumnRenamed("id", "doc_id").withColumnRenamed("item", "item_id")
