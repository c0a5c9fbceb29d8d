"""Line deduplication by a log-template tree.

Every line is parsed to a fixed depth: token count, then its first tokens, with variable
fields (tokens with a digit) generalised; a line of mostly variable fields keeps them, so that only equal
ones are one. In a leaf, lines whose tokens agree in most places are one template, the other places becoming
variable too; a leaf of many lines is split by its next token, and the templates of its parts meet once more. A template is dropped where it
recurs in independent documents. Whole texts are judged for that: texts that hold a recurring
line are cut into runs of words, ended by words of some hashes, and those whose sets of runs
are alike are copies of one document (components of links, as in op8_jaccard), so copies alone
make no template recur, and what stands beside a line makes no difference.

Counting works on hashes of generalised lines. Tokens travel only for lines in leaves that
recur (a fixed-size bitmap of leaves decides, its false positives only cost time).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import kept_by, written
from .jaccard import near_components
from .words import Words, blocks, mix, mixed

#: Makes every digit a 0, so that a token with a digit is one with a 0.
_ZERO = bytes(48 if 48 <= x <= 57 else x for x in range(256))
#: Makes digits and white space other than blanks a 0: what a plain line has none of.
_ODD = bytes(48 if 48 <= x <= 57 or x in (9, 11, 12, 13) else x for x in range(256))
#: Tokens of the tree, least tokens of a line that is judged, leaves of the bitmap, lines of a leaf that one task takes as they are.
LEADING, LEAST_TOKENS, BITS, SPLIT = 3, 3, 1 << 24, 20_000
#: Texts and templates that a task remembers to pass over repeated ones; beyond, it forgets, which only costs time.
SEEN = 500_000


def _hash(x: bytes) -> int:
    return xxh3_64_intdigest(x) - 2**63


def generalise(line: bytes) -> tuple[int, list[bytes]] | None:
    """(leaf, tokens) of a line of enough tokens, else None; a variable token is b'*' where at least half are fixed."""
    toks = line.split()
    if len(toks) < LEAST_TOKENS:
        return None
    zeros = line.translate(_ZERO)
    if b"0" in zeros:
        some = [b"*" if b"0" in z else t for z, t in zip(zeros.split(), toks, strict=True)]
        if 2 * some.count(b"*") <= len(toks):
            toks = some
    return _hash(b"%d " % len(toks) + b" ".join(toks[:LEADING])), toks


def parsed(text: bytes) -> list[tuple[int, bytes] | None]:
    """For each line its leaf and its tokens in a row, as generalise has them. A line of single blanks and without a digit, as most are, is not cut."""
    lines, odd, single = text.split(b"\n"), text.translate(_ODD), b"  " not in text
    marked = odd.split(b"\n") if b"0" in odd else None
    out: list[tuple[int, bytes] | None] = []
    for i, line in enumerate(lines):
        if single and line and (marked is None or b"0" not in marked[i]) and line[0] != 32 != line[-1]:
            n = line.count(b" ") + 1
            if n <= LEADING:
                out.append((_hash(b"%d %b" % (n, line)), line) if n >= LEAST_TOKENS else None)
            else:
                out.append((_hash(b"%d %b" % (n, line[: -1 - len(line.split(b" ", LEADING)[LEADING])])), line))
        else:
            got = generalise(line)
            out.append(got and (got[0], b" ".join(got[1])))
    return out


def _runs(column: pa.Array) -> list[bytes]:
    """The hashes of each text's runs of words, 8 bytes each; a word in four ends a run."""
    out = []
    for lo, hi in blocks(column):
        w = Words(column.slice(lo, hi - lo))
        h, first = w.hashes(), np.zeros(len(w.starts), bool)
        first[1:] = h[:-1] % np.uint64(4) == 0
        first[w.first[:-1][w.first[:-1] < len(h)]] = True
        at = np.flatnonzero(first)
        place = np.arange(len(h)) - np.repeat(at, np.diff(np.r_[at, len(h)]))
        runs = mix(np.add.reduceat(mix(h + mixed(place)), at)) if len(at) else h
        bounds = np.searchsorted(at, w.first)
        out += [runs[i:j].astype("<u8").tobytes() for i, j in zip(bounds, bounds[1:], strict=False)]
    return out


def _lines(docs: DataFrame) -> DataFrame:
    """(k1, k2, leaf, template, lines, runs): a row for each template of each text, and one with its runs of words alone. Repeated texts of a task are passed over."""
    names = ["k1", "k2", "leaf", "template", "lines", "runs"]
    types = [pa.int64()] * 4 + [pa.list_(pa.int32()), pa.binary()]

    def run(batches):
        kept_by("templates")  # frees what an operator before kept in this worker
        seen = set()
        for b in batches:
            new = []
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if key not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    new.append((i, *key))
            texts = b.column(2).take(pa.array([i for i, _, _ in new], pa.int64()))
            for lo in range(0, len(new), 500):  # bounded rows at once
                part = texts.slice(lo, 500)
                some = new[lo : lo + 500]
                none = [None] * len(some)
                yield _rows([[k1 for _, k1, _ in some], [k2 for _, _, k2 in some], none, none, none, _runs(part)])
                out: list[list] = [[] for _ in range(5)]
                for (_, k1, k2), text in zip(some, part, strict=True):
                    found: dict[int, tuple] = {}
                    for i, got in enumerate(parsed((text.as_py() or "").encode())):
                        if got:
                            found.setdefault(_hash(got[1]), (got[0], []))[1].append(i)
                    for t, (leaf, at) in found.items():
                        for col, x in zip(out, (k1, k2, leaf, t, at), strict=True):
                            col.append(x)
                    if len(out[0]) > 20_000:
                        yield _rows([*out, [None] * len(out[0])])
                        out = [[] for _ in range(5)]
                if out[0]:
                    yield _rows([*out, [None] * len(out[0])])

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return docs.mapInArrow(run, "k1 long, k2 long, leaf long, template long, lines array<int>, runs binary")


def _in_leaves(rows: DataFrame, leaves: np.ndarray) -> DataFrame:
    """Rows (leaf, ...) of the bitmap's leaves. No join, which a leaf of many lines would skew."""
    bitmap = np.zeros(BITS, bool)
    bitmap[leaves] = True
    sent = rows.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def run(batches):
        kept_by("templates")
        bits = np.unpackbits(sent.value).view(bool)
        for b in batches:
            yield b.filter(pa.array(bits[b.column(0).to_numpy() % BITS]))

    return rows.mapInArrow(run, rows.schema)


def _tokens(docs: DataFrame, leaves: np.ndarray) -> DataFrame:
    """(leaf, template, tokens as binary 64-bit hashes, 0: variable) of lines in the bitmap's leaves."""
    bitmap = np.zeros(BITS, bool)
    bitmap[leaves] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def run(batches):
        kept_by("templates")
        bits, seen = np.unpackbits(sent.value).view(bool), set()
        for b in batches:
            out = []
            for text in b.column(0):
                for got in parsed((text.as_py() or "").encode()):
                    if got and bits[got[0] % BITS]:
                        t = _hash(got[1])
                        if t in seen:
                            continue
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(t)
                        out.append((got[0], t, np.array([0 if x == b"*" else xxh3_64_intdigest(x) for x in got[1].split(b" ")], "<u8").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["leaf", "template", "tokens"])

    return docs.select("text").mapInArrow(run, "leaf long, template long, tokens binary").dropDuplicates(["template"])


class Leaf:
    """Templates of one leaf. A line that agrees in enough places agrees in all of some segment, so only templates that share one are compared."""

    def __init__(self, length: int, similar: float):
        spare = int(length * (1 - similar) + 1e-9)  # places that may differ, all of them beyond the leading ones
        start, n = min(LEADING, length), spare + 1
        cuts = [start + (length - start) * k // n for k in range(n + 1)]
        self.segments = list(zip(cuts, cuts[1:], strict=False)) if length - start > spare else []
        self.similar, self.length = similar, length
        self.kept: list[np.ndarray] = []
        self.ids: list[int] = []
        self.by: dict[tuple, list[int]] = {}

    def _keys(self, x):
        raw = x.tobytes()
        return [(k, raw[8 * lo : 8 * hi]) for k, (lo, hi) in enumerate(self.segments)]

    def _file(self, number, keys):
        for k in keys:
            own = self.by.setdefault(k, [])
            if number not in own:
                own.append(number)

    def place(self, x: np.ndarray, t: int) -> int:
        """Number of the most similar template, or of a new one; of equal ones the first."""
        if not self.ids:  # a leaf of one line needs no keys
            self.kept.append(x)
            self.ids.append(t)
            return 0
        if not self.by:
            self._file(0, self._keys(self.kept[0]))
        keys = self._keys(x)
        at = sorted({c for k in keys for c in self.by.get(k, ())}) if self.segments else list(range(len(self.ids)))
        best, most = -1, 0.0
        for lo in range(0, len(at), 4096):
            same = np.stack([self.kept[c] for c in at[lo : lo + 4096]]) == x
            share = same.mean(1)
            k = int(share.argmax())
            if share[k] >= self.similar and share[k] > most:
                best, most = at[lo + k], float(share[k])
        if best < 0:
            best = len(self.ids)
            self.kept.append(x)
            self.ids.append(t)
        else:
            before = self.kept[best]
            now = np.where(before == x, before, 0)
            if (now == before).all():
                return best
            self.kept[best] = now
            keys = self._keys(now)
        self._file(best, keys)
        return best


def _grouped(rows: DataFrame, key: str, similar: float) -> DataFrame:
    """(leaf, template, cluster, kept): rows of one key, most frequent first, join the most similar template or start one; kept: its tokens then, for crowded rows."""

    def run(batches):
        at, tree, held, done = None, None, [], []

        def out(part):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["leaf", "template", "cluster", "kept"])

        def end():
            """Keeps what a leaf of all its rows gives; many small leaves leave in one batch."""
            done.extend((leaf, t, tree.ids[n], tree.kept[n].tobytes() if crowded else None) for leaf, t, n, crowded in held)

        for b in batches:
            for k, leaf, t, tokens, crowded in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                x = np.frombuffer(tokens, "<i8")
                if (k, len(x)) != at:
                    end()
                    while len(done) >= 10_000:
                        yield out(done[:10_000])
                        del done[:10_000]
                    at, tree, held = (k, len(x)), Leaf(len(x), similar), []
                held.append((leaf, t, tree.place(x, t), crowded))
        end()
        for lo in range(0, len(done), 10_000):
            yield out(done[lo : lo + 10_000])

    return rows.repartition(key).sortWithinPartitions(key, F.length("tokens"), F.desc("texts"), "template").select(F.col(key).alias("key"), "leaf", "template", "tokens", "crowded").mapInArrow(run, "leaf long, template long, cluster long, kept binary")


def _clusters(rows: DataFrame, similar: float) -> DataFrame:
    """(template, cluster) of rows (leaf, template, tokens, texts). Leaves of more than SPLIT lines are dealt by their next token first."""
    rows = written(rows, "tokens")
    crowded = rows.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT).select("leaf", F.lit(True).alias("crowded"))
    dealt = rows.join(crowded, "leaf", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    part = F.when(F.col("crowded"), F.xxhash64("leaf", F.substring("tokens", 8 * LEADING + 1, 8))).otherwise(F.col("leaf"))
    first = written(_grouped(dealt.withColumn("part", part), "part", similar), "parts")
    split = first.join(crowded, "leaf", "left_semi")
    heads = split.join(rows.select("template", "texts"), "template").groupBy("leaf", F.col("cluster").alias("template"), F.col("kept").alias("tokens")).agg(F.sum("texts").alias("texts"))
    second = _grouped(heads.withColumn("crowded", F.lit(False)), "leaf", similar).select(F.col("template").alias("cluster"), F.col("cluster").alias("whole"))
    return first.select("template", "cluster").join(second, "cluster", "left").select("template", F.coalesce("whole", "cluster").alias("cluster"))


def drop_templates(docs: DataFrame, text_col: str = "text", least: int = 2, similar: float = 0.8, alike: int = 75) -> DataFrame:
    """docs with recurring lines taken out of text_col, and dropped_lines (line numbers from 0) added.

    A line of at least 3 tokens goes, wherever it stands, if its template stands in at least
    `least` independent documents. Texts that share `alike` per cent of their runs of words, and what such links join, are
    one document. Null texts stay null; a text that loses every line is empty; equal texts lose equal lines,
    so repeated rows and null ids make no difference. All other columns stay as they are (one
    named dropped_lines is replaced). An empty table stays empty.
    """
    keys = (F.xxhash64(F.col(text_col)), F.xxhash64(F.lit(1), F.col(text_col)))
    # a null text has the keys of its seeds: no line, nothing to drop
    texts = docs.select(keys[0].alias("k1"), keys[1].alias("k2"), F.col(text_col).cast("string").alias("text"))
    found = written(_lines(texts), "lines")
    lines = found.where("template is not null")
    bit = F.pmod("leaf", F.lit(BITS)).cast("int")
    several = (F.col("n") >= least) & ((F.col("low") < F.col("high")) | F.lit(least < 2))
    bits = lines.groupBy(bit.alias("b")).agg(F.count("*").alias("n"), F.min("k1").alias("low"), F.max("k1").alias("high")).where(several).select("b").toArrow()["b"].to_numpy()  # at most BITS
    pairs = written(_in_leaves(lines.select("leaf", "template", "k1", "k2", "lines"), bits).distinct(), "alive")
    alive = pairs.groupBy("leaf", "template").agg(F.count("*").alias("texts"))
    tokens = _tokens(texts, bits).join(alive.select("template", "texts"), "template")
    of = written(_clusters(tokens, similar), "clusters")
    held = pairs.select("template", "k1").join(of, "template").select("cluster", "k1").distinct()
    often = of.join(alive, "template").groupBy("cluster").agg(F.sum("texts").alias("n")).where(F.col("n") >= least)
    held = written(held.join(often.select("cluster"), "cluster"), "held")
    compared = written(found.where("runs is not null").select("k1", "runs").join(held.select("k1").distinct(), "k1", "left_semi"), "runs")
    copies = near_components(compared, "k1", "runs", 1, alike).select(F.col("id").alias("k1"), "component_id").distinct()
    apart = held.join(copies, "k1").select("cluster", "component_id").distinct().groupBy("cluster").agg(F.count("*").alias("n"))
    gone = of.join(apart.where(F.col("n") >= least), "cluster").select("template").distinct()
    cut = pairs.join(gone, "template").groupBy("k1", "k2").agg(F.sort_array(F.flatten(F.collect_list("lines"))).alias("_cut"))
    rest = [c for c in docs.columns if c.lower() != "dropped_lines"]
    beside = [c for c in rest if c != text_col]
    whole = docs.select((F.struct(*[F.col(f"`{c}`") for c in beside]) if beside else F.lit(0)).alias("_row"), F.col(text_col).cast("string").alias("_text"), keys[0].alias("k1"), keys[1].alias("k2"))
    joined = whole.join(cut, ["k1", "k2"], "left")
    kept = F.array_join(F.filter(F.split("_text", "\n", -1), lambda x, i: ~F.array_contains("_cut", i)), "\n")
    text = F.when(F.col("_cut").isNull(), F.col("_text")).otherwise(kept)
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in rest], F.coalesce("_cut", F.array().cast("array<int>")).alias("dropped_lines"))


def op10_templates(spark, sf_dir: str) -> DataFrame:
    """Every document with its text less the recurring lines, and those lines' numbers."""
    return drop_templates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
