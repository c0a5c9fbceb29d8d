"""N-gram Jaccard join by a prefix tree.

Documents are sets of hashed word shingles. Equal sets are one class. A shuffle of compact
blobs counts in how many texts each shingle occurs; the global order is by that count,
then hash, so shingles of one text come first. A class whose first |x| - ceil(t|x|) + 1
shingles all occur nowhere else has no partner and goes. Classes that share a shingle of
those prefixes are connected into candidate components (light rows only), and each component's
ordered sets are stored in a path-compressed trie; a set is matched while it descends the
trie, adding up overlaps along shared paths and leaving subtrees whose remaining lengths
cannot reach the needed overlap, or which are already joined with it. A component that is too
large for one task is split into blocks: first each block with the least class, then, if
classes are still apart, all pairs of blocks. No pair is lost and no group is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, kept_by, written
from .words import Words, blocks, mix, shingles, text_buffers

#: Entries that a task sorts at once, and shingles that one trie holds.
CHUNK, BUCKET, TRIE = 2_000_000, 1_500_000, 3_000_000


def set_rows(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct hashes of all rows of a block, bounds by row). Binary rows are sets already: 64-bit hashes in any order."""
    for lo, hi in blocks(texts):
        if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type):
            data, offsets = text_buffers(texts.slice(lo, hi - lo))
            h, rows = np.frombuffer(data.tobytes(), "<u8"), np.repeat(np.arange(hi - lo), np.diff(offsets) // 8)
        else:
            w = Words(texts.slice(lo, hi - lo))
            h, rows = shingles(w.hashes(), w.first, n)
        order = np.lexsort((h, rows))
        h, rows = h[order], rows[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        h, rows = h[keep], rows[keep]
        yield lo, h, np.searchsorted(rows, np.arange(hi - lo + 1))


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever the order; 0 for an empty set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h), dtype=np.uint64)])
    size = np.diff(bounds).astype(np.uint64)
    out = mix((total[bounds[1:]] - total[bounds[:-1]]) + size * np.uint64(0x9E3779B97F4A7C15))
    return np.where(size > 0, out, np.uint64(0)).view(np.int64)


def pack(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes of their differences."""
    d = np.diff(x.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def pack_mixed(x: np.ndarray) -> bytes:
    """Numbers in no order as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_mixed(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_mixed(blob), dtype=np.uint64)


def _sets_or_text(docs: DataFrame, col: str):
    """The column as it is if it is binary (sets of hashes), else as text."""
    return F.col(col) if docs.schema[col].dataType.typeName() == "binary" else F.col(col).cast("string")


def classes(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """One row per document: id, n_shingles, cls (equal for equal sets, null for empty ones)."""
    from pyspark.sql.types import LongType, StructField, StructType

    kind = docs.schema[id_col].dataType
    schema = StructType([StructField("id", kind), StructField("n_shingles", LongType()), StructField("cls", LongType())])

    def run(batches):
        kept_by("jaccard")  # frees what an operator before kept in this worker
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for lo, h, bounds in set_rows(texts, n):
                size = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(size)), pa.array(size.astype(np.int64)), pa.array(signatures(h, bounds), mask=size == 0)], ["id", "n_shingles", "cls"])

    return docs.select(F.col(id_col).alias("id"), _sets_or_text(docs, text_col).alias("text")).mapInArrow(run, schema)


def shared_shingles(docs: DataFrame, text_col: str, n: int, n_buckets: int) -> DataFrame:
    """Blobs of the shingles that occur in more than one text, dealt by text: rows (part, kind, x, y, z).

    kind 0: texts (x), shingles (y) and in how many texts each stands (z); kind 1: texts (x),
    their classes (y) and set sizes (z). A text is numbered where it is read; texts of one class
    that are read by one task count once.
    """

    def part_of(uid):
        return (mix(uid) % np.uint64(n_buckets)).astype(np.int64)

    def rows(out, names, types):
        out = list(out)
        for at in range(0, len(out), 64):
            part = out[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate(types)], names)

    def deal(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        hs, idx, cls, size, seen, held = [], [], [], [], set(), 0

        def flush():
            if not hs:
                return
            h, i = np.concatenate(hs), np.concatenate(idx)
            order = np.argsort(h, kind="stable")
            h, i = h[order], i[order]
            to = ((h >> np.uint64(16)) * np.uint64(n_buckets)) >> np.uint64(48)
            cuts = np.searchsorted(to, np.arange(n_buckets + 1, dtype=np.uint64))
            for k in range(n_buckets):
                x, y = cuts[k], cuts[k + 1]
                if x < y:
                    yield k, base, pack(h[x:y]), i[x:y].astype(np.uint32).tobytes() if len(cls) > 65536 else i[x:y].astype(np.uint16).tobytes(), None
            yield int(base >> 40) % n_buckets, base, None, np.array(cls, np.int64).tobytes(), np.array(size, np.int64).tobytes()

        names, types = ["bucket", "base", "h", "i", "s"], (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        for b in batches:
            for _, h, bounds in set_rows(b.column(0), n):
                sig = signatures(h, bounds)
                for r in range(len(sig)):
                    lo, hi = bounds[r], bounds[r + 1]
                    if lo == hi or sig[r] in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(sig[r])
                    hs.append(h[lo:hi])
                    idx.append(np.full(hi - lo, len(cls), np.int32))
                    cls.append(sig[r])
                    size.append(hi - lo)
                    held += hi - lo
                    if held >= CHUNK:
                        yield from rows(flush(), names, types)
                        base += len(cls)
                        hs, idx, cls, size, held = [], [], [], [], 0
        yield from rows(flush(), names, types)

    names, types = ["part", "kind", "x", "y", "z"], (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def spread(kind, uid, *more):
        to = part_of(uid)
        order = np.lexsort((uid, to))
        to, uid, more = to[order], uid[order], [m[order] for m in more]
        cuts = np.searchsorted(to, np.arange(n_buckets + 1))
        for k in range(n_buckets):
            x, y = cuts[k], cuts[k + 1]
            if x < y:
                yield k, kind, pack(uid[x:y]), *(pack_mixed(m[x:y]) for m in more)

    def meet(batches):
        got: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                if r["h"] is None:
                    c = np.frombuffer(r["i"], np.uint64)
                    yield from rows(spread(1, np.uint64(r["base"]) + np.arange(len(c), dtype=np.uint64), c, np.frombuffer(r["s"], np.uint64)), names, types)
                else:
                    got.setdefault(r["bucket"], []).append(r)
        for parts in got.values():
            hs, uids = [], []
            for r in parts:
                hs.append(unpack(r["h"]))
                width = np.uint16 if len(r["i"]) == 2 * len(hs[-1]) else np.uint32
                uids.append(np.frombuffer(r["i"], width).astype(np.uint64) + np.uint64(r["base"]))
            h, uid = np.concatenate(hs), np.concatenate(uids)
            order = np.argsort(h)
            h, uid = h[order], uid[order]
            runs = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
            count = np.repeat(np.diff(runs), np.diff(runs))
            some = count > 1
            if some.any():
                yield from rows(spread(0, uid[some], h[some], count[some].astype(np.uint64)), names, types)

    dealt = docs.select(_sets_or_text(docs, text_col)).mapInArrow(deal, "bucket int, base long, h binary, i binary, s binary")
    return dealt.repartition(n_buckets, "bucket").mapInArrow(meet, "part int, kind int, x binary, y binary, z binary")


def prefix_length(n: int, per_cent: int) -> int:
    return n - -(-per_cent * n // 100) + 1


def ordered_sets(blobs: DataFrame, per_cent: int, n_buckets: int) -> DataFrame:
    """(cls, n, m, h, k, prefix): m shared shingles in the global order (by count, then hash), those of the prefix.

    Sets whose prefix is all of shingles that stand nowhere else are left out.
    """

    def order(batches):
        got: dict[int, list] = {0: [], 1: []}
        for b in batches:
            for kind, *row in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                got[kind].append((unpack(row[0]), unpack_mixed(row[1]), unpack_mixed(row[2])))
        if not got[0]:
            return
        uid, h, k = (np.concatenate(x) for x in zip(*got[0], strict=True))
        known, cls, size = (np.concatenate(x) for x in zip(*got[1], strict=True))
        at = np.lexsort((h, k, uid))
        uid, h, k = uid[at], h[at], k[at]
        cuts = np.flatnonzero(np.r_[True, uid[1:] != uid[:-1], True])
        by = np.argsort(known)
        of = by[np.searchsorted(known[by], uid[cuts[:-1]])]
        out = []
        for x, y, c, n in zip(cuts, cuts[1:], cls[of].view(np.int64).tolist(), size[of].tolist(), strict=False):
            own = prefix_length(n, per_cent) - (n - int(y - x))
            if own > 0:
                out.append((c, n, int(y - x), h[x:y].astype("<u8").tobytes(), k[x:y].astype(np.int32).tobytes(), h[x : x + own].view(np.int64).tolist()))
            if len(out) >= 500:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[x] for r in out], t) for x, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())))], ["cls", "n", "m", "h", "k", "prefix"])

    return blobs.repartition(n_buckets, "part").mapInArrow(order, "cls long, n long, m long, h binary, k binary, prefix array<long>")


class Trie:
    """Ordered sets along paths; links found so far are kept as labels of joined sets.

    heads: the prefix of every set that will be added, in that order. Linked sets share a token of their prefixes, so a set
    enters at the root's branches that hold such sets, not at all of them.
    """

    def __init__(self, per_cent: int, heads: list[np.ndarray]):
        self.t = per_cent
        self.nodes: list[list] = [[np.zeros(0, np.int64), {}, [], 1 << 60, 0, 0, -1, False]]
        self.members: dict[int, list[int]] = {}
        self.sets: list[np.ndarray] = []
        self.edges: list[tuple[int, int]] = []
        self.label, self.n, self.branch = (np.zeros(len(heads), np.int64) for _ in range(3))
        tokens, of = np.concatenate([*heads, np.zeros(0, np.int64)]), np.repeat(np.arange(len(heads)), [len(x) for x in heads])
        order = np.argsort(tokens, kind="stable")
        # holders[at[t] : at[t] + stored[t]]: the sets stored so far whose prefix holds token t
        self.heads, self.holders, self.at = heads, of[order], np.searchsorted(tokens[order], np.arange(tokens.max(initial=-1) + 1))
        self.stored = np.zeros(len(self.at), np.int64)

    # a node: 0 its run of tokens, 1 children, 2 sets that end here, 3 and 4 least and most size of sets below,
    # 5 most tokens below it, 6 a set below, 7 whether sets below have several labels

    def need(self, a: int, b: int) -> int:
        return -(-self.t * (a + b) // (100 + self.t))

    def join(self, a: int, b: int) -> None:
        x, y = self.label[a], self.label[b]
        if x != y:
            self.edges.append((a, b))
            if len(self.members[x]) < len(self.members[y]):
                x, y = y, x
            move = self.members.pop(y)
            self.label[move] = x
            self.members[x] += move

    def _entries(self, me: int, mark: np.ndarray) -> list[int]:
        """The root's branches with sets that share a token of the prefix, aren't joined with this one and can reach the needed overlap."""
        head, n, nodes = self.heads[me], int(self.n[me]), self.nodes
        near = [self.holders[a : a + k] for a, k in zip(self.at[head].tolist(), self.stored[head].tolist(), strict=True) if k]
        if not near:
            return []
        some = np.concatenate(near)
        size = self.n[some]
        some = some[(self.label[some] != self.label[me]) & (size * self.t <= 100 * n) & (n * self.t <= 100 * size)]
        branches, out = np.unique(self.branch[some]).tolist(), []
        for lo in range(0, len(branches), 4096):
            part = branches[lo : lo + 4096]
            runs = [nodes[c][0] for c in part]
            length, least, below = (np.array(x) for x in ([len(x) for x in runs], [nodes[c][3] for c in part], [nodes[c][5] for c in part]))
            got = np.add.reduceat(mark[np.concatenate(runs)], np.cumsum(length) - length, dtype=np.int64)
            can = got + below >= -(-self.t * (n + least) // (100 + self.t))
            out += [c for c, x in zip(part, can.tolist(), strict=True) if x]
        return out

    def add(self, tokens: np.ndarray, n: int, mark: np.ndarray) -> None:
        """Links the set with those that are stored, then stores it. mark: zeros, as many as tokens in all."""
        me = len(self.sets)
        self.label[me], self.n[me] = me, n
        self.members[me] = [me]
        mark[tokens] = 1
        for o in [own[0] for own in islice(self.members.values(), 8)]:  # the trie finds the rest
            if self.label[o] != self.label[me] and int(mark[self.sets[o]].sum()) >= self.need(n, self.n[o]):
                self.join(me, o)
        todo = [(c, 0) for c in self._entries(me, mark)]
        nodes = self.nodes
        while todo:
            at, got = todo.pop()
            run, children, ends, least, most, below, some, mixed = nodes[at]
            if not mixed and self.label[some] == self.label[me]:
                continue
            if len(run):
                got += int(mark[run].sum())
            far = min(below, len(tokens) - got, len(tokens) - int(np.searchsorted(tokens, run[-1], "right")) if len(run) else len(tokens))
            if got + far < self.need(n, least) or least * self.t > 100 * n or n * self.t > 100 * most:
                continue
            for o in ends:
                if self.label[o] != self.label[me] and got >= self.need(n, self.n[o]):
                    self.join(me, o)
            if len(children) > 64:
                kids = np.fromiter(children.values(), np.int64, len(children))
                some = np.fromiter((nodes[c][6] for c in kids), np.int64, len(kids))
                many = np.fromiter((nodes[c][7] for c in kids), bool, len(kids))
                todo += [(int(c), got) for c in kids[many | (self.label[some] != self.label[me])]]
            else:
                todo += [(c, got) for c in children.values()]
        mark[tokens] = 0
        self.sets.append(tokens)
        self._store(me, tokens, n)
        self.branch[me] = self.nodes[0][1][int(tokens[0])]
        self.stored[self.heads[me]] += 1

    def _store(self, me: int, tokens: np.ndarray, n: int) -> None:
        nodes, at, pos = self.nodes, 0, 0
        while True:
            node = nodes[at]
            run = node[0]
            same = min(len(run), len(tokens) - pos)
            differ = np.flatnonzero(run[:same] != tokens[pos : pos + same])
            k = int(differ[0]) if len(differ) else same
            if k < len(run):  # split the run
                nodes.append([run[k:], node[1], node[2], node[3], node[4], node[5], node[6], node[7]])
                node[0], node[1], node[2], node[5] = run[:k], {int(run[k]): len(nodes) - 1}, [], node[5] + len(run) - k
            pos += k
            node[3], node[4], node[5] = min(node[3], n), max(node[4], n), max(node[5], len(tokens) - pos)
            if node[6] < 0:
                node[6] = me
            elif self.label[node[6]] != self.label[me]:
                node[7] = True
            if pos == len(tokens):
                node[2].append(me)
                return
            child = node[1].get(int(tokens[pos]))
            if child is None:
                nodes.append([tokens[pos:], {}, [me], n, n, 0, me, False])
                node[1][int(tokens[pos])] = len(nodes) - 1
                return
            at = child


def trie_edges(rows: list[tuple[int, int, bytes, bytes]], per_cent: int) -> list[tuple[int, int]]:
    """Links (cls, cls) that join all sets of the rows (cls, n, hashes, counts) that any links join."""
    rows = sorted({r[0]: r for r in rows}.values(), key=lambda r: (r[1], r[0]))
    h = np.concatenate([np.frombuffer(r[2], "<u8") for r in rows])
    k = np.concatenate([np.frombuffer(r[3], np.int32) for r in rows])
    u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    rank = np.empty(len(u), np.int64)
    rank[np.lexsort((u, k[first]))] = np.arange(len(u))
    ranks, mark = rank[inverse], np.zeros(len(u), np.uint8)
    cuts = np.cumsum([len(r[2]) // 8 for r in rows])[:-1]
    sets = [np.sort(x) for x in np.split(ranks, cuts)]
    trie = Trie(per_cent, [x[: prefix_length(r[1], per_cent) - (r[1] - len(x))] for x, r in zip(sets, rows, strict=True)])
    for x, r in zip(sets, rows, strict=True):
        trie.add(x, r[1], mark)
    return [(rows[a][0], rows[b][0]) for a, b in trie.edges]


def _edges_of(groups: DataFrame, per_cent: int) -> DataFrame:
    """groups: (g, cls, n, h, k), each g small; its rows meet in one task, one g after the other."""

    def run(batches):
        def out(rows):
            e = trie_edges(rows, per_cent) if len(rows) > 1 else []
            return [pa.RecordBatch.from_arrays([pa.array([x[0] for x in e]), pa.array([x[1] for x in e])], ["a", "b"])] if e else []

        g, rows = None, []
        for b in batches:
            cols = [b.column(x).to_pylist() for x in range(5)]
            for x, *row in zip(*cols, strict=True):
                if x != g:
                    yield from out(rows)
                    g, rows = x, []
                rows.append(tuple(row))
        yield from out(rows)

    return groups.select("g", "cls", "n", "h", "k").repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, per_cent: int = 75) -> DataFrame:
    """One row per document: id, n_shingles, cls, component_id.

    component_id is the least id reachable by links (itself if none); two documents link when
    100 * |A and B| >= per_cent * |A or B| over their sets of n-word shingles (A-Z lower-cased,
    words without ASCII white space, fewer words than n: all of them as one). Null and wordless
    texts have empty sets, no links and their own id. A binary text_col holds sets already, as 64-bit hashes (n has no meaning then). Rows of a null id take part and get the
    least id of their component, or null. Repeated rows and ties share a component. Other
    columns are ignored, whatever their names. An empty table gives an empty table.
    """
    light = written(classes(docs, id_col, text_col, n), "classes")
    total = light.agg(F.sum("n_shingles")).first()[0] or 0
    n_buckets = max(1, -(-total // BUCKET))
    sets = written(ordered_sets(shared_shingles(docs, text_col, n, n_buckets), per_cent, n_buckets), "sets")

    posts = sets.select("cls", F.explode("prefix").alias("token"))
    lead = posts.groupBy("token").agg(F.min("cls").alias("lead"), F.max("cls").alias("most")).where("lead < most").select("token", "lead")
    near = components(posts.join(lead, "token").select(F.col("lead").alias("a"), F.col("cls").alias("b")), "candidates")
    near = written(near.join(sets.groupBy("cls").agg(F.max("m").alias("m")), near.node == F.col("cls")).select("cls", "component", "m"), "near")
    size = near.groupBy("component").agg(F.sum("m").alias("size"))
    small = near.join(size.where(F.col("size") <= TRIE), "component").select(F.col("component").alias("g"), "cls")
    links = written(_edges_of(small.join(sets, "cls"), per_cent), "links")

    big = written(near.join(size.where(F.col("size") > TRIE), "component").select("component", "cls", (F.pmod(F.xxhash64("cls"), F.ceil(2 * F.col("size") / TRIE) + 1)).alias("block"), (F.ceil(2 * F.col("size") / TRIE) + 1).alias("n_blocks")), "big")
    if big.limit(1).count():
        least = big.select("component", F.col("component").alias("lead"), "block").distinct()
        own = big.select(F.xxhash64("component", "block").alias("g"), "cls").union(least.select(F.xxhash64("component", "block").alias("g"), F.col("lead").alias("cls"))).distinct()
        links = written(links.union(_edges_of(own.join(sets, "cls"), per_cent)), "links")
        label = components(links, "blocks")
        big = big.join(label.withColumnRenamed("node", "cls").withColumnRenamed("component", "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        apart = big.groupBy("component").agg(F.countDistinct("label").alias("labels")).where("labels > 1").select("component")
        pairs = big.join(apart, "component").withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int")))).where("other <> block")
        pairs = pairs.select(F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("g"), "cls")
        links = written(links.union(_edges_of(pairs.join(sets, "cls"), per_cent)), "links")

    of = components(links).select(F.col("node").alias("cls"), F.col("component").alias("label"))
    least = light.where("cls is not null").groupBy("cls").agg(F.min("id").alias("least")).join(of, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    one = least.groupBy("label").agg(F.min("least").alias("component_id"))
    back = least.join(one, "label").select("cls", "component_id")
    return light.join(back, "cls", "left").select("id", "n_shingles", "cls", F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of 5-word shingles and its component at Jaccard 0.75."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_components(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
