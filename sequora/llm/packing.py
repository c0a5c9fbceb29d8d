"""Token sequences by vector best fit.

Texts become pieces of token ids. Pieces of one length are alike to the packer, so it works
on the histogram of lengths: best fit decreasing, where every group of bins of one residual
vector (tokens, documents, attention cost) is a run of sequence ids, filled by as many equal pieces
at once as fit; the group is chosen by the weighted norm of the residual vector, or its dot product with
the piece. The plan is bounded by the number of lengths, not by the corpus. A piece finds its
place from its rank among the pieces of its length: its rank in its partition plus an offset
that a small table of partition histograms gives.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import kept_by, written

#: Words whose ids a Python worker keeps (some 150 bytes each), words looked up at once, words of letters encoded in a row; a mark that ends a word and is a token of its own (İ in lower case ends in a mark).
KEPT, ONCE, ROW = 1_200_000, 100_000, 60
MARK = re.compile(r"[.,;:!?](?<=[^\W_İ].)(?=[ \t-\r]|\Z)")


def _encoder(path: str):
    known = kept_by("packing")
    if path not in known:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        one = Tokenizer.from_file(path)
        suffix, ends = getattr(one.model, "end_of_word_suffix", None), np.zeros(one.get_vocab_size(), bool)
        if suffix:
            ends[[i for t, i in one.get_vocab().items() if t.endswith(suffix)]] = True
        known[path] = (one, {}, ends)
    return known[path]


def words_of(text: str) -> list[bytes]:
    """The text's words, A-Z lower-cased, and apart from them the marks that the tokenizer cuts off from letters and digits."""
    words = MARK.sub(r" \g<0>", text).encode()
    if b"<|" not in words:  # may hold a special token's string, whose case counts
        words = words.lower()
    return words.split()


def encode_words(path: str, words: Iterable[bytes], keep: int = KEPT) -> dict[bytes, bytes]:
    """Ids (little-endian, 32 bits) of words; the tokenizer drops white space, so words don't touch."""
    tokenizer, known, ends = _encoder(path)
    words = set(words)
    new = words.difference(known)
    if not new:
        return known
    if len(known) + len(new) > keep:
        known.clear()
        new = words
    # a word of letters is one piece, which ends in an id of `ends`: many such are encoded as one text and cut there, unless some word has more pieces
    letters, alone = [], []
    for w in new:
        (letters if w.decode().lower().isalpha() else alone).append(w)
    for lo in range(0, len(letters), 80 * ROW):
        rows = [letters[at : at + ROW] for at in range(lo, min(lo + 80 * ROW, len(letters)), ROW)]
        got = tokenizer.encode_batch_fast([b" ".join(r).decode() for r in rows], add_special_tokens=False)
        for row, e in zip(rows, got, strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
            if len(cuts) == len(row):
                raw = ids.tobytes()
                known.update((w, raw[x:y]) for w, x, y in zip(row, [0, *cuts[:-1]], cuts, strict=True))
            else:
                alone += row
    for lo in range(0, len(alone), 5_000):
        part = alone[lo : lo + 5_000]
        got = tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
        known.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, got, strict=True))
    return known


def ids_of(path: str, texts: Iterable[str], keep: int = KEPT) -> Iterator[bytes]:
    """Ids of each text. Words of several texts are looked up at once, so that new ones fill rows; a long text's are in parts."""

    def out():
        known = encode_words(path, chain.from_iterable(held), keep)
        for words in held:
            yield b"".join(map(known.__getitem__, words))

    held: list[list[bytes]] = []
    n = 0
    for text in texts:
        words = words_of(text)
        if n + len(words) > ONCE:
            yield from out()
            held, n = [], 0
        if len(words) > ONCE:
            parts = (words[lo : lo + ONCE] for lo in range(0, len(words), ONCE))
            yield b"".join([b"".join(map(encode_words(path, some, keep).__getitem__, some)) for some in parts])
        else:
            held.append(words)
            n += len(words)
    yield from out()


def tokenised(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = 4096, end: int = 1, keep: int = KEPT) -> DataFrame:
    """One row per piece: id, piece, start, length, ids (binary, unsigned little-endian 32 bits), part, rank.

    A text's ids (null: none) and the end id make one piece, or pieces of exactly `most` ids
    and a rest. part and rank number the pieces of one length within a partition.
    """
    schema = StructType([StructField("id", docs.schema[id_col].dataType), *(StructField(n, t) for n, t in (("piece", IntegerType()), ("start", LongType()), ("length", LongType()), ("ids", BinaryType()), ("part", IntegerType()), ("rank", LongType())))])
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, ranks = TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
        for b in batches:
            out, held = [], 0
            for key, ids in zip(b.column(0), ids_of(tokenizer_path, (x.as_py() or "" for x in b.column(1)), keep), strict=True):
                ids += last
                for k, at in enumerate(range(0, len(ids), 4 * most)):
                    one = ids[at : at + 4 * most]
                    n = len(one) // 4
                    out.append((key.as_py(), k, at // 4, n, one, part, int(ranks[n])))
                    ranks[n] += 1
                    held += len(one)
                if held > 4_000_000:
                    yield _batch(out, b.column(0).type)
                    out, held = [], 0
            if out:
                yield _batch(out, b.column(0).type)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _batch(rows: list, kind) -> pa.RecordBatch:
    types = (kind, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["id", "piece", "start", "length", "ids", "part", "rank"])


class Groups:
    """Groups of equal bins as arrays: residuals in every dimension, first sequence id and how many."""

    def __init__(self, caps: tuple[int, ...]):
        self.caps = np.array(caps, float)
        self.room = np.zeros((16, len(caps)), np.int64)
        self.ids, self.n = np.zeros((16, 2), np.int64), 0

    def add(self, room, first: int, many: int) -> int:
        if self.n == len(self.room):
            self.room, self.ids = (np.concatenate([x, np.zeros_like(x)]) for x in (self.room, self.ids))
        self.room[self.n], self.ids[self.n] = room, (first, many)
        self.n += 1
        return self.n - 1

    def drop(self, at: int) -> None:
        self.n -= 1
        self.room[at], self.ids[at] = self.room[self.n], self.ids[self.n]

    def prune(self, least: np.ndarray) -> None:
        """Forgets bins with no room for the least piece."""
        keep = np.flatnonzero((self.room[: self.n] >= least).all(1))
        self.room[: len(keep)], self.ids[: len(keep)] = self.room[keep], self.ids[keep]
        self.n = len(keep)

    def best(self, item: np.ndarray, weights: np.ndarray, by: str) -> int:
        """The group with room in every dimension that fits best, or -1; ties go to the least sequence id."""
        room = self.room[: self.n]
        at = np.flatnonzero((room >= item).all(1))
        if not len(at):
            return -1
        if by == "dot":
            cost = -((room[at] / self.caps) @ (weights * item / self.caps))
        else:
            cost = (((room[at] - item) / self.caps) ** 2) @ weights
        return int(at[np.lexsort((self.ids[at, 0], cost))[0]])


def plan(sizes: dict[int, int], tokens: int, documents: int | None = None, cost: int | None = None, weights: tuple = (1.0, 0.01, 0.01), by: str = "norm") -> tuple[dict[int, np.ndarray], int]:
    """Runs by length, as rows (first rank, first sequence id, pieces in each, first offset), and the number of sequences.

    Of the bins with room in every dimension (tokens, documents, attention cost as length
    squared), a piece takes the one of the least weighted norm of what it leaves over, or of the greatest
    weighted dot product of residual and piece (by="dot"). Every dimension has a part in the choice, whether or not
    its capacity binds; the default of documents is a document for each token, that of cost one piece of all tokens.

    Longer pieces go first. A length leaves at most three groups of equal bins more than it found, and it
    fills a group at most once, so steps are bounded by the square of the number of lengths, whatever the number of pieces.
    """
    caps = (tokens, documents or tokens, cost or tokens * tokens)
    groups, weight = Groups(caps), np.array(weights, float)
    runs: dict[int, list] = {}
    n_bins = 0
    if sizes and (max(sizes) > tokens or max(sizes) ** 2 > caps[2]):
        raise ValueError(f"a piece of {max(sizes)} tokens fits in no sequence")
    smallest = min(sizes, default=0)
    for size in sorted(sizes, reverse=True):
        item = np.array((size, 1, size * size))
        left, rank, own = sizes[size], 0, runs.setdefault(size, [])
        groups.prune(np.array((smallest, 1, smallest * smallest)))
        while left:
            at = groups.best(item, weight, by)
            if at < 0:
                each = int((np.array(caps) // item).min())
                at = groups.add(caps, n_bins, -(-left // each))
                n_bins += -(-left // each)
            room, (first, many) = groups.room[at].copy(), groups.ids[at].tolist()
            each = int((room // item).min())
            full = min(many, left // each)
            rest = left - full * each if full < many else 0
            for bins, in_each in ((full, each), (1 if rest else 0, rest)):
                if bins:
                    own.append((rank, first, in_each, tokens - int(room[0])))
                    groups.add(room - in_each * item, first, bins)
                    first, many = first + bins, many - bins
                    rank += bins * in_each
                    left -= bins * in_each
            if many:
                groups.ids[at] = first, many
            else:
                groups.drop(at)
    return {size: np.array(own, np.int64) for size, own in runs.items()}, n_bins


def packed(pieces: DataFrame, most: int = 4096, documents: int | None = None, cost: int | None = None, **how) -> DataFrame:
    """pieces (a written table of tokenised(), any columns) with sequence_id and offset added.

    Every piece gets one place; a sequence's pieces follow each other without gaps from 0 and
    keep within every capacity. Pieces of one length are alike, so ties don't matter. An empty
    table has no sequences.
    """
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(sizes, most, documents, cost, **how)
    runs = pieces.sparkSession.sparkContext.broadcast(runs)
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")
    schema = StructType([*ranked.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for rows in np.split(order, cuts[1:]) if len(order) else []:
                run = runs.value[int(length[rows[0]])]
                at = run[np.searchsorted(run[:, 0], rank[rows], "right") - 1]
                k = rank[rows] - at[:, 0]
                seq[rows] = at[:, 1] + k // at[:, 2]
                off[rows] = at[:, 3] + k % at[:, 2] * length[rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(off)], [*b.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, keep: int = KEPT) -> DataFrame:
    """Pieces of all documents with their places; the digest stands for the ids."""
    import public_tokenizers

    pieces = tokenised(docs, public_tokenizers.path("word_bpe_49k.json"), keep=keep)
    slim = written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packed(slim, 4096, documents=4096, cost=4096 * 4096).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 4096 tokens in as few sequences as best fit needs."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
