"""Scores of texts by a class-based bigram model (Brown et al., 1992).

Exchange clustering gives every word of the training corpus a class. An exact sequential exchange
seeds the classes with the most frequent words; then frequent words (a bounded number, the broadcast)
move in parallel rounds, half of them at a time, to the class that raises the likelihood most against
the class counts of the round, their own counts left out; last, all other words choose in the same way,
in a shuffle by word. The number of classes is the cube root of the vocabulary, so that it grows with
the corpus. What conditions the next word is the class of a frequent word, and for other words their last
two bytes (one of SHAPES), which needs no look-up. An unseen word belongs to the class in which most
words of its shape are.

A text's log probability is the sum of class-transition and word-emission log probabilities, both with
added-one smoothing. Counts and classes of all words stay in a table; words that are not in the broadcast are
looked up by a shuffle join, which no frequent word can skew.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import written
from .words import Words, blocks, mix

#: Words of the broadcast, words that the sequential exchange seeds, shapes, rounds of parallel exchange.
HOT, SEEDS, SHAPES, ROUNDS = 60_000, 600, 64, 4
END = 0  # the hash that stands for the end of a text
ALPHA = 0.5  # added to class counts while words choose


def tokens(texts: pa.Array):
    """(first row, rows, token hashes, shapes, bounds): words and an end for every row of a block."""
    for lo, hi in blocks(texts):
        w = Words(texts.slice(lo, hi - lo))
        h = w.hashes()
        h = np.where(h == END, np.uint64(1), h)
        last = w.data[w.ends - 1].astype(np.uint64) if len(h) else np.zeros(0, np.uint64)
        prior = np.where(w.ends - w.starts > 1, w.data[np.maximum(w.ends - 2, 0)], 0).astype(np.uint64) if len(h) else last
        shape = (mix(last * np.uint64(256) + prior + np.uint64(1)) % np.uint64(SHAPES)).astype(np.int64)
        at = w.first[1:]
        h, shape = np.insert(h, at, np.uint64(END)), np.insert(shape, at, SHAPES)
        bounds = w.first + np.arange(len(w.first))
        yield lo, np.repeat(np.arange(hi - lo), np.diff(bounds)), h.view(np.int64), shape, bounds


def slim(x: np.ndarray) -> bytes:
    """64-bit numbers by their bytes, the lowest of all first, up to the highest that any needs: shuffles store and compress this in a fraction of their size."""
    raw = np.ascontiguousarray(x, "<i8").view("<u8")
    width = -(-int(raw.max()).bit_length() // 8) or 1 if len(raw) else 1
    return bytes([width]) + raw.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def wide(x: bytes) -> np.ndarray:
    """The numbers of slim()."""
    width, raw = x[0], np.frombuffer(x, np.uint8, offset=1)
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(width, -1).T
    return out.view("<i8")[:, 0]


def steps_of(x: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers, from 0 on and modulo 2 ** 64; their running sums are the numbers."""
    return np.diff(x.view(np.uint64), prepend=np.uint64(0)).view(np.int64)


def dealt(bucket: np.ndarray, *columns: np.ndarray):
    """Rows (bucket, one binary of each column, slim): what is bound for one task is one row, so that the shuffle moves few rows. The first column is sorted, and sent as steps."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
    ends = np.r_[cuts[1:], len(bucket)]
    names = ["bucket", *"abc"[: len(columns)]]
    for lo in range(0, len(cuts), 64):
        part = list(zip(cuts[lo : lo + 64], ends[lo : lo + 64], strict=False))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[lo : lo + 64]].astype(np.int32)), *(pa.array([slim(c[x:y] if k else steps_of(c[x:y])) for x, y in part], pa.binary()) for k, c in enumerate(columns))], names)


def received(*columns) -> list[np.ndarray]:
    """The columns of a row of dealt()."""
    first, *rest = map(wide, columns)
    return [np.cumsum(first), *rest]


class Sums:
    """Counts by 64-bit key, merged when many are held, and given out, dealt by bucket_of(keys), when too many are different."""

    def __init__(self, bucket_of, most: int = 3_000_000):
        self.bucket_of, self.most, self.held, self.size = bucket_of, most, [], 0

    def _merged(self):
        keys = np.concatenate([x[0] for x in self.held])
        u, inverse = np.unique(keys, return_inverse=True)
        return u, np.bincount(inverse, np.concatenate([x[1] for x in self.held]), len(u)).astype(np.int64)

    def add(self, keys: np.ndarray, n: np.ndarray | None = None):
        if n is None:
            keys, n = np.unique(keys, return_counts=True)
        self.held.append((keys, n.astype(np.int64)))
        self.size += len(keys)
        if self.size > self.most:
            one = self._merged()
            self.held, self.size = ([], 0) if len(one[0]) > self.most // 3 else ([one], len(one[0]))
            if not self.held:
                yield from dealt(self.bucket_of(one[0]), *one)

    def rest(self):
        if self.held:
            one = self._merged()
            yield from dealt(self.bucket_of(one[0]), *one)


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, shape, n) of all tokens."""

    def run(batches):
        held, size = [], 0

        def out():
            h, s = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            n = np.concatenate([x[2] for x in held])
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return u, s[first], np.bincount(inverse, n).astype(np.int64)

        def rows(x):
            for lo in range(0, len(x[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000]) for c in x], ["word", "shape", "n"])

        for b in batches:
            for _, _, h, shape, _ in tokens(b.column(0)):
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                held.append((u, shape[first], n.astype(np.int64)))
                size += len(u)
                if size > 3_000_000:
                    one = out()
                    held, size = ([], 0) if len(one[0]) > 1_000_000 else ([one], len(one[0]))
                    if not held:
                        yield from rows(one)
        if held:
            yield from rows(out())

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word long, shape long, n long").groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


def numbers_of(h: np.ndarray, shape: np.ndarray, words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A frequent word's number, len(words) + shape of another word, len(words) + SHAPES for the end."""
    if not len(words):
        return shape
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where((words[at] == h) & (shape < SHAPES), order[at], len(words) + shape)


def encoded(train: DataFrame, text_col: str, words: np.ndarray) -> DataFrame:
    """(ids): numbers of the tokens of a block of texts, 16 bits each, so that no round hashes words again."""
    order = np.argsort(words)
    sent = train.sparkSession.sparkContext.broadcast((words[order], order))

    def run(batches):
        for b in batches:
            for _, _, h, shape, _ in tokens(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([numbers_of(h, shape, *sent.value).astype("<u2").tobytes()], pa.binary())], ["ids"])

    return train.select(F.col(text_col).cast("string")).mapInArrow(run, "ids binary")


def _before(s: np.ndarray, start: int) -> np.ndarray:
    out = np.empty_like(s)
    out[1:], out[:1] = s[:-1], start
    return out


def pair_counts(ids: DataFrame, symbol: np.ndarray, size: int) -> np.ndarray:
    """Counts [size, size] of neighbours, symbol giving each number's symbol, the last of which is the end (which starts every text too)."""
    sent = ids.sparkSession.sparkContext.broadcast(symbol)

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for b in batches:
            for blob in b.column(0):
                s = sent.value[np.frombuffer(blob.as_py(), "<u2")]
                total += np.bincount(_before(s, size - 1) * size + s, minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    return _matrix(ids.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), size, size)


def _matrix(rows: DataFrame, n: int, m: int) -> np.ndarray:
    """rows (pair, n), at most n * m of them, as a matrix."""
    got, out = rows.toPandas(), np.zeros(n * m)
    out[got["pair"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out.reshape(n, m)


def _xlogx(x):
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, n_words: int, n_classes: int, rounds: int = 3) -> np.ndarray:
    """Class of each symbol: words move, one after the other, to the class that gains most likelihood.

    The first n_words symbols move among n_classes classes; each other symbol is its own class.
    """
    size = len(pairs)
    n_classes = max(1, min(n_classes, n_words)) if n_words else 0
    of = np.r_[np.arange(n_words) % max(n_classes, 1), n_classes + np.arange(size - n_words)].astype(np.int64)
    m = n_classes + size - n_words
    by_row = np.zeros((m, size), float)
    np.add.at(by_row, of, pairs)
    n = np.zeros((m, m))
    np.add.at(n.T, of, by_row.T)
    for _ in range(rounds):
        moved = 0
        for w in range(n_words):
            to = np.bincount(of, pairs[w], m)
            back = np.bincount(of, pairs[:, w], m)
            self_n, old = float(pairs[w, w]), of[w]
            to[old] -= self_n
            back[old] -= self_n  # pairs with itself apart
            n[old] -= to
            n[:, old] -= back
            n[old, old] -= self_n
            c = np.arange(n_classes)
            row = _xlogx(n[:n_classes] + to) - _xlogx(n[:n_classes])
            col = _xlogx(n[:, :n_classes] + back[:, None]) - _xlogx(n[:, :n_classes])
            diag = n[c, c]
            gain = row.sum(1) - row[c, c] + col.sum(0) - col[c, c] + _xlogx(diag + to[c] + back[c] + self_n) - _xlogx(diag)
            out, inn = n.sum(1)[:n_classes], n.sum(0)[:n_classes]
            gain -= _xlogx(out + to.sum() + self_n) - _xlogx(out) + _xlogx(inn + back.sum() + self_n) - _xlogx(inn)
            new = int(gain.argmax())
            n[new] += to
            n[:, new] += back
            n[new, new] += self_n
            of[w] = new
            moved += new != old
        if not moved:
            break
    return of


def n_classes_of(vocabulary: int) -> int:
    """The cube root of the number of words, 2 at least: transitions then number its power of two thirds."""
    return max(2, int(np.ceil(vocabulary ** (1 / 3))))


def best_class(left: np.ndarray, right: np.ndarray | None, own: np.ndarray, counts: np.ndarray, n_classes: int) -> np.ndarray:
    """The class that gains most likelihood by each word, from counts of symbols before (left) and after (right) it.

    counts: neighbours by symbol, its first n_classes rows and columns being classes. own: the word's class, whose counts
    are taken without it, or -1. Ties go to the least class.
    """
    m = len(counts)
    into, out = counts[:, :n_classes], counts[:n_classes]

    def logs(x, total):
        return np.log((np.maximum(x, 0) + ALPHA) / (np.maximum(total, 0) + ALPHA * m))

    score = left @ logs(into, into.sum(0))
    if right is not None:
        score += right @ logs(out, out.sum(1, keepdims=True)).T
    at = np.flatnonzero(own >= 0)
    if len(at):
        c = own[at]
        x = left[at]
        mine = (x * logs(into.T[c] - x, (into.sum(0)[c] - x.sum(1))[:, None])).sum(1)
        if right is not None:
            x = right[at]
            mine += (x * logs(out[c] - x, (out.sum(1)[c] - x.sum(1))[:, None])).sum(1)
        score[at, c] = mine
    return score.argmax(1)


def summed(w: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by word and symbol, in this order."""
    order = np.lexsort((s, w))
    w, s, n = w[order], s[order], n[order]
    at = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (s[1:] != s[:-1])]) if len(w) else np.zeros(0, int)
    return w[at], s[at], np.add.reduceat(n, at) if len(w) else n


def best_left(place: np.ndarray, s: np.ndarray, n: np.ndarray, n_words: int, counts: np.ndarray, n_classes: int) -> np.ndarray:
    """best_class of words that have no class yet by the symbols s before them, n times; place: the word's number, in order."""
    into = counts[:, :n_classes]
    gain = np.log((into + ALPHA) / (into.sum(0) + ALPHA * len(counts)))
    score = np.add.reduceat(gain[s] * n[:, None], np.flatnonzero(np.r_[True, place[1:] != place[:-1]]), axis=0) if len(s) else np.zeros((0, n_classes))
    return score.argmax(1)


def _round(ids: DataFrame, symbol: np.ndarray, of: np.ndarray, n_hot: int, n_classes: int) -> np.ndarray:
    """Classes that the frequent words choose against the counts of one pass over the corpus."""
    size, spark, buckets = n_classes + SHAPES + 1, ids.sparkSession, -(-n_hot // 1000)
    sent = spark.sparkContext.broadcast((symbol, pair_counts(ids, symbol, size), of))

    def bucket_of(keys):
        return keys // size % n_hot % buckets

    def count(batches):
        sums, symbol = Sums(bucket_of), sent.value[0]
        for b in batches:
            for blob in b.column(0):
                i = np.frombuffer(blob.as_py(), "<u2").astype(np.int64)
                s = symbol[i]
                here = np.flatnonzero(i < n_hot)  # the last token is an end, so each has one after it
                yield from sums.add(np.concatenate([i[here] * size + _before(s, size - 1)[here], (n_hot + i[here]) * size + s[np.minimum(here + 1, len(s) - 1)]]))
        yield from sums.rest()

    def merge(batches):
        sums = Sums(bucket_of)
        for b in batches:
            for keys, n in zip(b.column(1), b.column(2), strict=True):
                yield from sums.add(*received(keys.as_py(), n.as_py()))
        yield from sums.rest()

    def choose(batches):
        _, counts, of = sent.value
        rows: dict[int, np.ndarray] = {}  # counts of each word of the bucket, before and after it
        for b in batches:
            for bucket, keys, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                word = np.arange(bucket, n_hot, buckets)
                held = rows.setdefault(bucket, np.zeros((len(word), 2 * size)))
                key, n = received(keys.as_py(), n.as_py())
                at = (key // size % n_hot) // buckets * 2 * size + key % size + np.where(key >= n_hot * size, size, 0)
                held += np.bincount(at, n, held.size).reshape(held.shape)
        for bucket, held in rows.items():
            word = np.arange(bucket, n_hot, buckets)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(best_class(held[:, :size], held[:, size:], of[word], counts, n_classes))], ["w", "c"])

    found = ids.mapInArrow(count, "bucket int, a binary, b binary")
    parts = ids.rdd.getNumPartitions()
    if parts > 256:  # some tasks' counts of a bucket are added up first, so that no task reads those of all
        found = found.withColumn("salt", F.spark_partition_id() % (parts // 64)).repartition("bucket", "salt").drop("salt").mapInArrow(merge, "bucket int, a binary, b binary")
    got = found.repartition(buckets, "bucket").mapInArrow(choose, "w long, c long").toPandas()  # a row for each frequent word
    new = of.copy()
    new[got["w"].to_numpy(np.int64)] = got["c"].to_numpy(np.int64)
    return new


@dataclass
class Model:
    """words: (word, n, cls) of all words but the broadcast ones; hot: hashes, counts and classes of those.

    step [symbol, class]: log10 of a class (the last: the end) after a symbol (classes, shapes, start); under: log10 of each
    class's denominator of emissions; by_shape: class of unseen words; n_tokens, n_kinds, n_ends: of the training corpus.
    """

    words: DataFrame
    hot: tuple[np.ndarray, np.ndarray, np.ndarray]
    step: np.ndarray
    under: np.ndarray
    by_shape: np.ndarray
    n_classes: int
    n_tokens: int
    n_kinds: int
    n_ends: int


def learn(train: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> Model:
    """The class model of a corpus. rounds=0 deals words to classes by hash instead, to compare with."""
    spark = train.sparkSession
    counts = written(word_counts(train, text_col), "counts")
    n_all, kinds, n_ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0))).first()
    c = n_classes_of(kinds)
    top = counts.where(F.col("word") != END).orderBy(F.desc("n"), "word").limit(HOT).toPandas()
    words, n_of, shapes = (top[x].to_numpy(np.int64) for x in ("word", "n", "shape"))
    ids, h = written(encoded(train, text_col, words), "encoded"), len(words)
    tail = np.arange(SHAPES + 1)
    of = (mix(words.view(np.uint64)) % np.uint64(c)).astype(np.int64)
    if rounds:
        seeds = min(SEEDS, h)
        first = np.r_[np.arange(seeds), seeds + shapes[seeds:], seeds + tail].astype(np.int64)
        of = np.full(h, -1)
        of[:seeds] = exchange(pair_counts(ids, first, seeds + SHAPES + 1), seeds, c)[:seeds]
        for r in range(rounds):
            symbol = np.r_[np.where(of >= 0, of, c + shapes), c + tail].astype(np.int64)
            new = _round(ids, symbol, of, h, c) if h else of
            turn = (of < 0) | ((np.arange(h) + r) % 2 == 0)
            of = np.where(turn, new, of)
    symbol, size = np.r_[of, c + tail].astype(np.int64), c + SHAPES + 1
    pairs = pair_counts(ids, symbol, size)
    sent = spark.sparkContext.broadcast((np.sort(words), np.argsort(words), symbol, pairs))

    # all other words: (word, symbol before and shape) pairs, dealt by word to tasks of some million
    n_words = counts.where(F.col("word") != END).agg(F.sum("n")).first()[0] or 0
    n_buckets = max(1, -(-(n_words - int(n_of.sum())) // 3_000_000))

    def cold(batches):
        keys, order, symbol, _ = sent.value
        held, total = [], 0

        def out():
            w, s, n = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return dealt((mix(w.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64), w, s, n)

        for b in batches:
            for _, _, hashes, shape, _ in tokens(b.column(0)):
                i = numbers_of(hashes, shape, keys, order)
                at = np.flatnonzero((i >= len(keys)) & (shape < SHAPES))
                held.append(summed(hashes[at], (_before(symbol[i], size - 1)[at] * SHAPES + shape[at]).astype(np.int32), np.ones(len(at), np.int64)))
                total += len(at)
                if total > 1_000_000:
                    yield from out()
                    held, total = [], 0
        if held:
            yield from out()

    def choose(batches):
        pairs, into, got = sent.value[3], np.zeros(size * c, np.int64), {}
        for b in batches:
            for bucket, *x in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                got.setdefault(bucket, []).append(received(*x))
        for parts in got.values():
            w, s, n = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            starts = np.r_[np.flatnonzero(np.r_[True, w[1:] != w[:-1]]), len(w)] if len(w) else np.zeros(1, int)
            for lo in range(0, len(starts) - 1, 20_000):
                some = starts[lo : lo + 20_001]
                x = slice(some[0], some[-1])
                word, place = w[some[:-1]], np.repeat(np.arange(len(some) - 1), np.diff(some))
                cls = best_left(place, s[x] // SHAPES, n[x], len(word), pairs, c) if rounds else (mix(word.view(np.uint64)) % np.uint64(c)).astype(np.int64)
                into += np.bincount(s[x] // SHAPES * c + cls[place], n[x], size * c).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(word), np.int32)), pa.array(word), pa.array(np.add.reduceat(n[x], some[:-1] - some[0])), pa.array(cls.astype(np.int32)), pa.array((s[some[:-1]] % SHAPES).astype(np.int32))], ["kind", "word", "n", "cls", "shape"])
        at = np.flatnonzero(into)
        zero = np.zeros(len(at), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(zero + 1), pa.array(at), pa.array(into[at]), pa.array(zero), pa.array(zero)], ["kind", "word", "n", "cls", "shape"])

    neighbours = train.select(F.col(text_col).cast("string")).mapInArrow(cold, "bucket int, a binary, b binary, c binary")
    chosen = written(neighbours.repartition(n_buckets, "bucket").mapInArrow(choose, "kind int, word long, n long, cls int, shape int"), "classes")
    into = _matrix(chosen.where("kind = 1").groupBy(F.col("word").alias("pair")).agg(F.sum("n").alias("n")), size, c)
    rest = chosen.where("kind = 0").select("word", "n", "cls")
    of_shape = np.zeros((SHAPES, c))
    np.add.at(of_shape, (shapes, of), 1)
    for r in chosen.where("kind = 0").groupBy("shape", "cls").count().collect():  # at most shapes by classes
        of_shape[r["shape"], r["cls"]] += r["count"]
    n = np.c_[pairs[:, :c] + into, pairs[:, -1]]
    step = np.log10((n + 1) / (n.sum(1, keepdims=True) + c + 1))
    distinct = of_shape.sum(0)
    under = np.log10(n[:, :c].sum(0) + distinct + 1)
    by_shape = np.where(of_shape.sum(1) > 0, of_shape.argmax(1), distinct.argmax())
    return Model(rest, (words, n_of, of), step, under, by_shape, c, int(n_all), int(kinds), int(n_ends))


def score(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens: words (A-Z lower-cased) and one end; null and wordless texts have only the end.
    base_score is the add-one unigram log10 probability, score the class model's. With an empty
    training table every count is 0: base_score is then 0 (log10 of 1/1 for each token).
    Ids may be null or repeated; other columns are ignored.
    """
    return scored(docs, learn(train, text_col, rounds), id_col, text_col)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score() by a model that is learned already."""
    spark, c = docs.sparkSession, model.n_classes
    order = np.argsort(model.hot[0])
    sent = spark.sparkContext.broadcast((model.hot[0][order], order, model.hot[1], model.hot[2], model.step, model.under))
    base_under, end_log, n_ends = float(np.log10(model.n_tokens + model.n_kinds + 1)), float(np.log10(model.n_ends + 1)), model.n_ends
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("uid", LongType()), StructField("n_tokens", LongType()), StructField("known", LongType()), StructField("base", DoubleType()), StructField("class", DoubleType()), StructField("rare", ArrayType(LongType())), StructField("after", ArrayType(IntegerType()))])

    def run(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        keys, order, hot_n, of, step, under = sent.value
        log_n = np.log10(hot_n + 1.0)
        symbol = np.r_[of, c + np.arange(SHAPES + 1)].astype(np.int64)
        for b in batches:
            for lo, rows, h, shape, bounds in tokens(b.column(1)):
                k = len(bounds) - 1
                i = numbers_of(h, shape, keys, order)
                before = _before(symbol[i], c + SHAPES)
                hot, end = np.flatnonzero(i < len(keys)), shape == SHAPES
                base, cls = np.full(len(h), -base_under), np.zeros(len(h))
                base[hot] += log_n[i[hot]]
                cls[hot] = step[before[hot], of[i[hot]]] + log_n[i[hot]] - under[of[i[hot]]]
                base[end] += end_log
                cls[end] = step[before[end], c]
                seen = np.zeros(len(h), bool)
                seen[hot], seen[end] = True, n_ends > 0
                rare = (i >= len(keys)) & ~end
                at = np.concatenate([[0], np.cumsum(np.bincount(rows[rare], minlength=k))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (h[rare], (before[rare] * SHAPES + shape[rare]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, k), pa.array(uid + np.arange(k)), pa.array(np.diff(bounds)), pa.array(np.bincount(rows, seen, k).astype(np.int64)), pa.array(np.bincount(rows, base, k)), pa.array(np.bincount(rows, cls, k)), *lists], schema.names)
                uid += k

    first = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema), "scores")
    rare = first.select("uid", F.explode(F.arrays_zip("rare", "after")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.after").alias("after"))
    found = rare.join(model.words, "word", "left")
    shape_class = F.array(*[F.lit(int(x)) for x in model.by_shape])
    found = found.select("uid", "n", F.coalesce("cls", F.get(shape_class, F.col("after") % SHAPES)).alias("cls"), F.floor(F.col("after") / SHAPES).cast("int").alias("s"))
    s, k = np.divmod(np.arange((c + SHAPES + 1) * c), c)
    chances = spark.createDataFrame(pa.table({"s": pa.array(s, pa.int32()), "cls": pa.array(k, pa.int32()), "p": model.step[:, :c].ravel() - np.tile(model.under, c + SHAPES + 1)}))
    log_n = F.log10(F.coalesce("n", F.lit(0)) + 1)  # as many chances as symbols by classes
    more = found.join(F.broadcast(chances), ["s", "cls"]).groupBy("uid").agg(F.count("n").alias("more"), F.sum(log_n).alias("log"), F.sum(log_n + F.col("p")).alias("chance"))
    one = first.drop("rare", "after").join(more, "uid", "left").na.fill({"more": 0, "log": 0.0, "chance": 0.0})
    return one.select("id", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"), (F.col("base") + F.col("log")).alias("base_score"), (F.col("class") + F.col("chance")).alias("score"))


def op9_lm(spark, sf_dir: str) -> DataFrame:
    """Base and class-model scores of every document, learned from those of crc32(doc_id) mod 7 other than 2."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, docs.where(F.coalesce(fold != 2, F.lit(True))))
    return out.withColumnRenamed("id", "doc_id").select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
