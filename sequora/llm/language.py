"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. For each language, expectation
maximisation over a bounded labelled sample gives every piece a probability; a text's score
is the sum, over all ways to cut it into pieces, of the product of their probabilities
(forward algorithm). Pieces don't cross words, so a text's sum is a product over its words,
and each distinct word is summed once per worker, all words of one length together.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import give_back, kept_by

#: Runs of letters: \\w less digits, the underscore and numbers that are no letters (such as superscripts and fractions).
LETTERS = re.compile(rf"[^\W\d_{''.join(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())}]+")
WORDS = re.compile(r"[^\W\d_]+")  # ten times as fast, and right for words of letters only
#: Probability of a letter that is no piece; words kept by a worker; letters after which sums are scaled; rows given out at once.
FLOOR, KEPT, SCALED, ROWS = 1e-7, 150_000, 16, 1000
_B = np.uint64(0x9E3779B97F4A7C15)


def letter_words(text: str) -> list[str]:
    """The text's runs of letters, in lower case."""
    words = WORDS.findall(text.lower())
    return words if all(map(str.isalpha, words)) else [x for w in words for x in LETTERS.findall(w)]


def vocabulary(path: str) -> list[str]:
    """All pieces of a sentencepiece model that can stand in a lower-case word of letters, however long; a leading mark stands for a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p == p.lower() and p.replace("▁", "", 1 if p[0] == "▁" else 0).isalpha() or p == "▁"})


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Pieces:
    """Finds the pieces that end at each place of words of equal length."""

    def __init__(self, pieces: list[str]):
        h = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            x = 0
            for c in p:
                x = (x * int(_B) + ord(c) + 1) % 2**64
            h[i] = x
        h = _mix(h)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.none = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.sizes = sorted({len(p) for p in pieces} | {1})
        self.power = np.array([pow(int(_B), k, 2**64) for k in range(self.longest + 1)], np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint64(44)] = True

    def ids(self, codes: np.ndarray):
        """codes: [words, length]. Yields for each end j: [(start, words that have a piece there, its ids)]; pieces of one letter for all words, none: no piece."""
        n, length = codes.shape
        prefix, all_rows = [np.zeros(n, np.uint64)], np.arange(n)
        for j in range(length):
            prefix.append(prefix[-1] * _B + codes[:, j] + np.uint64(1))
            found = []
            for size in self.sizes:
                if size > j + 1:
                    break
                h = _mix(prefix[j + 1] - prefix[j + 1 - size] * self.power[size])
                some = np.flatnonzero(self.maybe[h >> np.uint64(44)]) if size > 1 else all_rows
                if not len(some):
                    continue
                x = h[some]
                at = np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)
                there = self.hashes[at] == x
                if size == 1:
                    found.append((j, slice(None), np.where(there, self.order[at], self.none)))
                elif there.any():
                    found.append((j + 1 - size, some[there], self.order[at[there]]))
            yield j + 1, found


def by_length(words: list[str], longest: int):
    """(indexes, code matrix) of words of one length, with the mark in front, in parts. longest: letters of the longest piece."""
    size = np.array([len(w) for w in words])
    for length in np.unique(size):
        idx = np.flatnonzero(size == length)
        step = max(1, 2_000_000 // ((length + 1) * (longest + 8)))
        for lo in range(0, len(idx), step):
            part = idx[lo : lo + step]
            codes = np.frombuffer("".join("▁" + words[i] for i in part).encode("utf-32-le"), "<u4").reshape(len(part), length + 1).astype(np.uint64)
            yield part, codes


def forward(pieces: Pieces, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """log of the sum over segmentations: [words, languages]. prob: [pieces + 1, languages], its last row 0."""
    out = np.zeros((len(words), prob.shape[1]))
    for part, codes in by_length(words, pieces.longest):
        alpha, scale = {0: np.ones((len(part), prob.shape[1]))}, np.zeros((len(part), prob.shape[1]))
        for j, found in pieces.ids(codes):
            total = np.zeros_like(scale)
            for i, rows, ids in found:
                p = prob[ids]
                if i == j - 1:
                    p = np.maximum(p, FLOOR)
                total[rows] += alpha[i][rows] * p
            alpha[j] = total
            alpha.pop(j - pieces.longest, None)
            if j % SCALED == 0:
                scale += np.log(total)
                alpha = {k: a / total for k, a in alpha.items()}
        out[part] = np.log(alpha[codes.shape[1]]) + scale
    return out


def fit(pieces: Pieces, counts: dict[str, dict[str, int]], rounds: int = 3) -> np.ndarray:
    """Probabilities [pieces + 1, languages] from word counts by language."""
    langs = sorted(counts)
    words = sorted(set().union(*counts.values()))
    weight = np.array([[counts[x].get(w, 0) for x in langs] for w in words], float)
    prob = np.full((pieces.none + 1, len(langs)), 1.0 / (pieces.none + 1))
    prob[-1] = 0
    for _ in range(rounds):
        expected = np.full(prob.shape, 0.1)
        for part, codes in by_length(words, pieces.longest):
            steps, length = list(pieces.ids(codes)), codes.shape[1]
            ones, zero = np.ones((len(part), len(langs))), np.zeros((len(part), len(langs)))
            # sums from the start and from the end, each with the log of what it was scaled by
            alpha, log_a, live, scale = [ones], [zero], {0: ones}, zero
            for j, found in steps:
                total = np.zeros_like(zero)
                for i, rows, ids in found:
                    total[rows] += live[i][rows] * (np.maximum(prob[ids], FLOOR) if i == j - 1 else prob[ids])
                live[j] = total
                live.pop(j - pieces.longest, None)
                if j % SCALED == 0:
                    scale = scale + np.log(total)
                    live = {k: x / total for k, x in live.items()}
                alpha.append(live[j])
                log_a.append(scale)
            beta, log_b, live, scale = [zero] * length + [ones], [zero] * (length + 1), {length: ones}, zero
            for j, found in reversed(steps):
                if j < length and (length - j) % SCALED == 0:
                    by = live[j]
                    scale = scale + np.log(by)
                    live = {k: x / by for k, x in live.items()}
                beta[j], log_b[j] = live[j], scale
                for i, rows, ids in found:
                    live.setdefault(i, np.zeros_like(zero))[rows] += live[j][rows] * (np.maximum(prob[ids], FLOOR) if i == j - 1 else prob[ids])
                del live[j]
            all_of = np.log(alpha[length]) + log_a[length]
            share = weight[part] * np.exp(-all_of) if length <= SCALED else None
            for j, found in steps:
                for i, rows, ids in found:
                    post = alpha[i][rows] * prob[ids] * beta[j][rows] * (weight[part][rows] * np.exp(log_a[i] + log_b[j] - all_of)[rows] if share is None else share[rows])
                    for k in range(len(langs)):
                        expected[:, k] += np.bincount(ids, post[:, k], len(expected))
        expected[-1] = 0
        prob = expected / expected.sum(0)
    return prob


def training_words(docs: DataFrame, text_col: str, lang_col: str, id_col: str, per_language: int, longest: int) -> dict[str, dict[str, int]]:
    """Word counts by language of a bounded sample: about per_language rows of each, at most longest characters in a row of a longer text."""
    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.col(id_col).alias("i")).where("t is not null and l is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    limit = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, max(1, int(2**30 * min(1, per_language / n))))])
    picked = rows.where(F.pmod(F.xxhash64("i"), F.lit(2**30)) <= limit[F.col("l")]).select("l", F.substr("t", F.pmod(F.xxhash64(F.lit(1), "i"), F.greatest(F.length("t") - longest, F.lit(0)) + 1).cast("int") + 1, F.lit(longest)).alias("t"))
    counts: dict[str, Counter] = {}
    for r in picked.toLocalIterator():
        counts.setdefault(r["l"], Counter()).update(letter_words(r["t"]))
    return {k: dict(c) for k, c in counts.items() if c}


class _Worker:
    """Scores of words seen by this Python worker."""

    def __init__(self, pieces: list[str], prob: np.ndarray):
        self.pieces, self.prob = Pieces(pieces), prob
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((0, prob.shape[1]))

    def index(self, words: list[str]) -> None:
        """Makes all words known; an over-full store is emptied first."""
        new = {w for w in words if w not in self.ids}
        if new:
            if len(self.ids) + len(new) > KEPT:
                self.ids, self.scores = {}, self.scores[:0]
                new = set(words)
            new = list(new)
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, forward(self.pieces, self.prob, new)])


def identify(docs: DataFrame, train: DataFrame, vocabulary_path: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 300, longest: int = 20_000) -> DataFrame:
    """docs with lang_pred and score added (columns of these names are replaced).

    train: labelled rows; about per_language of each language, and at most longest characters in a row of
    each, are learned from. lang_pred is the language of the greatest probability and score
    its share after the log probabilities are divided by the number of words (0 to 1). Null
    texts and texts without a letter are `und` with score 0, as is everything if nothing is
    labelled. Other languages than the learned ones can't come out. Ties go to the first name.
    Repeated rows and null ids are rows like others; an empty table gives an empty table.
    """
    import uuid

    pieces = vocabulary(vocabulary_path)
    counts = training_words(train, text_col, lang_col, id_col, per_language, longest)
    langs, key = sorted(counts), uuid.uuid4().hex
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score")])
    if not langs:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    model = docs.sparkSession.sparkContext.broadcast((pieces, fit(Pieces(pieces), counts)))
    del counts
    give_back()  # what the fit took in the driver
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # a text travels once, in its row
    at = docs.columns.index(text_col)
    schema = StructType([whole.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        kept = kept_by(f"language {key}")
        own = kept.setdefault("worker", None) or _Worker(*model.value)
        kept["worker"] = own
        for b in batches:
            sums, sizes = np.zeros((b.num_rows, len(langs))), np.zeros(b.num_rows, int)
            held, rows = [], []

            def settle(sums=sums, sizes=sizes):
                own.index([w for x in held for w in x])
                ids = own.ids
                for r, x in zip(rows, held, strict=True):
                    got = np.fromiter(map(ids.__getitem__, x), np.int64, len(x))
                    sums[r] += own.scores[got].sum(0)
                    sizes[r] += len(x)
                held.clear()
                rows.clear()

            size = 0
            for r, text in enumerate(pc.struct_field(b.column(0), at).cast(pa.string())):
                words = letter_words(text.as_py() or "")
                for lo in range(0, len(words), 200_000):
                    held.append(words[lo : lo + 200_000])
                    rows.append(r)
                    size += len(held[-1])
                    if size >= 200_000:
                        settle()
                        size = 0
            settle()
            mean = sums / np.maximum(sizes, 1)[:, None]
            share = np.exp(mean - mean.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            best = share.argmax(1)
            score = np.where(sizes > 0, share[np.arange(len(best)), best], 0.0)
            pred = pa.array([langs[k] if n else "und" for k, n in zip(best, sizes, strict=True)], pa.string())
            out = pa.RecordBatch.from_arrays([b.column(0), pred, pa.array(score)], ["row", "lang_pred", "score"])
            for lo in range(0, len(out), ROWS):
                yield out.slice(lo, ROWS)

    return whole.mapInArrow(run, schema).select("row.*", "lang_pred", "score")


def bucket(id_col: str, n: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op5_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32 of doc_id isn't divisible by 5."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    train = docs.where(bucket("doc_id", 5) != 0)
    found = identify(docs.select("doc_id", "text"), train, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.coalesce(bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
