"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule's cost and rejections are measured on a sample of what reaches the cascade. The rule of most rejections per
second comes first, then the one of most rejections per second among the documents left, and so on; a
document leaves at the first rule that rejects it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, lower_ascii, written

#: Rows of the sample on which costs and rejections are measured, on average, and timed runs of each rule (after one that is not).
SAMPLE, RUNS = 1000, 1
WHITE = " \t\n\x0b\f\r"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = "the of and to in that is it for was on with as are der die und das den ist zu nicht ein mit von le la les de des et que un une pour dans est el los las y en por con una su se del".split()


@dataclass(frozen=True)
class Rule:
    """fails: a Column over the text column that is true for documents to reject."""

    name: str
    fails: Column


def count_of(text: Column, pattern: str) -> Column:
    """Characters of the text that the class matches."""
    return F.length(F.regexp_replace(text, f"[^{pattern}]+", ""))


def words_in(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP, -1))


def default_rules(text_col: str = "text") -> list[Rule]:
    """Reject texts by symbols, word length, lines, letters, function words and variety of words.

    symbols: over 0.1 of `#*$%&|<>` a word; word_length: mean outside 2.5 to 10; repeated_lines: over 30 % equal to an
    earlier line; open_lines: under 10 % end in a mark; upper_case: over half the letters; stop_words: under 2 % of
    the words (of four languages); few_words: under one different word in 20. A text without words is rejected by
    none of them.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+"))
    chars = F.length(F.regexp_replace(t, GAP, ""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    ended = F.filter(lines, lambda x: x.rlike(r"[.!?:;,)\"'\u201d\u2026][\x20\x09-\x0D]*$"))
    upper, letters = F.length(F.regexp_replace(t, r"\P{Lu}+", "")), F.length(F.regexp_replace(t, r"\P{L}+", ""))
    words = words_in(t)
    stop = F.filter(words, lambda x: lower_ascii(x).isin(STOP_WORDS))
    return [
        Rule("symbols", 10 * count_of(t, r"#*$%&|<>") > n),
        Rule("word_length", (2 * chars < 5 * n) | (chars > 10 * n)),
        Rule("repeated_lines", 10 * (F.size(lines) - F.size(F.array_distinct(lines))) > 3 * F.size(lines)),
        Rule("open_lines", 10 * F.size(ended) < F.size(lines)),
        Rule("upper_case", 2 * upper > letters),
        Rule("stop_words", 50 * F.size(stop) < n),
        Rule("few_words", 20 * F.size(F.array_distinct(words)) < n),
    ]


def ordered(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample: int = SAMPLE, reaches=None) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected of what is left) on about `sample` random rows, in the order of rejections per second of what is left.

    reaches: from the sampled rows, those that come to the cascade (by default all).
    """
    n = docs.count()
    rows = docs.select(text_col).sample(min(1.0, sample / max(n, 1)), seed=1)
    rows = written(reaches(rows).select(text_col) if reaches else rows, "sample")
    names = [f"r{k}" for k in range(len(rules))]
    fails = [F.coalesce(r.fails, F.lit(False)) for r in rules]
    # which rules reject together: at most two to the number of rules
    seen = [([r[x] for x in names], r["count"]) for r in rows.select(*[f.alias(x) for f, x in zip(fails, names, strict=True)]).groupBy(*names).count().collect()] if rules else []

    def seconds(col):
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            rows.agg(F.count_if(col)).first()
            took.append(time.perf_counter() - began)
        return min(took[1:])  # the first run compiles

    scan = seconds(F.length(text_col) >= 0)
    cost = [max(seconds(f) - scan, 1e-3) for f in fails]
    out, left = [], set(range(len(rules)))
    while left:
        total = sum(c for _, c in seen)
        share = {k: sum(c for x, c in seen if x[k]) / total if total else 0.0 for k in left}
        best = min(left, key=lambda k: (-share[k] / cost[k], rules[k].name))
        out.append((rules[best], cost[best], share[best]))
        seen = [(x, c) for x, c in seen if not x[best]]
        left.remove(best)
    return out


def cascade(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample: int = SAMPLE, reaches=None) -> Column:
    """True for documents that no rule rejects, rules being tried in the order of ordered(); a rule that gives null doesn't reject.

    The order changes the work, not the verdict. Rows are judged one by one: null and empty texts, repeated rows and
    ties need nothing special, and an empty table (or no rule) gives True for any row.
    """
    verdict = None
    for rule, _, _ in ordered(docs, rules, text_col, sample, reaches):
        verdict = (F if verdict is None else verdict).when(rule.fails, F.lit(False))
    return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words added (long; columns of these names are replaced).

    Words are runs without ASCII white space; a null text has none. Repeats of 3-word windows
    are found by sorting the windows' 64-bit hashes, and only for texts that have any.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rest = [c for c in docs.columns if c.lower() not in names]
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), t.alias("_t"), F.btrim(t, F.lit(WHITE)).alias("_trim"))
    words = whole.withColumn("_w", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", GAP, -1)))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = words.select(
        "_row",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", GAP, "")).cast("long").alias("word_chars"),
        count_of(F.col("_t"), r"#*$%&|<>").cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.when(F.size("_w") < 3, F.array().cast("array<bigint>")).otherwise(F.slice(F.transform("_w", lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2))), 1, F.size("_w") - 2)).alias("_tri"),
    )
    two = one.select("_row", "n_words", "word_chars", "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), "_tri", F.size(F.array_distinct("_tri")).alias("_kinds"))
    three = two.withColumn("_at", F.when(F.col("_kinds") < F.size("_tri"), F.sort_array(F.transform("_tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    four = three.withColumn("_at", F.sort_array(F.transform(F.filter("_at", lambda x, k: (x["h"] == F.get("_at", k - 1)["h"]) | (x["h"] == F.get("_at", k + 1)["h"])), lambda x: x["i"])))
    # windows of 3 words at sorted places cover, each, up to the next window's start
    five = F.aggregate(F.transform("_at", lambda x, k: F.coalesce(F.least(F.lit(3), F.get("_at", k + 1) - x), F.lit(3))), F.lit(0), lambda a, x: a + x)
    # the row number, never negative, keeps filters above the measures: pushed below, they would be worked out again for each window
    repeated = F.when(F.monotonically_increasing_id() >= 0, F.coalesce(five, F.lit(0)).cast("long"))
    return four.select("_row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Measures of every document, whether it fails the base rules, and whether the cascade keeps it; documents that fail the base don't reach it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rest = cascade(docs, default_rules(), reaches=lambda rows: measured(rows).where(~base))
    out = measured(docs).withColumn("base_failed", base)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(F.col("base_failed"), F.lit(False)).otherwise(rest).alias("kept"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM tri, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, t, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
 len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;,)"''\x{201d}\x{2026}][\x20\x09-\x0D]*$'))) AS n_ended,
 len(list_filter(words, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN (@STOP@))) AS n_stop,
 CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(list_distinct(words)) AS n_kinds FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 10 * n_symbols > n_words OR 2 * word_chars < 5 * n_words OR word_chars > 10 * n_words OR 10 * n_dup_lines > 3 * n_lines
  OR 10 * n_ended < n_lines OR 50 * n_stop < n_words OR 20 * n_kinds < n_words
  OR 2 * length(regexp_replace(t, '\P{Lu}+', '', 'g')) > length(regexp_replace(t, '\P{L}+', '', 'g'))) AS kept FROM b
""".replace("@STOP@", ", ".join(f"'{w}'" for w in STOP_WORDS))
