"""URL filters: host and path rules, then a character language-model ratio. DataFrame functions only.

URLs that rules decide teach two smoothed Markov models of variable order. A context (the symbols before) grows by one more symbol
where the labelled URLs give evidence: it must hold a share of a class's symbols, which bounds the model whatever the
number of URLs, and must tell more about the next symbol than the context it grows from. Each context's counts are
interpolated with that shorter context by its number of different successors. Both models together are an automaton whose states are the
contexts, so a URL is scored in one pass over its symbols. A URL without
a rule is judged by the difference of its log likelihoods per character against a threshold
that the labelled URLs calibrate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Symbols of the models: letters, 0 for any digit, marks; ~ stands for all else. ^ is the start, and no symbol.
ALPHABET, START = "abcdefghijklmnopqrstuvwxyz0/.-_?=&%:#+~", "^"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longest context, share of a class's symbols (and number) a context must precede, nats it must tell more than the shorter one.
DEPTH, SHARE, LEAST, GAIN = 6, 1 / 4000, 5, 3.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first :// up to / ? # or the end, A-Z lower-cased, and path up to ? # or the end; else both empty."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    valid = at > 0
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(valid, host).otherwise(F.lit("")), F.when(valid, path).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls. rules: ("allow" or "block", host with path); of equal length the first wins."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: -len(r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule = (F if rule is None else rule).when(fits, F.lit(text))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(kind))
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def plain(text: Column) -> Column:
    """The text in symbols of the alphabet."""
    lower = F.translate(F.translate(text, UPPER, LOWER), "123456789", "000000000")
    return F.regexp_replace(lower, r"[^a-z0/.\-_?=&%:#+]", "~")


def contexts(labelled: DataFrame) -> DataFrame:
    """(kind, context, n, next) of labelled (kind, plain): symbols that follow each context of up to DEPTH symbols, with counts.

    One row for each place is counted; shorter contexts come from the counts of the longest.
    """
    at = F.when(F.length("plain") > 0, F.sequence(F.lit(1), F.length("plain"))).otherwise(F.array().cast("array<int>"))
    padded = F.concat(F.lit(START * DEPTH), F.col("plain"))
    grams = labelled.select("kind", padded.alias("p"), at.alias("at")).select("kind", F.explode(F.transform("at", lambda i: F.substring("p", i, F.lit(DEPTH + 1)))).alias("gram"))
    grams = grams.groupBy("kind", "gram").agg(F.count("*").alias("n"))
    parts = grams.select("kind", "n", F.explode(F.transform(F.sequence(F.lit(1), F.lit(DEPTH + 1)), lambda k: F.right("gram", k))).alias("part")).where(~F.col("part").startswith(START * 2))
    parts = parts.groupBy("kind", "part").agg(F.sum("n").alias("n"))
    each = parts.select("kind", F.expr("left(part, length(part) - 1)").alias("context"), F.right("part", F.lit(1)).alias("c"), "n")
    return each.groupBy("kind", "context").agg(F.sum("n").alias("n"), F.collect_list(F.struct("c", "n")).alias("next"))


@dataclass
class Chain:
    """One class's model: log probabilities of the next symbol after the contexts that were kept."""

    rows: dict[str, list[float]]

    def after(self, context: str) -> list[float]:
        while context not in self.rows:
            context = context[1:]
        return self.rows[context]


def chain(found: dict[str, dict[str, int]]) -> Chain:
    """The model from counts of next symbols by context; contexts that tell too little go, unless one that stays grows from them."""
    size = len(ALPHABET)
    total = sum(found.get("", {}).values())
    prob = {"": [(found.get("", {}).get(c, 0) + 1) / (total + size) for c in ALPHABET]}
    tells = {}
    for context in sorted((x for x in found if x), key=len):
        counts, below = found[context], prob[context[1:]]
        n, kinds = sum(counts.values()), len(counts)
        prob[context] = [(counts.get(c, 0) + kinds * b) / (n + kinds) for c, b in zip(ALPHABET, below, strict=True)]
        tells[context] = n * sum(p * math.log(p / b) for p, b in zip(prob[context], below, strict=True))
    kept = {""}
    for context in sorted(tells, key=len, reverse=True):
        if tells[context] >= GAIN or context in kept:
            kept |= {context, context[1:]}
    return Chain({x: [math.log(p) for p in prob[x]] for x in kept})


def automaton(allow: Chain, block: Chain) -> tuple[list[int], list[float], int]:
    """(next state, log P(c | allow) - log P(c | block)) of every state and symbol, and the state at the start."""
    states = set(allow.rows) | set(block.rows) | {"", START}
    todo = list(states)
    while todo:  # parts of a state are states, so that the longest context is always reached from the one before
        x = todo.pop()
        for y in (x[1:], x[:-1]):
            if x and y not in states:
                states.add(y)
                todo.append(y)
    number = {x: k for k, x in enumerate(sorted(states, key=lambda x: (len(x), x)))}
    follow, value = [], []
    for x in number:
        for k, c in enumerate(ALPHABET):
            follow.append(number.get(x + c, follow[number[x[1:]] * len(ALPHABET) + k] if x else 0))
        value += [a - b for a, b in zip(allow.after(x), block.after(x), strict=True)]
    return follow, value, number[START]


def models(labelled: DataFrame) -> tuple[list[int], list[float], int] | None:
    """The automaton of labelled (kind, plain), kinds being allow and block; None if a class has no symbol."""
    rows = written(contexts(labelled), "contexts")
    totals = {r["kind"]: r["n"] for r in rows.where("context = ''").collect()}
    if len(totals) < 2:
        return None
    enough = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, max(LEAST, math.ceil(n * SHARE)))])[F.col("kind")]
    found: dict[str, dict] = {k: {} for k in totals}
    for r in rows.where(F.col("n") >= enough).collect():  # at most DEPTH / SHARE contexts of a class
        found[r["kind"]][r["context"]] = {x["c"]: x["n"] for x in r["next"]}
    return automaton(chain(found["allow"]), chain(found["block"]))


def judged(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, score (log-likelihood difference per character) and verdict added (columns of these names are replaced).

    The rule's verdict holds where there is one; else `allow` if the score reaches the
    threshold, which lies between the labelled means, nearer to the class that spreads less.
    Null and empty URLs score 0; if either class has no labelled URL all others are allowed.
    Rows are judged one by one, so equal URLs (repeated rows) fare alike; an empty table gives an empty table.
    """
    names = ("host", "path", "rule", "score", "verdict")
    rest = [c for c in pages.columns if c.lower() not in names]
    host, path = host_and_path(F.col(url_col).cast("string"))
    host, path = F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_ruled": verdict, "_plain": plain(F.concat("host", "path"))})

    labelled = rows.where("_ruled is not null").select(F.col("_ruled").alias("kind"), F.col("_plain").alias("plain"))
    model = models(labelled)
    score, limit = (lambda text: F.lit(0.0)), None
    if model:
        follow, value = (F.split(F.lit(" ".join(x)), " ").cast(t) for x, t in ((map(str, model[0]), "array<int>"), ((f"{x:.6f}" for x in model[1]), "array<double>")))

        def step(a, c):
            at = a["state"] * len(ALPHABET) + F.instr(F.lit(ALPHABET), c) - 1
            return F.struct(F.get(follow, at).alias("state"), (a["sum"] + F.get(value, at)).alias("sum"))

        def score(text):
            begin = F.struct(F.lit(model[2]).alias("state"), F.lit(0.0).alias("sum"))
            each = F.filter(F.split(text, "", -1), lambda c: c != "")
            return F.aggregate(each, begin, step, lambda a: a["sum"]) / F.greatest(F.length(text), F.lit(1))

        seen = {r[0]: (r[1], r[2] or 0.0) for r in labelled.groupBy("kind").agg(F.avg(score("plain")), F.stddev_pop(score("plain"))).collect()}
        (a, sa), (b, sb) = seen["allow"], seen["block"]
        limit = (a * sb + b * sa) / (sa + sb) if sa + sb else (a + b) / 2
    own = F.lit("allow") if limit is None else F.when(F.col("score") >= limit, F.lit("allow")).otherwise(F.lit("block"))
    return rows.withColumn("score", score("_plain")).select("_row.*", "host", "path", "rule", "score", F.coalesce("_ruled", own).alias("verdict"))


#: The rules of the contract.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op4_urls(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages, RULES).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
