"""Operators for training text against brute force, round trips, and odd inputs."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sequora.llm import brown, decontaminate, jaccard, language, packing, quality, substrings, templates, urls, warc, words

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "über", "Été,", "x1.", "of", "the", "and"]
    prose = [" ".join(rnd.choice(words) + str(rnd.randrange(50)) for _ in range(n)) for n in (3, 4, 5, 60, 60, 400, 30_000)]
    near = prose[3].split()
    near[7] = "changed"
    texts = [None, "", " \n\t ", "...", *prose, prose[3], prose[3], " ".join(near), prose[3].upper(), "one line here\nand another\none line here"]
    rows = [(i, t, None if i % 5 == 0 else "en", "s", 1) for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, prose[4], "en", None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).withColumns({"id": F.lit("x"), "score": F.lit(1), "Host": F.lit(2), "k1": F.lit(3), "start": F.lit(4)})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def toks(t):
    return (t or "").encode().lower().split()


def shingle_set(t):
    w = toks(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    rows = [(i, shingle_set(t)) for i, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, s) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return sorted(((i, len(s), least.get(root(a)) if s else i) for a, (i, s) in enumerate(rows)), key=str)


def test_jaccard(odd, none):
    got = [(r.id, r.n_shingles, r.component_id) for r in jaccard.near_components(odd).collect()]
    assert sorted(got, key=str) == brute_components(odd_rows())
    assert jaccard.near_components(none).count() == 0


def test_jaccard_blocks(spark, monkeypatch):
    """A component over a task's limit is split; the result is the same."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(1 + i // 6):  # farther and farther from the first
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_components(rows)
    for limit in (3_000_000, 500):
        monkeypatch.setattr(jaccard, "TRIE", limit)
        assert sorted(((r.id, r.n_shingles, r.component_id) for r in jaccard.near_components(df).collect()), key=str) == want


def trie_rows(sets):
    """Rows of trie_edges: sets of numbers, each number once in its order by how many sets hold it."""
    count = Counter(x for s in sets for x in s)
    rows = []
    for i, s in enumerate(sets):
        h = np.array(sorted((x for x in s if count[x] > 1), key=lambda x: (count[x], x)), "<u8")
        rows.append((i, len(s), h.tobytes(), np.array([count[x] for x in h.tolist()], np.int32).tobytes()))
    return [r for r in rows if len(r[2]) // 8 - -(-75 * r[1] // 100) + 1 > 0]


def test_jaccard_trie_links():
    """Families of sets that grow apart, with numbers of their own and common ones: joined as all pairs say."""
    rnd = random.Random(7)
    for _ in range(60):
        sets = []
        for _ in range(rnd.randrange(1, 6)):
            base = rnd.sample(range(200), rnd.choice((1, 2, 4, 9, 30)))
            for _ in range(rnd.randrange(1, 12)):
                sets.append(frozenset(rnd.randrange(200) if rnd.random() < 0.12 else x for x in base) | {rnd.randrange(1000, 10**6) for _ in range(rnd.randrange(3))})
        sets = sorted(set(sets), key=sorted)
        label = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label = [label[b] if x == label[a] else x for x in label]
        got, edges = list(range(len(sets))), jaccard.trie_edges(rows, 75) if (rows := trie_rows(sets)) else []
        for a, b in edges:
            got = [got[b] if x == got[a] else x for x in got]
        assert [label.index(x) for x in label] == [got.index(x) for x in got]


def test_jaccard_trie_of_a_chain(monkeypatch):
    """Sets that share a number with two others each, which makes them one candidate component, meet those only, not all others."""
    asked, need = [0], jaccard.Trie.need

    def counted(self, a, b):
        asked[0] += 1
        return need(self, a, b)

    monkeypatch.setattr(jaccard.Trie, "need", counted)
    n = 1500
    sets = [frozenset([i, i + 1, *range(10_000 + i % 4 * 9, 10_000 + i % 4 * 9 + 9)]) for i in range(n)]
    edges = jaccard.trie_edges(trie_rows(sets), 60)
    assert len({b for e in edges for b in e}) == n and len(edges) == n - 4
    asked[0] = 0
    apart = [frozenset([i, i + 1, *range(10_000 + 9 * i, 10_007 + 9 * i)]) for i in range(n)]
    twice = [*apart, *(s | {10**6 + i, 10**7} for i, s in enumerate(apart))]
    assert len(jaccard.trie_edges(trie_rows(twice), 75)) == n
    assert asked[0] < 100 * n


def test_jaccard_table(spark):
    rows = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, jaccard.op8_jaccard(spark, D).collect()), key=str)
    assert got == brute_components([tuple(r) for r in rows])


def test_quality(spark, odd, none):
    got = {r.doc_id: r for r in quality.measured(odd.where("doc_id is not null")).collect()}
    for i, t, *_ in odd_rows():
        if i is None:
            continue
        w = (t or "").encode().split()
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n, covered = Counter(tri), set()
        for k, g in enumerate(tri):
            if n[g] > 1:
                covered |= {k, k + 1, k + 2}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(len(x.decode()) for x in w), len(covered), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
    assert quality.measured(none).count() == 0
    bad = spark.createDataFrame([("*** &&& " * 40,), ("Plain words in a row. " * 20,), (None,)], "text string")
    assert [r[0] for r in bad.select(quality.cascade(bad, quality.default_rules())).collect()] == [False, True, True]
    assert none.select(quality.cascade(none, quality.default_rules())).count() == 0


def test_quality_order(spark):
    docs = spark.createDataFrame([("***",)] * 50, "text string")
    rules = quality.ordered(docs, [quality.Rule("never", F.lit(False)), quality.Rule("always", F.length("text") > 0)])
    assert [r[0].name for r in rules] == ["always", "never"]


def test_quality_order_of_what_is_left(spark):
    """A rule that rejects nothing beyond an earlier one comes last, however much it rejects alone."""
    docs = spark.createDataFrame([("***",)] * 40 + [("###",)] * 10 + [("fine",)] * 50, "text string")
    stars, marks = F.col("text").startswith("*"), F.col("text").rlike("[*]")
    rules = quality.ordered(docs, [quality.Rule("b_same", marks), quality.Rule("a_stars", stars), quality.Rule("hash", F.col("text").startswith("#"))])
    assert rules[-1][0].name in ("a_stars", "b_same") and rules[-1][2] == 0 and {r[0].name: r[2] for r in rules}["hash"] in (0.1, 1 / 6)
    assert quality.ordered(docs, [], reaches=lambda rows: rows.where("false")) == []


def test_quality_table(spark):
    """The registered query against its SQL."""
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    got = quality.op1_quality(spark, D)
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(quality.OP1_SQL).fetchall())
    assert got.where("kept").count() > 100


def test_quality_rules(spark):
    """Each rule rejects what it is for; a plain text passes all."""
    plain = "\n".join(f"The house number {i} of the old street is there and it has a garden." for i in range(6))
    bad = {"symbols": "&& " * 60, "word_length": "a " * 60, "repeated_lines": "one of the lines.\n" * 9, "open_lines": "a line of the text\nand the next", "upper_case": plain.upper(), "stop_words": " ".join(f"w{i}" for i in range(99)), "few_words": "spam ham " * 50}
    df = spark.createDataFrame([("plain", plain), ("null", None), ("empty", " \n"), *bad.items()], "name string, text string")
    rules = quality.default_rules()
    got = {r["name"]: {x for x in bad if r[x]} for r in df.select("name", *[x.fails.alias(x.name) for x in rules]).collect()}
    assert set(bad) == {r.name for r in rules} and all(x in got[x] for x in bad) and not got["plain"] and not got["null"] and not got["empty"]


def test_substrings(spark, odd, none):
    assert substrings.repeated_spans(none).count() == 0
    spans = substrings.repeated_spans(odd, least_words=20).collect()
    text = {i: t for i, t, *_ in odd_rows()}
    assert {s.id for s in spans} >= {11, 12, 14} and not {s.id for s in spans} & {4, 5, 6, 10}
    passage = ". ".join(" ".join(f"p{i}{j}" for j in range(9)) for i in range(8)) + "."
    docs = [(1, f"Own words one. {passage} More own."), (2, f"Quite different start. {passage} And end."), (3, "Nothing shared at all in this one. " + " ".join(f"z{i}" for i in range(60)))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = substrings.repeated_spans(df)
    row = got.collect()
    assert [(r.id, r.kept_id) for r in row] == [(2, 1)] and docs[1][1][row[0].start : row[0].end].strip() == passage
    left = {r.doc_id: r.text for r in substrings.without(df, got).collect()}
    assert left[1] == docs[0][1] and left[2] == "Quite different start. And end." and text[4]


def brute_spans(rows, least):
    """Spans by the definition: units in order of document, the first one kept."""
    found = {i: list(substrings.units(t or "")) for i, t in rows}
    owners = {}
    for i, us in found.items():
        for u in us:
            owners.setdefault(u[3], []).append(i)
    out = set()
    for i, us in found.items():
        seen, run = set(), []
        for u in [*us, None]:
            if u and (u[3] in seen or min(owners[u[3]]) < i):
                run.append(u)
            else:
                if sum(x[2] for x in run) >= least:
                    first = owners[run[0][3]]
                    out.add((i, run[0][0], run[-1][1], sum(x[2] for x in run), min(first) if len(first) > 1 else None))
                run = []
            seen |= {u[3]} if u else set()
    return out


def test_substrings_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in substrings.op2_lines(spark, D).select("doc_id", "start", "end", "n_words", "kept_doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(rows, 25) and got


def test_substrings_ids(spark):
    """Rows of a null id are last and don't remove each other; texts of one id are cut each by its own spans."""
    a, b = (". ".join(" ".join(f"{x}{i}{j}" for j in range(9)) for i in range(5)) + ". " for x in "ab")
    df = spark.createDataFrame([(1, a), (None, a + "Tail one."), (None, b), (None, b), (2, "Head here. " + a), (2, "x " * 60), (3, None), (3, "")], "id bigint, text string").withColumns({"_id": F.lit(1), "_spans": F.lit(2), "text_key": F.lit(3)})
    spans = substrings.repeated_spans(df, "id")
    assert {(r.id, r.start, r.kept_id) for r in spans.collect()} == {(None, 0, 1), (2, 11, 1)}
    left = substrings.without(df, spans, "id")
    assert left.columns == df.columns
    assert Counter((r.id, r.text) for r in left.collect()) == Counter([(1, a), (None, "Tail one."), (None, b), (None, b), (2, "Head here. "), (2, "x " * 60), (3, None), (3, "")])
    assert substrings.without(df.where("false"), spans, "id").count() == 0 and substrings.without(df, spans.where("false"), "id").count() == df.count()


def test_warc_round_trip(spark, tmp_path):
    big = "".join(random.Random(1).choices("abcdef<>&é", k=700_000))
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u\r\nv", big), (6, "w", big), (6, "w", big), (None, "n", "x"), (None, None, "only")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha", F.lit(1))
    got = [r for split in (1000, 8 << 20) for r in [warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/{split}"), split).collect()]]
    for records in got:
        assert len(records) == len(rows)
        want = Counter()
        first = {}
        for i, _, h in rows:
            if i is not None:
                first[h or ""] = min(i, first.get(h or "", i))
        for i, _, h in rows:
            p = (h or "").encode()
            f = first.get(h or "")
            refers = f if f is not None and i != f else None
            want[(f"<urn:page:{'none' if i is None else i}>", "revisit" if refers else "response", f"<urn:page:{refers}>" if refers else None, base64.b32encode(hashlib.sha1(p).digest()).decode(), len(p), None if refers else p)] += 1
        assert Counter((r.record_id, r.type, r.refers_to, r.payload_digest, r.payload_bytes, None if r.payload is None else bytes(r.payload)) for r in records) == want
        assert all(r.digest_ok in (True, None) for r in records)
    empty = warc.read_archives(warc.write_archives(pages.where("false"), f"file://{tmp_path}/none"))
    assert empty.count() == 0


def test_warc_damage(tmp_path):
    import io

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    parts = [warc.member(str(i), None, bytes([i]) * 50_000, None) for i in range(4)]
    broken = parts[1][:-30] + bytes(30)
    data = b"".join([parts[0], broken, b"\x1f\x8b\x08junk", parts[2], parts[3]])
    assert [warc.parse(m)[0] for m in warc.members(File(data), 0, len(data))] == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>"]


def test_urls(spark, none):
    cases = {
        "http://WWW.Example.com/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "https://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"),
        "http://notcom/x": ("notcom", "/x", None, None),
        "http://com/": ("com", "/", "com/", "allow"),
        "http://x.com": ("x.com", "", None, None),
        "x.com/a": ("", "", None, None),
        "": ("", "", None, None),
    }
    rows = [(i, u) for i, u in enumerate(cases)] + [(None, None), (0, next(iter(cases)))]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumns({"Host": F.lit(1), "verdict": F.lit("x")})
    got = urls.judged(df, urls.RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = cases.get(r.url, ("", "", None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict in (None, r.verdict)) and r.verdict in ("allow", "block")
    assert urls.judged(df.where("false"), urls.RULES).count() == 0


def test_urls_learn(spark):
    good = [(f"http://{random.Random(i).choice(['news', 'blog', 'wiki'])}{i}.com/article/{i}",) for i in range(200)]
    bad = [(f"http://casino-win{i}.net/es/bet{i}",) for i in range(200)]
    new = [(f"http://wiki{i}.org/article/{i}",) for i in range(20)] + [(f"http://casino-win{i}.org/bet{i}",) for i in range(20)]
    df = spark.createDataFrame([*good, *bad, *new], "url string")
    got = {r.url: r.verdict for r in urls.judged(df, urls.RULES).where("rule is null").collect()}
    assert sum(got[u] == ("block" if "casino" in u else "allow") for (u,) in new) >= 36


def brute_url_scores(labelled, new):
    """Scores by the definition: all contexts counted, kept by evidence, the longest that is kept used at each place."""
    size, logs = len(urls.ALPHABET), {}
    for kind, texts in labelled.items():
        counts = {}
        for text in texts:
            s = urls.START + text
            for k in range(1, len(s)):
                for d in range(urls.DEPTH + 1):
                    if k - d >= 0:
                        counts.setdefault(s[k - d : k], Counter())[s[k]] += 1
        need = max(urls.LEAST, math.ceil(counts[""].total() * urls.SHARE))
        counts = {x: c for x, c in counts.items() if c.total() >= need or not x}

        def prob(x, c, counts=counts):
            if not x:
                return (counts[""][c] + 1) / (counts[""].total() + size)
            n = counts[x]
            return (n[c] + len(n) * prob(x[1:], c)) / (n.total() + len(n))

        def tells(x, counts=counts, prob=prob):
            return counts[x].total() * sum(prob(x, c) * math.log(prob(x, c) / prob(x[1:], c)) for c in urls.ALPHABET)

        strong = {x for x in counts if x and tells(x) >= urls.GAIN}
        logs[kind] = ({""} | {x[k:] for x in strong for k in range(len(x))}, prob)
    out = {}
    for text in new:
        s, total = urls.START + text, 0.0
        for k in range(1, len(s)):
            for kind, sign in (("allow", 1), ("block", -1)):
                kept, prob = logs[kind]
                x = next(s[k - d : k] for d in range(urls.DEPTH, -1, -1) if k - d >= 0 and s[k - d : k] in kept)
                total += sign * math.log(prob(x, s[k]))
        out[text] = total / max(1, len(text))
    return out, max(len(x) for kept, _ in logs.values() for x in kept)


def test_urls_model(spark):
    """Scores equal those of a plain variable-order model of all labelled URLs, a rare class too; contexts deeper than two are used."""
    rnd = random.Random(11)
    part = lambda: rnd.choice(["news", "blog", "wiki", "shop", "data"])
    good = [f"{part()}{i}.com/{part()}/{i % 977}" for i in range(2000)]
    bad = [f"casino{i}.net/es/bet-{part()}{i}" for i in range(60)]
    new = [f"casino{i}.org/bet{i}" for i in range(4)] + [f"{part()}.org/{part()}/x" for _ in range(4)] + ["x", "%%~~.org"]
    df = spark.createDataFrame([("http://" + u,) for u in [*good, *bad, *new]], "url string")
    as_symbols = lambda u: "".join("0" if c.isdigit() else c for c in u)
    want, deepest = brute_url_scores({"allow": map(as_symbols, good), "block": map(as_symbols, bad)}, map(as_symbols, new))
    got = {r.url[7:]: r.score for r in urls.judged(df, urls.RULES).where("rule is null").collect()}
    assert got == {u: pytest.approx(want[as_symbols(u)], abs=1e-5) for u in new} and deepest > 3


def test_urls_table(spark):
    """The registered query: every page, its rules by hand and the model's verdicts by brute force."""
    rows = urls.op4_urls(spark, D).collect()
    url = {r.page_id: r.url for r in spark.read.parquet(f"{D}/pages.parquet").select("page_id", "url").collect()}
    assert {r.page_id for r in rows} == set(url) and len(rows) == len(url)
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    as_symbols = lambda r: "".join(c if c in urls.ALPHABET else "~" for c in (r.host + r.path).translate(table))
    for r in rows:
        rest = (url[r.page_id] or "").partition("://")[2]
        host = rest.replace("?", "/").replace("#", "/").split("/")[0]
        path = rest[len(host) :].replace("?", "#").split("#")[0]
        assert (r.host, r.path) == (host.lower(), path)
        fits = [(kind, rule) for kind, rule in urls.RULES if ("." + r.host).endswith("." + rule.split("/", 1)[0]) and path.startswith("/" + rule.split("/", 1)[1])]
        best = max(fits, key=lambda x: len(x[1]), default=(None, None))
        assert r.rule == best[1] and best[0] in (None, r.verdict)
    labelled = {k: [as_symbols(r) for r in rows if r.rule and r.verdict == k] for k in ("allow", "block")}
    want, _ = brute_url_scores(labelled, {as_symbols(r) for r in rows})
    stats = {k: (np.mean([want[x] for x in v]), np.std([want[x] for x in v])) for k, v in labelled.items()}
    (a, sa), (b, sb) = stats["allow"], stats["block"]
    limit = (a * sb + b * sa) / (sa + sb)
    for r in rows:
        assert r.score == pytest.approx(want[as_symbols(r)], abs=1e-5)
        assert r.rule or r.verdict == ("allow" if want[as_symbols(r)] >= limit else "block") or abs(want[as_symbols(r)] - limit) < 1e-5


def test_language_forward():
    """The forward sum equals the sum over all segmentations."""
    pieces = ["▁", "▁a", "a", "b", "ab", "ba"]
    prob = np.vstack([np.random.default_rng(0).random((6, 2)), np.zeros((1, 2))])
    p = language.Pieces(pieces)

    def brute(s, k):
        return 1.0 if not s else sum((prob[pieces.index(s[:n]), k] if s[:n] in pieces else language.FLOOR if n == 1 else 0) * brute(s[n:], k) for n in range(1, len(s) + 1))

    words = ["a", "ab", "abba", "bbb", "abababab", "c", "ac"]
    got = language.forward(p, prob, words)
    assert np.allclose(got, [[math.log(brute("▁" + w, k)) for k in (0, 1)] for w in words])
    assert np.isfinite(language.forward(p, prob, ["ab" * 3000])).all()


def test_language_fit():
    """One round of expectation maximisation against expectations over all segmentations, for long words too."""
    pieces, counts = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab"], {"x": {"ab": 3, "abba": 2, "b": 1, "ab" * 9: 2}, "y": {"a": 1, "bab": 4, "ab" * 9 + "b": 1}}
    p = language.Pieces(pieces)
    got = language.fit(p, counts, rounds=2)

    def cuts(s):
        if not s:
            yield ()
        for n in range(1, len(s) + 1):
            if s[:n] in pieces:
                yield from ((s[:n], *x) for x in cuts(s[n:]))

    prob = {k: dict.fromkeys(pieces, 1 / 9) for k in counts}
    for _ in range(2):
        for k, words in counts.items():
            expected = dict.fromkeys(pieces, 0.1)
            for w, n in words.items():
                ways = [(math.prod(prob[k][x] for x in c), c) for c in cuts("▁" + w)]
                total = sum(x for x, _ in ways)
                for x, c in ways:
                    for piece in c:
                        expected[piece] += n * x / total
            prob[k] = {x: v / sum(expected.values()) for x, v in expected.items()}
    assert np.allclose(got[:-1], [[prob[k][x] for k in ("x", "y")] for x in pieces]) and not got[-1].any()


def test_language_letters(spark):
    """Numbers that are no letters make no word; a language of long texts only is learned too."""
    assert not language.LETTERS.search("² ½ 12 Ⅷ _ ٣") and language.LETTERS.findall("a²é3ß") == ["a", "é", "ß"]
    assert language.letter_words("Ab² ½ c½d E_f 一二 Ⅷ") == ["ab", "c", "d", "e", "f", "一二"] and language.letter_words("² ½") == []
    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "½ ²", "en"), (2, "the house " * 3000, "en"), (3, "das haus " * 3000, "de"), (4, "x" * 5000, None), (5, "the " + "a" * 300, None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df, df, path).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] == "en" and got[3][0] == "de" and got[4][0] in ("en", "de") and math.isfinite(got[5][1])
    assert max(map(len, language.vocabulary(path))) > 9


def test_language(spark, odd, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    r = language.op5_language(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = r.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert held[0] > 0.97 and held[1] >= 0 and held[2] <= 1
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in r.collect())
    got = language.identify(odd, odd, path).collect()
    assert len(got) == len(odd_rows())
    assert {x.lang_pred for x in got if not any(c.isalpha() for c in x.text or "")} == {"und"}
    assert language.identify(none, none, path).count() == 0
    assert {x.lang_pred for x in language.identify(odd, none, path).collect()} == {"und"}


def test_leaks(spark, none):
    rnd = random.Random(2)
    vocab = [f"v{i}" for i in range(2000)]
    items = [(i, " ".join(rnd.choices(vocab, k=n))) for i, n in enumerate((15, 30, 59, 4, 40))] + [(5, None), (6, "")]
    near = items[4][1].split()
    near[0] = "other"
    docs = [(1, "start here " + items[0][1].upper() + " end."), (2, items[2][1]), (3, "x " * 50 + " ".join(near) + " y z"), (4, " ".join(rnd.choices(vocab, k=300))), (5, items[3][1]), (6, None), (7, ""), (2, items[2][1]), (8, items[1][1] + " and " + items[0][1]), (9, " ".join(items[1][1].split()[:12]))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"id": F.lit(1), "size": F.lit(2), "w": F.lit(3)})
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.id, r.item): r for r in decontaminate.leaks(d, b).collect()}
    assert set(got) == {(1, 0), (2, 2), (3, 4), (5, 3), (8, 0), (8, 1)}
    assert got[1, 0].start == 2 and got[1, 0].similarity == 1 and got[3, 4].start == 50
    assert decontaminate.leaks(none, b).count() == 0 and decontaminate.leaks(d, b.where("false")).count() == 0


def test_leaks_table(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").collect()
    items = [(r.item_id, f" {' '.join(r.text.lower().split())} ") for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    want = {(x.doc_id, i) for x in docs for i, t in items if t in f" {' '.join((x.text or '').lower().split())} "}
    assert want and want <= {(r.doc_id, r.item_id) for r in decontaminate.op6_decontaminate(spark, D).collect()}


def test_leaks_reordered(spark):
    """Parts of an item in another order are found at starts that no shingle of the item is aligned with."""
    rnd = random.Random(9)
    own = lambda k: [f"u{rnd.randrange(10**6)}" for _ in range(k)]
    items = [[f"v{i}_{k}" for k in range(n)] for i, n in enumerate((60, 75, 90))]
    docs = [(100 * i + k, " ".join([*own(20), *w[k:], *w[:k], *own(20)])) for i, w in enumerate(items) for k in (9, len(w) // 2)]
    got = {(r.id, r.item, r.start) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")).collect()}
    assert got == {(d, d // 100, 20) for d, _ in docs}


def test_leaks_beyond_radius(spark):
    """All documents and best windows of a brute-force search in steps of one word, near the threshold too."""
    rnd = random.Random(10)
    own = lambda k: [f"u{rnd.randrange(10**6)}" for _ in range(k)]
    items = [(i, [f"v{i}_{k}" for k in range(n)] if i % 2 else [f"w{rnd.randrange(12)}" for _ in range(n)]) for i, n in enumerate((20, 31, 44, 60))]
    docs = []
    for i, w in items:
        for cut in range(1, 6):
            docs += [[*own(9), *w[: len(w) - cut], *own(9)], [*own(7), *w[cut:], *own(9)], w[cut:], [*own(5), *w[: len(w) // 2], *own(cut), *w[len(w) // 2 :], *own(3)]]
    want = {}
    for d, w in enumerate(docs):
        for i, x in items:
            for a in range(max(1, len(w) - len(x) + 1)):
                p, q = (Counter(tuple(y[k : k + 5]) for k in range(len(y) - 4)) for y in (w[a : a + len(x)], x))
                both, either = (p & q).total(), (p | q).total()
                if 100 * both >= 75 * either:
                    want[d, i] = max(want.get((d, i), (0, 0)), (both / either, -a))
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id bigint, text string")
    got = decontaminate.leaks(d, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")).collect()
    assert {(r.id, r.item): (r.similarity, -r.start) for r in got} == want and len(want) > 40


def brute_leaks(docs, items):
    """(document, item) with a window of the item's words at 75 per cent, of all starts."""
    out = set()
    for d, w in docs.items():
        for i, x in items.items():
            if not set(x) & set(w):
                continue
            g = min(5, len(x))
            q = Counter(tuple(x[k : k + g]) for k in range(len(x) - g + 1))
            for a in range(max(1, len(w) - len(x) + 1)):
                y = w[a : a + len(x)]
                p = Counter(tuple(y[k : k + g]) for k in range(len(y) - g + 1))
                if p and 100 * (p & q).total() >= 75 * (p | q).total():
                    out.add((d, i))
                    break
    return out


def test_leaks_recall(spark, monkeypatch):
    """Items of 1 to 100 words with as many changes as the threshold lets pass, and one more: at least 0.99 are found, and nothing else."""
    rnd = random.Random(12)
    items, docs = {}, {}
    for size in [1, 2, 3, 4, *range(5, 101, 5)]:
        for v in range(12):
            x = items[len(items)] = [f"i{len(items)}_{k}" for k in range(size)]
            m = max(1, size - 4)
            spare = m - -(-6 * m // 7) if size >= 5 else 0  # shingles that may differ
            for more in (0, 1):
                y = list(x)
                if v % 3 == 0:  # words at the end
                    y = y[: len(y) - spare - more] + [f"z{rnd.randrange(10**9)}" for _ in range(spare + more)]
                elif v % 3 == 1:  # words at the start
                    y = [f"z{rnd.randrange(10**9)}" for _ in range(spare + more)] + y[spare + more :]
                elif spare + more >= 5:  # a word within, and the rest at the end
                    y[len(y) // 2] = "other"
                    y = y[: len(y) - (spare + more - 5)] + [f"z{rnd.randrange(10**9)}" for _ in range(spare + more - 5)]
                else:
                    y += ["end"] * more
                docs[len(docs)] = [*(f"u{rnd.randrange(10**9)}" for _ in range(7)), *y, *(f"u{rnd.randrange(10**9)}" for _ in range(9))]
    want = brute_leaks(docs, items)
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id bigint, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id bigint, text string")
    for limit in (decontaminate.BROADCAST, 0):  # the join's other plan too
        monkeypatch.setattr(decontaminate, "BROADCAST", limit)
        got = {(r.id, r.item) for r in decontaminate.leaks(d, b).collect()}
        assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 300


def shuffled(spark, run):
    """Bytes that a call writes to shuffles (in local mode)."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty()
        every = context.statusStore().executorList(False)
        return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))

    before = total()
    run()
    return total() - before


def test_leaks_leave_texts_in_place(spark):
    """Texts without a window aren't shuffled, even where no table is small enough to be broadcast unasked."""
    rnd = random.Random(8)
    item = " ".join(f"i{k}" for k in range(12))
    texts = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=20_000)) for _ in range(100)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "so " + item + " there"])], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = []
        assert shuffled(spark, lambda: got.extend(decontaminate.leaks(docs, items).collect())) < 300_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert [(r.id, r.item, r.start) for r in got] == [(100, 1, 1)]


def test_leaks_beyond_keys(spark, monkeypatch):
    """More found texts than are broadcast: the same rows."""
    docs, items = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "KEYS", 0)
    assert want and sorted(map(tuple, decontaminate.leaks(docs, items).collect())) == want


def test_leaks_blocks(spark):
    """Fingerprints within the radius share a key whatever bits differ; the radius is the greatest with that promise."""
    rnd = random.Random(6)
    rows = []
    for k in range(400):
        a = [rnd.getrandbits(64) for _ in range(2)]
        bits = rnd.sample(range(128), rnd.randrange(decontaminate.RADIUS + 1))
        b = [a[0] ^ sum(1 << x for x in bits if x < 64), a[1] ^ sum(1 << (x - 64) for x in bits if x >= 64)]
        rows.append((k, len(bits), [x - 2**64 if x >= 2**63 else x for x in a], [x - 2**64 if x >= 2**63 else x for x in b]))
    df = spark.createDataFrame(rows, "k bigint, n int, a array<bigint>, b array<bigint>")
    got = df.select("n", decontaminate.apart("a", "b").alias("d"), F.arrays_overlap(decontaminate.block_keys("a", near=True), decontaminate.block_keys("b")).alias("met")).collect()
    assert all(r.n == r.d and r.met for r in got)
    assert sum(bits for _, bits in decontaminate.block_values("a")) == 128 and decontaminate.RADIUS == 2 * decontaminate.BLOCKS - 1


def check_places(rows, most=4096):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= most
    return len(by)


def test_packing(odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    extra = odd.sparkSession.createDataFrame([(90, "It's <|endoftext|> ok<|STARTOFTEXT|>. É, é; don't!? á. ÀB!  x 12.", "en", "s", 1)], SCHEMA)
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").union(extra)
    rows = packing.pack_documents(docs).collect()
    want = Counter()
    total = 0
    for i, text, *_ in [*odd_rows(), *extra.collect()]:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        for k, a in enumerate(range(0, len(ids), 4096)):
            one = np.array(ids[a : a + 4096], "<u4")
            want[(i, k, a, len(one), zlib.crc32(one.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert check_places(rows) == -(-total // 4096)
    assert packing.pack_documents(none).count() == 0


def test_packing_encodes_words_in_rows(monkeypatch):
    """Words of letters reach the tokenizer in rows and get the ids they have alone; where a word is several pieces its row is encoded word by word."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdeéüßſñаяλς中字ㅏǅ\u1100\u1161", k=rnd.randint(1, 12))) for _ in range(600)] + ["".join(rnd.choices("etaoinshr", k=7)) for _ in range(3_000)]
    words = list(dict.fromkeys([*words, "ΟΔΟΣ", "İstanbul", "don't", "a1", "x.y", "***", "e\u0301t", "\u0301a", "\u0300", "<|endoftext|>", "ﬁ", "ªº", "ⅷ", "\U0001e900", "\U000323b0", "y" * 5_000]))
    packing._encoder(path)[1].clear()
    tokenizer, known, ends = packing._encoder(path)
    given = []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            given.extend(texts)
            return tokenizer.encode_batch_fast(texts, **how)

    monkeypatch.setattr(packing, "_encoder", lambda path: (Counted(), known, ends))
    got = packing.encode_words(path, [w.encode() for w in words])
    assert {w: got[w.encode()] for w in words} == {w: np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words}
    assert len(given) < len(words) / 10
    known.clear()
    given.clear()
    texts = [" ".join(words[i : i + 3]) for i in range(0, 3_000, 3)] + ["", " ".join(words)]
    for once in (100_000, 50):
        monkeypatch.setattr(packing, "ONCE", once)
        assert list(packing.ids_of(path, texts, 2_000)) == [np.array(tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
        assert once == 50 or len(given) < len(words) / 10  # short texts share rows


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_plan_keeps_every_capacity(by):
    rnd = random.Random(4)
    sizes = Counter(rnd.randrange(1, 38) for _ in range(500))
    runs, n = packing.plan(sizes, 60, documents=4, cost=1500, by=by)
    bins = {}
    for size, rows in runs.items():
        ranks = sorted((rank + k, seq + k // each, off + k % each * size) for (rank, seq, each, off), (nxt, *_) in zip(rows, [*rows[1:], (sizes[size],)], strict=True) for k in range(nxt - rank))
        assert [r[0] for r in ranks] == list(range(sizes[size]))
        for _, seq, off in ranks:
            bins.setdefault(seq, []).append((off, size))
    assert len(bins) == n
    for b in bins.values():
        assert sum(s for _, s in b) <= 60 and len(b) <= 4 and sum(s * s for _, s in b) <= 1500
        at = 0
        for off, s in sorted(b):
            assert off == at
            at += s


def test_plan_weighs_every_dimension():
    """Of bins with the same room of tokens that with less room of the others is taken; with heavier weights another bin of more tokens."""
    groups = packing.Groups((100, 100, 10_000))
    for first, room in enumerate([(30, 99, 9_000), (30, 97, 9_000), (30, 97, 8_000), (31, 50, 100)]):
        groups.add(room, first, 1)
    item = np.array((20, 1, 400))
    assert groups.best(item, np.array((1.0, 0.01, 0.01)), "norm") == 2 and groups.best(np.array((10, 1, 100)), np.array((1.0, 1.0, 1.0)), "norm") == 3
    assert groups.best(item, np.array((1.0, 0.0, 0.0)), "norm") == 0 and groups.best(item, np.array((1.0, 1.0, 1.0)), "dot") == 0
    assert groups.best(np.array((40, 1, 1600)), np.ones(3), "dot") == -1
    assert packing.plan({}, 100) == ({}, 0)


@pytest.mark.parametrize("seed", range(3))
def test_plan_reaches_the_bound(seed):
    rnd = random.Random(seed)
    sizes = Counter(min(4096, int(rnd.lognormvariate(5.5, 1.2)) + 1) for _ in range(20_000))
    runs, n = packing.plan(sizes, 4096)
    bound = -(-sum(k * v for k, v in sizes.items()) // 4096)
    assert bound <= n <= bound + 1 and sum(map(len, runs.values())) < 4 * len(sizes) + 100


def test_brown(spark, odd, none):
    rows = spark.read.parquet(f"{D}/documents.parquet").collect()
    got = {r.doc_id: r for r in brown.op9_lm(spark, D).collect()}
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    c = Counter(w for r in train for w in toks(r.text))
    n, v = sum(c.values()) + len(train), len(c) + 1
    better = 0
    for r in rows:
        w = toks(r.text)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        g = got[r.doc_id]
        assert g.base_score == pytest.approx(base) and (g.n_tokens, g.n_known, g.train_tokens) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert math.isfinite(g.score)
        better += g.score > g.base_score
    assert better > 0.9 * len(rows)
    assert brown.score(odd, odd).count() == len(odd_rows()) and brown.score(none, odd).count() == 0
    assert {r.base_score for r in brown.score(odd, none).collect()} == {0.0}


@pytest.mark.parametrize("hot", [60_000, 150])
def test_brown_scores(spark, monkeypatch, hot):
    """Scores equal those of a plain model with the learned classes, whatever number of words is broadcast; every word has a class."""
    monkeypatch.setattr(brown, "HOT", hot)
    monkeypatch.setattr(brown, "SEEDS", 80)
    rows = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(120)
    train, held = rows.where("doc_id % 3 <> 0"), rows.where("doc_id % 3 = 0")
    model = brown.learn(train)

    def encode(docs):
        for r in docs.collect():
            for _, _, h, shape, _ in brown.tokens(pa.array([r.text], pa.string())):
                yield r.doc_id, list(zip(h.tolist(), shape.tolist(), strict=True))

    cls = dict(zip(model.hot[0].tolist(), model.hot[2].tolist(), strict=True))
    broadcast = set(cls)
    cls |= {r.word: r.cls for r in model.words.collect()}
    texts, c, m = list(encode(train)), model.n_classes, model.n_classes + brown.SHAPES + 1
    counts = Counter(w for _, x in texts for w, _ in x)
    assert set(cls) == set(counts) - {brown.END} and len(broadcast) == min(hot, len(cls)) and len(set(cls.values())) > c // 2
    kinds = {w: s for _, x in texts for w, s in x if s < brown.SHAPES}
    of_shape = np.zeros((brown.SHAPES, c))
    for w, s in kinds.items():
        of_shape[s, cls[w]] += 1

    def steps(x):
        at = m - 1
        for w, s in x:
            k = c if s == brown.SHAPES else cls.get(w, int(of_shape[s].argmax()) if of_shape[s].sum() else int(of_shape.sum(0).argmax()))
            yield at, k, w
            at = m - 1 if s == brown.SHAPES else cls[w] if w in broadcast else c + s

    n = Counter((a, k) for _, x in texts for a, k, _ in steps(x))
    from_, into, size = Counter(), Counter(), Counter(cls.values())
    for (a, k), v in n.items():
        from_[a] += v
        into[k] += v
    got = {r.id: r.score for r in brown.scored(rows, model).collect()}
    for i, x in [*texts, *encode(held)]:
        want = sum(math.log10((n[a, k] + 1) / (from_[a] + c + 1)) + (math.log10((counts[w] + 1) / (into[k] + size[k] + 1)) if k < c else 0) for a, k, w in steps(x))
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_brown_counts_travel_slim():
    """Counts dealt to tasks come back whole, and in fewer bytes than their numbers hold."""
    rng = np.random.default_rng(3)
    for top in (1, 300, 2**40, 2**63 - 1):
        keys = np.unique(rng.integers(-top if top > 2**50 else 0, top, 5_000))
        n, symbol = rng.geometric(0.5, len(keys)).astype(np.int64), rng.integers(0, 9_000, len(keys)).astype(np.int32)
        bucket = keys % 7
        rows = [x for b in brown.dealt(bucket, keys, symbol, n) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert [b for b, *_ in rows] == sorted(set(bucket.tolist()))
        for b, *columns in rows:
            for got, want in zip(brown.received(*columns), (keys, symbol, n), strict=True):
                assert got.tolist() == want[bucket == b].tolist()
    keys = np.sort(rng.choice(2_000_000, 50_000, replace=False))
    [batch] = brown.dealt(np.zeros(50_000, np.int64), keys, rng.geometric(0.7, 50_000))
    assert sum(c.nbytes for c in batch.columns) < 4 * 50_000
    assert [len(x) for x in brown.received(brown.slim(keys[:0]), brown.slim(keys[:0]))] == [0, 0]


def test_brown_classes_help(spark):
    """Held-out texts are likelier by exchanged classes than by classes dealt by hash."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    train, held = docs.where("doc_id % 7 <> 2"), docs.where("doc_id % 7 = 2")
    total = [brown.score(held, train, rounds=r).agg(F.sum("score"), F.sum("n_tokens")).first() for r in (brown.ROUNDS, 0)]
    assert total[0][0] / total[0][1] > total[1][0] / total[1][1] + 0.1


def test_best_class():
    """Against the likelihood of every move, the word's own counts apart."""
    rnd = np.random.default_rng(3)
    counts = rnd.integers(100, 150, (7, 7)).astype(float)
    left, right = rnd.integers(0, 4, (6, 7)).astype(float), rnd.integers(0, 4, (6, 7)).astype(float)
    own = np.array([-1, 0, 1, 2, 3, 0])

    def gain(w, c):
        n = counts.copy()
        if own[w] == c:
            into, out = n[:, c] - left[w], n[c] - right[w]
        else:
            into, out = n[:, c], n[c]
        p = lambda x: np.log((np.maximum(x, 0) + brown.ALPHA) / (max(x.sum(), 0) + brown.ALPHA * 7))
        return left[w] @ p(into) + right[w] @ p(out)

    word, s = np.nonzero(left)
    assert brown.best_left(word, s, left[word, s], 6, counts, 4).tolist() == brown.best_class(left, None, np.full(6, -1), counts, 4).tolist()
    assert brown.best_class(left, right, own, counts, 4).tolist() == [max(range(4), key=lambda c, w=w: gain(w, c)) for w in range(6)]


def test_exchange_groups_alike_words():
    pairs = np.zeros((5, 5), np.int64)
    pairs[0, 2] = pairs[1, 2] = pairs[0, 3] = pairs[1, 3] = 50  # 0 and 1 come before 2 and 3
    pairs[2, 4] = pairs[3, 4] = pairs[4, 0] = pairs[4, 1] = 50
    of = brown.exchange(pairs, 4, 2)
    assert of[0] == of[1] != of[2] == of[3]


def test_templates(spark, odd, none):
    rnd = random.Random(7)
    own = lambda k: " ".join("".join(rnd.choices("abcdefghij", k=7)) for _ in range(k))
    docs = [(i, f"{own(8)}\nPage {i} of 99 printed by press\n{own(9)}\nposted on the board by user{chr(97 + i)}z this day\n{own(5)}") for i in range(20)]
    copy = f"{own(8)}\n{own(7)}\n{own(9)}"
    docs += [(100 + i, copy) for i in range(30)] + [(200, None), (201, ""), (201, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"k1": F.lit(1), "Dropped_Lines": F.lit("x"), "template": F.lit(2)})
    got = {r.doc_id: r for r in templates.drop_templates(df).collect()}
    for i, text in docs[:20]:
        lines = text.split("\n")
        assert got[i].text == "\n".join([lines[0], lines[2], lines[4]]) and got[i].dropped_lines == [1, 3]
    assert all(got[100 + i].text == copy for i in range(30)) and got[200].text is None and got[201].text == ""
    assert templates.drop_templates(odd).count() == len(odd_rows()) and templates.drop_templates(none).count() == 0


def test_templates_crowded_leaf(spark, monkeypatch):
    """A leaf that is split by its next token gives the same lines; lines of numbers go where they are equal."""
    rnd = random.Random(9)
    own = lambda k: " ".join("".join(rnd.choices("abcdefghij", k=7)) for _ in range(k))
    docs = [(i, "\n".join([own(9), f"posted on the board by {own(1)} this very day", f"first of all {own(6)}", "10 20 30 40 50 60", f"{i} 7{i} 8{i} 9{i} {i}1 {i}2", own(9)])) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for limit in (20_000, 3):
        monkeypatch.setattr(templates, "SPLIT", limit)
        assert {tuple(r.dropped_lines) for r in templates.drop_templates(df).collect()} == {(1, 3)}


def test_leaf_compares_what_can_be_similar():
    """The most similar template of all, as without an index."""
    rnd = random.Random(4)
    for length in (3, 4, 5, 8, 15):
        tree, kept = templates.Leaf(length, 0.8), []
        for i in range(300):
            x = np.array([7] * min(3, length) + [rnd.randrange(1, 4) for _ in range(length - 3)], "<i8")
            share = [(k == x).mean() for k in kept]
            got = tree.place(x, i)
            if share and max(share) >= 0.8:
                want = int(np.argmax(share))
                kept[want] = np.where(kept[want] == x, x, 0)
            else:
                want = len(kept)
                kept.append(x)
            assert got == want


def test_parsed_lines_are_generalised():
    """Plain lines, which are not cut, have the leaf and tokens that cutting gives; a plain line is handed on as it is."""
    rnd = random.Random(5)
    texts = ["", "a", " ", "a b c", " a b c", "a b c ", "a  b c", "a b\tc d", "a b c\r\nd e f", "a b c d\n\n1 b c d\n1 2 3", "a\x0bb c d", "* b c *", "\u00a0 b c d"]
    texts += ["".join(rnd.choices("ab1 \n\t", [5, 5, 1, 5, 1, 0.2], k=60)) for _ in range(300)]
    for text in texts:
        cut = [templates.generalise(x) for x in text.encode().split(b"\n")]
        assert templates.parsed(text.encode()) == [x and (x[0], b" ".join(x[1])) for x in cut]


def test_words_and_runs(monkeypatch):
    """Words of rows that touch, and the hashes of words and runs, as found one by one; each word is mixed but twice."""
    rnd = random.Random(11)
    rows = ["", None, "a", "b", " c", "d ", "", "ee\tff", "x" * 70, "\n\n", "é ü\x0b", "end", *("".join(rnd.choices("abA é\n\x0c", [5, 5, 2, 4, 1, 1, 0.3], k=rnd.randrange(60))) for _ in range(400)), *(" ".join(rnd.choices(["of", "the", "and", "posted", "by"], k=40)) for _ in range(200))]
    for column in (pa.array(rows, pa.string()), pa.array(rows, pa.large_string()).slice(3, 500), pa.array([""]), pa.array([], pa.string())):
        w, texts = words.Words(column), [(x.as_py() or "").encode().lower() for x in column]
        cut = [[w.data[a:b].tobytes() for a, b in zip(w.starts[x:y], w.ends[x:y], strict=True)] for x, y in zip(w.first, w.first[1:], strict=False)]
        assert cut == [x.split() for x in texts]

    mask = 2**64 - 1

    def mix(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    def word(x):
        h = mix(len(x) * 0x9E3779B97F4A7C15 & mask)
        for k in range(0, len(x), 8):
            h = mix(((h ^ int.from_bytes(x[k : k + 8], "little")) * 0x9E3779B97F4A7C15 + k + 1) & mask)
        return h

    def runs(x):
        out, place = [], 0
        for i, h in enumerate(hs := [word(t) for t in x.split()]):
            place = 0 if not i or hs[i - 1] % 4 == 0 else place + 1
            if not place:
                out.append(0)
            out[-1] = (out[-1] + mix((h + mix(place)) & mask)) & mask
        return np.array([mix(r) for r in out], "<u8").tobytes()

    column, given = pa.array(rows, pa.string()), []
    assert words.Words(column).hashes().tolist() == [word(t) for x in rows for t in (x or "").encode().lower().split()]
    for at in (words, templates):
        monkeypatch.setattr(at, "mix", lambda h, f=at.mix: given.append(len(h)) or f(h))
    assert templates._runs(column) == [runs((x or "").encode().lower()) for x in rows]
    assert sum(given) < 3 * len(words.Words(column).starts)


def test_templates_independent_documents(spark):
    """Blank lines, inner lines of a block and lines of few documents count; near copies are one document."""
    rnd = random.Random(8)
    own = lambda k: " ".join("".join(rnd.choices("abcdefghij", k=7)) for _ in range(k))
    block = [own(5) for _ in range(4)]
    docs = [(i, "\n\n".join([own(30), "read more about us here", own(25)])) for i in range(12)]
    docs += [(20 + i, "\n".join([own(30), *block, own(25)])) for i in range(9)]
    docs += [(40 + i, "\n".join([own(30), "seen in two documents only", own(25)])) for i in range(2)]
    page = [own(40) for _ in range(5)]
    docs += [(60 + i, "\n".join([*page[: i % 5], page[i % 5] + " " + own(1), *page[i % 5 + 1 :]])) for i in range(10)]
    got = {r.doc_id: r.dropped_lines for r in templates.drop_templates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert all(got[i] == [2] for i in range(12))
    assert all(got[20 + i] == [1, 2, 3, 4] for i in range(9))
    assert got[40] == got[41] == [1]
    assert all(got[60 + i] == [] for i in range(10))
