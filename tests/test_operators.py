"""Hand-computed cases of the operators."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sequora.functions import codes as C
from sequora.operators import concepts, intervals, metrics, neighbours, sites, taxonomy
from sequora.sources import tables


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_encode(spark):
    assert one(spark, C.encode(F.lit("ACGTUN-R"))) == "12344000"
    assert one(spark, C.encode_reverse(F.lit("AAC"))) == "344"
    assert one(spark, C.code_array(F.lit("102"))) == [1, 0, 2]


def test_cost():
    t = C.cost_table(1, 2)
    assert (t[1, 3], t[2, 4], t[1, 2], t[1, 0], t[0, 0]) == (1, 1, 2, 1.25, 1.25)
    assert C.cost_table(1, 1)[1, 0] == 0.75
    assert C.parse_cost("s1v2")[1, 2] == 2 and C.parse_cost("id")[0, 0] == 1
    with pytest.raises(ValueError):
        C.parse_cost("x")


def test_packed_distance_equals_costs(spark):
    import random

    rnd, t = random.Random(1), C.cost_table(1, 2)
    rows = [(i, [rnd.randrange(5) for _ in range(16)]) for i in range(12)]
    df = spark.createDataFrame(rows, "seq bigint, codes array<int>")
    for q, r, d4 in neighbours.distances(df, df, 16).collect():
        assert d4 == 4 * sum(t[a, b] if a and b else 1.25 for a, b in zip(rows[q][1], rows[r][1], strict=True))


def test_criteria_and_weights(spark):
    d = spark.createDataFrame([(0, i, x) for i, x in enumerate([0, 0, 1, 2, 2, 3])], "q bigint, r bigint, d4 bigint")
    n = {(c, k): neighbours.neighbours(d, k, c).count() for c in ("orbit", "neighbour") for k in (2, 3)}
    assert n == {("orbit", 2): 3, ("neighbour", 2): 2, ("orbit", 3): 5, ("neighbour", 3): 3}
    w = spark.createDataFrame([(0, i, x) for i, x in enumerate([1, 2, 3])], "q bigint, r bigint, d4 bigint")
    got = [(r.w, round(r.d, 6)) for r in neighbours.neighbours(w, 3).orderBy("r").collect()]
    assert got == [(1.0, 1.0), (0.5, 0.4), (0.0, 0.0)]


def test_winner_tie(spark):
    s = spark.createDataFrame([(1, 5, 1.5), (1, 6, 1.5), (2, 5, 1.5), (2, 6, 1.0)], "q bigint, genus bigint, w double")
    assert {r.q: r.pred for r in neighbours.winner(s, ["q"], "genus", "w").collect()} == {1: -1, 2: 5}


def test_collapse(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 2, 3]), (3, [1, 0, 3]), (4, [0, 2, 1])], "seq bigint, codes array<int>")
    kept = sites.full_collapse(df, 1 / 3)
    assert sorted(r.rep for r in kept.collect()) == [1, 4]
    assert {r.seq: r.branch for r in sites.members(df, kept).collect()} == {1: 1, 2: 1, 3: -1, 4: 4}
    assert [r.rep for r in sites.full_collapse(df, 0).collect()] == [1]


def test_consensus(spark):
    df = spark.createDataFrame([(1, 1, 5, 9), (1, 1, 5, 8), (2, 1, None, 9), (2, 1, None, 9)], "branch int, a int, b int, c int")
    assert {r.branch: r.lowest for r in sites.consensus(df, ["a", "b", "c"]).collect()} == {1: 5, 2: 1}
    assert {r.branch: r.lowest for r in sites.consensus(df, ["a", "b", "c"], skip_unknown=True).collect()}[2] == 9


def test_entropy(spark):
    df = spark.createDataFrame([(0, c) for c in (1, 1, 2, 2, 0)] + [(1, c) for c in (1, 1, 0)] + [(2, 0)], "site int, code int")
    assert {r.site: r.h for r in sites.entropy(sites.code_counts(df, ["site"]), ["site"]).collect()} == {0: 1.0, 1: 0.0, 2: float("inf")}


def test_metrics(spark):
    calls = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, -1)], "real int, pred int")
    got = {r.taxon: r for r in metrics.scores(metrics.confusion(calls)).collect()}
    assert (got[1].tp, got[1].fp, got[1].fn, got[1].acc) == (1, 0, 1, 0.75)
    assert (got[2].tp, got[2].fp, got[2].fn) == (1, 1, 1)
    ce = spark.createDataFrame([(1.0,), (math.exp(-2),), (-1.0,)], "s double").agg(F.avg(metrics.cross_entropy(F.col("s")))).first()[0]
    assert ce == pytest.approx(4)


def test_intervals(spark):
    r = spark.createDataFrame([(0, 0, 50), (1, 60, 100)], "id int, start int, end int")
    q = spark.createDataFrame([(0, 40, 80)], "id int, start int, end int")
    for size in (7, 100):
        assert sorted((x.start, x.end) for x in intervals.overlaps(r, q, 10, size).collect()) == [(40, 50), (60, 80)]
    cov = spark.createDataFrame([(i, c) for i, c in enumerate([1, 10, 10, 10, 1, 9, 9, 9, 9, 0])], "site bigint, coverage bigint")
    assert [(m.start, m.end) for m in intervals.mesas(cov).collect()] == [(1, 4), (5, 9)]


def test_overlaps_of_copies(spark):
    """Many equal intervals, equal rows and nulls: each pair as often as row by row, whatever the blocks."""
    rnd = random.Random(7)
    sides = []
    for n in (60, 90):
        rows = [(rnd.randrange(40), s, s + rnd.choice([1, 3, 20])) for s in rnd.choices([0, 2, 9, 10, 31], k=n)]
        sides.append([*rows, rows[0], (None, 9, 12), (1, None, 5), (2, 5, None)])
    r, q = (spark.createDataFrame(x, "id int, start int, end int") for x in sides)
    for least in (1, 3):
        full = ([(i, a, b) for i, a, b in x if a is not None and b is not None] for x in sides)
        pairs = itertools.product(*full)
        want = Counter((i, j, max(a, c), min(b, d)) for (i, a, b), (j, c, d) in pairs if min(b, d) - max(a, c) >= least)
        for size, most, grid in ((4, 5, 3), (100, 2048, 1), (7, 1, 2)):
            assert Counter(tuple(x) for x in intervals.overlaps(r, q, least, size, most, grid).collect()) == want


def test_overlaps_of_one_bin(spark, tmp_path):
    """Pairs of one bin are made by several tasks, and stored in a fraction of a byte each."""
    r, q = (spark.range(n).select("id", F.lit(0).alias("start"), F.lit(9).alias("end")) for n in (200, 20000))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        intervals.overlaps(r, q).write.parquet(f"{tmp_path}/pairs")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = spark.read.parquet(f"{tmp_path}/pairs")
    assert got.count() == got.select("r", "q").distinct().count() == 200 * 20000
    assert got.select(F.input_file_name()).distinct().count() > 1
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * 200 * 20000


def test_windows():
    assert sites.sliding(100, 40, 30) == [(0, 0, 40), (1, 60, 100)]
    with pytest.raises(ValueError):
        sites.sliding(100, 20, 30)
    with pytest.raises(ValueError):
        sites.custom(100, [5], [5])


def test_site_types(spark):
    a, c, g, t = 2, 4, 8, 16
    m = spark.createDataFrame([(0, a, c), (1, a | c, c), (2, a, a | c), (3, a | c, a | c | g), (4, t, t)], "site int, inside bigint, outside bigint")
    assert [r.type for r in concepts.site_types(m).orderBy("site").collect()] == [1, 2, 3, 4, 0]


def test_calls(spark):
    cells = spark.createDataFrame([(1, 1, 1), (1, 2, 3), (2, 1, 1), (2, 2, 4)], "seq int, site int, code int")
    rules = spark.createDataFrame([(7, 1, 2), (7, 2, 4 + 8)], "genus int, site int, allowed bigint")
    assert {r.seq: r.call for r in concepts.calls(cells, rules, "genus").collect()} == {1: True, 2: False}


def test_line_codes(spark):
    assert taxonomy.prefix_codes(["Aa", "Ab", "B"]) == ["Aa", "Ab", "B"]
    g = spark.createDataFrame([("Aa", "root", "x"), ("B", "root", "x"), ("C", "B", "y")], "name string, parent string, rank string")
    assert {r.name: r.code for r in taxonomy.line_codes(g).collect()} == {"Aa": "A", "B": "B", "C": "B.C"}


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">s1 first\nACG\nT\n>s2\nGG\n")
    got = {r.acc: r.seq for r in tables.fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert got == {"s1": "ACGT", "s2": "GG"}
    with pytest.raises(ValueError):
        tables.single_record(tables.fasta(spark, str(tmp_path / "a.fasta")))
    assert tables.separator("a;b;c,d") == ";"


def test_entry_and_oracle_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_distance_any_sites(spark):
    """Against a sum over sites, with as many sites as fit a word, one more, and a default window; costs of any kind."""
    import random

    rnd = random.Random(1)
    odd = C.parse_cost("s1v2") | {(1, 3): 0.75, (4, 0): 3.0}
    for n in (1, 64, 65, 200):
        rows = [(i, [rnd.randrange(5) for _ in range(n)]) for i in range(9)]
        df = spark.createDataFrame(rows, "seq bigint, codes array<int>")
        for cost in (None, C.parse_cost("id"), C.parse_cost("s1v2"), C.parse_cost("s2v5"), odd):
            table = cost or C.parse_cost("s1v2")
            want = {(a, b): 4 * sum(table[x, y] for x, y in zip(p, q, strict=True)) for a, p in rows for b, q in rows if a != b}
            got = {(r.q, r.r): r.d4 for r in neighbours.distances(df, df, n, cost=cost, blocks=3).collect()}
            assert got == want


def test_mesas_slope(spark):
    """A slow slope is one plateau however far it falls; a step of a twentieth of the peak ends it."""
    def found(c):
        df = spark.createDataFrame(list(enumerate(c)), "site bigint, coverage bigint")
        return [tuple(r) for r in intervals.mesas(df).collect()]

    slope = list(range(100, 78, -2))
    assert found(slope) == [(0, 11, 11, 90.0)]
    assert found([*slope, 40, 40, 40, 40]) == [(0, 11, 11, 90.0), (11, 15, 4, 40.0)]
    assert found([5, 5, 5, 50, 50, 50, 5, 5, 5, 100, 100, 100]) == [(3, 6, 3, 50.0), (9, 12, 3, 100.0)]


def test_encode_refuses_other_letters(spark):
    df = spark.createDataFrame([("ACGTUN-R",)], "s string")
    assert df.select(C.encode(F.col("s"))).first()[0] == "12344000"
    with pytest.raises(Exception, match="no base letters"):
        spark.createDataFrame([("ACGJ",)], "s string").select(C.encode(F.col("s"))).collect()


def test_nearest_equals_all_pairs(spark, monkeypatch):
    """Blocks of a few rows, copies, short rows, unknown taxa and groups: the neighbours of all pairs; tallies add up to them."""
    import random

    monkeypatch.setattr(neighbours, "REFERENCES", 9)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    monkeypatch.setattr(neighbours, "COLUMNS", 4)
    monkeypatch.setattr(neighbours, "HELD", 5)
    rnd = random.Random(5)
    rows = [(w, i, [rnd.randrange(5) for _ in range(4 if i % 6 else 3)], None if i % 7 == 0 else i % 3) for w in range(2) for i in range(40)]
    df = spark.createDataFrame(rows, "w bigint, seq bigint, codes array<int>, taxon bigint")
    cost = C.cost_table(1, 3)
    near = lambda d, c: sorted((r.w, r.q, r.r, r.d4, r.u, round(r["w2"], 9), round(r.d, 9)) for r in neighbours.neighbours(d.withColumnRenamed("w", "g"), 3, c, ["g", "q"]).withColumnRenamed("w", "w2").withColumnRenamed("g", "w").collect())
    for criterion in ("orbit", "neighbour"):
        full = None
        for w in range(2):
            one = neighbours.distances(df.where(f"w = {w}"), df.where(f"w = {w}"), 4, cost=cost).withColumn("w", F.lit(w).cast("bigint"))
            full = one if full is None else full.unionByName(one)
        want = near(full, criterion)
        pairs = neighbours.nearest(df, df, 4, 3, criterion, by=["w"], cost=cost)
        assert want and near(pairs, criterion) == want
        tally = neighbours.neighbour_counts(neighbours.nearest(df, df, 4, 3, criterion, by=["w"], taxon="taxon", cost=cost).withColumnRenamed("w", "g"), 3, criterion, ["g", "q"])
        got = {(r.g, r.q, r.taxon): (r.n, round(r.u, 9), round(r.w, 9), round(r.d, 9), round(r.mean_d, 9), round(r.std_d, 6)) for r in neighbours.support_counts(tally, ["g", "q"], "taxon").collect()}
        named = neighbours.neighbours(full.withColumnRenamed("w", "g"), 3, criterion, ["g", "q"]).join(df.where("w = 0").select(F.col("seq").alias("r"), "taxon"), "r")
        assert got == {(r.g, r.q, r.taxon): (r.n, round(r.u, 9), round(r.w, 9), round(r.d, 9), round(r.mean_d, 9), round(r.std_d, 6)) for r in neighbours.support(named, ["g", "q"], "taxon").collect()}
    assert neighbours.nearest(df.where("false"), df, 4, 3).count() == 0 and neighbours.nearest(df, df.where("false"), 4, 3).count() == 0
    with pytest.raises(ValueError):
        neighbours.nearest(df, df, 4, 3, cost=C.cost_table(1, 0.3))


def test_fitting_equals_calls(spark, monkeypatch):
    """Blocks of a few rows, taxa without a rule, missing codes: the pairs that rules joined by site give."""
    import random

    from sequora.operators import signals

    monkeypatch.setattr(concepts, "BLOCK", 7)
    rnd = random.Random(6)
    aln = spark.createDataFrame([(i, [rnd.randrange(5) for _ in range(3)]) for i in range(30)], "seq bigint, codes array<int>")
    rules = spark.createDataFrame([(t, s, rnd.randrange(1, 32)) for t in range(20) for s in range(3) if rnd.random() < 0.6], "taxon bigint, site int, allowed bigint")
    cells = aln.select("seq", F.posexplode("codes").alias("site", "code"))
    want = sorted((r.seq, r.concept, r.rules) for r in concepts.calls(cells, rules, "taxon").where("call").collect())
    assert want and sorted(map(tuple, concepts.fitting(aln, rules, "taxon", 3).collect())) == want
    want = sorted(map(tuple, signals.compatible(cells, rules, "taxon").collect()))
    assert sorted(map(tuple, concepts.fitting(aln, rules, "taxon", 3, True).select("seq", "concept").collect())) == want
    assert concepts.fitting(aln, rules.where("false"), "taxon", 3).count() == 0


def test_scores_read_the_confusion_once(spark):
    """A second or third use of the table would search all neighbours again."""
    calls = spark.createDataFrame([(1, "a", 5, 5), (1, "b", 5, 6), (1, "c", 6, -1), (2, "a", 6, 6), (2, "b", None, 5)], "w bigint, q string, real bigint, pred bigint")
    got = metrics.scores(metrics.confusion(calls, ["w"]), ["w"])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert sorted((r.w, r.taxon, r.tp, r.fp, r.fn, round(r.acc, 6)) for r in got.collect()) == [(1, 5, 1, 0, 1, 0.666667), (1, 6, 0, 1, 1, 0.333333), (2, 6, 1, 0, 0, 1.0)]
