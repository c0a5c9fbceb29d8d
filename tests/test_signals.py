"""Hand-computed signals, combinations and rule fits."""

import itertools
import random

import pytest

from sequora.operators import signals as S


def long(spark, rows):
    """rows: (seq, taxon, codes)."""
    return spark.createDataFrame([(q, t, s, c) for q, t, codes in rows for s, c in enumerate(codes)], "seq bigint, taxon bigint, site bigint, code bigint")


ROWS = [(1, 7, [1, 2, 3]), (2, 7, [1, 2, 0]), (3, 8, [1, 3, 3]), (4, 8, [2, 2, 3]), (5, None, [1, 2, 4])]


def test_single_values(spark):
    got = {tuple(r) for r in S.single_values(long(spark, ROWS), "taxon").collect()}
    assert got == {(7, 0, 1), (7, 1, 2), (7, 2, 3), (8, 2, 3)}
    assert {tuple(r) for r in S.single_values(long(spark, ROWS), "taxon", 1.0).collect()} == {(7, 0, 1), (7, 1, 2), (8, 2, 3)}


def test_vertical_and_horizontal(spark):
    c = long(spark, ROWS)
    # taxon 7: sites 0 and 1 each leave two of three others; together only row 5
    assert [tuple(r) for r in S.vertical(c, "taxon").where("concept = 7").orderBy("step").collect()] == [(7, 1, 0, 1, 2), (7, 2, 1, 2, 1)]
    h = S.horizontal(c, "taxon")
    assert [r.site for r in h.where("concept = 7").orderBy("step").collect()] == [0, 1, 2]
    assert h.where("concept = 7").orderBy("step").collect()[-1].left == 0
    assert {tuple(r) for r in S.solved_members(c, h, "taxon").where("taxon = 7").collect()} == {(1, 7)}


def test_greedy_against_rows(spark):
    rnd = random.Random(3)
    rows = [(i, i % 3 if i % 11 else None, [rnd.choice([0, 1, 1, 2]) for _ in range(5)]) for i in range(40)]
    signs = [(t, s, 1) for t in range(3) for s in range(5) if (s + t) % 4]
    got = S.greedy_signal(long(spark, rows), spark.createDataFrame(signs, "taxon bigint, site bigint, code bigint"), "taxon").collect()
    want = []
    for t in range(3):
        left, free = [r for r in rows if r[1] != t], [s for u, s, _ in signs if u == t]
        for step in itertools.count(1):
            if not left or not free:
                break
            site = min(free, key=lambda s: (sum(r[2][s] == 1 for r in left), s))
            kept = [r for r in left if r[2][site] == 1]
            if len(kept) == len(left):
                break
            left = kept
            free.remove(site)
            want.append((t, step, site, 1, len(left)))
    assert sorted(tuple(r) for r in got) == want


def test_greedy_does_not_pair_rows_with_taxa(spark, monkeypatch):
    """Rows meet taxa as bitmaps in several chunks and blocks, with sites that some rows lack; before, all rows were joined with all taxa by site."""
    monkeypatch.setattr(S, "CHUNK", 30)
    monkeypatch.setattr(S, "ROWS", 40)
    rnd = random.Random(6)
    rows = [(i, i // 4 if i % 9 else None, {s: rnd.choice([0, 1, 1, 1, 2]) for s in range(6) if rnd.random() < 0.8}) for i in range(200)]
    cells = spark.createDataFrame([(q, t, s, c) for q, t, codes in rows for s, c in codes.items()], "seq bigint, taxon bigint, site bigint, code bigint")
    signs = {t: {s: 1 for s in range(6) if (s + t) % 3} for t in range(50)}
    got = S.greedy_signal(cells, spark.createDataFrame([(t, s, c) for t, x in signs.items() for s, c in x.items()], "taxon bigint, site bigint, code bigint"), "taxon")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
    want = []
    for t, free in signs.items():
        left, step = [c for _, own, c in rows if own != t and set(c) & set(free)], 0
        free = dict(free)
        while left and free:
            site = min(sorted(free), key=lambda s: sum(c.get(s) == 1 for c in left))
            kept = [c for c in left if c.get(site) == 1]
            if len(kept) == len(left):
                break
            left, step = kept, step + 1
            want.append((t, step, site, free.pop(site), len(left)))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_signal_takes_the_best_combination(spark):
    c = long(spark, [(1, 7, [1, 1, 1]), (2, 7, [1, 2, 2]), (3, None, [1, 1, 2])])
    signs = S.single_values(c, "taxon")
    m = S.score_matrix(signs.where("false"), signs, spark.createDataFrame([(7, 2.0, 9.0)], "taxon bigint, ns double, info double"), "taxon")
    assert [tuple(r) for r in m.collect()] == [(0, 1, 2.0)]
    more = m.union(spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0)], m.schema))
    got = {r.seq: r.signal for r in S.signal(c, more, signs, S.combinations(c, "taxon"), "taxon").collect()}
    assert got == {1: 3.0, 2: 3.0, 3: 3.0}  # row 3 has half of each combination, never both


def test_compatible(spark):
    c = long(spark, ROWS)
    rules = spark.createDataFrame([(7, 0, 2), (7, 2, 8), (8, 1, 8)], "taxon bigint, site bigint, allowed bigint")
    fits = S.compatible(c, rules, "taxon")
    assert {tuple(r) for r in fits.collect()} == {(1, 7), (2, 7), (3, 7), (3, 8)}
    assert {r.seq: r.verdict for r in S.verdict(c, fits).collect()} == {1: "7", 2: "7", 3: "Unclear", 4: "Unknown", 5: "Unknown"}


def test_empty(spark):
    c = long(spark, ROWS).where("false")
    assert S.vertical(c, "taxon").count() == S.combinations(c, "taxon").count() == S.single_values(c, "taxon").count() == 0


@pytest.mark.parametrize("confirmed,fitting,status", [([1, 2], [3], "Full"), ([], [], "Full"), ([1], [3, 4, 5], "Partial"), ([], [3, 4], "Partial"), ([], [3, 4, 5], "No")])
def test_learning_status(spark, confirmed, fitting, status):
    members = long(spark, ROWS).select("seq", "taxon").distinct()
    a = spark.createDataFrame([(q, 7) for q in confirmed], "seq bigint, taxon bigint")
    b = spark.createDataFrame([(q, 7) for q in fitting], "seq bigint, concept bigint")
    assert S.learning_status(members, a, b, "taxon").where("taxon = 7").first().status == status
