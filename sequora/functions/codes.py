"""Column functions: base codes, packed sites and distances, costs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base letters with their codes (0 missing, 1 A, 2 C, 3 G, 4 T or U), and complements.
LETTERS, CODES, COMPLEMENT_CODES = "acgtunrykmswbdhv-", "12344000000000000", "43211000000000000"
#: Bases that each ambiguity letter of codes 0 to 4 stands for.
BASES = {1: "A", 2: "C", 3: "G", 4: "T", 0: "ACGT"}


def bases(text: Column) -> Column:
    """The base letters of a text, lower case."""
    return F.regexp_replace(F.lower(text), f"[^{LETTERS}]", "")


def _checked(seq: Column) -> Column:
    other = F.regexp_replace(seq, f"[{LETTERS}]+", "")
    return F.when(other == "", seq).when(seq.isNotNull(), F.raise_error(F.concat(F.lit("no base letters: "), F.substring(other, 1, 20))))


def encode(seq: Column) -> Column:
    """Codes as a string of digits; a letter that is no base is an error (see bases)."""
    return F.translate(_checked(F.lower(seq)), LETTERS, CODES)


def encode_reverse(seq: Column) -> Column:
    """Codes of the reverse complement."""
    return F.translate(F.reverse(_checked(F.lower(seq))), LETTERS, COMPLEMENT_CODES)


def code_array(digits: Column) -> Column:
    return F.transform(F.filter(F.split(digits, "", -1), lambda c: c != ""), lambda c: c.cast("tinyint"))


def cost_table(transition: float = 1, transversion: float = 2) -> dict[tuple[int, int], float]:
    """Mean cost of each pair of codes over the bases they stand for; 0 is any base."""

    def one(a, b):
        return 0 if a == b else transition if {a, b} in ({"A", "G"}, {"C", "T"}) else transversion

    return {(x, y): sum(one(a, b) for a in BASES[x] for b in BASES[y]) / (len(BASES[x]) * len(BASES[y])) for x in BASES for y in BASES}


def parse_cost(code: str) -> dict[tuple[int, int], float]:
    """'id' or 's<number>v<number>'."""
    if code == "id":
        return {(x, y): float(x != y or x == 0) for x in BASES for y in BASES}
    m = re.fullmatch(r"s(\d+(?:\.\d+)?)v(\d+(?:\.\d+)?)", code)
    if not m:
        raise ValueError(f"no cost matrix named {code!r}")
    return cost_table(float(m[1]), float(m[2]))


def words(n_sites: int) -> int:
    """64-bit words that hold a bit per site."""
    return -(-n_sites // 64)


def planes(codes: Column, n_sites: int) -> list[Column]:
    """Known, class and base planes, a bit per site in arrays of 64-bit words: purine or pyrimidine, and which of the two."""

    def plane(test, j):
        part = F.slice(codes, 64 * j + 1, 64)
        bits = F.transform(part, lambda c, i: F.when(test(c), F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))

    tests = [lambda c: c > 0, lambda c: (c == 1) | (c == 3), lambda c: c >= 3]
    return [F.array(*[plane(test, j) for j in range(words(n_sites))]) for test in tests]


def packed_distance(a: str, b: str, n_sites: int, cost: dict[tuple[int, int], float] | None = None) -> Column:
    """Four times the distance of two rows of planes (a_k, a_c, a_b against b_...), by counting bits: one count for each different cost.

    cost: of each pair of codes 0 to 4 (by default a transition 1, a transversion 2, unknown sites their mean). The result is a
    whole number where four times every cost is one.
    """
    cost = cost or cost_table()
    if set(cost) != {(x, y) for x in BASES for y in BASES}:
        raise ValueError("a cost is needed for each pair of the codes 0 to 4")
    groups: dict[float, list] = {}
    for pair, value in sorted(cost.items()):
        if value:
            groups.setdefault(4 * value, []).append(pair)
    total = F.lit(0)
    for j in range(words(n_sites)):
        here = min(64, n_sites - 64 * j)
        mask = F.lit(-1 if here == 64 else (1 << here) - 1).cast("bigint")

        def code_planes(x, j=j, mask=mask):
            k, c, s = (F.get(f"{x}_{p}", F.lit(j)) for p in "kcb")
            no = F.bitwise_not
            return [no(k).bitwiseAND(mask), k.bitwiseAND(c).bitwiseAND(no(s)), k.bitwiseAND(no(c)).bitwiseAND(no(s)), k.bitwiseAND(c).bitwiseAND(s), k.bitwiseAND(no(c)).bitwiseAND(s)]

        of, to = code_planes(a), code_planes(b)
        for value, pairs in groups.items():
            by: dict[int, Column] = {}
            for x, y in pairs:
                by[x] = to[y] if x not in by else by[x].bitwiseOR(to[y])
            bits = None
            for x, right in by.items():
                one = of[x].bitwiseAND(right)
                bits = one if bits is None else bits.bitwiseOR(one)
            total = total + F.lit(int(value) if float(value).is_integer() else float(value)) * F.bit_count(bits)
    return total.cast("bigint" if all(float(v).is_integer() for v in groups) else "double")


def weights(d: Column, first: Column, last: Column) -> dict[str, Column]:
    """The three weightings of a neighbour at distance d, the nearest being first and the farthest last."""
    w = F.when(last == first, F.lit(1.0)).otherwise((last - d) / (last - first))
    return {"u": F.lit(1.0), "w": w, "d": F.when(last == first, F.lit(1.0)).otherwise(w * (last + first) / (last + d))}


def lowest_known(*columns: str) -> Column:
    """The last of the columns, from high to low rank, that is known."""
    return F.coalesce(*[F.col(c) for c in reversed(columns)])
