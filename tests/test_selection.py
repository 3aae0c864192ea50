import random
from collections import Counter

from tracequarry.operators.selection import quota_select


def greedy(rows, per_cell, per_parent, per_operator):
    seen, cells, parents, operators, out = set(), Counter(), Counter(), Counter(), {}
    for i, score, fp, cell, parent, op in sorted(rows, key=lambda r: (-r[1], r[0])):
        if fp in seen:
            out[i] = "semantic_duplicate"
        elif cells[cell] >= per_cell:
            out[i] = "archive_cell_full"
        elif parents[parent] >= per_parent:
            out[i] = "parent_quota"
        elif operators[op] >= per_operator:
            out[i] = "operator_quota"
        else:
            out[i] = None
            seen.add(fp)
            cells[cell] += 1
            parents[parent] += 1
            operators[op] += 1
    return out


def test_same_as_one_by_one(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.randrange(40)), rng.randrange(90), f"c{rng.randrange(60)}", rng.randrange(25), f"o{rng.randrange(3)}") for i in range(150)]
    df = spark.createDataFrame(rows, "id long, score double, fingerprint long, cell string, parent long, operator string")
    for quotas in ((1, 2, 10), (2, 3, 100)):
        got = {r.id: r.reason for r in quota_select(df, *quotas).collect()}
        assert got == greedy(rows, *quotas)


def test_prefixes_leave_the_same(spark):
    """Folded by one task or decided in rounds, candidates of short prefixes come out as one by one; scores tie."""
    rng = random.Random(2)
    rows = [(i, float(rng.randrange(30)), rng.randrange(90), f"c{rng.randrange(60)}", rng.randrange(25), f"o{rng.randrange(3)}") for i in range(150)]
    df = spark.createDataFrame(rows, "id long, score double, fingerprint long, cell string, parent long, operator string")
    for folded in (0, 1000):
        got = {r.id: r.reason for r in quota_select(df, 1, 2, 10, prefix=60, folded=folded).collect()}
        assert got == greedy(rows, 1, 2, 10)
