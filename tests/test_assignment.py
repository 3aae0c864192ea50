import random

import pytest
from pyspark.sql import functions as F

from tracequarry.operators.assignment import Card, assign, hits

CARDS = [Card("m", "x", ("ab",)), Card("b", "y", ("b", "cc")), Card("z", "x", ("c",)), Card("a", "w", ())]


def one_by_one(rows):
    used, families, out = {c.id: 0 for c in CARDS}, {c.family: 0 for c in CARDS}, {}
    for i, found in sorted(rows):
        score = lambda c: 5 * found[CARDS.index(c)] - 4 * used[c.id] - 2 * families[c.family]  # noqa: E731, B023
        best = max(CARDS, key=lambda c: (used[c.id] == 0, families[c.family] == 0, score(c), c.id))
        used[best.id] += 1
        families[best.family] += 1
        out[i] = best.id
    return out


@pytest.mark.parametrize("most", [0, 3, 200])
@pytest.mark.parametrize("parts", [1, 7])
def test_same_as_one_by_one(spark, most, parts):
    rng = random.Random(most)
    rows = [(i, [rng.randrange(most + 1) if rng.random() < 0.5 else 0 for _ in CARDS]) for i in rng.sample(range(10**6), 400)]
    got = {r.id: r.operator for r in assign(spark.createDataFrame(rows, "id long, hits array<long>"), CARDS, parts).collect()}
    assert got == one_by_one(rows)


def test_hits_count_as_text_does(spark):
    texts = ["", None, "ABabccc", "cccc b", "aab" * 9]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", hits(F.col("text"), CARDS).alias("h"))
    for r in df.collect():
        assert r.h == [sum((r.text or "").lower().count(h) for h in c.hints) for c in CARDS]


def test_no_rows_and_no_cards(spark):
    empty = spark.createDataFrame([], "id long, hits array<long>")
    assert assign(empty, CARDS).count() == 0
    with pytest.raises(ValueError):
        assign(empty, [])
