import random

import pytest

from tracequarry.operators.conversations import nearest_rank
from tracequarry.operators.ordering import global_ordinal, values_at


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_ordinals_follow_the_key(spark, parts):
    rng = random.Random(1)
    keys = rng.sample(range(-(10**6), 10**6), 500)
    df = spark.createDataFrame([(k, str(k)) for k in keys] + [(None, "none")], "k long, t string").repartition(5)
    out = global_ordinal(df, "k", parts=parts)
    assert out.columns == ["k", "t", "ordinal"]
    got = sorted(out.collect(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in got] == list(range(1, 502)) and [r.k for r in got] == [*sorted(keys), None]
    assert global_ordinal(df.limit(0), "k", parts=parts).count() == 0


@pytest.mark.parametrize("parts", [None, 6])
def test_values_at_ranks(spark, parts):
    rng = random.Random(2)
    values = [rng.choice([1.5, 2.0, rng.random()]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    ranks = [0, 1, 57, 199, 398, 399]
    assert values_at(df, "v", ranks, parts) == [sorted(values)[r] for r in ranks]


def test_nearest_rank(spark):
    for n in (1, 2, 3, 10, 11):
        df = spark.createDataFrame([(i * i,) for i in range(n)] + [(None,)], "v long")
        r = nearest_rank(df, "v", [0.5, 0.9]).first()
        assert (r.p50, r.p90) == (round((n - 1) * 0.5) ** 2, round((n - 1) * 0.9) ** 2)
    empty = nearest_rank(spark.createDataFrame([], "v long"), "v", [0.5])
    assert empty.columns == ["p50"] and empty.first().p50 is None
