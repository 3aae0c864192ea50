import random

import pytest

from tracequarry.operators.episodes import minimal_plan

SCHEMA = "episode_id long, step long, tool string"


def met(tools, needs):
    return all(sum(t in names for t in tools) >= least for names, least in needs)


def one_by_one(steps, needs):
    """Runs taken out one after another: step -> round."""
    left, gone, turn = list(steps), {}, 0
    while True:
        runs = ((n, i) for n in range(len(left), 0, -1) for i in range(len(left) - n + 1))
        found = next(((n, i) for n, i in runs if met([t for _, t in left[:i] + left[i + n :]], needs)), None)
        if found is None:
            return gone
        turn, (n, i) = turn + 1, found
        gone |= {s: turn for s, _ in left[i : i + n]}
        left = left[:i] + left[i + n :]


def test_same_as_one_by_one_and_nothing_kept_can_go(spark):
    rng = random.Random(3)
    needs = [(("a",), 2), (("b",), 1), (("a", "b", "c"), 5)]
    episodes = {e: [(s * 3, rng.choice(["a", "b", "c", "d", "d", None])) for s in range(rng.randrange(1, 30))] for e in range(60)}
    df = spark.createDataFrame([(e, *s) for e, steps in episodes.items() for s in steps], SCHEMA)
    got = {(r.episode_id, r.step): (r.met, r.removed_in) for r in minimal_plan(df, needs).collect()}
    assert len(got) == df.count()
    assert {m for m, _ in got.values()} == {True, False}
    for e, steps in episodes.items():
        fine = met([t for _, t in steps], needs)
        gone = one_by_one(steps, needs) if fine else {}
        assert {s: got[e, s] for s, _ in steps} == {s: (fine, gone.get(s)) for s, _ in steps}
        kept = [t for s, t in steps if fine and got[e, s][1] is None]
        assert not any(met(kept[:i] + kept[j:], needs) for i in range(len(kept)) for j in range(i + 1, len(kept) + 1))


def test_no_rows_and_no_needs(spark):
    assert minimal_plan(spark.createDataFrame([], SCHEMA), [(("a",), 1)]).count() == 0
    with pytest.raises(ValueError):
        minimal_plan(spark.createDataFrame([], SCHEMA), [(("a",), 0)])
