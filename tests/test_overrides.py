import random

from tracequarry.operators.episodes import final_states, overridden_states

RULES = {"put": [("set", "a", 3.0), ("increment", "b", 1.0)], "add": [("increment", "a", 2.0)], "drop": [("delete", "a", 0.0)], "both": [("delete", "b", 0.0), ("increment", "b", 4.0)]}
VARIANTS = {"plain": {}, "a": {"a": 7.0}, "none": {"a": None, "b": 1.0}, "new": {"c": 5.0, "b": -2.0}}


def walk(tools, start):
    state, touched = {k: v for k, v in start.items() if v is not None}, set()
    for tool in tools:
        for op, key, amount in RULES.get(tool, []):
            if op == "increment":
                state[key] = state.get(key, 0.0) + amount
                continue
            touched.add(key)
            state.pop(key, None)
            if op == "set":
                state[key] = amount
    return {k: state.get(k) for k in "abc"}, len(touched & set(start))


def test_replay_from_overridden_states(spark):
    rng = random.Random(5)
    episodes = {e: [rng.choice(["put", "add", "add", "drop", "both", "other", None]) for _ in range(rng.randrange(1, 8))] for e in range(150)}
    df = spark.createDataFrame([(e, s, t) for e, tools in episodes.items() for s, t in enumerate(tools)], "episode_id long, step long, tool string")
    got = {(r.episode_id, r.variant): (r.state.asDict(), r.hidden) for r in overridden_states(df, VARIANTS, RULES).collect()}
    assert got == {(e, v): walk(tools, start) for e, tools in episodes.items() for v, start in VARIANTS.items()}
    plain = {(r.episode_id, r.key): r.value for r in final_states(df, RULES).collect()}
    assert plain == {(e, k): x for (e, v), (state, _) in got.items() if v == "plain" for k, x in state.items() if x is not None}


def test_no_rows(spark):
    assert overridden_states(spark.createDataFrame([], "episode_id long, step long, tool string"), VARIANTS, RULES).count() == 0
