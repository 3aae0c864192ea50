import json
import random

from pyspark.sql import functions as F

from tracequarry.functions.json_edits import kept_paths, patch_text, patched, sliced
from tracequarry.operators.bundles import bundles, contract_errors, contracts, v11_contracts
from tracequarry.operators.json_edits import complete, r5_json_patch, state_effects, state_types


def made(rng, depth=3):
    kind = rng.randrange(6 if depth else 3)
    if kind >= 4:
        return {rng.choice(["a", "b", "c/d", "e~f"]): made(rng, depth - 1) for _ in range(rng.randrange(4))}
    if kind == 3:
        return [made(rng, depth - 1) for _ in range(rng.randrange(3))]
    return [None, rng.randrange(3), rng.choice("xyz")][kind]


def edited(rng, value):
    """The value with some parts made anew, so that pairs share most of their trees."""
    if isinstance(value, dict) and rng.random() < 0.85:
        out = {k: edited(rng, v) for k, v in value.items() if rng.random() < 0.85}
        return out | ({rng.choice("abg"): made(rng, 2)} if rng.random() < 0.4 else {})
    return made(rng, 2) if rng.random() < 0.3 else value


def test_effects_lead_from_one_tree_to_the_other(spark):
    rng = random.Random(1)
    pairs = [(i, a, edited(rng, a)) for i, a in enumerate([made(rng, 4) for _ in range(150)] + [{"a": made(rng, 4), "b": made(rng, 4)} for _ in range(150)])]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, a, b in pairs], "id long, before string, after string")
    effects = {}
    for r in state_effects(df).collect():
        effects.setdefault(r.id, []).append(r)
    for i, a, b in pairs:
        own = effects.get(i, [])
        paths = [r.path for r in own]
        assert not any(p != q and q.startswith(p + "/") for p in paths for q in paths)
        if "" in paths:
            assert len(own) == 1 and json.loads(own[0].value) == b
            continue
        assert bool(own) == (json.dumps(a, sort_keys=True) != json.dumps(b, sort_keys=True))
        todo = [{"op": "remove" if r.op == "delete" else "add", "path": r.path} | ({} if r.op == "delete" else {"value": json.loads(r.value)}) for r in own]
        if todo:
            got = patch_text(json.dumps(a), json.dumps(todo), None)
            assert got["error"] is None and json.loads(got["document"]) == b


def test_patches(spark):
    document = json.dumps({"plan": {"steps": [1, 2, 3], "a/b": {"x~y": 0}}, "other": 1})
    cases = [
        ([{"op": "add", "path": "/plan/steps/-", "value": 4}], {"plan": {"steps": [1, 2, 3, 4], "a/b": {"x~y": 0}}, "other": 1}),
        ([{"op": "add", "path": "/plan/steps/0", "value": 0}, {"op": "remove", "path": "/plan/steps/3"}], {"plan": {"steps": [0, 1, 2], "a/b": {"x~y": 0}}, "other": 1}),
        ([{"op": "replace", "path": "/plan/a~1b/x~0y", "value": [1]}], {"plan": {"steps": [1, 2, 3], "a/b": {"x~y": [1]}}, "other": 1}),
        ([{"op": "remove", "path": "/plan"}, {"op": "add", "path": "/plan", "value": None}], {"plan": None, "other": 1}),
        ([{"op": "remove", "path": "/plan/none"}], "0:no_target"),
        ([{"op": "add", "path": "/plan/new", "value": 1}, {"op": "replace", "path": "/plan/steps/3", "value": 1}], "1:out_of_range"),
        ([{"op": "replace", "path": "/plan/steps/01", "value": 1}], "0:bad_index"),
        ([{"op": "replace", "path": "/plan/steps/-", "value": 1}], "0:bad_index"),
        ([{"op": "add", "path": "/plan/steps/0/x", "value": 1}], "0:scalar"),
        ([{"op": "add", "path": "/other", "value": 1}], "0:forbidden_root"),
        ([{"op": "add", "path": "plan", "value": 1}], "0:bad_path"),
        ([{"op": "add", "path": "/plan/x"}], "0:no_value"),
        ([{"op": "move", "path": "/plan/x"}], "0:bad_operation"),
        ([], "bad_batch"),
        ([{"op": "add", "path": "/plan/x", "value": 1}] * 65, "bad_batch"),
        ("no list", "bad_batch"),
    ]
    rows = [(i, document, json.dumps(todo)) for i, (todo, _) in enumerate(cases)]
    df = spark.createDataFrame([*rows, (98, None, "[]"), (99, "{", "[]")], "id long, d string, o string")
    got = {r.id: r.p for r in df.select("id", patched(df.d, df.o, ["plan"]).alias("p")).collect()}
    for i, (_, expected) in enumerate(cases):
        assert (got[i].error or json.loads(got[i].document)) == expected
        assert (got[i].document is None) == isinstance(expected, str)
    assert got[98].error == got[99].error == "not_json"


def types_of(values, path):
    """(type, nullable, present) of a path over values, walked one by one."""
    kinds, present = set(), 0
    for value in values:
        for token in path[1:].split("/") if path else []:
            value = value.get(token.replace("~1", "/").replace("~0", "~"), "\0") if isinstance(value, dict) else "\0"
        if value != "\0":
            present += 1
            kinds.add("boolean" if isinstance(value, bool) else "null" if value is None else {str: "string", int: "integer", float: "number", list: "list", dict: "object"}[type(value)])
    rest = kinds - {"null"}
    named = "null" if not rest else "number" if rest == {"integer", "number"} else rest.pop() if len(rest) == 1 else "any"
    return named, "null" in kinds, present


def test_types_are_the_least_that_fit_and_states_become_complete(spark):
    rng = random.Random(4)
    values = [{"a": rng.choice([1, 2.5, None]), "b": {k: made(rng, 1) for k in rng.sample("xyz", rng.randrange(3))}, **({"c/d": {"n": rng.randrange(3)}} if rng.random() < 0.5 else {"c/d": None} if rng.random() < 0.3 else {})} for _ in range(80)]
    df = spark.createDataFrame([("g", i, json.dumps(v)) for i, v in enumerate(values)], "`group` string, id long, state string")
    types = {r.path: r for r in state_types(df).collect()}
    assert set(types) >= {"", "/a", "/b", "/b/x", "/c~1d", "/c~1d/n"}
    for path, r in types.items():
        assert (r.type, r.nullable, r.present) == types_of(values, path)
    full = complete(df).collect()
    assert len(full) == len(values)
    for r in full:
        value, old = json.loads(r.state), values[r.id]
        assert {"a", "b", "c/d"} <= set(value) and {"x", "y", "z"} <= set(value["b"]) and (value["c/d"] is None or "n" in value["c/d"])
        assert all(set(v) <= set(value["b"][k]) if isinstance(v, dict) else value["b"][k] == v for k, v in old["b"].items()) and value["a"] == old["a"]
    again = spark.createDataFrame([("g", r.id, r.state) for r in full], "`group` string, id long, state string")
    assert not any(r.missing for r in state_types(again).collect())
    assert {r.id: r.state for r in complete(again).collect()} == {r.id: r.state for r in full}
    assert state_types(df.limit(0)).count() == complete(df.limit(0)).count() == 0


def leaves_under(value, path=()):
    """Paths of scalars and empty containers."""
    inside = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    found = [x for k, v in inside for x in leaves_under(v, (*path, str(k)))]
    return found or [path]


def test_slices_hold_just_the_named_paths(spark):
    cases = [
        ({"a": {"b": [1, {"c": 2, "d": 3}], "e": 4}, "f": 5}, ["/a/b/1/c", "/f"], {"a": {"b": [{"c": 2}]}, "f": 5}),
        ({"a": [{"x": 1, "y": 2}, {"x": 3}]}, ["/a/*/x"], {"a": [{"x": 1}, {"x": 3}]}),
        ({"a/b": {"c~d": 1, "e": 2}}, ["/a~1b/c~0d", "/none/x"], {"a/b": {"c~d": 1}}),
        ({"a": 1, "b": 2}, [""], {"a": 1, "b": 2}),
        ({"a": 1, "b": 2}, [], {}),
        ({"a": 1}, ["/a/b"], {"a": None}),
    ]
    for value, paths, expected in cases:
        df = spark.createDataFrame([(json.dumps(value),), (None,), ("{",)], "t string")
        got = [r.s for r in df.select(sliced(df.t, paths).alias("s")).collect()]
        assert json.loads(got[0]) == expected and got[1] is got[2] is None
    rng = random.Random(5)
    for _ in range(200):
        value = {"a": made(rng, 3), "b": made(rng, 3), "c": made(rng, 2)}
        every = leaves_under(value)
        named = [p for p in every if p and not any(t.isdigit() for t in p) and rng.random() < 0.4]
        kept = kept_paths(value, [list(p) for p in named])
        assert set(leaves_under(kept)) - {()} == set(named) - {()}


def shown(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_trees_are_compared_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":1,"c":1}}', '{"a":{"b":1.0,"d":{}}}'), (2, None, "[]"), (3, "{}", None), (4, "no", None)], "id long, before string, after string")
    assert "Exchange" not in shown(state_effects(df))
    got = {(r.id, r.op, r.path, r.value) for r in state_effects(df).collect()}
    assert got == {(1, "set", "/a/b", "1.0"), (1, "delete", "/a/c", None), (1, "set", "/a/d", "{}"), (2, "set", "", "[]"), (3, "delete", "", None)}


def test_states_are_read_once(spark):
    df = spark.createDataFrame([("g", 1, '{"a":{"b":1}}'), ("g", 2, '{"a":{}}')], "group string, id long, state string")
    assert shown(state_types(df)).count("ArrowEvalPython") == 1
    assert {(r.path, r.type, r.present, r.missing) for r in state_types(df).collect()} == {("", "object", 2, 0), ("/a", "object", 2, 0), ("/a/b", "integer", 1, 1)}


def test_contracts_are_parsed_once(spark, sf_dir):
    df = spark.createDataFrame([("{}",)], "contract string")
    assert shown(df.select(contract_errors(F.col("contract")).alias("e"))).count("from_json(") == 1
    plan = shown(v11_contracts(spark, sf_dir))
    assert "concat" not in plan[plan.index("Exchange") :]  # JSON is made after the shuffle
    assert shown(r5_json_patch(spark, sf_dir)).count("from_json(") == 1


def test_contracts_are_made_of_dealt_lines(spark, sf_dir):
    plan = shown(v11_contracts(spark, sf_dir))
    assert "l_shipdate" not in plan and plan.count("Exchange") == 1
    assert "collect_list" not in plan[plan.index("Exchange") :]  # lines are dealt as they are
    assert sorted(contracts(spark, sf_dir).collect()) == sorted(bundles(spark, sf_dir).select("task_id", "contract").collect())


def test_predicates_are_listed_once(spark):
    df = spark.createDataFrame([("{}",)], "contract string")
    assert shown(df.select(contract_errors(F.col("contract")).alias("e"))).count(".invariants") == 1
    p = lambda id, op, *args: {"id": id, "predicate": {op: list(args)}}
    axes = [{"state_path": "$state.a", "variants": [1.0]}, {"state_path": "$state.b", "variants": [1.0, 2.0]}]
    cases = [
        ({"goal_predicates": [p("a", "eq", "$state.x", "1")], "invariants": [p("a", "near", "x"), p("b", "gt", "y")], "counterfactual_axes": axes}, ["repeated_ids", "operator:a", "no_state:a", "no_state:b", "axis:$state.a"]),
        ({"goal_predicates": [], "counterfactual_axes": []}, ["no_goal"]),
        ({"goal_predicates": [p(None, "near", "$state.x")], "counterfactual_axes": []}, [None]),
        ({"goal_predicates": [None, {"id": "c"}, p("d", "eq"), {"id": "e", "predicate": {"eq": None}}], "counterfactual_axes": []}, ["no_state:d"]),
        ({"goal_predicates": [p("a", "eq", "$state.x")]}, None),
    ]
    rows = [(i, json.dumps({"contract_version": "1", **c})) for i, (c, _) in enumerate(cases)] + [(5, "{"), (6, None)]
    df = spark.createDataFrame(rows, "i int, contract string").select("i", contract_errors(F.col("contract")).alias("e"))
    assert {r.i: r.e for r in df.collect()} == {**{i: e for i, (_, e) in enumerate(cases)}, 5: ["not_a_contract"], 6: ["not_a_contract"]}
