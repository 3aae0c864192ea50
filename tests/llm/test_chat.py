import json
import random

from tracequarry.llm.chat import format_messages, link_calls

SCHEMA = "conv_id long, turn long, role string, text string"
TOOLS = {"tools": [{"function": {"name": "add", "parameters": {"properties": {"x": {"type": "integer"}, "y": {"type": "number"}, "s": {"type": "string", "enum": ["a", "b"]}, "b": {"type": "boolean"}, "l": {"type": "array"}, "o": {"type": "object"}}, "required": ["x"], "additionalProperties": False}}}]}


def call(i, args, name="add"):
    return {"id": i, "function": {"name": name, "arguments": args}}


def talk(conv, *texts):
    return [(conv, t, role, x if isinstance(x, str) or x is None else json.dumps(x)) for t, (role, x) in enumerate(texts)]


def test_links_levels_and_errors(spark):
    rows = talk(
        1,
        ("system", TOOLS),
        ("assistant", {"tool_calls": [call("b", json.dumps({"y": "${a}", "x": 1})), call("a", {"x": 2, "y": 1.5, "b": True, "l": [1], "o": {}})]}),
        ("tool", {"tool_call_id": "b", "content": {"z": 1, "a": [2, None]}}),
        ("tool", {"tool_call_id": "a", "content": "done"}),
        ("assistant", {"content": "x", "tool_calls": [call("c", {"x": "1", "s": "q", "z": 0}), call("d", [1]), call("e", {"x": "${b}"}), call("f", {}, "nope")]}),
        ("tool", {"tool_call_id": "e", "content": 5}),
    )
    rows += talk(2, ("tool", {"tool_call_id": "p", "content": 1}), ("assistant", {"tool_calls": [call("p", {"v": "${q}"}), call("q", {"v": "${p}"}), call("r", {"v": "${none}"}), {"name": "add", "arguments": {}}]}))
    rows += [(3, i, "assistant", json.dumps({"tool_calls": [call(f"k{i}", {"from": f"${{k{i - 1}}}"})]})) for i in range(1, 13)]
    got = {(r.conv_id, r.call_id): r for r in link_calls(spark.createDataFrame(rows, SCHEMA)).collect()}
    one = lambda i: got[1, i]
    assert [one(i).level for i in "abcdef"] == [0, 1, 0, 0, 2, 0]
    assert [one(i).status for i in "abcdef"] == ["linked", "linked", "no_result", "no_result", "linked", "no_result"]
    assert one("a").errors == one("b").errors == one("e").errors == []
    assert one("c").errors == ["enum:s", "type:x", "unexpected:z"]
    assert one("d").errors == ["not_an_object"] and one("f").errors == ["unknown_tool"]
    assert json.loads(one("b").canonical) == {"arguments": {"x": 1, "y": "${a}"}, "id": "b", "level": 1, "name": "add", "result": {"a": [2, None], "z": 1}}
    assert one("b").canonical == json.dumps(json.loads(one("b").canonical), separators=(",", ":"), sort_keys=True)
    assert [got[2, i].level for i in "pqr"] == [None, None, 0] and got[2, "p"].status == "early"
    assert got[2, None].status == "no_id" and got[2, "q"].errors == []
    assert [got[3, f"k{i}"].level for i in range(1, 13)] == list(range(12))


def test_messages(spark):
    rows = talk(1, ("user", 'say "é"\n'), ("assistant", {"tool_calls": [call("b", {"x": "${a}"}), call("a", {})]}), (None, None), ("user", "{broken"), ("user", {"b": 1, "a": 2}))
    rows += [rows[0], rows[0], (None, 1, "assistant", json.dumps({"tool_calls": [call("n", {})]})), (4, None, "user", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", items int")
    out = format_messages(df).collect()
    assert len(out) == len(rows)
    by = {(r.conv_id, r.turn): r for r in out}
    assert json.loads(by[1, 0].canonical) == {"content": 'say "é"\n', "role": "user"}
    assert [c["id"] for c in json.loads(by[1, 1].canonical)["tool_calls"]] == ["a", "b"] and by[1, 1].n_calls == 2 and by[1, 1].level == 1
    assert json.loads(by[1, 2].canonical) == {"content": None, "role": None}
    assert json.loads(by[1, 3].canonical)["content"] == "{broken" and by[1, 4].canonical == '{"a":2,"b":1}'
    assert sum(r.conv_id == 1 and r.turn == 0 for r in out) == 3
    assert format_messages(spark.createDataFrame([], SCHEMA)).count() == 0



def errors_of(spark, schema, *arguments):
    rows = talk(1, ("system", {"tools": [{"name": "f", "parameters": schema}]}), ("assistant", {"tool_calls": [{"id": str(i), "name": "f", "arguments": a} for i, a in enumerate(arguments)]}))
    got = {r.call_id: r.errors for r in link_calls(spark.createDataFrame(rows, SCHEMA)).collect()}
    return [got[str(i)] for i in range(len(arguments))]


def test_nested_schemas(spark):
    schema = {
        "properties": {
            "o": {"type": "object", "properties": {"k": {"type": ["string", "null"]}, "deep": {"properties": {"n": {"type": "integer"}}, "additionalProperties": False}}, "required": ["k"]},
            "l": {"type": "array", "items": {"type": "object", "properties": {"v": {"enum": [1, "a"]}}, "required": ["v"]}},
            "c": {"const": {"a": 1}},
            "f": {"type": "number"},
        },
        "required": [],
    }
    good = {"o": {"k": None, "more": 1, "deep": {"n": 3}}, "l": [{"v": 1}, {"v": "a"}], "c": {"a": 1}, "f": 1.0, "free": True}
    bad = {"o": {"deep": {"n": 1.0, "x": 0}}, "l": [{"v": 2}, {}, 5], "c": {"a": 2}, "f": "1.0"}
    loose = {"o": "${x}", "l": "${y}", "f": 1e3}
    assert errors_of(spark, schema, good, bad, loose) == [[], sorted(["missing:o.k", "type:o.deep.n", "unexpected:o.deep.x", "enum:l[].v", "missing:l[].v", "type:l[]", "const:c", "type:f"]), []]


def test_numbers_and_other_members_stay_as_written(spark):
    text = '{"z": 1.0, "content": "a 1.0 \\"2.50\\" b", "n": [1e3, -0, 12345678901234567890123, 2.50, 7], "refusal": null, "tool_calls": [{"id": "a", "type": "function", "function": {"name": "f", "arguments": "{\\"x\\": 1.0}"}}]}'
    out = {r.role: r for r in format_messages(spark.createDataFrame([(1, 1, "assistant", text), (1, 2, "user", text)], SCHEMA)).collect()}
    assert out["assistant"].canonical == '{"content":"a 1.0 \\"2.50\\" b","n":[1e3,-0,12345678901234567890123,2.50,7],"refusal":null,"role":"assistant","tool_calls":[{"arguments":{"x":1.0},"id":"a","level":0,"name":"f","result":null,"type":"function"}],"z":1.0}'
    assert '"z":1.0}' in out["user"].canonical and out["user"].n_calls == 0


def test_messages_of_one_turn_keep_their_calls(spark):
    one = lambda i: json.dumps({"tool_calls": [call(i, {})]})
    out = format_messages(spark.createDataFrame([(1, 1, "assistant", one("a")), (1, 1, "assistant", one("b")), (1, 1, "user", "x"), (1, 1, "assistant", one("a"))], SCHEMA)).collect()
    assert sorted((r.n_calls, [c["id"] for c in json.loads(r.canonical)["tool_calls"]] if r.role == "assistant" else []) for r in out) == [(0, []), (1, ["a"]), (1, ["a"]), (1, ["b"])]


def brute_levels(wants):
    done = {}
    while True:
        ready = {i: 1 + max((done[w] for w in ws if w in wants), default=-1) for i, ws in wants.items() if i not in done and all(w in done for w in ws if w in wants)}
        if not ready:
            return {i: done.get(i) for i in wants}
        done |= ready


def test_levels_of_any_graph(spark):
    rng, rows, wanted = random.Random(4), [], {}
    for conv in range(40):
        n = rng.randrange(1, 30)
        for i in range(n):
            pool = range(i) if conv % 3 else range(n)
            ws = {f"k{rng.choice(pool)}" for _ in range(rng.choice((0, 1, 1, 1, 2, 3)))} if pool else set()
            wanted.setdefault(conv, {})[f"k{i}"] = ws
            rows.append((conv, i, "assistant", json.dumps({"tool_calls": [call(f"k{i}", {w: f"${{{w}}}" for w in ws})]})))
    got = {}
    for r in link_calls(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.conv_id, {})[r.call_id] = r.level
    assert got == {conv: brute_levels(ws) for conv, ws in wanted.items()}


def test_texts_that_hold_the_mark_stay(spark):
    import json

    from pyspark.sql import functions as F

    from tracequarry.llm.chat import MARK, TAIL, canonical

    values = [{"content": MARK + "abc"}, {"content": f'say "{MARK}x" ok', "n": 1.5}, {"a": MARK + "12.0", "b": 12.5}, {"a": MARK + TAIL + "1.0", "b": "\\" + MARK}, [f'"{MARK}7.0"']]
    texts = [json.dumps(v, ensure_ascii=e) for v in values for e in (True, False)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", canonical(F.col("t")).alias("c")).collect()}
    assert [json.loads(got[i]) for i in range(len(texts))] == [v for v in values for _ in (True, False)]
