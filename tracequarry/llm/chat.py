"""Chat formatting: tool calls linked to their results, ordered, validated, and written as canonical JSON.

DataFrame functions only. A message's text is plain, or a JSON object in one of two common shapes: an assistant's
{"content", "tool_calls": [{"id", "function": {"name", "arguments"}}]} (or with name and arguments beside the id), and a
tool's {"tool_call_id", "content"}. A system message may carry {"tools": [{"function": {"name", "parameters"}}]}.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.columns import let
from tracequarry.llm.common import materialize

#: `"${id}"` anywhere in a call's arguments stands for that call's result.
REFERENCE = r"\$\{([A-Za-z0-9_.:-]+)\}"
MESSAGE = "struct<content:variant,tool_call_id:string,tool_calls:array<variant>,tools:array<variant>>"
#: Numbers that a variant would write otherwise (1.0, 1e3, -0, more than 18 digits) go through it as marked strings.
MARK, TAIL = "\ue000\ue001", "\ue002"
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?[eE][+-]?[0-9]+|-?[0-9]+\.[0-9]+|-?[0-9]{19,}|-0(?![0-9])"


def exact(text: Column) -> Column:
    """JSON whose numbers keep their form: outside of strings, those that a variant changes are marked."""

    def marked(t: Column) -> Column:
        rest = F.transform(F.split(t, _STRING, -1), lambda p: F.regexp_replace(p, f"({_NUMBER})", f'"{MARK}$1"'))
        return F.array_join(F.zip_with(rest, F.regexp_extract_all(t, F.lit(_STRING), F.lit(0)), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")

    # A mark that the text itself holds, escaped or not, gets a tail that no number begins with.
    own = F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)(?:\\u[eE]000|\ue000)(?:\\u[eE]001|\ue001)", f"$1{MARK}{TAIL}")
    return let(own, lambda t: F.when(t.rlike(_NUMBER), marked(t)).otherwise(t))


def plain(json: Column) -> Column:
    """The JSON with its marked numbers, and marks of its own, as they were."""
    return F.replace(F.regexp_replace(json, f'"{MARK}({_NUMBER})"', "$1"), F.lit(MARK + TAIL), F.lit(MARK))


def canonical(text: Column) -> Column:
    """JSON with sorted keys and without spaces; null if it isn't JSON."""
    return plain(F.to_json(F.try_parse_json(exact(text))))


def json_string(value: Column) -> Column:
    """A string as JSON; null for null."""
    return let(F.to_json(F.array(value)), lambda j: F.when(value.isNotNull(), F.substring(j, F.lit(2), F.length(j) - 2)))


def _object(entries: Column) -> Column:
    """A JSON object of array<struct<k, v>>, where v is JSON."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(json_string(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))


def _entries(members: Column, besides: tuple[str, ...]) -> Column:
    """The members of map<string, variant> as entries, but for those named."""
    kept = F.map_filter(members, lambda k, _: ~k.isin(*besides))
    return F.transform(F.map_entries(kept), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v")))


def messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, mid, role, text, and m: what a message's JSON holds, null for plain texts.

    mid tells messages of one turn apart; messages that are the same in all four columns share it.
    """
    body = F.when(F.ltrim(F.col("text")).startswith("{"), F.from_json(exact(F.col("text")), MESSAGE))
    return conversations.select("conv_id", "turn", F.xxhash64("role", "text").alias("mid"), "role", "text", body.alias("m"))


def _variant_text(v: Column) -> Column:
    """Arguments as JSON with sorted keys and marked numbers, whether they came as an object or as a string that holds one."""
    inner = F.try_variant_get(v, "$", "string")
    own = F.to_json(v)
    return F.when(F.schema_of_variant(v) == "STRING", F.coalesce(F.to_json(F.try_parse_json(exact(inner))), own)).otherwise(own)


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def calls(found: DataFrame) -> DataFrame:
    """One row a call: conv_id, turn, mid, position, call_id, tool, arguments, wants (ids it refers to), others (entries of
    its other members)."""
    each = found.filter(F.col("role") == "assistant").select("conv_id", "turn", "mid", F.posexplode("m.tool_calls").alias("position", "c"))
    c = F.col("c")
    arguments = F.coalesce(_variant_text(F.coalesce(_at(c, "$.function.arguments", "variant"), _at(c, "$.arguments", "variant"))), F.lit("{}"))
    others = _entries(F.coalesce(_at(c, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")), ("id", "name", "arguments", "function", "level", "result"))
    rows = each.select("conv_id", "turn", "mid", "position", _at(c, "$.id").alias("call_id"), F.coalesce(_at(c, "$.function.name"), _at(c, "$.name")).alias("tool"), arguments.alias("arguments"), others.alias("others")).distinct()
    return rows.withColumn("wants", F.array_sort(F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1)))))


def results(found: DataFrame) -> DataFrame:
    """One row a result: conv_id, call_id, result turn, content (canonical JSON, or a JSON string)."""
    rows = found.filter(F.col("m.tool_call_id").isNotNull()).select("conv_id", F.col("m.tool_call_id").alias("call_id"), F.col("turn").alias("result_turn"), _variant_text(F.col("m.content")).alias("result"))
    return rows.groupBy("conv_id", "call_id").agg(F.min(F.struct("result_turn", "result")).alias("r"), F.count("*").alias("n_results")).select("conv_id", "call_id", "r.result_turn", "r.result", "n_results")


def schemas(found: DataFrame) -> DataFrame:
    """conv_id, tool, schema (JSON) of its parameters. Of several declarations the one at the least turn holds."""
    each = found.filter(F.col("role") == "system").select("conv_id", "turn", F.explode("m.tools").alias("t"))
    t = F.col("t")
    given = F.to_json(F.coalesce(_at(t, "$.function.parameters", "variant"), _at(t, "$.parameters", "variant")))
    rows = each.select("conv_id", F.coalesce(_at(t, "$.function.name"), _at(t, "$.name")).alias("tool"), "turn", given.alias("p")).filter("tool is not null")
    return rows.groupBy("conv_id", "tool").agg(F.min(F.struct("turn", "p")).alias("f")).select("conv_id", "tool", F.col("f.p").alias("schema"))


def _walk(rows: DataFrame, keys: list[str], below) -> DataFrame:
    """keys, path, json of every value that `below` leads to from the rows' own (path $, json); one round a level."""
    level = materialize(rows.select(*keys, F.lit("$").alias("path"), "json"), "level")
    seen = level
    while True:
        v = F.try_parse_json("json")
        inner = level.select(*keys, "path", F.explode(below(v)).alias("e"))
        level = materialize(inner.select(*keys, F.concat("path", "e.k").alias("path"), F.col("e.v").alias("json")), "level")
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)


def _members(v: Column, of: str = "$") -> Column:
    """Entries (.name, JSON) of an object's members; none for other values."""
    m = F.when(F.schema_of_variant(_at(v, of, "variant")).startswith("OBJECT"), _at(v, of, "map<string,variant>"))
    return F.coalesce(F.transform(F.map_entries(m), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("k"), F.to_json(e["value"]).alias("v"))), F.array().cast("array<struct<k:string,v:string>>"))


def _values(v: Column) -> Column:
    """What an argument holds: members by name, elements under []."""
    elements = F.when(F.schema_of_variant(v).startswith("ARRAY"), _at(v, "$", "array<variant>"))
    return F.concat(_members(v), F.coalesce(F.transform(elements, lambda e: F.struct(F.lit("[]").alias("k"), F.to_json(e).alias("v"))), F.array().cast("array<struct<k:string,v:string>>")))


def _subschemas(v: Column) -> Column:
    items = F.to_json(_at(v, "$.items", "variant"))
    return F.concat(_members(v, "$.properties"), F.array_compact(F.array(F.when(items.startswith("{"), F.struct(F.lit("[]").alias("k"), items.alias("v"))))))


def _type_fits(kind: Column, v: Column) -> Column:
    own = F.schema_of_variant(v)
    real = F.coalesce(_at(v, "$").startswith(MARK), F.lit(False)) & (own == "STRING")
    whole = own.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | own.rlike(r"^DECIMAL\([0-9]+,0\)$") | (real & _at(v, "$").rlike(f"^{MARK}-?[0-9]+$"))
    return (
        F.when(kind == "string", (own == "STRING") & ~real)
        .when(kind == "integer", whole)
        .when(kind == "number", whole | real | own.rlike("^(DECIMAL|DOUBLE|FLOAT)"))
        .when(kind == "boolean", own == "BOOLEAN")
        .when(kind == "array", own.startswith("ARRAY"))
        .when(kind == "object", own.startswith("OBJECT"))
        .when(kind == "null", own == "VOID")
        .otherwise(True)
    )


def argument_errors(made: DataFrame, known: DataFrame) -> DataFrame:
    """conv_id, tool, arguments, errors (sorted) of the different arguments that a schema was declared for.

    Arguments and schemas are flattened to rows of paths, joined path by path: type (a list of types too), enum, const,
    required, additionalProperties where it is false, properties and items at any depth. References fit any type.
    """
    keys = ["conv_id", "tool", "arguments"]
    given = _walk(made.join(known, ["conv_id", "tool"], "left_semi").select("conv_id", "tool", "arguments", F.col("arguments").alias("json")).distinct(), keys, _values)
    rules = _walk(known.select("conv_id", "tool", F.col("schema").alias("json")).filter("json is not null"), ["conv_id", "tool"], _subschemas)
    s, v = F.try_parse_json("schema"), F.try_parse_json("json")
    kinds = F.coalesce(_at(s, "$.type", "array<string>"), F.when(F.schema_of_variant(_at(s, "$.type", "variant")) == "STRING", F.array(_at(s, "$.type"))))
    listed = F.transform(_at(s, "$.enum", "array<variant>"), lambda e: F.to_json(e))
    named = F.map_keys(F.when(F.schema_of_variant(v).startswith("OBJECT"), _at(v, "$", "map<string,variant>")))
    declared = F.coalesce(F.map_keys(_at(s, "$.properties", "map<string,variant>")), F.array().cast("array<string>"))
    where = F.substring("path", F.lit(3), F.length("path"))
    below = lambda k: F.concat_ws(".", F.when(F.col("path") != "$", where), k)
    free = F.col("json").rlike(rf'^"{REFERENCE}"$') & (F.col("path") != "$")
    checks = F.struct(v.alias("v"), kinds.alias("kinds"), listed.alias("enum"), F.to_json(_at(s, "$.const", "variant")).alias("const"), _at(s, "$.required", "array<string>").alias("required"), _at(s, "$.additionalProperties", "boolean").alias("more"), named.alias("named"), declared.alias("declared"))

    def errors(x: Column) -> Column:
        fits = F.coalesce(F.exists(x["kinds"], lambda k: _type_fits(k, x["v"])), F.lit(True))
        own = F.when(~fits, F.concat(F.lit("type:"), where)).when(x["enum"].isNotNull() & ~F.array_contains(x["enum"], F.col("json")), F.concat(F.lit("enum:"), where)).when(x["const"].isNotNull() & (x["const"] != F.col("json")), F.concat(F.lit("const:"), where))
        missing = F.transform(F.array_except(x["required"], x["named"]), lambda k: F.concat(F.lit("missing:"), below(k)))
        extra = F.when(~x["more"], F.transform(F.array_except(x["named"], x["declared"]), lambda k: F.concat(F.lit("unexpected:"), below(k))))
        none = F.array().cast("array<string>")
        inner = F.concat(F.array_compact(F.array(own)), F.coalesce(missing, none), F.coalesce(extra, none))
        return F.when((F.col("path") == "$") & x["named"].isNull(), F.array(F.lit("not_an_object"))).when(free, none).otherwise(inner)

    each = given.join(rules.withColumnRenamed("json", "schema"), ["conv_id", "tool", "path"]).select(*keys, F.explode(let(checks, errors)).alias("e"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_set("e")).alias("errors"))


def levels(linked: DataFrame) -> DataFrame:
    """conv_id, call_id, level: 0 for calls that want none, else one more than the highest level they want; null on a cycle,
    and for calls that want one of a cycle.

    Calls that want just one other are chains. Their jumps to the chain's end double in length each round, so a chain takes
    the logarithm of its length; only calls that want several are decided a level a round. Wanted ids that are no call of
    the conversation don't count.
    """
    ids = linked.select("conv_id", "call_id").filter("call_id is not null and conv_id is not null").distinct()
    edges = linked.filter(F.size("wants") > 0).select("conv_id", "call_id", F.explode("wants").alias("want")).distinct()
    edges = materialize(edges.join(ids.select("conv_id", F.col("call_id").alias("want")), ["conv_id", "want"], "left_semi"), "wants")
    if edges.isEmpty():
        return ids.withColumn("level", F.lit(0))
    fan = materialize(edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("want").alias("to")), "fan")
    jump = materialize(fan.filter("n = 1").select("conv_id", "call_id", "to", F.lit(1).alias("hops")), "jump")
    while True:
        on = jump.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        after = materialize(jump.join(on, ["conv_id", "to"]).select("conv_id", "call_id", F.col("next").alias("to"), (F.col("hops") + F.col("more")).alias("hops")), "jump")
        if after.isEmpty():
            break
        # a jump longer than the conversation has chain calls goes round a cycle, and is dropped
        most = jump.groupBy("conv_id").agg(F.count("*").alias("calls"))
        ended = jump.join(after.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
        jump = materialize(ended.unionByName(after.join(most, "conv_id").filter("hops <= calls").drop("calls")), "jump")
    # now every jump ends at a call that wants none or several
    several = edges.join(fan.filter("n > 1").select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi")
    direct = several.join(jump.select("conv_id", F.col("call_id").alias("want"), "to", "hops"), ["conv_id", "want"], "left")
    chains = fan.filter("n = 1").select("conv_id", F.col("call_id").alias("want"))
    lost = direct.filter("to is null").join(chains, ["conv_id", "want"], "left_semi").select("conv_id", "call_id").distinct()
    direct = materialize(direct.join(lost, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.coalesce("to", "want").alias("to"), F.coalesce("hops", F.lit(0)).alias("hops")), "several")
    known = materialize(ids.join(fan.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "known")
    done = [known]
    while not direct.isEmpty():
        so_far = reduce(DataFrame.unionByName, done)
        told = direct.join(so_far.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"], "left")
        ready = told.groupBy("conv_id", "call_id").agg((F.max(F.col("level") + F.col("hops")) + 1).alias("level"), F.count_if(F.col("level").isNull()).alias("open")).filter("open = 0").select("conv_id", "call_id", "level")
        ready = materialize(ready, "known")
        if ready.isEmpty():
            break
        done.append(ready)
        direct = materialize(direct.join(ready.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"), "several")
    ends = reduce(DataFrame.unionByName, done)
    chained = jump.join(ends.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"]).select("conv_id", "call_id", (F.col("level") + F.col("hops")).alias("level"))
    return ids.join(ends.unionByName(chained), ["conv_id", "call_id"], "left")


def link_calls(conversations: DataFrame) -> DataFrame:
    """Every call with its result, level, validation errors and canonical JSON; one row a call.

    Status: linked, early (the result comes before the call), no_result, or no_id. Calls with equal id in a conversation
    are told apart by turn and position and share the id's first result. Tools that were declared nowhere in the
    conversation are an error only if the conversation declares any. The JSON keeps the call's other members.
    """
    found = messages(conversations)
    made = materialize(calls(found), "calls")
    got = results(found)
    known = materialize(schemas(found), "schemas")
    declares = known.select("conv_id").distinct().withColumn("declares", F.lit(True))
    joined = made.join(got, ["conv_id", "call_id"], "left").join(known.select("conv_id", "tool", F.lit(True).alias("known")), ["conv_id", "tool"], "left").join(declares, "conv_id", "left")
    joined = joined.join(argument_errors(made, known), ["conv_id", "tool", "arguments"], "left").join(levels(made), ["conv_id", "call_id"], "left")
    status = F.when(F.col("call_id").isNull(), "no_id").when(F.col("n_results").isNull(), "no_result").when(F.col("result_turn") < F.col("turn"), "early").otherwise("linked")
    errors = F.coalesce("errors", F.when(F.col("declares") & F.col("known").isNull(), F.array(F.lit("unknown_tool"))), F.array().cast("array<string>"))
    null = F.lit("null")
    own = [("arguments", F.col("arguments")), ("id", F.coalesce(json_string(F.col("call_id")), null)), ("level", F.coalesce(F.col("level").cast("string"), null)), ("name", F.coalesce(json_string(F.col("tool")), null)), ("result", F.coalesce("result", null))]
    body = plain(_object(F.concat("others", F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in own]))))
    return joined.select("conv_id", "turn", "mid", "position", "call_id", "tool", plain(F.col("arguments")).alias("arguments"), status.alias("status"), "level", errors.alias("errors"), plain(F.col("result")).alias("result"), body.alias("canonical"))


def format_messages(conversations: DataFrame) -> DataFrame:
    """Every message as canonical JSON with what its calls came to; one row a message.

    Returned: conv_id, turn, role, n_calls, n_linked, n_invalid, level (the highest of its calls), canonical. Plain texts
    are {"content", "role"}; JSON messages keep their object with sorted keys and numbers as written, and with the calls in
    topological order (level, then position), beside the role. Conversations aren't gathered into one row, so a very long
    one doesn't load one task. Messages that share a turn keep their own calls. Null role, turn or conv_id: kept, such a
    message is linked to nothing. Texts that begin like JSON but aren't are plain. Repeated rows stay. Empty table: no
    rows.
    """
    found = messages(conversations)
    linked = link_calls(conversations)
    item = F.struct(F.coalesce("level", F.lit(1 << 30)).alias("o"), F.col("position").alias("p"), F.col("canonical").alias("c"))
    per = linked.groupBy("conv_id", "turn", "mid").agg(
        F.count("*").alias("n_calls"),
        F.count_if(F.col("status") == "linked").alias("n_linked"),
        F.count_if(F.size("errors") > 0).alias("n_invalid"),
        F.max("level").alias("level"),
        F.array_sort(F.collect_list(item)).alias("items"),
    )
    has = (F.col("role") == "assistant") & F.col("m.tool_calls").isNotNull()
    joined = found.withColumn("has", F.coalesce(has, F.lit(False))).join(per, ["conv_id", "turn", "mid"], "left")
    ordered = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["c"]), ","), F.lit("]"))
    null = F.lit("null")
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    members = F.try_variant_get(F.try_parse_json(exact(F.col("text"))), "$", "map<string,variant>")
    own = F.array(entry("content", F.coalesce(F.to_json(F.col("m.content")), null)), entry("role", F.coalesce(json_string(F.col("role")), null)), entry("tool_calls", ordered))
    with_calls = plain(_object(F.concat(_entries(members, ("content", "role", "tool_calls")), own)))
    whole = F.when(F.col("m").isNotNull(), canonical(F.col("text")))
    text = F.to_json(F.struct("text", "role").cast("struct<content:string,role:string>"), {"ignoreNullFields": "false"})
    zero = lambda c: F.when(F.col("has"), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("long").alias(c)
    return joined.select("conv_id", "turn", "role", zero("n_calls"), zero("n_linked"), zero("n_invalid"), F.when(F.col("has"), F.col("level")).cast("long").alias("level"), F.when(F.col("has") & F.col("items").isNotNull(), with_calls).otherwise(F.coalesce(whole, text)).alias("canonical"))
