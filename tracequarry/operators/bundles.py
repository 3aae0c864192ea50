"""Task bundles as nested JSON, and the rules that their parts have to keep.

A bundle is one row: manifest, contract, environment, bindings and plan as JSON. The registered queries build one for every
order: its line items are the plan's actions, the tools, the capabilities and the contract's predicates. The validators
parse the JSON; their SQL twins come to the same errors from the line items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.plans.catalog import query
from tracequarry.sources.tables import table

PREDICATE = "struct<id:string,predicate:map<string,array<string>>>"
CONTRACT = f"struct<contract_version:string,goal:string,goal_predicates:array<{PREDICATE}>,invariants:array<{PREDICATE}>,counterfactual_axes:array<struct<state_path:string,variants:array<double>>>>"
ENVIRONMENT = "struct<runtime_version:string,capabilities:map<string,struct<branches:array<struct<id:string,`when`:string,effects:array<struct<op:string,path:string>>>>>>>"
BINDINGS = "struct<tools:array<struct<name:string,capability_id:string>>>"
PLAN = "struct<actions:array<struct<tool:string>>>"
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte")
EFFECTS = ("set", "increment", "append", "delete")


def _listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _predicate(x: Column) -> Column:
    """A line's predicate as JSON."""
    number, quantity = x["n"].cast("string"), x["l_quantity"].cast("long").cast("string")
    path = F.concat(F.when(x["stateless"], "q").otherwise("$state.q"), number)
    op = F.when(x["l_quantity"] > 45, "near").otherwise("gt")
    return F.concat(F.lit('{"id":"p'), (x["n"] % 6).cast("string"), F.lit('","predicate":{"'), op, F.lit('":["'), path, F.lit('","'), quantity, F.lit('"]}}'))


def _contract(shown: Callable[[Column], Column]) -> Column:
    """The contract of an order's lines r, given how a line shows its predicate."""
    goals = F.transform(F.filter("r", lambda x: x["l_returnflag"] == "R"), shown)
    kept = F.transform(F.filter("r", lambda x: x["l_returnflag"] != "R"), shown)
    taxes = F.sort_array(F.array_distinct(F.transform("r", lambda x: x["l_tax"])))
    return F.concat(F.lit('{"contract_version":"1","goal":"ship","goal_predicates":'), _listed(goals), F.lit(',"invariants":'), _listed(kept), F.lit(',"counterfactual_axes":[{"state_path":"$state.tax","variants":'), _listed(F.transform(taxes, lambda x: x.cast("string"))), F.lit("}]}"))


def _stateless() -> Column:
    return ~F.coalesce(F.col("l_linestatus") == "F", F.lit(False))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, contract of every order, as in its bundle, without the other parts."""
    # Lines are dealt as they are; each shows its predicate where its order is, before the order's list is made. What a
    # contract doesn't show settles the order of equal lines, as in bundles.
    li = table(spark, sf_dir, "lineitem").filter("l_orderkey is not null").repartition("l_orderkey")
    line = li.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), "l_returnflag", "l_quantity", "l_discount", "l_tax", (F.col("l_suppkey") % 5).alias("s"), _stateless().alias("stateless"))
    line = line.withColumn("shown", _predicate(F.struct("n", "l_quantity", "stateless")))
    g = line.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.sort_array(F.collect_list(F.struct("n", "p", "l_returnflag", "l_quantity", "l_discount", "l_tax", "s", "shown"))).alias("r"))
    return g.select("task_id", _contract(lambda x: x["shown"]).alias("contract"))


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, contract, environment, bindings, plan (JSON) of every order."""
    li = table(spark, sf_dir, "lineitem").filter("l_orderkey is not null")
    # Only the values are dealt by order, in the plan's order; JSON is made of them afterwards.
    always = F.coalesce(F.col("l_shipdate") < F.lit("1995-01-01"), F.lit(False))
    kept = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), "l_returnflag", "l_quantity", "l_discount", "l_tax", (F.col("l_suppkey") % 5).alias("s"), _stateless().alias("stateless"), always.alias("always"))
    g = li.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.sort_array(F.collect_list(kept)).alias("r"))
    number, quantity = lambda x: x["n"].cast("string"), lambda x: x["l_quantity"].cast("long").cast("string")
    tool = lambda x: x["s"].cast("string")

    def branch(x: Column) -> Column:
        effect = F.concat(F.lit('{"op":"'), F.when(x["l_returnflag"] == "A", "swap").otherwise("set"), F.lit('","path":"$state.q'), number(x), F.lit('"}'))
        return F.concat(F.lit('{"id":"b'), number(x), F.lit('","when":'), F.when(x["always"], F.lit("true")).otherwise(F.concat(F.lit('"q > '), quantity(x), F.lit('"'))), F.lit(',"effects":['), effect, F.lit("]}"))

    of = lambda keep, show: F.transform(F.filter("r", keep), show)
    contract = _contract(_predicate)
    tools = F.array_sort(F.array_distinct(of(lambda x: x["l_quantity"] > 10, tool)))
    bindings = F.concat(F.lit('{"tools":'), _listed(F.transform(tools, lambda t: F.concat(F.lit('{"name":"tool_'), t, F.lit('","capability_id":"cap_'), t, F.lit('"}')))), F.lit("}"))
    capabilities = F.array_sort(F.array_distinct(of(lambda x: x["l_discount"] > 0.01, tool)))
    own = F.transform(capabilities, lambda c: F.concat(F.lit('"cap_'), c, F.lit('":{"branches":'), _listed(of(lambda x: tool(x) == c, branch)), F.lit("}")))
    environment = F.concat(F.lit('{"runtime_version":"1","capabilities":{'), F.array_join(own, ","), F.lit("}}"))
    plan = F.concat(F.lit('{"actions":'), _listed(F.transform("r", lambda x: F.concat(F.lit('{"tool":"tool_'), tool(x), F.lit('"}')))), F.lit("}"))
    return g.select("task_id", contract.alias("contract"), environment.alias("environment"), bindings.alias("bindings"), plan.alias("plan"))


def _shown(task: Column, errors: Column) -> list[Column]:
    ordered = F.sort_array(F.array_distinct(errors))
    return [task.alias("task_id"), F.array_join(ordered, ",").alias("errors"), (F.size(ordered) == 0).alias("valid")]


def contract_errors(contract: Column) -> Column:
    """Codes: not JSON, no goal, repeated ids, unknown operators, predicates that read no state, axes of one variant."""
    none, empty = F.array().cast(f"array<{PREDICATE}>"), F.array().cast("array<string>")
    code = lambda bad, name: F.when(bad, F.array(F.lit(name))).otherwise(empty)
    unknown = lambda p: F.exists(F.map_keys(p["predicate"]), lambda k: ~k.isin(*OPERATORS))
    stateless = lambda p: ~F.exists(F.map_values(p["predicate"]), lambda v: F.exists(v, lambda x: x.startswith("$state")))

    def rules(both: Column) -> Column:
        repeated = F.size(F.array_distinct(F.transform(both, lambda p: p["id"]))) < F.size(both)
        of = lambda bad, name: F.transform(F.filter(both, bad), lambda p: F.concat(F.lit(name), p["id"]))
        return F.flatten(F.array(code(repeated, "repeated_ids"), of(unknown, "operator:"), of(stateless, "no_state:")))

    def own(c: Column) -> Column:
        both = F.flatten(F.array(F.coalesce(c["goal_predicates"], none), F.coalesce(c["invariants"], none)))
        axes = F.transform(F.filter(c["counterfactual_axes"], lambda a: F.size(a["variants"]) < 2), lambda a: F.concat(F.lit("axis:"), a["state_path"]))
        every = F.flatten(F.array(code(F.size(c["goal_predicates"]) == 0, "no_goal"), F.transform(F.array(both), rules)[0], axes))
        return F.when(c["contract_version"].isNull(), F.array(F.lit("not_a_contract"))).otherwise(every)

    # The contract is parsed once: inside, c is the one item of a list.
    return F.transform(F.array(F.from_json(contract, CONTRACT)), own)[0]


_LINES = "l AS (SELECT l_orderkey AS task_id, l_linenumber AS n, l_partkey AS p, 'p' || (l_linenumber % 6) AS id, l_returnflag AS flag, l_linestatus = 'F' AS stateful, l_quantity AS q, l_tax AS tax, CAST(l_suppkey % 5 AS VARCHAR) AS tool, l_discount AS discount, l_shipdate < TIMESTAMP '1995-01-01' AS always FROM lineitem)"
_ERRORS = "SELECT t.task_id, coalesce(string_agg(DISTINCT e.e, ',' ORDER BY e.e), '') AS errors, count(e.e) = 0 AS valid FROM (SELECT DISTINCT task_id FROM l) t LEFT JOIN e USING (task_id) GROUP BY t.task_id"


@query(f"""WITH {_LINES}, e AS (
  SELECT task_id, 'no_goal' AS e FROM l GROUP BY 1 HAVING count(*) FILTER (flag = 'R') = 0
  UNION ALL SELECT task_id, 'repeated_ids' FROM l GROUP BY 1 HAVING count(DISTINCT id) < count(*)
  UNION ALL SELECT task_id, 'operator:' || id FROM l WHERE q > 45
  UNION ALL SELECT task_id, 'no_state:' || id FROM l WHERE NOT stateful
  UNION ALL SELECT task_id, 'axis:$state.tax' FROM l GROUP BY 1 HAVING count(DISTINCT tax) < 2) {_ERRORS}""")
def v11_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = contracts(spark, sf_dir)
    return b.select(*_shown(F.col("task_id"), contract_errors(F.col("contract"))))


def spec_errors(environment: Column) -> Column:
    """Codes by capability: no capability at all, repeated branch ids, a catch-all that isn't last, no catch-all, unknown
    effects."""
    e = F.from_json(environment, ENVIRONMENT)

    def own(x: Column) -> Column:
        branches = x["value"]["branches"]
        ids = F.transform(branches, lambda b: b["id"])
        always = F.transform(branches, lambda b: is_catch_all(b["when"]))
        effects = F.exists(F.flatten(F.transform(branches, lambda b: b["effects"])), lambda f: ~f["op"].isin(*EFFECTS))
        early = F.array_contains(F.slice(always, F.lit(1), F.greatest(F.size(always) - 1, F.lit(0))), True)
        codes = F.array_compact(F.array(F.when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated_branch"), F.when(early, "early_catch_all"), F.when(~F.array_contains(always, True), "no_catch_all"), F.when(effects, "unknown_effect")))
        return F.transform(codes, lambda c: F.concat(c, F.lit(":"), x["key"]))

    errors = F.flatten(F.transform(F.map_entries(e["capabilities"]), own))
    return F.when(e["runtime_version"].isNull(), F.array(F.lit("not_an_environment"))).when(F.size(e["capabilities"]) == 0, F.array(F.lit("no_capability"))).otherwise(errors)


def is_catch_all(when: Column) -> Column:
    """A condition that is literally true."""
    return F.coalesce(when == "true", F.lit(False))


@query(f"""WITH {_LINES}, c AS (SELECT task_id, tool, max(discount) > 0.01 AS there, count(*) AS n, count(DISTINCT n) AS ids, bool_or(always) AS any_always, bool_or(flag = 'A') AS swap FROM l GROUP BY 1, 2),
  o AS (SELECT task_id, tool, always, lead(n) OVER (PARTITION BY task_id, tool ORDER BY n, p) IS NOT NULL AS more FROM l),
  e AS (
  SELECT task_id, 'no_capability' AS e FROM c GROUP BY 1 HAVING NOT bool_or(there)
  UNION ALL SELECT task_id, 'repeated_branch:cap_' || tool FROM c WHERE there AND ids < n
  UNION ALL SELECT task_id, 'no_catch_all:cap_' || tool FROM c WHERE there AND NOT any_always
  UNION ALL SELECT task_id, 'unknown_effect:cap_' || tool FROM c WHERE there AND swap
  UNION ALL SELECT DISTINCT o.task_id, 'early_catch_all:cap_' || o.tool FROM o JOIN c ON c.task_id = o.task_id AND c.tool = o.tool AND c.there WHERE always AND more) {_ERRORS}""")
def v10_runtime_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bundles(spark, sf_dir)
    return b.select(*_shown(F.col("task_id"), spec_errors(F.col("environment"))))


def bundle_errors(environment: Column, bindings: Column, plan: Column) -> Column:
    """Codes: tools bound to no capability, actions whose tool isn't bound, capabilities that no tool offers, no tool."""
    have = F.coalesce(F.map_keys(F.from_json(environment, ENVIRONMENT)["capabilities"]), F.array().cast("array<string>"))
    tools = F.from_json(bindings, BINDINGS)["tools"]
    names, offered = F.transform(tools, lambda t: t["name"]), F.transform(tools, lambda t: t["capability_id"])
    unbound = F.transform(F.filter(tools, lambda t: ~F.array_contains(have, t["capability_id"])), lambda t: F.concat(F.lit("capability:"), t["name"]))
    actions = F.transform(F.from_json(plan, PLAN)["actions"], lambda a: a["tool"])
    lost = F.transform(F.array_except(actions, names), lambda t: F.concat(F.lit("tool:"), t))
    unused = F.transform(F.array_except(have, offered), lambda c: F.concat(F.lit("unused:"), c))
    return F.concat(F.array_compact(F.array(F.when(F.size(tools) == 0, "no_tool"))), unbound, lost, unused)


@query(f"""WITH {_LINES}, c AS (SELECT task_id, tool, max(discount) > 0.01 AS there, max(q) > 10 AS bound FROM l GROUP BY 1, 2), e AS (
  SELECT task_id, 'no_tool' AS e FROM c GROUP BY 1 HAVING NOT bool_or(bound)
  UNION ALL SELECT task_id, 'capability:tool_' || tool FROM c WHERE bound AND NOT there
  UNION ALL SELECT task_id, 'tool:tool_' || tool FROM c WHERE NOT bound
  UNION ALL SELECT task_id, 'unused:cap_' || tool FROM c WHERE there AND NOT bound) {_ERRORS}""")
def v12_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bundles(spark, sf_dir)
    return b.select(*_shown(F.col("task_id"), bundle_errors(F.col("environment"), F.col("bindings"), F.col("plan"))))


def first_object(text: Column) -> Column:
    """The JSON object that begins at a text's first brace: one scan that counts braces outside of strings."""

    def step(s: Column, c: Column) -> Column:
        quoted = F.when((c == '"') & ~s["escaped"], ~s["quoted"]).otherwise(s["quoted"])
        depth = s["depth"] + F.when(s["quoted"], 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        done = s["end"] > 0
        end = F.when(done, s["end"]).when((depth == 0) & (c == "}") & ~s["quoted"], s["at"] + 1).otherwise(F.lit(0))
        return F.struct((s["at"] + 1).alias("at"), depth.alias("depth"), quoted.alias("quoted"), ((c == "\\") & s["quoted"] & ~s["escaped"]).alias("escaped"), end.alias("end"))

    tail = F.substring(text, F.instr(text, F.lit("{")), F.length(text))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))
    cut = F.transform(F.array(tail), lambda t: F.substring(t, F.lit(1), F.aggregate(F.split(t, ""), start, step)["end"]))[0]
    return F.when(F.instr(text, F.lit("{")) > 0, F.try_parse_json(cut))


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '}' || event_type || '{' AS note FROM events")
def x11_first_json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with words around an object that holds the event's properties, and braces inside a string and after it."""
    answer = F.concat(F.col("event_type"), F.lit(': {"props":'), F.col("props"), F.lit(',"note":"}'), F.col("event_type"), F.lit('{"} and {"'), F.col("event_id").cast("string"), F.lit("}"))
    v = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), first_object(answer).alias("v"))
    return v.select("id", F.try_variant_get("v", "$.props.k", "bigint").alias("k"), F.try_variant_get("v", "$.note", "string").alias("note"))
