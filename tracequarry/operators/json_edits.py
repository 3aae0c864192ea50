"""JSON patches of task bundles, and the least effects that turn one state tree into another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracequarry.functions.json_edits import KINDS, effects, kinds, patched, shape, sliced
from tracequarry.operators.bundles import bundles, contract_errors
from tracequarry.plans.catalog import query
from tracequarry.sources.tables import table

#: The members of a bundle that a patch may touch: fixed values.
PATCH_ROOTS = ["instruction", "environment", "bindings", "reference_plan"]


@query("""WITH l AS (SELECT l_orderkey AS task_id, 'tool_' || (l_suppkey % 5) AS tool, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity, l_discount, l_tax, l_suppkey % 5) AS i FROM lineitem WHERE l_orderkey IS NOT NULL),
  n AS (SELECT task_id, count(*) AS n FROM l GROUP BY 1),
  a AS (SELECT task_id, i, CASE WHEN i = 1 THEN 'first' ELSE tool END AS tool FROM l UNION ALL SELECT task_id, n + 1, 'audit' FROM n),
  k AS (SELECT task_id, string_agg(tool, ',' ORDER BY i) AS tools, count(*) AS n FROM a WHERE NOT (task_id % 5 = 0 AND i = 2) GROUP BY 1),
  e AS (SELECT task_id, CASE WHEN task_id % 7 = 0 THEN (2 + (task_id % 5 = 0)::INT) || ':forbidden_root' WHEN task_id % 11 = 0 THEN (2 + (task_id % 5 = 0)::INT) || ':out_of_range' END AS error FROM n)
  SELECT task_id, error, CASE WHEN error IS NULL THEN tools END AS tools, CASE WHEN error IS NULL THEN k.n END AS actions FROM k JOIN e USING (task_id)""")
def r5_json_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bundle's plan gets an audit at its end and another first tool; some lose their second action; batches that
    touch the contract or a place beyond the end are refused whole."""
    task = F.col("task_id")
    extra = F.when(task % 5 == 0, F.lit(',{"op":"remove","path":"/reference_plan/actions/1"}')).otherwise("")
    bad = F.when(task % 7 == 0, F.lit(',{"op":"replace","path":"/contract/goal","value":"none"}')).when(task % 11 == 0, F.lit(',{"op":"replace","path":"/reference_plan/actions/99","value":{}}')).otherwise("")
    todo = F.concat(F.lit('[{"op":"add","path":"/reference_plan/actions/-","value":{"tool":"audit"}},{"op":"replace","path":"/reference_plan/actions/0/tool","value":"first"}'), extra, bad, F.lit("]"))
    whole = F.concat(F.lit('{"contract":'), "contract", F.lit(',"environment":'), "environment", F.lit(',"bindings":'), "bindings", F.lit(',"reference_plan":'), "plan", F.lit("}"))
    # A generated row keeps the function out of the aggregate that makes the bundles.
    inputs = bundles(spark, sf_dir).select("task_id", F.explode(F.array(F.struct(whole.alias("whole"), todo.alias("todo")))).alias("i"))
    done = inputs.select("task_id", patched(F.col("i.whole"), F.col("i.todo"), PATCH_ROOTS).alias("p")).select("task_id", "p.*")
    actions = F.from_json("document", "struct<reference_plan:struct<actions:array<struct<tool:string>>>>")["reference_plan"]["actions"]
    done = done.select("task_id", "error", actions.alias("actions"))
    actions = F.col("actions")
    return done.select("task_id", "error", F.array_join(F.transform(actions, lambda a: a["tool"]), ",").alias("tools"), F.when(F.col("error").isNull(), F.size(actions)).cast("long").alias("actions"))


def state_effects(pairs: DataFrame) -> DataFrame:
    """id, path, op (set or delete), value: the least effects that turn `before` into `after`.

    pairs: id, before, after (JSON). A pair's trees are compared where the pair is, so no node is shuffled. A node that is
    new, gone or of another value is an effect if its parent is an object in both trees; below a new or replaced object
    nothing is said twice. Lists are values as a whole. A root that isn't an object on both sides is set whole, at path "".
    """
    return pairs.select("id", F.explode(effects(F.col("before"), F.col("after"))).alias("e")).select("id", "e.*")


@query("""WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, CAST(sum(l_quantity) AS BIGINT) AS q, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
  p AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, o_orderstatus AS s, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t FROM orders),
  a AS (SELECT id, n, q, f FROM p JOIN l ON l.o = p.prev), b AS (SELECT id, n, q, f FROM p JOIN l ON l.o = p.id WHERE prev IS NOT NULL),
  j AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.n, b.n) AS n, a.q AS aq, b.q AS bq, a.f AS af, b.f AS bf FROM a FULL JOIN b ON a.id = b.id AND a.n = b.n),
  e AS (
    SELECT id, 'delete:/lines/' || n || '=' AS e FROM j WHERE bq IS NULL
    UNION ALL SELECT id, 'set:/lines/' || n || '={"f":"' || bf || '","q":' || bq || '}' FROM j WHERE aq IS NULL
    UNION ALL SELECT id, 'set:/lines/' || n || '/q=' || bq FROM j WHERE aq <> bq
    UNION ALL SELECT id, 'set:/lines/' || n || '/f="' || bf || '"' FROM j WHERE af <> bf
    UNION ALL SELECT id, 'set:/status="' || s || '"' FROM p WHERE prev IS NOT NULL AND s <> t)
  SELECT p.id, p.prev, count(e) AS n_effects, coalesce(string_agg(e, ';' ORDER BY e), '') AS effects FROM p LEFT JOIN e USING (id) WHERE prev IS NOT NULL GROUP BY 1, 2""")
def r2_state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects from each order's state to the customer's next one."""
    state = order_states(spark, sf_dir)
    w = Window.partitionBy("o_custkey").orderBy(F.asc_nulls_last("id"))
    pairs = state.select("id", F.col("state").alias("after"), F.lag("state").over(w).alias("before"), F.lag("id").over(w).alias("prev")).filter("prev is not null")
    own = F.when(F.col("id").isNotNull(), effects(F.col("before"), F.col("after"))).otherwise(F.array())
    found = pairs.select("id", "prev", own.alias("found"))
    lines = F.transform("found", lambda e: F.concat(e["op"], F.lit(":"), e["path"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return found.select("id", "prev", F.size("found").cast("long").alias("n_effects"), F.array_join(F.array_sort(lines), ";").alias("effects"))


def order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, o_custkey, state (JSON) of every order: lines by number, each of flag and quantity, and status.

    Lines are dealt by order once; both aggregates and the join then find them in place.
    """
    dealt = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").repartition("l_orderkey")
    lines = dealt.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("q"), F.max("l_returnflag").alias("f"))
    entry = F.struct(F.col("l_linenumber").cast("string").alias("key"), F.struct("f", "q").alias("value"))
    held = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.map_from_entries(F.collect_list(entry)).alias("lines"))
    state = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderstatus").alias("status")).join(held, "id", "left")
    none = F.map_from_entries(F.array().cast("array<struct<key:string,value:struct<f:string,q:bigint>>>"))
    return state.select("id", "o_custkey", F.to_json(F.struct(F.coalesce("lines", none).alias("lines"), "status")).alias("state"))


@query("""WITH l AS (SELECT l_orderkey AS o, l_linenumber::VARCHAR AS n FROM lineitem GROUP BY 1, 2),
  t AS (SELECT o, string_agg('"' || n || '":{"f":"<string>","q":"<number>"}', ',' ORDER BY n) AS t FROM l GROUP BY 1),
  s AS (SELECT o_orderkey AS id, '{"lines":{' || coalesce(t, '') || '},"status":"<string>"}' AS shape FROM orders LEFT JOIN t ON t.o = o_orderkey)
  SELECT sha256(shape) AS fingerprint, count(*) AS orders, min(id) AS first, any_value(shape) AS shape FROM s GROUP BY shape""")
def x14_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the shape of their states."""
    s = order_states(spark, sf_dir).select("id", F.explode(F.array("state")).alias("state")).select("id", shape(F.col("state")).alias("shape"))
    g = s.groupBy("shape").agg(F.count("*").alias("orders"), F.min("id").alias("first"))
    return g.select(F.sha2("shape", 256).alias("fingerprint"), "orders", "first", "shape")


def repair_rounds(df: DataFrame, value: str, validate: Callable[[Column], Column], repairs: list[Callable[[Column], Column]]) -> DataFrame:
    """df with `value` repaired, and errors (sorted), rounds (taken repairs) and converged.

    One repair a round; it is taken only if its errors are a strict subset of those before. A row without errors leaves:
    its value isn't repaired or validated again. All rounds are columns of one projection, so no row is shuffled.
    """
    ordered = lambda c: F.array_sort(F.array_distinct(validate(c)))
    out = df.withColumn("errors", ordered(F.col(value))).withColumn("rounds", F.lit(0))
    for repair in repairs:
        out = out.withColumn("__try", F.when(F.size("errors") > 0, repair(F.col(value))))
        out = out.withColumn("__left", F.when(F.col("__try").isNotNull() & (F.col("__try") != F.col(value)), ordered(F.col("__try"))))
        better = F.coalesce((F.size("__left") < F.size("errors")) & (F.size(F.array_except("__left", "errors")) == 0), F.lit(False))
        out = out.withColumn("__take", better).withColumn(value, F.when(F.col("__take"), F.col("__try")).otherwise(F.col(value)))
        out = out.withColumn("errors", F.when(F.col("__take"), F.col("__left")).otherwise(F.col("errors"))).withColumn("rounds", F.col("rounds") + F.col("__take").cast("int"))
    return out.drop("__try", "__left", "__take").withColumn("converged", F.size("errors") == 0)


@query("""WITH l AS (SELECT l_orderkey AS task_id, l_linenumber % 6 AS i, l_returnflag AS flag, l_linestatus = 'F' AS stateful, l_quantity > 45 AS near, l_tax AS tax FROM lineitem WHERE l_orderkey IS NOT NULL),
  g AS (SELECT task_id, count(*) FILTER (flag = 'R') = 0 AS no_goal, count(DISTINCT i) < count(*) AS repeated, count(DISTINCT tax) < 2 AS axis, bool_or(near) AS near, bool_or(NOT stateful) AS stateless, bool_or(i = 3) AS third FROM l GROUP BY 1),
  r AS (SELECT *, no_goal AND (NOT third OR repeated) AS goal_made FROM g)
  SELECT task_id, (near::INT + stateless::INT + goal_made::INT)::INT AS rounds, concat_ws(',', CASE WHEN axis THEN 'axis:$state.tax' END, CASE WHEN no_goal AND NOT goal_made THEN 'no_goal' END, CASE WHEN repeated THEN 'repeated_ids' END) AS errors,
    NOT (axis OR (no_goal AND NOT goal_made) OR repeated) AS converged FROM r""")
def r9_monotone_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts repaired in three rounds: unknown operators, predicates that read no state, and a missing goal, whose new
    predicate may repeat an id and is refused then."""
    repairs = [
        lambda c: F.replace(c, F.lit('{"near":'), F.lit('{"gt":')),
        lambda c: F.replace(c, F.lit('":["q'), F.lit('":["$state.q')),
        lambda c: F.replace(c, F.lit('"goal_predicates":[]'), F.lit('"goal_predicates":[{"id":"p3","predicate":{"gt":["$state.q0","0"]}}]')),
    ]
    out = repair_rounds(bundles(spark, sf_dir).select("task_id", "contract"), "contract", contract_errors, repairs)
    return out.select("task_id", "rounds", F.array_join("errors", ",").alias("errors"), "converged")


#: What a missing member of each type begins as; any other type begins as null.
DEFAULTS = {"boolean": "false", "string": '""', "integer": "0", "number": "0", "list": "[]", "object": "{}"}


def _members(states: DataFrame) -> DataFrame:
    return states.select("group", "id", F.explode(kinds(F.col("state"))).alias("n")).select("group", "id", "n.*")


def state_types(states: DataFrame) -> DataFrame:
    """group, path, parent, type, nullable, present, missing: the least type that all values at a path have.

    states: group, id, state (JSON). Integers are numbers; values of several other kinds make any; nulls don't change a type
    but make it nullable; a path of nulls alone is of type null. missing: states of the group whose parent at that path is
    an object without the member. One aggregate that combines before the shuffle; states aren't gathered,
    and are read once.
    """
    g = _members(states).groupBy("group", "path", "parent").agg(F.bit_or("kind").alias("kinds"), F.count("*").alias("present"), F.count_if(F.col("kind") == KINDS["object"]).alias("objects"))
    bare = F.col("kinds").bitwiseAND(F.lit(127 - KINDS["null"]))
    kind = F.when(bare == 0, "null").when(bare == KINDS["integer"] + KINDS["number"], "number")
    for name, bit in KINDS.items():
        kind = kind.when(bare == bit, name)
    # A path stands under its own name for what it holds and under its parent's for what it asks: no second read of states.
    names = F.array(F.struct(F.col("path").alias("at"), F.lit(True).alias("holds")), F.struct(F.col("parent").alias("at"), F.lit(False).alias("holds")))
    named = g.withColumn("name", F.explode(names))
    above = named.withColumn("above", F.max(F.when(F.col("name.holds"), F.col("objects"))).over(Window.partitionBy("group", "name.at")))
    out = above.filter(~F.col("name.holds"))
    missing = F.when(F.col("parent").isNull(), F.lit(0).cast("long")).otherwise(F.coalesce("above", "present") - F.col("present"))
    return out.select("group", "path", "parent", kind.otherwise("any").alias("type"), (F.col("kinds").bitwiseAND(F.lit(KINDS["null"])) > 0).alias("nullable"), "present", missing.alias("missing"))


def complete(states: DataFrame) -> DataFrame:
    """group, id, state: every object gets the members that its group's states have at that path, with their defaults.

    What hangs from a value that isn't an object in this state, or begins as none, stays out.

    Missing members are found by an anti join on (id, path) against the group's types and added by one patch a state,
    parents first. Ids are unique within a group. A group without a missing member stays as it was.
    """
    types = state_types(states).filter("parent is not null")
    value = F.lit("null")
    for name, default in DEFAULTS.items():
        value = F.when(F.col("type") == name, default).otherwise(value)
    members = _members(states)
    wanted = states.select("group", "id").join(types.select("group", "path", value.alias("value")), "group")
    lost = wanted.join(members.select("group", "id", "path"), ["group", "id", "path"], "left_anti")
    # What would hang from a value that isn't an object, there or as a default, stays out.
    plain = members.filter(F.col("kind") != KINDS["object"]).select("group", "id", "path").unionByName(lost.filter("value <> '{}'").select("group", "id", "path"))
    blocked = plain.select("group", "id", F.concat("path", F.lit("/")).alias("under"))
    closed = lost.join(blocked, ["group", "id"]).filter(F.startswith("path", "under")).select("group", "id", "path").distinct()
    todo = lost.join(closed, ["group", "id", "path"], "left_anti")
    step = F.struct(F.size(F.split("path", "/")).alias("depth"), "path", F.concat(F.lit('{"op":"add","path":'), F.to_json(F.array("path")).substr(F.lit(2), F.length(F.to_json(F.array("path"))) - 2), F.lit(',"value":'), "value", F.lit("}")).alias("text"))
    batch = todo.groupBy("group", "id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    batch = batch.select("group", "id", F.concat(F.lit("["), F.array_join(F.transform("steps", lambda s: s["text"]), ","), F.lit("]")).alias("todo"))
    both = states.join(batch, ["group", "id"], "left").select("group", "id", F.explode(F.array(F.struct("state", "todo"))).alias("i"))
    done = F.when(F.col("i.todo").isNull(), F.col("i.state")).otherwise(patched(F.col("i.state"), F.col("i.todo"))["document"])
    return both.select("group", "id", done.alias("state"))


@query("""WITH s AS (SELECT l_linestatus AS "group", l_quantity > 45 AS many, l_linenumber % 3 = 0 AS untaxed, l_tax = 0 AS zero, l_discount = 0 AS plain FROM lineitem WHERE l_linestatus IS NOT NULL),
  g AS (SELECT "group", count(*) AS n, count(*) FILTER (many) AS many, count(*) FILTER (NOT untaxed) AS taxed, count(*) FILTER (NOT untaxed AND NOT zero) AS rated, count(*) FILTER (plain) AS plain FROM s GROUP BY 1)
  SELECT "group", '' AS path, 'object' AS type, false AS nullable, n AS present, 0::BIGINT AS missing FROM g
  UNION ALL SELECT "group", '/q', CASE WHEN many = 0 THEN 'integer' WHEN many = n THEN 'string' ELSE 'any' END, false, n, 0 FROM g
  UNION ALL SELECT "group", '/t', CASE WHEN rated = 0 THEN 'integer' ELSE 'number' END, false, taxed, n - taxed FROM g WHERE taxed > 0
  UNION ALL SELECT "group", '/d', CASE WHEN plain = n THEN 'null' ELSE 'object' END, plain > 0, n, 0 FROM g
  UNION ALL SELECT "group", '/d/rate', 'number', false, n - plain, 0 FROM g WHERE plain < n""")
def r3_state_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the members of line states by status: quantities of two kinds, taxes that some lines lack, discounts that are
    null or nested."""
    li = table(spark, sf_dir, "lineitem").filter("l_linestatus is not null")
    q = F.when(F.col("l_quantity") > 45, '"many"').otherwise(F.col("l_quantity").cast("long").cast("string"))
    t = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit(',"t":'), F.when(F.col("l_tax") == 0, "0").otherwise(F.col("l_tax").cast("string"))))
    d = F.when(F.col("l_discount") == 0, "null").otherwise(F.concat(F.lit('{"rate":'), F.col("l_discount").cast("string"), F.lit("}")))
    states = li.select(F.col("l_linestatus").alias("group"), F.col("l_orderkey").alias("id"), F.concat(F.lit('{"q":'), q, t, F.lit(',"d":'), d, F.lit("}")).alias("state"))
    return state_types(states).drop("parent")


#: What a request about a contract's goal may show: the goal, which predicates there are, and which paths vary.
CONTEXT_PATHS = ["/goal", "/goal_predicates/*/id", "/counterfactual_axes/*/state_path"]


@query("""WITH l AS (SELECT l_orderkey AS task_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity, l_discount, l_tax, l_suppkey % 5) AS i, l_linenumber % 6 AS p, l_returnflag = 'R' AS goal FROM lineitem WHERE l_orderkey IS NOT NULL)
  SELECT task_id, '{"counterfactual_axes":[{"state_path":"$state.tax"}],"goal":"ship","goal_predicates":[' || coalesce(string_agg('{"id":"p' || p || '"}', ',' ORDER BY i) FILTER (goal), '') || ']}' AS context, count(*) FILTER (goal) AS predicates FROM l GROUP BY 1""")
def p16_context_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts cut down to CONTEXT_PATHS: no condition, invariant or variant is left."""
    c = bundles(spark, sf_dir).select("task_id", F.explode(F.array("contract")).alias("contract")).select("task_id", sliced(F.col("contract"), CONTEXT_PATHS).alias("context"))
    return c.select("task_id", "context", F.size(F.from_json("context", "struct<goal_predicates:array<struct<id:string>>>")["goal_predicates"]).cast("long").alias("predicates"))
