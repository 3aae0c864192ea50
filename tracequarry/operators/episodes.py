"""Episodes replayed over a state of numbers, with histories, ablation, rewards and exports.

Rules are declarative: for each tool the effects on keys. A key's value is what its last reset (set or delete) left, and
the sum of what came after, so states are aggregates and running sums over rows of effects: no episode is gathered into one
row, and none is cut off. A step budget only names the steps beyond it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.plans.catalog import query
from tracequarry.sources.tables import MESSAGES, TRACE, VALIDATIONS, messages, trace, validations, with_sql

BUDGET = 64
#: tool -> effects: (operation, key, amount); "set" replaces, "increment" adds, "delete" removes.
RULES = {
    "signup": [("set", "open", 1.0), ("set", "errors", 0.0)],
    "view": [("increment", "seen", 1.0)],
    "click": [("increment", "clicks", 1.0)],
    "error": [("increment", "errors", 1.0)],
    "purchase": [("increment", "bought", 1.0), ("delete", "errors", 0.0)],
}


def effects(t: DataFrame, rules: dict = RULES) -> DataFrame:
    """One row an effect: episode_id, step, ord (its place in the tool's list), key, reset, amount (null for a delete)."""
    listed = F.array().cast("array<struct<ord:int,key:string,reset:boolean,amount:double>>")
    for tool, own in rules.items():
        one = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(key).alias("key"), F.lit(op != "increment").alias("reset"), F.lit(None if op == "delete" else amount).cast("double").alias("amount")) for i, (op, key, amount) in enumerate(own)])
        listed = F.when(F.col("tool") == tool, one).otherwise(listed)
    return t.select("episode_id", "step", F.explode(listed).alias("e")).select("episode_id", "step", "e.*")


def _parts(t: DataFrame, rules: dict) -> DataFrame:
    """episode_id, key, r (the last reset: step, ord, amount; null if there was none) and more (what was added after it)."""
    e = effects(t, rules)
    last = e.filter("reset").groupBy("episode_id", "key").agg(F.max(F.struct("step", "ord", "amount")).alias("r"))
    later = ~F.col("reset") & (F.col("r").isNull() | (F.struct("step", "ord") > F.struct("r.step", "r.ord")))
    return e.join(last, ["episode_id", "key"], "left").groupBy("episode_id", "key").agg(F.max("r").alias("r"), F.sum(F.when(later, F.col("amount"))).alias("more"))


def final_states(t: DataFrame, rules: dict = RULES) -> DataFrame:
    """episode_id, key, value of every key that an episode leaves behind. Unknown tools change nothing."""
    g = _parts(t, rules)
    return g.filter("r.amount is not null or more is not null").select("episode_id", "key", (F.coalesce("r.amount", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("value"))


def overridden_states(t: DataFrame, variants: dict[str, dict[str, float | None]], rules: dict = RULES) -> DataFrame:
    """episode_id, variant, state (struct of every key's final value, null where it is absent) and hidden (how many of the
    variant's overrides a later reset hides), for every episode replayed from each variant's initial state.

    variants: name -> key -> value before the first step (None: absent). An override is one more reset before the first
    step, so it stands in the final state just where the episode has no reset of that key. Steps are summed once whatever
    the number of variants; only the episodes' states are multiplied by it.
    """
    keys = sorted({key for own in rules.values() for _, key, _ in own} | {key for own in variants.values() for key in own})
    part = lambda key, value: F.max(F.when(F.col("key") == key, value))
    each = [c for i, key in enumerate(keys) for c in (part(key, F.col("r")).alias(f"r{i}"), part(key, F.col("more")).alias(f"m{i}"))]
    sums = t.select("episode_id").distinct().join(_parts(t, rules).groupBy("episode_id").agg(*each), "episode_id", "left")

    def state(own: dict[str, float | None]) -> Column:
        values = []
        for i, key in enumerate(keys):
            base = F.when(F.col(f"r{i}").isNull(), F.lit(own.get(key)).cast("double")).otherwise(F.col(f"r{i}.amount"))
            more = F.col(f"m{i}")
            values.append(F.when(base.isNotNull() | more.isNotNull(), F.coalesce(base, F.lit(0.0)) + F.coalesce(more, F.lit(0.0))).alias(key))
        return F.struct(*values)

    hidden = lambda own: sum((F.col(f"r{keys.index(key)}").isNotNull().cast("long") for key in own), F.lit(0).cast("long"))
    rows = F.array(*[F.struct(F.lit(name).alias("variant"), state(own).alias("state"), hidden(own).alias("hidden")) for name, own in variants.items()])
    return sums.select("episode_id", F.explode(rows).alias("v")).select("episode_id", "v.*")


def with_values(t: DataFrame, keys: list[str], rules: dict = RULES) -> DataFrame:
    """t with each of the keys' values after every step (null where it is absent), by running sums since the last reset.

    A tool has at most one effect on a key.
    """
    order = Window.partitionBy("episode_id").orderBy("step")
    for key in keys:
        own = {tool: [x for x in es if x[1] == key] for tool, es in rules.items()}
        if any(len(x) > 1 for x in own.values()):
            raise ValueError(f"several effects on {key} in one step")
        amount = lambda ops: F.coalesce(*[F.when(F.col("tool") == tool, F.lit(x[0][2])) for tool, x in own.items() if x and x[0][0] in ops], F.lit(None).cast("double"))
        reset = F.col("tool").isin(*[tool for tool, x in own.items() if x and x[0][0] != "increment"])
        since = Window.partitionBy("episode_id", f"__since_{key}").orderBy("step")
        t = t.withColumn(f"__since_{key}", F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(order))
        base, more = F.max(amount(("set",))).over(since), F.sum(amount(("increment",))).over(since)
        t = t.withColumn(key, F.when(base.isNotNull() | more.isNotNull(), F.coalesce(base, F.lit(0.0)) + F.coalesce(more, F.lit(0.0))))
    return t.drop(*[f"__since_{key}" for key in keys])


def without_step(t: DataFrame, keys: list[str], rules: dict = RULES) -> DataFrame:
    """t with key (the final value) and without_key (the final value if this step is left out) for each of the keys.

    An increment after the last reset is subtracted. The last reset gives way to the value before it. All other steps
    change nothing.
    """
    order = Window.partitionBy("episode_id").orderBy("step")
    whole = Window.partitionBy("episode_id")
    out = with_values(t, keys, rules)
    for key in keys:
        own = {tool: x for tool, es in rules.items() for x in es if x[1] == key}
        op = F.coalesce(*[F.when(F.col("tool") == tool, F.lit(x[0])) for tool, x in own.items()], F.lit(""))
        amount = F.coalesce(*[F.when(F.col("tool") == tool, F.lit(x[2])) for tool, x in own.items() if x[0] != "delete"], F.lit(0.0))
        out = out.withColumn("__op", op).withColumn("__amount", amount)
        out = out.withColumn("__last", F.max(F.when(F.col("__op").isin("set", "delete"), F.col("step"))).over(whole)).withColumn("__before", F.lag(key).over(order))
        out = out.withColumn("__final", F.max(F.struct("step", F.col(key).alias("v"))).over(whole)["v"])
        after = F.coalesce(F.col("step") > F.col("__last"), F.lit(True))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        out = out.withColumn(f"without_{key}", F.when((F.col("__op") == "increment") & after, F.col("__final") - F.col("__amount")).when(F.col("step") == F.col("__last"), zero("__before") + zero("__final") - F.col("__amount")).otherwise(F.col("__final")))
        out = out.withColumn(key, F.col("__final"))
    return out.drop("__op", "__amount", "__last", "__before", "__final")


_SEG = "s AS (SELECT *, max(CASE WHEN tool = 'purchase' THEN step END) OVER (PARTITION BY episode_id) AS lp, max(CASE WHEN tool = 'signup' THEN step END) OVER (PARTITION BY episode_id) AS ls FROM trace)"


@query(with_sql(TRACE, _SEG) + """SELECT episode_id, count(*) AS steps, CASE WHEN count(*) > 64 THEN 'over_budget' ELSE 'completed' END AS status, count(*) FILTER (tool = 'view')::DOUBLE AS seen, count(*) FILTER (tool = 'click')::DOUBLE AS clicks, count(*) FILTER (tool = 'purchase')::DOUBLE AS bought,
  CASE WHEN greatest(coalesce(lp, 0), coalesce(ls, 0)) = 0 OR coalesce(lp, 0) > coalesce(ls, 0) THEN nullif(count(*) FILTER (tool = 'error' AND step > coalesce(lp, 0)), 0)::DOUBLE ELSE count(*) FILTER (tool = 'error' AND step > ls)::DOUBLE END AS errors FROM s GROUP BY episode_id, lp, ls""")
def t2_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final state of every whole episode, and whether it is longer than the budget; errors is missing after a purchase
    until the next error or signup."""
    t = trace(spark, sf_dir)
    state = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    s = final_states(t).groupBy("episode_id").agg(*[state(k).alias(k) for k in ("seen", "clicks", "bought", "errors")])
    n = t.groupBy("episode_id").agg(F.count("*").alias("steps"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    status = F.when(F.col("steps") > BUDGET, "over_budget").otherwise("completed")
    return n.join(s, "episode_id", "left").select("episode_id", "steps", status.alias("status"), zero("seen"), zero("clicks"), zero("bought"), "errors")


@query(with_sql(TRACE, "r AS (SELECT episode_id, step, sum(CASE WHEN tool = 'click' THEN 1 ELSE 0 END) OVER w AS c, sum(CASE WHEN tool = 'view' THEN 1 ELSE 0 END) OVER w AS v FROM trace WINDOW w AS (PARTITION BY episode_id ORDER BY step))") + "SELECT episode_id, min(step) FILTER (c > v) AS first_violation, count(*) FILTER (c > v) AS violations, arg_max(c <= v, step) AS holds_at_end FROM r GROUP BY episode_id")
def t14_predicate_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicate clicks <= seen at every step: first violation, number, and whether it holds at the end."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    h = with_values(trace(spark, sf_dir).select("episode_id", "step", "tool"), ["clicks", "seen"]).withColumn("holds", zero("clicks") <= zero("seen"))
    return h.groupBy("episode_id").agg(F.min(F.when(~F.col("holds"), F.col("step"))).alias("first_violation"), F.count_if(~F.col("holds")).alias("violations"), F.max_by("holds", "step").alias("holds_at_end"))


@query(with_sql(TRACE, "n AS (SELECT episode_id, count(*) AS steps, count(*) FILTER (tool = 'purchase') AS b, count(*) FILTER (tool = 'view') AS v FROM trace GROUP BY 1)") + "SELECT f.episode_id, steps, count(*) FILTER (b >= 1 AND v >= 1 AND ((tool = 'purchase' AND b = 1) OR (tool = 'view' AND v = 1))) AS necessary, round(count(*) FILTER (b >= 1 AND v >= 1 AND ((tool = 'purchase' AND b = 1) OR (tool = 'view' AND v = 1))) / steps, 4) AS ratio FROM trace f JOIN n USING (episode_id) GROUP BY f.episode_id, steps")
def c10_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the goal bought >= 1 and seen >= 1: the steps without which a met goal is missed. Every step is judged."""
    judged = without_step(trace(spark, sf_dir).select("episode_id", "step", "tool"), ["bought", "seen"])
    goal = lambda p: (F.coalesce(F.col(f"{p}bought"), F.lit(0.0)) >= 1) & (F.coalesce(F.col(f"{p}seen"), F.lit(0.0)) >= 1)
    g = judged.groupBy("episode_id").agg(F.count("*").alias("steps"), F.count_if(goal("") & ~goal("without_")).alias("necessary"))
    return g.withColumn("ratio", F.round(F.col("necessary") / F.col("steps"), 4))


#: What a plan must bring about: how many steps at least of which tools. A step may serve several needs.
NEEDS = [(("purchase",), 2), (("view",), 3), (("click", "view"), 8), (("signup", "error"), 1)]


def minimal_plan(steps: DataFrame, needs: list[tuple[tuple[str, ...], int]]) -> DataFrame:
    """episode_id, step, met, removed_in: the steps of each episode, with the round in which one was taken out of its plan.

    As long as a run of neighbouring steps can go without missing a need, the longest such run goes, the first of equals.
    What stays (removed_in is null) can't lose any step or run. An episode that misses a need keeps all steps, and met is
    false. steps: episode_id, step (unique in an episode), tool; a step without a tool serves no need.

    All episodes are shortened at once. How far a run may reach from each step is looked up for every need by a running
    maximum over the sorted sums of needs served, so a round sorts the steps and never pairs them. The neighbours of a run
    that went can't go later, so there are no more rounds than steps needed, and one; finished episodes leave.
    """
    if not any(least > 0 for _, least in needs):
        raise ValueError("a plan needs a step at least")
    serves = [F.coalesce(F.col("tool").isin(*tools), F.lit(False)).cast("long").alias(f"n{m}") for m, (tools, _) in enumerate(needs)]
    rows = steps.select("episode_id", "step", *serves)
    slack = [(F.sum(f"n{m}") - least).alias(f"s{m}") for m, (_, least) in enumerate(needs)]
    met = reduce(and_, [F.col(f"s{m}") >= 0 for m in range(len(needs))])
    judged = rows.groupBy("episode_id").agg(*slack).select("episode_id", met.alias("met"))
    all_rows = rows.join(judged, "episode_id").checkpoint()
    out = all_rows.filter("not met").select("episode_id", "step", "met", F.lit(None).cast("long").alias("removed_in"))
    left, turn = all_rows.filter("met").drop("met"), 0
    order = Window.partitionBy("episode_id").orderBy("step")
    sorted_sums = Window.partitionBy("episode_id", "need").orderBy("sum", "asks", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while not left.isEmpty():
        turn += 1
        free = left.groupBy("episode_id").agg(*slack)
        sums = [F.sum(f"n{m}").over(order).alias(f"p{m}") for m in range(len(needs))]
        placed = left.select("*", F.row_number().over(order).alias("pos"), *sums).join(free, "episode_id")
        marks = [F.struct(F.lit(m).alias("need"), at.alias("sum"), F.lit(asks).alias("asks")) for m in range(len(needs)) for asks, at in ((False, F.col(f"p{m}")), (True, F.col(f"p{m}") - F.col(f"n{m}") + F.col(f"s{m}")))]
        run = placed.select("episode_id", "pos", F.explode(F.array(*marks)).alias("m")).select("episode_id", "pos", "m.*")
        reach = F.coalesce(F.max(F.when(~F.col("asks"), F.col("pos"))).over(sorted_sums), F.lit(0))
        ends = run.withColumn("end", reach).filter("asks").groupBy("episode_id", "pos").agg(F.min("end").alias("end")).filter("end >= pos")
        best = ends.groupBy("episode_id").agg(F.max(F.struct((F.col("end") - F.col("pos")).alias("more"), (-F.col("pos")).alias("back"))).alias("b"))
        best = best.select("episode_id", (-F.col("b.back")).alias("first"), (F.col("b.more") - F.col("b.back")).alias("last"))
        goes = F.coalesce(F.col("pos").between(F.col("first"), F.col("last")), F.lit(False))
        state = placed.join(best, "episode_id", "left").select(*left.columns, goes.alias("goes"), F.col("first").isNull().alias("done")).checkpoint()
        out = out.unionByName(state.filter("goes or done").select("episode_id", "step", F.lit(True).alias("met"), F.when(F.col("goes"), F.lit(turn)).cast("long").alias("removed_in")))
        left = state.filter("not goes and not done").drop("goes", "done")
    return out


def _needs_sql(tools: str) -> str:
    return " AND ".join(f"len(list_filter({tools}, lambda x: x IN ({', '.join(repr(t) for t in names)}))) >= {least}" for names, least in NEEDS)


@query(f"""WITH RECURSIVE {TRACE}, plan AS (
  SELECT episode_id, 0 AS round, list(step ORDER BY step) AS kept, list(tool ORDER BY step) AS tools FROM trace GROUP BY episode_id
  UNION ALL
  SELECT episode_id, round + 1, kept[:b.i - 1] || kept[b.j + 1:], tools[:b.i - 1] || tools[b.j + 1:]
  FROM (SELECT episode_id, round, kept, tools, arg_max({{'i': i, 'j': j}}, (j - i, -i)) AS b
        FROM (SELECT *, unnest(range(i, len(kept) + 1)) AS j FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS i FROM plan))
        WHERE {_needs_sql("(tools[:i - 1] || tools[j + 1:])")} GROUP BY ALL)),
  ends AS (SELECT episode_id, max(len(kept)) AS steps, max(round) AS removals, arg_max(kept, round) AS kept, arg_min({_needs_sql("tools")}, round) AS met FROM plan GROUP BY episode_id)
  SELECT episode_id, steps, met, CASE WHEN met THEN len(kept) END AS kept, CASE WHEN met THEN removals ELSE 0 END::BIGINT AS removals, CASE WHEN met THEN array_to_string(kept, ',') END AS kept_steps FROM ends""")
def c11_minimization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A least plan of every episode for NEEDS: what is kept can lose no run of steps; null if the episode misses a need.

    A kept plan has no more steps than the needs add up to, so it fits a row.
    """
    p = minimal_plan(trace(spark, sf_dir).select("episode_id", "step", "tool"), NEEDS)
    stays = F.when(F.col("met") & F.col("removed_in").isNull(), F.col("step"))
    g = p.groupBy("episode_id", "met").agg(F.count("*").alias("steps"), F.count(stays).alias("kept"), F.coalesce(F.max("removed_in"), F.lit(0)).alias("removals"), F.array_join(F.array_sort(F.collect_list(stays)), ",").alias("kept_steps"))
    return g.select("episode_id", "steps", "met", F.when(F.col("met"), F.col("kept")).alias("kept"), "removals", F.when(F.col("met"), F.col("kept_steps")).alias("kept_steps"))


#: Initial states to replay from. The first is the episode as it was.
VARIANTS = {"plain": {}, "seen_2": {"seen": 2.0}, "seen_5": {"seen": 5.0}, "errors_9": {"errors": 9.0}, "both": {"seen": 5.0, "errors": 9.0}}
_SUMS = """v AS (SELECT episode_id, lp, ls, count(*) FILTER (tool = 'view') AS views, count(*) FILTER (tool = 'click') AS clicks, count(*) FILTER (tool = 'error' AND step > greatest(coalesce(lp, 0), coalesce(ls, 0))) AS late FROM s GROUP BY 1, 2, 3),
  x AS (SELECT *, unnest([{'variant': 'plain', 'a': 0, 'b': NULL}, {'variant': 'seen_2', 'a': 2, 'b': NULL}, {'variant': 'seen_5', 'a': 5, 'b': NULL}, {'variant': 'errors_9', 'a': 0, 'b': 9}, {'variant': 'both', 'a': 5, 'b': 9}]) AS o FROM v),
  f AS (SELECT episode_id, o.variant AS variant, (views + o.a)::DOUBLE AS seen, clicks::DOUBLE AS clicks, (o.b IS NOT NULL AND (lp IS NOT NULL OR ls IS NOT NULL))::BIGINT AS hidden,
    CASE WHEN coalesce(ls, 0) > coalesce(lp, 0) THEN late WHEN lp IS NOT NULL THEN nullif(late, 0) ELSE coalesce(late + o.b, nullif(late, 0)) END::DOUBLE AS errors FROM x),
  g AS (SELECT *, seen >= clicks AND coalesce(errors, 0) <= 8 AS goal FROM f)"""


@query(with_sql(TRACE, _SEG, _SUMS) + "SELECT episode_id, variant, seen, clicks, errors, hidden, goal, goal <> max(CASE WHEN variant = 'plain' THEN goal END) OVER (PARTITION BY episode_id) AS changed FROM g")
def c13_counterfactuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every episode replayed from VARIANTS (c12): the states it ends in, the overrides that later resets hide, whether the
    goal seen >= clicks and errors <= 8 is met, and whether that differs from the episode as it was."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    v = overridden_states(trace(spark, sf_dir).select("episode_id", "step", "tool"), VARIANTS)
    v = v.select("episode_id", "variant", zero("state.seen").alias("seen"), zero("state.clicks").alias("clicks"), F.col("state.errors").alias("errors"), "hidden")
    v = v.withColumn("goal", (F.col("seen") >= F.col("clicks")) & (zero("errors") <= 8))
    plain = F.max(F.when(F.col("variant") == "plain", F.col("goal"))).over(Window.partitionBy("episode_id"))
    return v.withColumn("changed", F.col("goal") != plain)


def reward(goal: Column, invariant: Column, grounded: Column, steps: Column, reference: Column, valid: Column) -> Column:
    """0.6 goal + 0.15 invariant + 0.15 provenance + 0.1 efficiency, at most 0.89 if the episode isn't valid."""
    efficiency = F.least(F.lit(1.0), F.greatest(reference, F.lit(1)) / F.greatest(steps, F.lit(1)))
    raw = 0.6 * goal + 0.15 * invariant + 0.15 * grounded.cast("int") + 0.1 * efficiency
    return F.round(F.when(valid, raw).otherwise(F.least(raw, F.lit(0.89))), 6)


@query(with_sql(TRACE, "g AS (SELECT episode_id, count(*) AS steps, count(*) FILTER (tool = 'purchase') / 20.0 AS goal0, 1 - count(error_code) / CAST(count(*) AS DOUBLE) AS inv, count(*) FILTER (k = 0) = 0 AS grounded FROM trace GROUP BY 1)") + "SELECT episode_id, round(CASE WHEN steps >= 60 THEN raw ELSE least(raw, 0.89) END, 6) AS reward FROM (SELECT *, CAST(0.6 AS DOUBLE) * least(goal0, 1.0)::DOUBLE + CAST(0.15 AS DOUBLE) * inv + CAST(0.15 AS DOUBLE) * CAST(grounded AS INT) + CAST(0.1 AS DOUBLE) * least(CAST(1 AS DOUBLE), 50 / steps::DOUBLE) AS raw FROM g)")
def m5_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of 20 purchases, of steps without error, no use of k = 0, against 50 reference steps; valid from 60 steps."""
    g = trace(spark, sf_dir).groupBy("episode_id").agg(F.count("*").alias("steps"), F.least(F.count_if(F.col("tool") == "purchase") / 20.0, F.lit(1.0)).alias("goal"), (1 - F.count("error_code") / F.count("*")).alias("inv"), (F.count_if(F.col("k") == 0) == 0).alias("grounded"))
    return g.select("episode_id", reward(F.col("goal"), F.col("inv"), F.col("grounded"), F.col("steps"), F.lit(50), F.col("steps") >= 60).alias("reward"))


@query(with_sql(MESSAGES, VALIDATIONS, "ok AS (SELECT id FROM validations GROUP BY id HAVING bool_and(valid))", "m AS (SELECT id, '[' || string_agg(to_json({'content': text, 'role': role})::VARCHAR, ',' ORDER BY idx) || ']' AS messages, count(*) AS n FROM messages GROUP BY id)") + "SELECT m.id, messages, n, 'conversation' AS domain, sha256(messages) AS messages_sha256 FROM m WHERE id IN (SELECT id FROM ok)")
def m1_sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of conversations that every validator accepts: the messages as canonical JSON, and its hash."""
    ok = validations(spark, sf_dir).groupBy("id").agg(F.bool_and("valid").alias("ok")).filter("ok").select("id")
    one = F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"})
    part = F.array_sort(F.collect_list(F.struct("idx", one.alias("p"))))
    m = messages(spark, sf_dir).join(ok, "id", "left_semi").groupBy("id").agg(F.concat(F.lit("["), F.array_join(F.transform(part, lambda s: s["p"]), ","), F.lit("]")).alias("messages"), F.count("*").alias("n"))
    return m.select("id", "messages", "n", F.lit("conversation").alias("domain"), F.sha2("messages", 256).alias("messages_sha256"))


CATALOGUE = '["click","view"]'


@query(with_sql(MESSAGES, "f AS (SELECT id, min(idx) AS first, bool_or(role = 'system') AS has FROM messages GROUP BY id)", "t AS (SELECT m.id, m.idx, m.role, CASE WHEN role = 'system' AND row_number() OVER (PARTITION BY m.id, m.role ORDER BY idx) = 1 THEN text || chr(10) || 'Tools: [\"click\",\"view\"]' ELSE text END AS text FROM messages m UNION ALL SELECT id, first - 1, 'system', 'Tools: [\"click\",\"view\"]' FROM f WHERE NOT has)") + "SELECT id, idx, role, sha256(text) AS text_hash FROM t")
def p20_tool_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool list is appended to the first system message, or a new one is put before the first message."""
    m = messages(spark, sf_dir)
    note = F.lit(f"Tools: {CATALOGUE}")
    w = Window.partitionBy("id")
    marked = m.withColumn("at", F.min(F.when(F.col("role") == "system", F.col("idx"))).over(w)).withColumn("first", F.min("idx").over(w))
    own = F.struct("idx", "role", F.when(F.col("idx") == F.col("at"), F.concat_ws("\n", "text", note)).otherwise(F.col("text")).alias("text"))
    new = F.when(F.col("at").isNull() & (F.col("idx") == F.col("first")), F.struct((F.col("first") - 1).alias("idx"), F.lit("system").alias("role"), note.alias("text")))
    out = marked.select("id", F.explode(F.array_compact(F.array(new, own))).alias("m"))
    return out.select("id", "m.idx", "m.role", F.sha2("m.text", 256).alias("text_hash"))
