"""Provenance and causal structure over trace steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.functions import text as T
from tracequarry.plans.catalog import query
from tracequarry.sources.tables import TRACE, table, trace, with_sql

FIRST = "first AS (SELECT episode_id, produced AS handle, min(step) AS producer_step, arg_min(tool, step) AS producer_tool FROM trace WHERE produced IS NOT NULL GROUP BY 1, 2)"
DELAYED = "delayed AS (SELECT t.episode_id, t.consumed AS handle, f.producer_step, f.producer_tool, t.step AS consumer_step, t.tool AS consumer_tool, t.step - f.producer_step AS distance FROM trace t JOIN first f ON f.episode_id = t.episode_id AND f.handle = t.consumed)"


def first_producers(t: DataFrame) -> DataFrame:
    """The first step that shows a handle; later echoes don't count."""
    p = t.filter(F.col("produced").isNotNull())
    return p.groupBy("episode_id", F.col("produced").alias("handle")).agg(F.min("step").alias("producer_step"), F.min_by("tool", "step").alias("producer_tool"))


def delayed_handles(t: DataFrame) -> DataFrame:
    """Every use of a handle with its first producer anywhere in the episode, so a distance may be negative."""
    use = t.filter(F.col("consumed").isNotNull()).select("episode_id", F.col("consumed").alias("handle"), F.col("step").alias("consumer_step"), F.col("tool").alias("consumer_tool"))
    return use.join(first_producers(t), ["episode_id", "handle"]).withColumn("distance", F.col("consumer_step") - F.col("producer_step"))


@query(with_sql(TRACE, FIRST) + "SELECT * FROM first")
def w4_first_producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_producers(trace(spark, sf_dir))


@query(with_sql(TRACE, FIRST, DELAYED) + "SELECT * FROM delayed")
def j15_delayed_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delayed_handles(trace(spark, sf_dir))


@query(with_sql(TRACE, FIRST, DELAYED) + "SELECT episode_id, max(distance) AS longest, count(*) AS uses, coalesce(max(distance) >= 4, false) AS passes FROM delayed GROUP BY episode_id")
def c1_delayed_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = delayed_handles(trace(spark, sf_dir)).groupBy("episode_id").agg(F.max("distance").alias("longest"), F.count("*").alias("uses"))
    return d.withColumn("passes", F.col("longest") >= 4)


def latest_observations(t: DataFrame) -> DataFrame:
    """Each use of a handle with the last step before it that showed the handle: an as-of join done as one window.

    Shows and uses of a handle stand in one ordered run, and the last show is carried forward, so there is no join of
    every use with every show.
    """
    events = t.filter(F.coalesce("produced", "consumed").isNotNull()).withColumn("handle", F.coalesce("produced", "consumed"))
    w = Window.partitionBy("episode_id", "handle").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    shown = F.last(F.when(F.col("produced").isNotNull(), F.struct("step", "tool")), ignorenulls=True).over(w)
    return events.withColumn("source", shown).filter(F.col("consumed").isNotNull()).select("episode_id", "step", "tool", "handle", F.col("source.step").alias("source_step"), F.col("source.tool").alias("source_tool"))


SOURCED = "sourced AS (SELECT u.episode_id, u.step, u.tool, u.consumed AS handle, p.step AS source_step, p.tool AS source_tool FROM (SELECT * FROM trace WHERE consumed IS NOT NULL) u ASOF LEFT JOIN (SELECT * FROM trace WHERE produced IS NOT NULL) p ON p.episode_id = u.episode_id AND p.produced = u.consumed AND p.step < u.step)"


@query(with_sql(TRACE, SOURCED) + "SELECT * FROM sourced")
def t7_argument_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_observations(trace(spark, sf_dir))


@query(with_sql(TRACE, SOURCED) + "SELECT episode_id, count(*) FILTER (source_step IS NOT NULL) AS tool_grounded, count(*) FILTER (source_step IS NULL AND handle IN ('h1', 'h2', 'h3')) AS schema_grounded, count(*) FILTER (source_step IS NULL AND handle NOT IN ('h1', 'h2', 'h3') AND length(handle) = 2) AS user_grounded, count(*) FILTER (source_step IS NULL AND handle NOT IN ('h1', 'h2', 'h3') AND length(handle) <> 2) AS unexplained FROM sourced GROUP BY episode_id")
def a17_provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses by kind: seen before, in the schema's enum (h1-h3 here), in the user's text (one digit here), unexplained."""
    s = latest_observations(trace(spark, sf_dir))
    seen, listed, told = F.col("source_step").isNotNull(), F.col("handle").isin("h1", "h2", "h3"), F.length("handle") == 2
    return s.groupBy("episode_id").agg(F.count_if(seen).alias("tool_grounded"), F.count_if(~seen & listed).alias("schema_grounded"), F.count_if(~seen & ~listed & told).alias("user_grounded"), F.count_if(~seen & ~listed & ~told).alias("unexplained"))


@query(with_sql(TRACE, SOURCED) + "SELECT episode_id, step, handle FROM sourced WHERE source_step IS NULL AND handle NOT IN ('h1', 'h2', 'h3') AND length(handle) <> 2")
def c7_unexplained(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = latest_observations(trace(spark, sf_dir))
    return s.filter(F.col("source_step").isNull() & ~F.col("handle").isin("h1", "h2", "h3") & (F.length("handle") != 2)).select("episode_id", "step", "handle")


def chain_depth(t: DataFrame) -> DataFrame:
    """Longest chain of sourced steps in each episode: a step's depth is one more than its source's, 1 without a source.

    Every round doubles the length of the known jumps, so rounds are the logarithm of the longest chain; a round is one
    join of steps with steps, and no episode is gathered into one row.
    """
    found = t.select("episode_id", "step").join(latest_observations(t).select("episode_id", "step", "source_step"), ["episode_id", "step"], "left")
    state = found.select("episode_id", "step", F.col("source_step").alias("next"), F.lit(1).cast("long").alias("depth")).checkpoint()
    while not state.filter("next is not null").isEmpty():
        jump = state.select("episode_id", F.col("step").alias("next"), F.col("next").alias("on"), F.col("depth").alias("more"))
        state = state.join(jump, ["episode_id", "next"], "left").select("episode_id", "step", F.col("on").alias("next"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")).checkpoint()
    return state.groupBy("episode_id").agg(F.max("depth").alias("depth"))


@query("WITH RECURSIVE " + TRACE + ",\n" + SOURCED + """,
links AS (SELECT t.episode_id, t.step, s.source_step FROM trace t LEFT JOIN sourced s ON s.episode_id = t.episode_id AND s.step = t.step),
chain AS (SELECT episode_id, step, 1::BIGINT AS depth FROM links WHERE source_step IS NULL
  UNION ALL SELECT l.episode_id, l.step, c.depth + 1 FROM links l JOIN chain c ON c.episode_id = l.episode_id AND c.step = l.source_step)
SELECT episode_id, max(depth) AS depth FROM chain GROUP BY episode_id""")
def c2_chain_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_depth(trace(spark, sf_dir))


def recoveries(t: DataFrame) -> DataFrame:
    """Failures and the first later step that resolves their code: the latest open failure is closed once.

    In the run of a code's failures and resolutions, a resolution right after a failure closes it.
    """
    code = F.coalesce("error_code", "resolves")
    w = Window.partitionBy("episode_id", "code").orderBy("step")
    runs = t.withColumn("code", code).filter("code is not null")
    runs = runs.withColumn("before", F.lag(F.struct("step", F.col("error_code").isNotNull().alias("failed"))).over(w))
    return runs.filter(F.col("resolves").isNotNull() & F.col("before.failed")).select("episode_id", F.col("code").alias("error_code"), F.col("before.step").alias("failure_step"), F.col("step").alias("recovery_step"), F.col("tool").alias("recovery_tool"))


RECOVERIES = "runs AS (SELECT *, coalesce(error_code, resolves) AS code FROM trace WHERE coalesce(error_code, resolves) IS NOT NULL), prior AS (SELECT *, lag(step) OVER w AS b_step, lag(error_code) OVER w AS b_error FROM runs WINDOW w AS (PARTITION BY episode_id, code ORDER BY step)), recoveries AS (SELECT episode_id, code AS error_code, b_step AS failure_step, step AS recovery_step, tool AS recovery_tool FROM prior WHERE resolves IS NOT NULL AND b_error IS NOT NULL)"


@query(with_sql(TRACE, RECOVERIES) + "SELECT * FROM recoveries")
def c4_recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recoveries(trace(spark, sf_dir))


@query(with_sql(TRACE, RECOVERIES) + "SELECT error_code, count(*) AS n, count(DISTINCT recovery_tool) AS tools, count(DISTINCT episode_id) AS episodes, count(DISTINCT recovery_tool) >= 2 AS alternatives FROM recoveries GROUP BY error_code")
def c21_alternative_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = recoveries(trace(spark, sf_dir)).groupBy("error_code").agg(F.count("*").alias("n"), F.countDistinct("recovery_tool").alias("tools"), F.countDistinct("episode_id").alias("episodes"))
    return r.withColumn("alternatives", F.col("tools") >= 2)


@query(with_sql(TRACE, SOURCED) + """SELECT t.episode_id, t.tool, count(*) AS calls, count(DISTINCT t.branch) AS branches, array_to_string(list_sort(list(DISTINCT t.branch)), ',') AS branch_list FROM trace t LEFT JOIN sourced s ON s.episode_id = t.episode_id AND s.step = t.step
GROUP BY t.episode_id, t.tool HAVING count(DISTINCT t.branch) >= 2 AND count(s.source_step) > 0""")
def c5_observation_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools that took several branches and had an observed argument at least once."""
    t = trace(spark, sf_dir)
    s = latest_observations(t).select("episode_id", "step", "source_step")
    g = t.join(s, ["episode_id", "step"], "left").groupBy("episode_id", "tool").agg(F.count("*").alias("calls"), F.array_sort(F.collect_set("branch")).alias("b"), F.count("source_step").alias("observed"))
    return g.filter((F.size("b") >= 2) & (F.col("observed") > 0)).select("episode_id", "tool", "calls", F.size("b").cast("long").alias("branches"), F.array_join("b", ",").alias("branch_list"))


@query(with_sql(TRACE, SOURCED) + "SELECT episode_id, source_step, min(source_tool) AS source_tool, count(DISTINCT handle) AS distinct_values, count(*) AS consumers, count(*) > 3 AS concentrated FROM sourced WHERE source_step IS NOT NULL GROUP BY episode_id, source_step")
def c6_source_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = latest_observations(trace(spark, sf_dir)).filter("source_step is not null")
    g = s.groupBy("episode_id", "source_step").agg(F.min("source_tool").alias("source_tool"), F.countDistinct("handle").alias("distinct_values"), F.count("*").alias("consumers"))
    return g.withColumn("concentrated", F.col("consumers") > 3)


@query(with_sql(TRACE) + "SELECT episode_id, coalesce(max(step) FILTER (tool = 'purchase' AND k < 50), 0) AS last_goal_write FROM trace GROUP BY episode_id")
def w5_last_goal_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with k below 50 stand for writes that touch a goal."""
    writes = F.when((F.col("tool") == "purchase") & (F.col("k") < 50), F.col("step"))
    return trace(spark, sf_dir).groupBy("episode_id").agg(F.coalesce(F.max(writes), F.lit(0)).alias("last_goal_write"))


@query(with_sql(TRACE, "last AS (SELECT episode_id, coalesce(max(step) FILTER (tool = 'purchase' AND k < 50), 0) AS since FROM trace GROUP BY episode_id)", "c AS (SELECT t.*, k % 7 AS covered FROM trace t JOIN last USING (episode_id) WHERE step > since AND tool IN ('view', 'signup'))") + "SELECT episode_id, arg_max(step, covered * 100000 + step) AS step, arg_max(tool, covered * 100000 + step) AS tool, max(covered) AS covered, round(max(covered) / 6, 4) AS coverage FROM c GROUP BY episode_id")
def w6_best_final_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the read-only steps after the last goal write, the one that covers most goals (k mod 7 of 6), the latest of ties."""
    goal = F.when((F.col("tool") == "purchase") & (F.col("k") < 50), F.col("step"))
    t = trace(spark, sf_dir).withColumn("at", F.coalesce(F.max(goal).over(Window.partitionBy("episode_id")), F.lit(0))).withColumn("covered", F.col("k") % 7)
    c = t.filter((F.col("step") > F.col("at")) & F.col("tool").isin("view", "signup"))
    best = c.groupBy("episode_id").agg(F.max(F.struct("covered", "step", "tool")).alias("b"))
    return best.select("episode_id", "b.step", "b.tool", "b.covered", F.round(F.col("b.covered") / 6, 4).alias("coverage"))


@query(with_sql(TRACE, "p AS (SELECT a.episode_id, a.step AS pos, a.tool AS x, b.tool AS y FROM trace a FULL JOIN trace b ON b.episode_id = a.episode_id + 1 AND b.step = a.step WHERE a.episode_id IS NOT NULL AND a.episode_id % 2 = 0)", "n AS (SELECT episode_id, count(*) AS n FROM trace GROUP BY 1)") + "SELECT e.episode_id, coalesce(min(p.pos) FILTER (x <> y) - 1, least(e.n, f.n)) AS divergence FROM n e JOIN n f ON f.episode_id = e.episode_id + 1 LEFT JOIN p ON p.episode_id = e.episode_id WHERE e.episode_id % 2 = 0 GROUP BY e.episode_id, e.n, f.n")
def w10_first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First unequal action of an even episode and the next, from 0; the shorter length if there is none."""
    t = trace(spark, sf_dir).withColumn("pair", F.floor(F.col("episode_id") / 2) * 2).withColumn("odd", F.col("episode_id") % 2 == 1)
    by = t.groupBy("pair", "step").agg(F.max(F.when(~F.col("odd"), F.col("tool"))).alias("x"), F.max(F.when(F.col("odd"), F.col("tool"))).alias("y"))
    g = by.groupBy("pair").agg(F.min(F.when(F.col("x") != F.col("y"), F.col("step"))).alias("at"), F.count("x").alias("nx"), F.count("y").alias("ny"))
    return g.filter((F.col("nx") > 0) & (F.col("ny") > 0)).select(F.col("pair").alias("episode_id"), F.coalesce(F.col("at") - 1, F.least("nx", "ny")).alias("divergence"))


@query(with_sql(TRACE, SOURCED) + "SELECT source_tool AS source, tool AS target, count(*) AS provenance_count FROM sourced WHERE source_step IS NOT NULL AND source_tool <> tool GROUP BY 1, 2")
def g1_api_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = latest_observations(trace(spark, sf_dir)).filter("source_step is not null and source_tool <> tool")
    return s.groupBy(F.col("source_tool").alias("source"), F.col("tool").alias("target")).agg(F.count("*").alias("provenance_count"))


@query(with_sql(TRACE, "alt AS (SELECT DISTINCT step, k % 4 AS axes, tool, k FROM trace)") + "SELECT step AS divergence, axes, count(*) AS alternatives, count(DISTINCT tool) > 1 AS policy_branch, CASE WHEN count(DISTINCT tool) > 1 THEN round(log2(count(*)), 4) ELSE 0.0 END AS entropy FROM alt GROUP BY step, axes")
def c15_decision_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct alternatives at each divergence and set of changed axes; entropy counts where tools differ."""
    alt = trace(spark, sf_dir).select(F.col("step").alias("divergence"), (F.col("k") % 4).alias("axes"), "tool", "k").distinct()
    g = alt.groupBy("divergence", "axes").agg(F.count("*").alias("alternatives"), (F.countDistinct("tool") > 1).alias("policy_branch"))
    return g.withColumn("entropy", F.when(F.col("policy_branch"), F.round(F.log2("alternatives"), 4)).otherwise(F.lit(0.0)))


@query(with_sql(TRACE) + "SELECT episode_id, min(step) FILTER (value < 0 OR error_code = 'E0') AS first_violation, count(*) FILTER (value < 0 OR error_code = 'E0') AS violations FROM trace GROUP BY episode_id")
def c8_invariant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invariant: values aren't negative, and E0 never occurs."""
    bad = (F.col("value") < 0) | (F.coalesce(F.col("error_code"), F.lit("")) == "E0")
    return trace(spark, sf_dir).groupBy("episode_id").agg(F.min(F.when(bad, F.col("step"))).alias("first_violation"), F.count_if(bad).alias("violations"))


@query(with_sql(TRACE, FIRST, DELAYED, SOURCED, RECOVERIES, "d AS (SELECT episode_id, max(distance) AS longest FROM delayed GROUP BY 1)", "r AS (SELECT episode_id, count(*) AS n FROM recoveries GROUP BY 1)", "u AS (SELECT episode_id, count(*) AS n FROM sourced WHERE source_step IS NULL GROUP BY 1)") + "SELECT e.episode_id, coalesce(d.longest, 0) AS longest, coalesce(r.n, 0) AS recoveries, coalesce(u.n, 0) AS unexplained, coalesce(d.longest, 0) >= 4 AND coalesce(r.n, 0) >= 1 AND coalesce(u.n, 0) <= 10 AS valid FROM (SELECT DISTINCT episode_id FROM trace) e LEFT JOIN d USING (episode_id) LEFT JOIN r USING (episode_id) LEFT JOIN u USING (episode_id)")
def c9_episode_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance, recoveries and provenance together; thresholds 4, 1 and at most 10 unexplained uses."""
    t = trace(spark, sf_dir)
    d = delayed_handles(t).groupBy("episode_id").agg(F.max("distance").alias("longest"))
    r = recoveries(t).groupBy("episode_id").agg(F.count("*").alias("recoveries"))
    u = latest_observations(t).filter("source_step is null").groupBy("episode_id").agg(F.count("*").alias("unexplained"))
    e = t.select("episode_id").distinct()
    j = e.join(d, "episode_id", "left").join(r, "episode_id", "left").join(u, "episode_id", "left").na.fill(0, ["longest", "recoveries", "unexplained"])
    return j.withColumn("valid", (F.col("longest") >= 4) & (F.col("recoveries") >= 1) & (F.col("unexplained") <= 10))


@query("""WITH RECURSIVE up AS (SELECT p_partkey AS id, p_partkey AS root, 0::BIGINT AS generation FROM part WHERE p_partkey // 2 = p_partkey OR p_partkey // 2 NOT IN (SELECT p_partkey FROM part)
  UNION ALL SELECT p.p_partkey, u.root, u.generation + 1 FROM part p JOIN up u ON p.p_partkey // 2 = u.id AND p.p_partkey <> u.id) SELECT * FROM up""")
def g3_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and generation of every part under the parent id/2: each round doubles the length of the known jumps."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    parent = p.select("id", F.floor(F.col("id") / 2).alias("up")).join(p.select(F.col("id").alias("up")), "up", "left_semi").filter("id <> up").select("id", "up")
    state = p.join(parent, "id", "left").select("id", F.coalesce("up", "id").alias("root"), F.col("up").isNotNull().cast("long").alias("generation"))
    for _ in range(64):
        state = state.checkpoint()
        jump = state.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("generation").alias("more"))
        after = state.join(jump, "root").select("id", F.col("next").alias("root"), (F.col("generation") + F.col("more")).alias("generation"))
        if jump.filter("more > 0").join(state.select("root").distinct(), "root", "left_semi").isEmpty():
            return state
        state = after
    raise RuntimeError("lineage has a cycle")


@query(with_sql(TRACE, "s AS (SELECT episode_id, arg_max(coalesce(error_code, ''), step) AS last, count(*) AS steps FROM trace GROUP BY 1)") + "SELECT episode_id, coalesce(CASE WHEN last <> '' THEN 'failed' WHEN steps > 64 THEN 'step_limit' END, 'completed') = 'completed' AS completed FROM s")
def f10_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes whose status is missing or says so: one that ends in an error failed, one above 64 steps met the limit."""
    s = trace(spark, sf_dir).groupBy("episode_id").agg(F.max_by(F.coalesce("error_code", F.lit("")), "step").alias("last"), F.count("*").alias("steps"))
    status = F.when(F.col("last") != "", "failed").when(F.col("steps") > 64, "step_limit")
    return s.select("episode_id", T.is_completed(status).alias("completed"))


@query(with_sql(TRACE, "m AS (SELECT episode_id, step, CASE error_code WHEN 'E4' THEN '{\"finishReason\": \"SAFETY\"}' WHEN 'E3' THEN 'blockReason: ' || tool ELSE 'timeout ' || error_code END AS message FROM trace WHERE error_code IS NOT NULL)") + "SELECT episode_id, step, contains(message, 'blockReason') OR contains(message, 'SAFETY') AS permanent FROM m")
def f11_permanent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as providers word them; E3 and E4 are rejections."""
    code = F.col("error_code")
    message = F.when(code == "E4", F.lit('{"finishReason": "SAFETY"}')).when(code == "E3", F.concat(F.lit("blockReason: "), F.col("tool"))).otherwise(F.concat(F.lit("timeout "), code))
    return trace(spark, sf_dir).filter(code.isNotNull()).select("episode_id", "step", T.is_permanent_error(message).alias("permanent"))


@query(with_sql(TRACE) + "SELECT episode_id, count(*) FILTER (tool = 'signup' OR branch = 'b0') AS scaffolding, count(*) FILTER (NOT (tool = 'signup' OR branch = 'b0')) AS own, count(*) FILTER (tool = 'view') AS exempt FROM trace GROUP BY episode_id")
def f13_scaffolding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that only hold a task together (a fixed tool, or a capability of audits: branch b0 here), and arguments that
    need no source (named by the step's tool here)."""
    capability = F.concat(F.when(F.col("branch") == "b0", "audit.").otherwise("task."), F.col("tool"))
    held = T.is_scaffolding(F.col("tool"), capability, ["signup"])
    return trace(spark, sf_dir).groupBy("episode_id").agg(F.count_if(held).alias("scaffolding"), F.count_if(~held).alias("own"), F.count_if(T.is_control_argument(F.col("tool"))).alias("exempt"))


@query(with_sql(TRACE) + "SELECT episode_id, arg_max(tool, (k, step)) FILTER (tool IN ('purchase', 'signup')) AS commit_tool, max(step) FILTER (tool IN ('view', 'signup')) AS verify_step, min(step) FILTER (produced IS NOT NULL) AS target_step FROM trace GROUP BY episode_id")
def o10_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hooks of an episode: its strongest change (by k, then the later), its last check, and the first step that shows a
    handle."""
    change = F.when(F.col("tool").isin("purchase", "signup"), F.struct("k", "step", "tool"))
    check = F.when(F.col("tool").isin("view", "signup"), F.col("step"))
    g = trace(spark, sf_dir).groupBy("episode_id").agg(F.max(change).alias("c"), F.max(check).alias("verify_step"), F.min(F.when(F.col("produced").isNotNull(), F.col("step"))).alias("target_step"))
    return g.select("episode_id", F.col("c.tool").alias("commit_tool"), "verify_step", "target_step")
