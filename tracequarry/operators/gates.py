"""Gates over whole episodes: profiles of planning, recovery and control, and the ranges that they have to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions.text import bucketize
from tracequarry.operators.episodes import without_step
from tracequarry.operators.trace import DELAYED, FIRST, RECOVERIES, SOURCED, chain_depth, delayed_handles, latest_observations, recoveries
from tracequarry.plans.catalog import query
from tracequarry.sources.tables import TRACE, trace, with_sql

# The ranges of the gate, lowest and highest, by measure.
GATE = {"steps": (15, 25), "necessary": (15, 25), "ratio": (0.75, 1.0), "decisions": (3, 5), "recoveries": (1, 2)}


def profile(t: DataFrame) -> DataFrame:
    """Per episode: steps, necessary steps for bought >= 1 and seen >= 1, their ratio, decisions (tools that took several
    branches on something observed), recoveries, longest distance of a handle, and whether a check follows every change."""
    goal = lambda p: (F.coalesce(F.col(f"{p}bought"), F.lit(0.0)) >= 1) & (F.coalesce(F.col(f"{p}seen"), F.lit(0.0)) >= 1)
    last = lambda *tools: F.coalesce(F.max(F.when(F.col("tool").isin(*tools), F.col("step"))), F.lit(0))
    n = without_step(t.select("episode_id", "step", "tool"), ["bought", "seen"]).groupBy("episode_id").agg(F.count("*").alias("steps"), F.count_if(goal("") & ~goal("without_")).alias("necessary"), (last("view") > last("purchase", "signup")).alias("verified"))
    o = t.join(latest_observations(t).select("episode_id", "step", "source_step"), ["episode_id", "step"], "left").groupBy("episode_id", "tool").agg(F.countDistinct("branch").alias("b"), F.count("source_step").alias("seen"))
    d = o.filter("b >= 2 and seen > 0").groupBy("episode_id").agg(F.count("*").alias("decisions"))
    r = recoveries(t).groupBy("episode_id").agg(F.count("*").alias("recoveries"))
    far = delayed_handles(t).groupBy("episode_id").agg(F.max("distance").alias("longest"))
    j = n.join(d, "episode_id", "left").join(r, "episode_id", "left").join(far, "episode_id", "left").na.fill(0, ["decisions", "recoveries", "longest"])
    return j.withColumn("ratio", F.round(F.col("necessary") / F.col("steps"), 4))


PROFILE = """n AS (SELECT episode_id, count(*) AS steps, count(*) FILTER (tool = 'purchase') AS b, count(*) FILTER (tool = 'view') AS v, coalesce(max(step) FILTER (tool = 'view'), 0) > coalesce(max(step) FILTER (tool IN ('purchase', 'signup')), 0) AS verified FROM trace GROUP BY 1),
 o AS (SELECT t.episode_id, t.tool FROM trace t LEFT JOIN sourced s ON s.episode_id = t.episode_id AND s.step = t.step GROUP BY 1, 2 HAVING count(DISTINCT t.branch) >= 2 AND count(s.source_step) > 0),
 d AS (SELECT episode_id, count(*) AS decisions FROM o GROUP BY 1), rr AS (SELECT episode_id, count(*) AS recoveries FROM recoveries GROUP BY 1), f AS (SELECT episode_id, max(distance) AS longest FROM delayed GROUP BY 1),
 profile AS (SELECT episode_id, steps, CASE WHEN b >= 1 AND v >= 1 THEN (b = 1)::BIGINT + (v = 1)::BIGINT ELSE 0 END AS necessary, round(CASE WHEN b >= 1 AND v >= 1 THEN (b = 1)::BIGINT + (v = 1)::BIGINT ELSE 0 END / steps, 4) AS ratio, coalesce(decisions, 0) AS decisions, coalesce(recoveries, 0) AS recoveries, coalesce(longest, 0) AS longest, verified FROM n LEFT JOIN d USING (episode_id) LEFT JOIN rr USING (episode_id) LEFT JOIN f USING (episode_id))"""
_BASE = (TRACE, FIRST, DELAYED, SOURCED, RECOVERIES, PROFILE)


def outside(ranges: dict[str, tuple[float, float]] = GATE) -> Column:
    """Names of the measures that are outside their range, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(~F.col(n).between(low, high), F.lit(n)) for n, (low, high) in ranges.items()]))


@query(with_sql(*_BASE) + "SELECT episode_id, " + "concat_ws(',', " + ", ".join(f"CASE WHEN NOT {n} BETWEEN {low} AND {high} THEN '{n}' END" for n, (low, high) in GATE.items()) + ") AS failed, " + " AND ".join(f"{n} BETWEEN {low} AND {high}" for n, (low, high) in GATE.items()) + " AS valid FROM profile")
def c22_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over every episode's profile: 15 to 25 steps, as many necessary ones, three quarters of them at least, three
    to five decisions, one or two recoveries. The failed rules are named."""
    p = profile(trace(spark, sf_dir))
    return p.select("episode_id", F.array_join(outside(), ",").alias("failed"), (F.size(outside()) == 0).alias("valid"))


@query(with_sql(*_BASE) + "SELECT episode_id, longest >= 4 AND decisions >= 1 AS planning, recoveries >= 1 AS recovery, verified AS closed_loop, longest >= 4 AND decisions >= 1 AND (recoveries >= 1 OR verified) AS adaptive FROM profile")
def c18_adaptive_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planning, and with it recovery or a closed loop."""
    planning, recovery = (F.col("longest") >= 4) & (F.col("decisions") >= 1), F.col("recoveries") >= 1
    p = profile(trace(spark, sf_dir))
    return p.select("episode_id", planning.alias("planning"), recovery.alias("recovery"), F.col("verified").alias("closed_loop"), (planning & (recovery | F.col("verified"))).alias("adaptive"))


@query(with_sql(*_BASE) + "SELECT c.episode_id, c.recoveries >= p.recoveries AND c.decisions >= p.decisions AS no_regression, greatest(c.longest - p.longest, 0) + greatest(c.decisions - p.decisions, 0) AS gain, c.recoveries >= p.recoveries AND c.decisions >= p.decisions AND greatest(c.longest - p.longest, 0) + greatest(c.decisions - p.decisions, 0) > 0 AND c.verified AS accepted FROM profile c JOIN profile p ON p.episode_id = c.episode_id // 2 AND p.episode_id <> c.episode_id")
def c25_evolution_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A child (its parent has half its id) is accepted if it is verified, loses no recovery or decision, and gains."""
    p = profile(trace(spark, sf_dir)).checkpoint()
    parent = p.select(F.col("episode_id").alias("up"), *[F.col(c).alias(f"p_{c}") for c in ("recoveries", "decisions", "longest")])
    kept = (F.col("recoveries") >= F.col("p_recoveries")) & (F.col("decisions") >= F.col("p_decisions"))
    gain = F.greatest(F.col("longest") - F.col("p_longest"), F.lit(0)) + F.greatest(F.col("decisions") - F.col("p_decisions"), F.lit(0))
    j = p.withColumn("up", F.floor(F.col("episode_id") / 2)).join(parent, "up").filter("up <> episode_id")
    return j.select("episode_id", kept.alias("no_regression"), gain.alias("gain"), (kept & (gain > 0) & F.col("verified")).alias("accepted"))


_CELL = "concat_ws('/', CASE WHEN verified THEN 'closed' ELSE 'open' END, CASE WHEN depth <= 1 THEN 'le_1' WHEN depth <= 2 THEN 'le_2' WHEN depth <= 4 THEN 'le_4' ELSE 'gt_4' END, CASE WHEN decisions <= 0 THEN 'le_0' WHEN decisions <= 1 THEN 'le_1' WHEN decisions <= 3 THEN 'le_3' WHEN decisions <= 6 THEN 'le_6' ELSE 'gt_6' END)"


@query("WITH RECURSIVE " + ",\n".join(_BASE) + """,
links AS (SELECT t.episode_id, t.step, s.source_step FROM trace t LEFT JOIN sourced s ON s.episode_id = t.episode_id AND s.step = t.step),
chain AS (SELECT episode_id, step, 1::BIGINT AS depth FROM links WHERE source_step IS NULL UNION ALL SELECT l.episode_id, l.step, c.depth + 1 FROM links l JOIN chain c ON c.episode_id = l.episode_id AND c.step = l.source_step),
depths AS (SELECT episode_id, max(depth) AS depth FROM chain GROUP BY 1)
SELECT cell, count(*) AS episodes, max(decisions * 1000 + longest) AS score, arg_max(episode_id, (decisions * 1000 + longest, -episode_id)) AS best FROM (SELECT *, """ + _CELL + " AS cell FROM profile JOIN depths USING (episode_id)) GROUP BY cell")
def r20_archive_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes by control, bucketed chain depth and decisions; of every cell the one with most decisions, then distance."""
    t = trace(spark, sf_dir)
    p = profile(t).join(chain_depth(t), "episode_id")
    cell = F.concat_ws("/", F.when(F.col("verified"), "closed").otherwise("open"), bucketize(F.col("depth"), [1, 2, 4]), bucketize(F.col("decisions"), [0, 1, 3, 6]))
    score = F.col("decisions") * 1000 + F.col("longest")
    g = p.groupBy(cell.alias("cell")).agg(F.count("*").alias("episodes"), F.max(score).alias("score"), F.max(F.struct(score.alias("s"), (-F.col("episode_id")).alias("e"))).alias("b"))
    return g.select("cell", "episodes", "score", (-F.col("b.e")).alias("best"))
