"""Goal alignment over traces, prefix joins of paths, and readiness of workflows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.functions import text as T
from tracequarry.plans.catalog import query
from tracequarry.sources.tables import TRACE, table, trace, with_sql

#: What each tool adds one to; a tool that isn't here only reads.
WRITES = {"view": "seen", "click": "clicks", "purchase": "bought", "error": "errors"}
#: What a reading step observes, by the parity of its k.
READS = (["$state.clicks", "$state.seen"], ["$state.seen", "$state.bought"])


class Clause(NamedTuple):
    """A clause of a goal: its condition on the state, where its change must show, what must observe it, who makes it."""

    id: str
    holds: Callable[[dict[str, Column]], Column]
    transition_paths: list[str]
    evidence_paths: list[str]
    witness_tools: list[str]


CLAUSES = [
    Clause("bought", lambda s: s["bought"] >= 1, ["$state.bought"], ["$state.bought"], ["purchase"]),
    Clause("seen_first", lambda s: s["seen"] >= s["clicks"], ["$state.seen"], ["$state.seen"], ["view", "click"]),
    Clause("few_errors", lambda s: s["errors"] <= 15, ["$state.err"], ["$state.clicks"], ["error"]),
]


def _meets(paths: Column, wanted: list[str]) -> Column:
    """Whether any of the paths overlaps any wanted one."""
    return F.exists(paths, lambda p: reduce(lambda a, b: a | b, [T.paths_overlap(p, F.lit(w)) for w in wanted]))


def _covers(paths: Column, wanted: list[str]) -> Column:
    """Whether every wanted path overlaps one of the paths."""
    return reduce(lambda a, b: a & b, [_meets(paths, [w]) for w in wanted])


def align(steps: DataFrame, clauses: list[Clause], writes: dict[str, str]) -> DataFrame:
    """episode_id, clause_id, temporal mode, witnesses, evidence and error codes: one row an episode and clause.

    steps: episode_id, step, tool, reads, writes (arrays of paths); each tool of `writes` adds one to a member of the
    state, which begins at zero. A clause's truth is followed over the steps. Mode: restored_invariant (true at first, then
    broken, true at last), maintained_invariant (never broken), else outcome. The witness is the first step of a witness
    tool that writes a transition path; the tool that broke a restored clause can't be its witness, and a maintained one
    needs none. Evidence is the last step that writes nothing, comes after the last write of a transition path and reads
    all evidence paths. A witness is necessary if the clause fails without all steps of the witness tools. One running
    sum and one aggregate an episode answer all of it; no plan is run again.
    """
    order = Window.partitionBy("episode_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    state = {key: F.col(f"s_{key}") for key in writes.values()}
    zero = {key: F.lit(0) for key in writes.values()}
    run = steps.select("*", *[F.sum(F.when(F.col("tool") == tool, 1).otherwise(0)).over(order).alias(f"s_{key}") for tool, key in writes.items()])
    place = F.struct("step", "tool")
    wanted = [F.sum(F.when(F.col("tool") == tool, 1).otherwise(0)).alias(f"n_{tool}") for tool in writes]
    for i, c in enumerate(clauses):
        holds, moves = c.holds(state), _meets(F.col("writes"), c.transition_paths)
        wanted += [
            F.max_by(holds, F.col("step")).alias(f"final_{i}"),
            F.min(F.when(~holds, place)).alias(f"broken_{i}"),
            F.coalesce(F.max(F.when(moves, F.col("step"))), F.lit(0)).alias(f"moved_{i}"),
            F.max(F.when((F.size("writes") == 0) & _covers(F.col("reads"), c.evidence_paths), F.col("step"))).alias(f"read_{i}"),
            *[F.min(F.when(moves & (F.col("tool") == tool), F.col("step"))).alias(f"first_{i}_{tool}") for tool in c.witness_tools],
        ]
    g = run.groupBy("episode_id").agg(*wanted)

    def judged(i: int, c: Clause) -> Column:
        final, broken = F.col(f"final_{i}"), F.col(f"broken_{i}")
        begins = c.holds(zero)
        restored, maintained = begins & broken.isNotNull() & final, begins & broken.isNull() & final
        may = {tool: ~(maintained | (restored & (broken["tool"] == tool))) for tool in c.witness_tools}
        witness = F.array_min(F.array(*[F.when(may[tool], F.col(f"first_{i}_{tool}")) for tool in c.witness_tools]))
        without = {key: F.when(may.get(tool, F.lit(False)), 0).otherwise(F.col(f"n_{tool}")) for tool, key in writes.items()}
        necessary = maintained | ~c.holds(without)
        evidence = F.when(F.col(f"read_{i}") > F.col(f"moved_{i}"), F.col(f"read_{i}"))
        nobody = restored & ~reduce(lambda a, b: a | b, may.values())
        codes = [(~final, "unsatisfied"), (nobody, "no_repair_witness"), (~maintained & witness.isNull(), "no_transition"), (evidence.isNull(), "no_evidence"), (~necessary, "unnecessary_witness")]
        errors = F.array_compact(F.array(*[F.when(test, code) for test, code in codes]))
        mode = F.when(restored, "restored_invariant").when(maintained, "maintained_invariant").otherwise("outcome")
        held = F.when(restored, broken)
        return F.struct(F.lit(c.id).alias("clause_id"), mode.alias("mode"), held["step"].alias("violation_step"), held["tool"].alias("violation_tool"), witness.alias("witness_step"), evidence.alias("evidence_step"), necessary.alias("necessary"), F.array_join(errors, ",").alias("errors"))

    return g.select("episode_id", F.inline(F.array(*[judged(i, c) for i, c in enumerate(clauses)])))


def path_steps(t: DataFrame) -> DataFrame:
    """A trace's steps with the paths that they read and write."""
    wrote = reduce(lambda w, x: w.when(F.col("tool") == x[0], F.array(F.lit(f"$state.{x[1]}"))), WRITES.items(), F.when(F.lit(False), F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    read = F.when(F.col("tool").isin(*WRITES), F.array().cast("array<string>")).when(F.col("k") % 2 == 1, F.array(*map(F.lit, READS[1]))).otherwise(F.array(*map(F.lit, READS[0])))
    return t.select("episode_id", "step", "tool", wrote.alias("writes"), read.alias("reads"))


def _clause_sql(name: str, holds: str, begins: str, moves: str, reads: str, witnesses: dict[str, str], ablated: str) -> str:
    """One clause by its own windows: holds, moves and reads are conditions on a step, ablated on the counts left."""
    may = {t: f"NOT (maintained OR (restored AND vt = '{t}'))" for t in witnesses}
    first = "least(" + ", ".join(f"CASE WHEN {may[t]} THEN (SELECT min(step) FROM r x WHERE x.episode_id = m.episode_id AND x.tool = '{t}' AND {on}) END" for t, on in witnesses.items()) + ", NULL)"
    return f"""SELECT episode_id, '{name}' AS clause_id, CASE WHEN restored THEN 'restored_invariant' WHEN maintained THEN 'maintained_invariant' ELSE 'outcome' END AS mode,
      CASE WHEN restored THEN vs END AS violation_step, CASE WHEN restored THEN vt END AS violation_tool, witness AS witness_step, evidence AS evidence_step, necessary,
      concat_ws(',', CASE WHEN NOT final THEN 'unsatisfied' END, CASE WHEN restored AND NOT ({" OR ".join(may.values())}) THEN 'no_repair_witness' END, CASE WHEN NOT maintained AND witness IS NULL THEN 'no_transition' END, CASE WHEN evidence IS NULL THEN 'no_evidence' END, CASE WHEN NOT necessary THEN 'unnecessary_witness' END) AS errors
    FROM (SELECT *, {first} AS witness, CASE WHEN seen_at > moved THEN seen_at END AS evidence, maintained OR NOT ({ablated.format(**may)}) AS necessary
      FROM (SELECT *, {begins} AND vs IS NOT NULL AND final AS restored, {begins} AND vs IS NULL AND final AS maintained
        FROM (SELECT episode_id, arg_max({holds}, step) AS final, min(step) FILTER (NOT ({holds})) AS vs, arg_min(tool, step) FILTER (NOT ({holds})) AS vt, coalesce(max(step) FILTER ({moves}), 0) AS moved, max(step) FILTER (tool = 'signup' AND {reads}) AS seen_at,
          count(*) FILTER (tool = 'view') AS nv, count(*) FILTER (tool = 'click') AS nc, count(*) FILTER (tool = 'purchase') AS np, count(*) FILTER (tool = 'error') AS ne FROM r GROUP BY episode_id)) m) q"""


_RUN = "r AS (SELECT *, count(*) FILTER (tool = 'view') OVER w AS v, count(*) FILTER (tool = 'click') OVER w AS c, count(*) FILTER (tool = 'purchase') OVER w AS p, count(*) FILTER (tool = 'error') OVER w AS e FROM trace WINDOW w AS (PARTITION BY episode_id ORDER BY step))"


@query(
    with_sql(TRACE, _RUN)
    + " UNION ALL ".join(
        [
            _clause_sql("bought", "p >= 1", "false", "tool = 'purchase'", "k % 2 = 1", {"purchase": "true"}, "CASE WHEN {purchase} THEN 0 ELSE np END >= 1"),
            _clause_sql("seen_first", "v >= c", "true", "tool = 'view'", "true", {"view": "true", "click": "false"}, "CASE WHEN {view} THEN 0 ELSE nv END >= CASE WHEN {click} THEN 0 ELSE nc END"),
            _clause_sql("few_errors", "e <= 15", "true", "tool = 'error'", "k % 2 = 0", {"error": "true"}, "CASE WHEN {error} THEN 0 ELSE ne END <= 15"),
        ]
    )
)
def c23_goal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every episode against CLAUSES: a purchase, no click before as many views, and few errors."""
    return align(path_steps(trace(spark, sf_dir)), CLAUSES, WRITES)


def claim_cover(sentences: DataFrame, claims: DataFrame) -> DataFrame:
    """Two-sided cover by place: id, n_sentences, n_claims, first_break, uncovered, invented, exhaustive.

    sentences, claims: id, at, span. Claims have to be the sentences, in order. first_break is the first place where they
    differ; uncovered are places of sentences that no claim of the text repeats, invented those of claims that no sentence
    does. A full join by (id, at) and two semi joins by (id, span); texts aren't gathered.
    """
    s, c = sentences.select("id", "at", F.col("span").alias("s")), claims.select("id", "at", F.col("span").alias("c"))
    places = s.join(c, ["id", "at"], "full").groupBy("id").agg(F.count("s").alias("n_sentences"), F.count("c").alias("n_claims"), F.min(F.when(~F.col("s").eqNullSafe(F.col("c")), F.col("at"))).alias("first_break"))
    lone = lambda x, y, name: x.join(y, ["id", "span"], "left_anti").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda a: a.cast("string")), ",").alias(name))
    out = places.join(lone(sentences, claims, "uncovered"), "id", "left").join(lone(claims, sentences, "invented"), "id", "left")
    return out.select("id", "n_sentences", "n_claims", "first_break", F.coalesce("uncovered", F.lit("")).alias("uncovered"), F.coalesce("invented", F.lit("")).alias("invented"), F.col("first_break").isNull().alias("exhaustive"))


_SPANS = "SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS pl, span FROM (SELECT item_id AS id, i, trim(x) AS span FROM (SELECT item_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS x FROM (SELECT item_id, {} AS l FROM benchmark))) WHERE span <> ''"


@query(
    "WITH s AS (" + _SPANS.format("string_split(text, '. ')") + "), c AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pl) AS pl, span FROM (" + _SPANS.format("string_split(replace(text, ' a ', '. '), '. ')") + """) WHERE (id + pl) % 9 <> 0),
  j AS (SELECT coalesce(s.id, c.id) AS id, coalesce(s.pl, c.pl) AS pl, s.span AS s, c.span AS c FROM s FULL JOIN c ON s.id = c.id AND s.pl = c.pl),
  u AS (SELECT id, string_agg(pl, ',' ORDER BY pl) AS u FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = s.id AND c.span = s.span) GROUP BY id),
  v AS (SELECT id, string_agg(pl, ',' ORDER BY pl) AS v FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = c.id AND s.span = c.span) GROUP BY id),
  g AS (SELECT id, count(s) AS n_sentences, count(c) AS n_claims, min(pl) FILTER (s IS DISTINCT FROM c) AS first_break FROM j GROUP BY id)
  SELECT id, n_sentences, n_claims, first_break, coalesce(u, '') AS uncovered, coalesce(v, '') AS invented, first_break IS NULL AS exhaustive FROM g LEFT JOIN u USING (id) LEFT JOIN v USING (id)"""
)
def c23_claim_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every benchmark item against claims that cut it elsewhere too and leave some out."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    order = Window.partitionBy("id").orderBy("i")

    def spans(text: Column) -> DataFrame:
        cut = items.select("id", F.posexplode(F.split(text, r"\. ")).alias("i", "x")).select("id", "i", F.trim("x").alias("span")).filter("span <> ''")
        return cut.withColumn("at", F.row_number().over(order).cast("long"))

    claims = spans(F.replace("text", F.lit(" a "), F.lit(". "))).filter((F.col("id") + F.col("at")) % 9 != 0)
    claims = claims.withColumn("at", F.row_number().over(order).cast("long"))
    return claim_cover(spans(F.col("text")).select("id", "at", "span"), claims.select("id", "at", "span"))


def prefix_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, a, b: the paths a of left and b of right of one id of which one begins with the other. Distinct.

    Plain prefixes count, whether or not they end at a segment. Every path is exploded into its prefixes and joined by
    equality, once from either side, so rows grow with the length of paths and not with the pairs tried.
    """
    a, b = left.select("id", "path").distinct(), right.select("id", "path").distinct()
    prefixes = lambda df, own: df.select("id", F.col("path").alias(own), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("path"), F.lit(1))), lambda n: F.substring("path", F.lit(1), n))).alias("p"))
    down = a.join(prefixes(b, "b").withColumnRenamed("p", "path"), ["id", "path"]).select("id", F.col("path").alias("a"), "b")
    up = b.join(prefixes(a, "a").withColumnRenamed("p", "path"), ["id", "path"]).select("id", "a", F.col("path").alias("b"))
    return down.union(up).distinct()


def path_coverage(goals: DataFrame, used: DataFrame) -> DataFrame:
    """id, goals, covered, share (4 places), uncovered (sorted, joined): goal paths that some used path overlaps."""
    met = prefix_pairs(goals, used).select("id", F.col("a").alias("path")).distinct().withColumn("met", F.lit(True))
    g = goals.select("id", "path").distinct().join(met, ["id", "path"], "left").groupBy("id").agg(F.count("*").alias("goals"), F.count("met").alias("covered"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("met").isNull(), F.col("path")))), ",").alias("uncovered"))
    return g.withColumn("share", F.round(F.col("covered") / F.col("goals"), 4))


#: Goals of every episode besides those that its errors and large handles name.
GOAL_PATHS = ["$state.purchase", "$state.view.b1", "$state.click.b3.h", "$state.refund"]
_PATHS = "goals AS (SELECT DISTINCT id, path FROM (SELECT episode_id AS id, unnest(['$state.purchase', '$state.view.b1', '$state.click.b3.h', '$state.refund']) AS path FROM trace UNION ALL SELECT episode_id, '$state.error.b' || (k % 3) || '.' || k FROM trace WHERE tool = 'error' OR k > 90)), used AS (SELECT DISTINCT episode_id AS id, '$state.' || tool || '.' || branch || CASE WHEN k % 2 = 0 THEN '.h' || k ELSE '' END AS path FROM trace WHERE tool {} 'signup')"


def _used(t: DataFrame, writes: bool) -> DataFrame:
    path = F.concat(F.lit("$state."), "tool", F.lit("."), "branch", F.when(F.col("k") % 2 == 0, F.concat(F.lit(".h"), F.col("k").cast("string"))).otherwise(""))
    return t.filter((F.col("tool") != "signup") == writes).select(F.col("episode_id").alias("id"), path.alias("path"))


@query(with_sql(TRACE, _PATHS.format("<>")) + "SELECT id, count(*) AS goals, count(*) FILTER (met) AS covered, coalesce(string_agg(path, ',' ORDER BY path) FILTER (NOT met), '') AS uncovered, round(count(*) FILTER (met) / count(*), 4) AS share FROM (SELECT g.*, EXISTS (SELECT 1 FROM used u WHERE u.id = g.id AND (starts_with(u.path, g.path) OR starts_with(g.path, u.path))) AS met FROM goals g) GROUP BY id")
def j17_path_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goal paths of every episode against the paths that its steps write."""
    t = trace(spark, sf_dir)
    fixed = t.select(F.col("episode_id").alias("id"), F.explode(F.array(*map(F.lit, GOAL_PATHS))).alias("path"))
    own = t.filter((F.col("tool") == "error") | (F.col("k") > 90)).select(F.col("episode_id").alias("id"), F.concat(F.lit("$state.error.b"), (F.col("k") % 3).cast("string"), F.lit("."), F.col("k").cast("string")).alias("path"))
    return path_coverage(fixed.unionByName(own), _used(t, True))


def readiness(t: DataFrame) -> DataFrame:
    """episode_id, hidden, undiscovered, unused, ready, strict: whether a workflow knows what it needs in time.

    hidden: values needed at a step before which no step has shown them; undiscovered: values needed before the first step
    that shows anything; unused: shown and never needed, a warning. ready: no error; strict: no warning either. First
    needs and first exposures are two aggregates joined by value, compared by step; no workflow is folded.
    """
    need = t.filter("consumed is not null").groupBy("episode_id", F.col("consumed").alias("h")).agg(F.min("step").alias("needed"))
    show = t.filter("produced is not null").groupBy("episode_id", F.col("produced").alias("h")).agg(F.min("step").alias("shown"))
    first = show.groupBy("episode_id").agg(F.min("shown").alias("first"))
    both = need.join(show, ["episode_id", "h"], "full").join(first, "episode_id", "left")
    late = F.col("needed").isNotNull() & (F.coalesce(F.col("shown") >= F.col("needed"), F.lit(True)))
    blind = F.col("needed").isNotNull() & F.coalesce(F.col("first") >= F.col("needed"), F.lit(True))
    listed = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.concat("h", F.lit("@"), F.col("needed").cast("string"))))), ",")
    g = both.groupBy("episode_id").agg(listed(late).alias("hidden"), listed(blind).alias("undiscovered"), F.count_if(F.col("needed").isNull()).alias("unused"))
    every = t.select("episode_id").distinct().join(g, "episode_id", "left").select("episode_id", F.coalesce("hidden", F.lit("")).alias("hidden"), F.coalesce("undiscovered", F.lit("")).alias("undiscovered"), F.coalesce("unused", F.lit(0)).alias("unused"))
    return every.withColumn("ready", (F.col("hidden") == "") & (F.col("undiscovered") == "")).withColumn("strict", F.col("ready") & (F.col("unused") == 0))


@query(with_sql(TRACE, "n AS (SELECT episode_id, consumed AS h, min(step) AS needed FROM trace WHERE consumed IS NOT NULL GROUP BY 1, 2), s AS (SELECT episode_id, produced AS h, min(step) AS shown FROM trace WHERE produced IS NOT NULL GROUP BY 1, 2), f AS (SELECT episode_id, min(shown) AS first FROM s GROUP BY 1)",
    "e AS (SELECT n.episode_id, h || '@' || needed AS e, NOT EXISTS (SELECT 1 FROM s WHERE s.episode_id = n.episode_id AND s.h = n.h AND s.shown < n.needed) AS late, NOT EXISTS (SELECT 1 FROM f WHERE f.episode_id = n.episode_id AND f.first < n.needed) AS blind FROM n)",
    "u AS (SELECT s.episode_id, count(*) AS unused FROM s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.episode_id = s.episode_id AND n.h = s.h) GROUP BY 1)",
    "g AS (SELECT episode_id, coalesce(string_agg(e, ',' ORDER BY e) FILTER (late), '') AS hidden, coalesce(string_agg(e, ',' ORDER BY e) FILTER (blind), '') AS undiscovered FROM e GROUP BY 1)")
    + "SELECT t.episode_id, coalesce(hidden, '') AS hidden, coalesce(undiscovered, '') AS undiscovered, coalesce(unused, 0) AS unused, coalesce(hidden, '') || coalesce(undiscovered, '') = '' AS ready, coalesce(hidden, '') || coalesce(undiscovered, '') = '' AND coalesce(unused, 0) = 0 AS strict FROM (SELECT DISTINCT episode_id FROM trace) t LEFT JOIN g USING (episode_id) LEFT JOIN u USING (episode_id)")
def v9_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readiness(trace(spark, sf_dir))


@query(with_sql(TRACE) + "SELECT episode_id, branch AS collection, count(*) AS rules, min(step) AS first_step FROM trace t WHERE consumed IS NOT NULL AND NOT EXISTS (SELECT 1 FROM trace p WHERE p.episode_id = t.episode_id AND p.branch = t.branch AND p.produced IS NOT NULL) GROUP BY 1, 2")
def v8_discoverable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections (branches) whose ids are required in an episode though none of its steps lists them."""
    t = trace(spark, sf_dir)
    lists = t.filter("produced is not null").select("episode_id", "branch").distinct()
    lost = t.filter("consumed is not null").join(lists, ["episode_id", "branch"], "left_anti")
    return lost.groupBy("episode_id", F.col("branch").alias("collection")).agg(F.count("*").alias("rules"), F.min("step").alias("first_step"))
