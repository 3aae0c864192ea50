"""Audits, readiness gates and exports over episodes, documents and tool schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.functions import text as T
from tracequarry.operators.ordering import global_ordinal, sequence_digest, sequence_digest_sql
from tracequarry.operators.trace import latest_observations, recoveries
from tracequarry.plans.catalog import query
from tracequarry.sources.tables import RESPONSES, TRACE, responses, table, trace, with_sql

SOURCED = "sourced AS (SELECT u.episode_id, u.step, u.tool, u.consumed AS handle, p.step AS source_step, p.tool AS source_tool FROM (SELECT * FROM trace WHERE consumed IS NOT NULL) u ASOF LEFT JOIN (SELECT * FROM trace WHERE produced IS NOT NULL) p ON p.episode_id = u.episode_id AND p.produced = u.consumed AND p.step < u.step)"


@query("SELECT doc_id AS id FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 40")
def o1_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 rows in input order: the limit is the operator."""
    return table(spark, sf_dir, "documents").filter("lang = 'de'").select(F.col("doc_id").alias("id")).orderBy("id").limit(40)


@query("SELECT s_suppkey AS id, s_acctbal AS score FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 8")
def o6_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beam of eight."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score")).orderBy(F.desc("score"), "id").limit(8)


@query("SELECT p.page_id AS id, coalesce(d.lang, '') AS source_lang, coalesce(length(d.text), 0) AS source_length FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id * 3")
def j13_manifest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("s"), "lang", F.length("text").cast("long").alias("n"))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") * 3).alias("s"))
    return p.join(d, "s", "left").select("id", F.coalesce("lang", F.lit("")).alias("source_lang"), F.coalesce("n", F.lit(0)).alias("source_length"))


@query(with_sql(TRACE) + "SELECT episode_id, coalesce(max(step) FILTER (tool IN ('purchase', 'signup')), 0) AS last_change, coalesce(max(step) FILTER (tool = 'view'), 0) AS last_check, coalesce(max(step) FILTER (tool IN ('purchase', 'signup')), 0) > coalesce(max(step) FILTER (tool = 'view'), 0) AS unverified FROM trace GROUP BY episode_id")
def w9_unverified_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the last state change comes after the last check: a scan backwards as two maxima."""
    last = lambda *tools: F.coalesce(F.max(F.when(F.col("tool").isin(*tools), F.col("step"))), F.lit(0))
    g = trace(spark, sf_dir).groupBy("episode_id").agg(last("purchase", "signup").alias("last_change"), last("view").alias("last_check"))
    return g.withColumn("unverified", F.col("last_change") > F.col("last_check"))


TIERS = "t AS (SELECT episode_id, count(*) >= 20 AS a, count(error_code) >= 2 AS b, count(*) FILTER (tool = 'purchase') >= 5 AS c, count(DISTINCT branch) = 4 AS d FROM trace GROUP BY 1)"


@query(with_sql(TRACE, TIERS) + "SELECT count(*) AS rows, count(*) FILTER (a) AS tier1, count(*) FILTER (a AND b) AS tier2, count(*) FILTER (a AND b AND c) AS tier3, count(*) FILTER (a AND b AND c AND d) AS tier4 FROM t")
def a15_quality_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested tiers: an episode counts in a tier if it counts in all before it."""
    g = trace(spark, sf_dir).groupBy("episode_id").agg((F.count("*") >= 20).alias("a"), (F.count("error_code") >= 2).alias("b"), (F.count_if(F.col("tool") == "purchase") >= 5).alias("c"), (F.countDistinct("branch") == 4).alias("d"))
    a, ab = F.col("a"), F.col("a") & F.col("b")
    return g.agg(F.count("*").alias("rows"), F.count_if(a).alias("tier1"), F.count_if(ab).alias("tier2"), F.count_if(ab & F.col("c")).alias("tier3"), F.count_if(ab & F.col("c") & F.col("d")).alias("tier4"))


@query(with_sql(RESPONSES) + "SELECT count(*) FILTER (ok) AS accepted, round(sum(elapsed), 3) AS elapsed, round(count(*) FILTER (ok) / (sum(elapsed) / 3600), 3) AS accepted_per_hour, max(elapsed) AS slowest FROM responses")
def a16_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).agg(F.count_if("ok").alias("accepted"), F.round(F.sum("elapsed"), 3).alias("elapsed"), F.round(F.count_if("ok") / (F.sum("elapsed") / 3600), 3).alias("accepted_per_hour"), F.max("elapsed").alias("slowest"))


@query(with_sql(TRACE) + "SELECT episode_id, step, tool, greatest(64 - step, 0) AS remaining_steps, step > 64 AS over_budget FROM trace")
def p18_policy_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a policy may see: no branches, errors or values. Steps beyond the budget are marked."""
    left = F.greatest(F.lit(64) - F.col("step"), F.lit(0).cast("long"))
    return trace(spark, sf_dir).select("episode_id", "step", "tool", left.alias("remaining_steps"), (F.col("step") > 64).alias("over_budget"))


@query(with_sql(TRACE) + "SELECT episode_id, concat_ws(';', CASE WHEN count(error_code) > 0 THEN 'errors=' || count(error_code) END, CASE WHEN count(*) FILTER (tool = 'purchase') = 0 THEN 'no_purchase' END, 'steps_diagnostic={\"steps\":' || count(*) || '}') AS feedback FROM trace GROUP BY episode_id")
def p21_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and a diagnostic as one list of strings."""
    g = trace(spark, sf_dir).groupBy("episode_id").agg(F.count("error_code").alias("e"), F.count_if(F.col("tool") == "purchase").alias("p"), F.count("*").alias("steps"))
    parts = F.array_compact(F.array(F.when(F.col("e") > 0, F.concat(F.lit("errors="), F.col("e").cast("string"))), F.when(F.col("p") == 0, "no_purchase"), F.concat(F.lit("steps_diagnostic="), F.to_json(F.struct("steps")))))
    return g.select("episode_id", F.array_join(parts, ";").alias("feedback"))


_CALLS = "o AS (SELECT episode_id, tool, consumed, row_number() OVER (PARTITION BY episode_id, tool ORDER BY step) AS i FROM trace WHERE tool IN ('click', 'purchase')), d AS (" + sequence_digest_sql("o", "episode_id, tool", "i", "consumed", "digest") + "), n AS (SELECT episode_id, count(*) FILTER (tool = 'click') AS calls, count(*) FILTER (tool = 'purchase') AS results FROM trace GROUP BY 1)"


@query(with_sql(TRACE, _CALLS) + "SELECT n.episode_id, calls, results, c.digest AS call_digest, r.digest AS result_digest, coalesce(c.digest = r.digest, false) AS balanced FROM n LEFT JOIN d c ON c.episode_id = n.episode_id AND c.tool = 'click' LEFT JOIN d r ON r.episode_id = n.episode_id AND r.tool = 'purchase'")
def v14_balanced_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results of an episode; balanced if their ids in order are the same, told by digests of the two lists."""
    t = trace(spark, sf_dir)
    o = t.filter(F.col("tool").isin("click", "purchase")).withColumn("i", F.row_number().over(Window.partitionBy("episode_id", "tool").orderBy("step")))
    d = sequence_digest(o, ["episode_id", "tool"], "i", "consumed", "digest")
    of = lambda tool: F.max(F.when(F.col("tool") == tool, F.col("digest")))
    both = d.groupBy("episode_id").agg(of("click").alias("call_digest"), of("purchase").alias("result_digest"))
    n = t.groupBy("episode_id").agg(F.count_if(F.col("tool") == "click").alias("calls"), F.count_if(F.col("tool") == "purchase").alias("results"))
    return n.join(both, "episode_id", "left").withColumn("balanced", F.coalesce(F.col("call_digest") == F.col("result_digest"), F.lit(False)))


@query(with_sql(TRACE, SOURCED, "n AS (SELECT episode_id, min(step) FILTER (error_code IS NOT NULL) AS divergence FROM trace GROUP BY 1)") + "SELECT n.episode_id, divergence, count(s.step) FILTER (s.source_step < divergence) AS seen_before, count(s.step) FILTER (s.source_step < divergence) > 0 AS grounded FROM n LEFT JOIN sourced s ON s.episode_id = n.episode_id WHERE divergence IS NOT NULL GROUP BY n.episode_id, divergence")
def c14_decision_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations before the first failure, which is where strategies part."""
    t = trace(spark, sf_dir)
    n = t.groupBy("episode_id").agg(F.min(F.when(F.col("error_code").isNotNull(), F.col("step"))).alias("divergence")).filter("divergence is not null")
    s = latest_observations(t).select("episode_id", "source_step")
    g = n.join(s, "episode_id", "left").groupBy("episode_id", "divergence").agg(F.count_if(F.col("source_step") < F.col("divergence")).alias("seen_before"))
    return g.withColumn("grounded", F.col("seen_before") > 0)


@query(with_sql(TRACE, "m AS (SELECT episode_id, k % 5 AS axis, min(step) FILTER (tool = 'view') AS v FROM trace GROUP BY 1, 2)", "c AS (SELECT m.*, (SELECT min(step) FROM trace t WHERE t.episode_id = m.episode_id AND t.k % 5 = m.axis AND t.tool = 'click' AND t.step > m.v) AS c FROM m WHERE v IS NOT NULL)", "r AS (SELECT c.*, (SELECT max(step) FROM trace t WHERE t.episode_id = c.episode_id AND t.k % 5 = c.axis AND t.tool IN ('view', 'signup') AND t.step > c.c) AS r FROM c WHERE c IS NOT NULL)") + "SELECT episode_id, axis, v AS measured, c AS controlled, r AS read_back FROM r WHERE r IS NOT NULL")
def c16_closed_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First measurement of an axis, first control after it, last read after that: running minima instead of a triple join."""
    t = trace(spark, sf_dir).withColumn("axis", F.col("k") % 5)
    w = Window.partitionBy("episode_id", "axis")
    first_view = F.min(F.when(F.col("tool") == "view", F.col("step"))).over(w)
    a = t.withColumn("measured", first_view)
    a = a.withColumn("controlled", F.min(F.when((F.col("tool") == "click") & (F.col("step") > F.col("measured")), F.col("step"))).over(w))
    read = F.max(F.when(F.col("tool").isin("view", "signup") & (F.col("step") > F.col("controlled")), F.col("step")))
    return a.groupBy("episode_id", "axis").agg(F.min("measured").alias("measured"), F.min("controlled").alias("controlled"), read.alias("read_back")).filter("read_back is not null")


@query(with_sql(TRACE, "c AS (SELECT DISTINCT error_code FROM trace WHERE error_code IS NOT NULL)", "t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(upper(text), 'E[0-9]+'))) AS code FROM documents)", "l AS (SELECT doc_id, string_agg(code, ',' ORDER BY code) AS leaked FROM t WHERE code IN (SELECT error_code FROM c) GROUP BY 1)") + "SELECT doc_id AS id, coalesce(leaked, '') AS leaked FROM documents LEFT JOIN l USING (doc_id)")
def c20_route_hiding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error codes that an instruction (a whole text) gives away.

    What looks like a code is joined with the codes there are, however many, so no list of codes goes along.
    """
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    codes = trace(spark, sf_dir).select(F.col("error_code").alias("code")).filter("code is not null").distinct()
    seen = d.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit("E[0-9]+"), F.lit(0)))).alias("code"))
    leaked = seen.join(codes, "code", "left_semi").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("leaked"))
    return d.select("id").join(leaked, "id", "left").na.fill("", ["leaked"])


PROFILE = "p AS (SELECT episode_id, count(*) AS steps, count(DISTINCT tool) AS tools, count(DISTINCT branch) AS branches, count(DISTINCT produced) AS handles FROM trace GROUP BY 1)"


@query(with_sql(TRACE, PROFILE) + "SELECT c.episode_id, c.steps - p.steps AS d_steps, c.tools - p.tools AS d_tools, c.branches - p.branches AS d_branches, c.handles - p.handles AS d_handles, greatest(c.steps - p.steps, 0) + greatest(c.tools - p.tools, 0) + greatest(c.branches - p.branches, 0) + greatest(c.handles - p.handles, 0) AS gain FROM p c JOIN p ON p.episode_id = c.episode_id // 2 AND c.episode_id <> p.episode_id")
def c24_complexity_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A child's profile less its parent's (id halved), and the sum of gains."""
    names = ["steps", "tools", "branches", "handles"]
    p = trace(spark, sf_dir).groupBy("episode_id").agg(F.count("*").alias("steps"), F.countDistinct("tool").alias("tools"), F.countDistinct("branch").alias("branches"), F.countDistinct("produced").alias("handles"))
    parent = p.select(F.col("episode_id").alias("up"), *[F.col(n).alias(f"p_{n}") for n in names])
    j = p.withColumn("up", F.floor(F.col("episode_id") / 2)).join(parent, "up").filter("episode_id <> up")
    gaps = {n: F.col(n) - F.col(f"p_{n}") for n in names}
    gain = sum((F.greatest(g, F.lit(0)) for g in gaps.values()), F.lit(0))
    return j.select("episode_id", *[g.alias(f"d_{n}") for n, g in gaps.items()], gain.alias("gain"))


@query("WITH p AS (SELECT page_id, url AS a, 'http' || substr(url, 5, page_id % 12) AS b FROM pages) SELECT page_id AS id, starts_with(a, b) OR starts_with(b, a) AS overlaps FROM p")
def f14_path_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain prefixes count, whether or not they end at a segment."""
    n = (F.col("page_id") % 12).cast("int")
    b = F.concat(F.lit("http"), F.col("url").substr(F.lit(5), n))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), T.paths_overlap(F.col("url"), b).alias("overlaps"))


@query(with_sql(RESPONSES) + "SELECT sha256(concat_ws(chr(31), 'v1', stage, request_hash, 'model')) AS key, count(*) AS uses, bool_or(ok) AS cached FROM responses GROUP BY 1")
def x5_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of versioned requests with the public part of the provider's settings."""
    key = F.sha2(F.concat_ws("\x1f", F.lit("v1"), "stage", "request_hash", F.lit("model")), 256)
    return responses(spark, sf_dir).groupBy(key.alias("key")).agg(F.count("*").alias("uses"), F.bool_or("ok").alias("cached"))


@query(with_sql(TRACE, "q AS (SELECT *, coalesce(sum(CASE WHEN error_code IS NULL OR error_code = 'E4' THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS request FROM trace)") + "SELECT episode_id, request, count(*) AS attempts, (count(*) * (count(*) - 1))::DOUBLE AS waited, bool_or(error_code IS NULL) AS ok, coalesce(bool_or(error_code = 'E4'), false) AS rejected FROM q GROUP BY episode_id, request")
def l2_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and their attempts: an error is a failed attempt that the next step repeats, but E4, which is permanent
    and ends the request. waited: seconds of a backoff that grows by two with every attempt."""
    ends = (F.col("error_code").isNull() | (F.col("error_code") == "E4")).cast("int")
    before = Window.partitionBy("episode_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    q = trace(spark, sf_dir).withColumn("request", F.coalesce(F.sum(ends).over(before), F.lit(0)).cast("long"))
    n = F.count("*")
    return q.groupBy("episode_id", "request").agg(n.alias("attempts"), (n * (n - 1)).cast("double").alias("waited"), F.bool_or(F.col("error_code").isNull()).alias("ok"), F.coalesce(F.bool_or(F.col("error_code") == "E4"), F.lit(False)).alias("rejected"))


_RENDERED = "r AS (SELECT episode_id, step, i AS rendering, CASE WHEN i = 0 THEN tool ELSE tool || '_' || i END AS name FROM trace, (SELECT unnest([0, 1, 2]) AS i)), d AS (" + sequence_digest_sql("r", "episode_id, rendering", "step", "name", "trace_hash") + ")"


@query(with_sql(TRACE, _RENDERED) + "SELECT episode_id, rendering, CASE WHEN rendering = 0 THEN 'canonical' ELSE 'seed_' || rendering END AS kind, trace_hash FROM d")
def m4_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical sample of every whole episode and two renderings."""
    r = trace(spark, sf_dir).select("episode_id", "step", "tool").withColumn("rendering", F.explode(F.sequence(F.lit(0), F.lit(2))))
    i = F.col("rendering").cast("string")
    r = r.withColumn("name", F.when(F.col("rendering") == 0, F.col("tool")).otherwise(F.concat_ws("_", "tool", i)))
    return sequence_digest(r, ["episode_id", "rendering"], "step", "name", "trace_hash").select("episode_id", "rendering", F.when(F.col("rendering") == 0, "canonical").otherwise(F.concat(F.lit("seed_"), i)).alias("kind"), "trace_hash")


@query(with_sql(TRACE, "g AS (" + sequence_digest_sql("trace", "episode_id", "step", "tool", "fp") + ")") + "SELECT fp AS fingerprint, min(episode_id) AS id, count(*) AS episodes, 'tier' || (min(episode_id) % 3) AS tier FROM g GROUP BY fp")
def m3_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes for export, one of each shape (the whole sequence of tools), with a tier label."""
    g = sequence_digest(trace(spark, sf_dir), ["episode_id"], "step", "tool", "fingerprint")
    return g.groupBy("fingerprint").agg(F.min("episode_id").alias("id"), F.count("*").alias("episodes")).withColumn("tier", F.concat(F.lit("tier"), (F.col("id") % 3).cast("string")))


@query(with_sql(TRACE) + "SELECT tool, bool_or(resolves IS NOT NULL OR produced IS NOT NULL) AS mutating, count(DISTINCT branch) AS branches FROM trace GROUP BY tool")
def f12_mutating_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).groupBy("tool").agg(F.bool_or(F.col("resolves").isNotNull() | F.col("produced").isNotNull()).alias("mutating"), F.countDistinct("branch").alias("branches"))


@query(with_sql(TRACE, "r AS (SELECT *, lag(step) OVER w AS b, lag(error_code) OVER w AS e FROM (SELECT *, coalesce(error_code, resolves) AS code FROM trace WHERE coalesce(error_code, resolves) IS NOT NULL) WINDOW w AS (PARTITION BY episode_id, code ORDER BY step))") + "SELECT episode_id, count(*) AS recoveries, round(avg(step - b), 4) AS mean_gap, max(step - b) AS longest_gap FROM r WHERE resolves IS NOT NULL AND e IS NOT NULL GROUP BY episode_id")
def j16_recovery_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("recovery_step") - F.col("failure_step")
    return recoveries(trace(spark, sf_dir)).groupBy("episode_id").agg(F.count("*").alias("recoveries"), F.round(F.avg(gap), 4).alias("mean_gap"), F.max(gap).alias("longest_gap"))


@query("SELECT doc_id AS id, replace(text, 'license', '***') AS redacted_hash FROM documents WHERE contains(text, 'license')")
def x18_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.col("text").contains("license"))
    return d.select(F.col("doc_id").alias("id"), T.redacted(F.col("text"), F.lit("license")).alias("redacted_hash"))


@query("SELECT url AS path, replace(replace(url, '~', '~0'), '/', '~1') AS pointer FROM pages")
def x17_json_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("url").alias("path"), T.pointer_token(F.col("url")).alias("pointer"))


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents) SELECT doc_id AS id, CAST((i - 1) % 4 AS BIGINT) AS worker FROM o")
def l3_ordered_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests dealt to four workers in input order."""
    d = global_ordinal(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "id")
    return d.select("id", ((F.col("ordinal") - 1) % 4).alias("worker"))
