"""Nested structures: observations, signatures, references between bundle parts, walks and refreshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.functions import text as T
from tracequarry.functions.json_walk import forbidden_keys, leaves, schema_signature
from tracequarry.operators.trace import latest_observations
from tracequarry.plans.catalog import query
from tracequarry.sources.tables import TRACE, table, trace, with_sql

SOURCED = "sourced AS (SELECT u.episode_id, u.step, u.tool, u.consumed AS handle, p.step AS source_step, p.tool AS source_tool FROM (SELECT * FROM trace WHERE consumed IS NOT NULL) u ASOF LEFT JOIN (SELECT * FROM trace WHERE produced IS NOT NULL) p ON p.episode_id = u.episode_id AND p.produced = u.consumed AND p.step < u.step)"


@query("SELECT event_id AS id, '$.k' AS path, 'k' AS key, json_extract(props, '$.k')::VARCHAR AS value, 'integer' AS kind FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def t6_observed_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar that a response shows, with its path."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.explode(leaves(F.col("props"))).alias("l"))
    return e.select("id", "l.path", "l.key", "l.value", "l.kind")


def _schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and a parameter schema as JSON: a property for every word of a part's type, typed by the word's length."""
    p = table(spark, sf_dir, "part")
    words = F.array_sort(F.array_distinct(F.split(F.lower("p_type"), " ")))
    kind = lambda w: F.when(F.length(w) % 2 == 0, "string").otherwise("integer")
    shown = F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('":{"type":"'), kind(w), F.lit('","description":"'), F.lower("p_brand"), F.lit('"}')))
    text = F.concat(F.lit('{"type":"object","description":"'), F.col("p_brand"), F.lit('","required":["'), words[0], F.lit('"],"properties":{'), F.array_join(shown, ","), F.lit("}}"))
    return p.select(F.col("p_partkey").alias("id"), text.alias("schema"))


_WORDS = "w AS (SELECT p_partkey, list_sort(list_distinct(string_split(lower(p_type), ' '))) AS w FROM part)"


@query(f"WITH {_WORDS} SELECT p_partkey AS id, '{{\"properties\":{{' || array_to_string(list_transform(w, lambda x: '\"' || x || '\":{{\"type\":\"' || CASE WHEN length(x) % 2 = 0 THEN 'string' ELSE 'integer' END || '\"}}'), ',') || '}},\"required\":[\"' || w[1] || '\"],\"type\":\"object\"}}' AS signature FROM w")
def x12_schema_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schemas(spark, sf_dir).select("id", schema_signature(F.col("schema")).alias("signature"))


@query(f"WITH {_WORDS} SELECT p_partkey AS id, '$.description,' || array_to_string(list_transform(w, lambda x: '$.properties.' || x || '.description'), ',') AS leaks FROM w")
def f18_leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths under keys that mustn't be published (descriptions here)."""
    return _schemas(spark, sf_dir).select("id", F.array_join(forbidden_keys(F.col("schema"), ["description", "solution"]), ",").alias("leaks"))


@query("WITH b AS (SELECT l_orderkey AS id, list(l_quantity > 40 ORDER BY l_linenumber, l_partkey, l_extendedprice) AS a FROM lineitem GROUP BY 1) SELECT id, len(list_filter(a, lambda x: x)) = 1 AND a[len(a)] AS valid, CAST(len(list_filter(a, lambda x: x)) AS BIGINT) AS unconditional FROM b")
def v16_final_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one branch always holds, and it is the last."""
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_quantity") > 40).alias("always"))))
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(order.alias("b"))
    n = F.size(F.filter("b", lambda x: x["always"])).cast("long")
    return g.select("id", ((n == 1) & F.element_at("b", -1)["always"]).alias("valid"), n.alias("unconditional"))


@query(with_sql(TRACE, SOURCED) + "SELECT s.episode_id, max(s.step) AS last_use, max(t.step) FILTER (t.tool IN ('view', 'signup')) AS last_read, max(t.step) FILTER (t.tool IN ('view', 'signup')) > max(s.step) AS witnessed FROM sourced s JOIN trace t ON t.episode_id = s.episode_id WHERE s.source_step IS NOT NULL GROUP BY s.episode_id")
def c17_temporal_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a read follows the last sourced use."""
    t = trace(spark, sf_dir)
    use = latest_observations(t).filter("source_step is not null").groupBy("episode_id").agg(F.max("step").alias("last_use"))
    read = t.filter(F.col("tool").isin("view", "signup")).groupBy("episode_id").agg(F.max("step").alias("last_read"))
    return use.join(read, "episode_id", "left").withColumn("witnessed", F.col("last_read") > F.col("last_use"))


@query("SELECT s_suppkey AS id, op AS operator, 's' || s_suppkey || '_' || op AS child FROM supplier, (SELECT unnest(['policy', 'capacity', 'audit', 'route', 'readiness']) AS op) WHERE s_nationkey % 5 <> 0 OR op <> 'audit'")
def r19_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every parent under every operator of a fixed catalogue, by explode rather than a cross join."""
    ops = F.array(*[F.lit(o) for o in ("policy", "capacity", "audit", "route", "readiness")])
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey", F.explode(ops).alias("operator"))
    return c.filter((F.col("s_nationkey") % 5 != 0) | (F.col("operator") != "audit")).select("id", "operator", F.concat(F.lit("s"), F.col("id").cast("string"), F.lit("_"), F.col("operator")).alias("child"))


@query("SELECT a.doc_id AS id, a.source = b.source AND a.lang = b.lang AND sha256(a.text) = sha256(b.text) AS reusable FROM documents a JOIN documents b ON b.doc_id = a.doc_id - a.doc_id % 2")
def r25_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored root is reused only if all its content fields are the same (a row's neighbour stands for it)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.concat_ws("\x1f", "source", "lang", F.sha2("text", 256)), 256).alias("h"))
    stored = d.select(F.col("id").alias("root"), F.col("h").alias("old"))
    return d.withColumn("root", F.col("id") - F.col("id") % 2).join(stored, "root").select("id", (F.col("h") == F.col("old")).alias("reusable"))


@query(with_sql(TRACE, "v AS (SELECT DISTINCT episode_id, step % 4 AS variant FROM trace WHERE error_code IS NULL)") + "SELECT v.episode_id, v.variant FROM v WHERE NOT EXISTS (SELECT 1 FROM trace t WHERE t.episode_id = v.episode_id AND t.step % 4 = v.variant AND t.error_code IS NOT NULL)")
def r8_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants none of whose steps failed."""
    v = trace(spark, sf_dir).groupBy("episode_id", (F.col("step") % 4).alias("variant")).agg(F.count("error_code").alias("failed"))
    return v.filter("failed = 0").select("episode_id", "variant")


@query("SELECT url AS path, NOT (url LIKE '/%' OR regexp_matches(url, '^[A-Za-z]:') OR contains(url, chr(92)) OR regexp_matches(url, '(^|/)[.]{0,2}(/|$)')) AS safe FROM pages")
def x19_safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("url").alias("path"), T.is_safe_name(F.col("url")).alias("safe"))


@query("SELECT o_orderkey AS id, round(o_totalprice / 7, 4) AS rate, CAST(round_even(o_orderkey / CAST(2 AS DOUBLE), 0) AS BIGINT) AS rank FROM orders")
def x21_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates half up at four places, ranks half to even."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 7, 4).alias("rate"), F.rint(F.col("o_orderkey") / 2).cast("long").alias("rank"))


@query("SELECT doc_id AS id, length(text) AS chars, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents WHERE lang <> 'en' AND length(text) >= 50")
def p7_stage_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for rows that have what the stage needs."""
    d = table(spark, sf_dir, "documents").filter((F.col("lang") != "en") & (F.length("text") >= 50))
    return d.select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("chars"), F.size(F.split("text", "\n")).cast("long").alias("lines"))


@query()
def g2_dependency_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded walks of up to five tools over the dependency graph, unique by path.

    Each walk takes, at every step, the outgoing edge that a hash of its seed and the edge ranks first; walks that can't
    go on end. One join a step; the graph has an edge for each pair of tools at most.
    """
    s = latest_observations(trace(spark, sf_dir)).filter("source_step is not null and source_tool <> tool")
    edges = s.groupBy(F.col("source_tool").alias("at"), F.col("tool").alias("to")).agg(F.count("*").alias("n"))
    starts = edges.select("at").distinct()
    walks = starts.select(F.explode(F.sequence(F.lit(1), F.lit(20))).alias("seed"), "at", F.array("at").alias("path"))
    for _ in range(4):
        w = Window.partitionBy("seed", "path").orderBy(F.xxhash64("seed", "path", "to"), "to")
        on = walks.join(edges.select("at", "to"), "at", "left").withColumn("r", F.row_number().over(w)).filter("r = 1")
        walks = on.select("seed", F.coalesce("to", "at").alias("at"), F.when(F.col("to").isNotNull(), F.concat("path", F.array("to"))).otherwise(F.col("path")).alias("path"))
    return walks.groupBy(F.array_join("path", ">").alias("walk")).agg(F.min("seed").alias("seed"), F.max(F.size("path")).alias("tools"))
