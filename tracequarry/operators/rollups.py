"""Usage, stage, shard and corpus rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.plans.catalog import query
from tracequarry.sources.tables import RESPONSES, responses, table, with_sql


@query("""WITH u AS (SELECT l_returnflag = 'N' AS ok, unnest(['quantity', 'price', 'tax']) AS key, unnest([l_quantity, l_extendedprice, l_tax]) AS v FROM lineitem)
SELECT key, coalesce(CAST(ok AS VARCHAR), 'all') AS ok, count(*) AS n, round(sum(v), 2) AS total FROM u GROUP BY GROUPING SETS ((key, ok), (key))""")
def a9_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of every numeric usage key, by outcome and altogether."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "N").alias("ok"), F.explode(F.create_map(F.lit("quantity"), "l_quantity", F.lit("price"), "l_extendedprice", F.lit("tax"), "l_tax")).alias("key", "v"))
    sets = li.groupingSets([["key", "ok"], ["key"]], "key", "ok").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))
    return sets.select("key", F.coalesce(F.col("ok").cast("string"), F.lit("all")).alias("ok"), "n", "total")


@query(with_sql(RESPONSES) + "SELECT stage, count(*) AS requests, sum(tokens)::BIGINT AS tokens, round(avg(elapsed), 3) AS avg_elapsed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (request_hash = 'stale') AS stale FROM responses GROUP BY stage")
def a10_stage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = responses(spark, sf_dir).groupBy("stage")
    return r.agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.round(F.avg("elapsed"), 3).alias("avg_elapsed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("request_hash") == "stale").alias("stale"))


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, min(length(text)) AS least, round(avg(length(text)), 3) AS mean, max(length(text)) AS most, count(*) FILTER (length(text) > 2000) AS long FROM documents GROUP BY lang")
def a11_corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.min(n).alias("least"), F.round(F.avg(n), 3).alias("mean"), F.max(n).alias("most"), F.count_if(n > 2000).alias("long"))


@query("SELECT coalesce(CAST(o_orderkey // 4096 AS VARCHAR), 'total') AS shard, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY ROLLUP (o_orderkey // 4096)")
def a12_shard_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("shard", F.floor(F.col("o_orderkey") / 4096))
    return o.rollup("shard").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done")).select(F.coalesce(F.col("shard").cast("string"), F.lit("total")).alias("shard"), "n", "done")


#: Three topologies by terms of the tables' own text.
TOPOLOGIES = {"closed_loop": ["the", "and", "of"], "recovery": ["der", "die", "und"], "temporal": ["que", "les", "del"]}


def topology_scores(df: DataFrame, topologies: dict[str, list[str]]) -> DataFrame:
    """Term hits of every topology as columns of a row, then unpivoted: no join with the topologies is needed."""
    low = F.lower("text")
    each = []
    for name, terms in topologies.items():
        found = [low.contains(f" {t} ") for t in terms]
        hits = sum((f.cast("long") for f in found), F.lit(0).cast("long"))
        missing = F.array_join(F.array_compact(F.array(*[F.when(~f, F.lit(t)) for f, t in zip(found, terms, strict=True)])), ",")
        each.append(F.struct(F.lit(name).alias("topology"), hits.alias("hits"), missing.alias("missing"), (F.least(hits, F.lit(3).cast("long")) + F.when(hits == len(terms), 1).otherwise(0)).alias("score")))
    return df.select(F.col("doc_id").alias("id"), F.explode(F.array(*each)).alias("t")).select("id", "t.*")


def _topology_sql() -> str:
    parts = []
    for name, terms in TOPOLOGIES.items():
        hits = " + ".join(f"CAST(contains(lower(text), ' {t} ') AS BIGINT)" for t in terms)
        missing = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT contains(lower(text), ' {t} ') THEN '{t}' END" for t in terms) + ")"
        parts.append(f"SELECT doc_id AS id, '{name}' AS topology, {hits} AS hits, {missing} AS missing, least({hits}, 3) + CASE WHEN ({hits}) = {len(terms)} THEN 1 ELSE 0 END AS score FROM documents")
    return " UNION ALL ".join(parts)


@query(_topology_sql())
def a14_topology_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology_scores(table(spark, sf_dir, "documents"), TOPOLOGIES)


@query(f"WITH s AS ({_topology_sql()}) SELECT id, arg_max(topology, score * 10 + CASE topology WHEN 'closed_loop' THEN 3 WHEN 'recovery' THEN 2 ELSE 1 END) AS best, max(score) AS score FROM s GROUP BY id")
def a14_best_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first topology of the highest score."""
    rank = F.when(F.col("topology") == "closed_loop", 3).when(F.col("topology") == "recovery", 2).otherwise(1)
    return a14_topology_scores(spark, sf_dir).groupBy("id").agg(F.max_by("topology", F.struct("score", rank)).alias("best"), F.max("score").alias("score"))


@query("""WITH f(metric, floor) AS (VALUES ('balance', 3000.0), ('parts', 20.0)), m AS (SELECT s_nationkey AS id, avg(s_acctbal) AS balance, CAST(count(*) AS DOUBLE) AS parts FROM supplier GROUP BY 1),
u AS (SELECT id, 'balance' AS metric, balance AS v FROM m UNION ALL SELECT id, 'parts', parts FROM m) SELECT u.id, u.metric, round(u.v, 4) AS v, floor FROM u JOIN f USING (metric) WHERE u.v < floor - 1e-9""")
def c26_quality_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics below their floor, with a tolerance of 1e-9."""
    m = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.avg("s_acctbal").alias("balance"), F.count("*").cast("double").alias("parts"))
    u = m.unpivot("id", ["balance", "parts"], "metric", "v").withColumn("floor", F.when(F.col("metric") == "balance", 3000.0).otherwise(20.0))
    return u.filter(F.col("v") < F.col("floor") - 1e-9).select("id", "metric", F.round("v", 4).alias("v"), "floor")
