"""Base tables, and the canonical relations derived from them.

Each relation is a DataFrame here and a common table expression for the SQL twins. Relations carry the columns that the
operators name: documents(id, title, body, text), messages(id, idx, role, text), trace(episode_id, step, tool, handle,
...), validations(id, validator, valid, errors).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title: the first line; body: the rest."""
    d = table(spark, sf_dir, "documents")
    head = F.substring_index("text", "\n", 1)
    return d.select(F.col("doc_id").alias("id"), "text", "lang", "source", head.alias("title"), F.col("text").substr(F.length(head) + 2, F.length("text")).alias("body"))


DOCUMENTS = "documents_rel AS (SELECT doc_id AS id, text, lang, source, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS body FROM documents)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("id"), F.col("turn").alias("idx"), "role", "text")


MESSAGES = "messages AS (SELECT conv_id AS id, turn AS idx, role, text FROM conversations)"

#: Events as tool-use episodes: a user's events in order are the steps; signup and view produce the handle props.k,
#: click and purchase consume it; an error has code E(k mod 5), which a purchase with the same k mod 5 resolves; the
#: branch taken is k mod 4.
STEP_ORDER = ("ts", "event_id")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy(*STEP_ORDER)).cast("long")
    kind: Column = F.col("event_type")
    return e.select(
        F.col("user_id").alias("episode_id"),
        step.alias("step"),
        kind.alias("tool"),
        k.alias("k"),
        F.concat(F.lit("b"), (k % 4).cast("string")).alias("branch"),
        F.when(kind.isin("signup", "view"), F.concat(F.lit("h"), k.cast("string"))).alias("produced"),
        F.when(kind.isin("click", "purchase"), F.concat(F.lit("h"), k.cast("string"))).alias("consumed"),
        F.when(kind == "error", F.concat(F.lit("E"), (k % 5).cast("string"))).alias("error_code"),
        F.when(kind == "purchase", F.concat(F.lit("E"), (k % 5).cast("string"))).alias("resolves"),
        "value",
    )


TRACE = """events_k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
trace AS (
  SELECT user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type AS tool, k,
         'b' || (k % 4) AS branch,
         CASE WHEN event_type IN ('signup', 'view') THEN 'h' || k END AS produced,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'h' || k END AS consumed,
         CASE WHEN event_type = 'error' THEN 'E' || (k % 5) END AS error_code,
         CASE WHEN event_type = 'purchase' THEN 'E' || (k % 5) END AS resolves, value
  FROM events_k)"""

#: Three validators over documents: labelled quality, labelled toxicity, and a length rule.
LENGTH_RULE = (200, 4000)


def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, validator, valid, errors: one row a document and validator that saw it."""
    d = table(spark, sf_dir, "documents")
    n = table(spark, sf_dir, "labels")
    low, high = LENGTH_RULE
    none = F.array().cast("array<string>")

    def rows(df: DataFrame, name: str, valid: Column, error: Column) -> DataFrame:
        return df.select(F.col("doc_id").alias("id"), F.lit(name).alias("validator"), valid.alias("valid"), F.when(valid, none).otherwise(F.array(error)).alias("errors"))

    quality = rows(n, "quality", F.col("quality") == 1, F.lit("json: unterminated string"))
    toxic = rows(n, "toxic", F.col("toxic") == 0, F.lit("argument is not grounded in prior context"))
    fits = F.length("text").between(low, high)
    length = rows(d, "length", fits, F.concat(F.lit("length "), F.length("text").cast("string"), F.lit(" out of bounds")))
    return quality.unionByName(toxic).unionByName(length)


VALIDATIONS = """validations AS (
  SELECT doc_id AS id, 'quality' AS validator, quality = 1 AS valid, CASE WHEN quality = 1 THEN []::VARCHAR[] ELSE ['json: unterminated string'] END AS errors FROM labels
  UNION ALL SELECT doc_id, 'toxic', toxic = 0, CASE WHEN toxic = 0 THEN []::VARCHAR[] ELSE ['argument is not grounded in prior context'] END FROM labels
  UNION ALL SELECT doc_id, 'length', length(text) BETWEEN 200 AND 4000, CASE WHEN length(text) BETWEEN 200 AND 4000 THEN []::VARCHAR[] ELSE ['length ' || length(text) || ' out of bounds'] END FROM documents)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, stage, request_hash: one model request a document."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.concat(F.lit("stage"), (F.col("doc_id") % 3).cast("string")).alias("stage"), F.sha2("text", 256).alias("request_hash"))


REQUESTS = "requests AS (SELECT doc_id AS id, 'stage' || (doc_id % 3) AS stage, sha256(text) AS request_hash FROM documents)"


#: Characters that a request of the earlier run could hold.
RUN_LIMIT = 20_000


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of an earlier run: every 7th was to another text, every 5th failed, none came for texts above RUN_LIMIT."""
    r = requests(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("tokens")), "id")
    stale = F.when(F.col("id") % 7 == 0, F.lit("stale")).otherwise(F.col("request_hash"))
    return r.filter(F.col("tokens") <= RUN_LIMIT).select("id", "stage", stale.alias("request_hash"), (F.col("id") % 5 != 0).alias("ok"), "tokens", ((F.col("id") % 11) * F.lit(0.5)).alias("elapsed"))


RESPONSES = """responses AS (
  SELECT doc_id AS id, 'stage' || (doc_id % 3) AS stage, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE sha256(text) END AS request_hash,
         doc_id % 5 <> 0 AS ok, CAST(length(text) AS BIGINT) AS tokens, (doc_id % 11) * CAST(0.5 AS DOUBLE) AS elapsed
  FROM documents WHERE length(text) <= 20000)"""


def with_sql(*relations: str) -> str:
    """WITH clause of the given relations."""
    return "WITH " + ",\n".join(relations) + "\n"
