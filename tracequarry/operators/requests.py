"""Model requests and responses as tables: construction, repair, materialisation and acceptance. No model is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators.ordering import global_ordinal
from tracequarry.plans.catalog import query
from tracequarry.sources.tables import RESPONSES, VALIDATIONS, responses, table, validations, with_sql

TEMPLATE = "Item {{id}}:\n{{text}}\nSummarise {{id}}."


def render(template: str, **values: Column) -> Column:
    """{{key}} replaced in the order of the keys; what a value brings in isn't looked at again for earlier keys."""
    out = F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{{" + key + "}}"), value)
    return out


def user_message(content: Column) -> Column:
    """One user message as JSON."""
    return F.to_json(F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))))


@query("SELECT item_id AS id, replace(replace('Item {{id}}:' || chr(10) || '{{text}}' || chr(10) || 'Summarise {{id}}.', '{{id}}', CAST(item_id AS VARCHAR)), '{{text}}', text) AS prompt FROM benchmark")
def p3_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("id"), render(TEMPLATE, id=F.col("item_id").cast("string"), text=F.col("text")).alias("prompt"))


@query("SELECT item_id AS id, 'stage1' AS stage, to_json([{'role': 'user', 'content': 'Read: ' || text}])::VARCHAR AS messages, sha256(to_json([{'role': 'user', 'content': 'Read: ' || text}])::VARCHAR) AS request_hash FROM benchmark")
def p4_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = user_message(F.concat(F.lit("Read: "), F.col("text")))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("stage1").alias("stage"), m.alias("messages"), F.sha2(m, 256).alias("request_hash"))


@query(with_sql(VALIDATIONS, "e AS (SELECT id, string_agg(validator || ': ' || errors[1], ';' ORDER BY validator) AS errors FROM validations WHERE NOT valid GROUP BY id)") + "SELECT doc_id AS id, coalesce(errors, '') AS errors, 'Repair ' || doc_id || ': ' || coalesce(errors, 'nothing') AS prompt FROM documents LEFT JOIN e ON e.id = doc_id")
def p6_repair_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its validation errors, none by default."""
    bad = validations(spark, sf_dir).filter(~F.col("valid")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("validator", F.get("errors", F.lit(0)).alias("e")))).alias("l"))
    bad = bad.select("id", F.array_join(F.transform("l", lambda s: F.concat(s["validator"], F.lit(": "), s["e"])), ";").alias("errors"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return d.join(bad, "id", "left").select("id", F.coalesce("errors", F.lit("")).alias("errors"), F.concat(F.lit("Repair "), F.col("id").cast("string"), F.lit(": "), F.coalesce("errors", F.lit("nothing"))).alias("prompt"))


CATALOG = ["policy", "capacity", "audit", "route", "readiness"]


@query("WITH o AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT id, i AS ordinal, ['policy', 'capacity', 'audit', 'route', 'readiness'][i % 5 + 1] AS operator FROM o")
def p11_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue entries dealt in turn to the rows in order."""
    d = global_ordinal(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "id")
    i = F.col("ordinal") - 1
    return d.select("id", i.alias("ordinal"), F.get(F.array(*map(F.lit, CATALOG)), (i % len(CATALOG)).cast("int")).alias("operator"))


@query(with_sql(VALIDATIONS, "p AS (SELECT id, errors[1] AS e, CASE validator WHEN 'length' THEN 1 WHEN 'quality' THEN 2 ELSE 3 END AS place FROM validations WHERE NOT valid)") + "SELECT id, arg_max(e, place) AS error FROM p GROUP BY id")
def p12_validation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of the last source that has one, sources in a fixed order."""
    place = F.when(F.col("validator") == "length", 1).when(F.col("validator") == "quality", 2).otherwise(3)
    return validations(spark, sf_dir).filter(~F.col("valid")).groupBy("id").agg(F.max_by(F.get("errors", F.lit(0)), place).alias("error"))


@query(with_sql(RESPONSES) + "SELECT doc_id AS id, CASE WHEN r.tokens % 3 = 0 THEN 'missing_tool' ELSE 'ready' END AS status, coalesce(CASE WHEN r.tokens % 2 = 0 THEN 'new' END, lang) AS plan, r.tokens - n_chars AS ignored FROM documents JOIN responses r ON r.id = doc_id WHERE r.ok")
def p14_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted answers on their base rows: what an answer has replaces, what it lacks stays."""
    r = responses(spark, sf_dir).filter("ok").select(F.col("id"), "tokens")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    return d.join(r, "id").select("id", F.when(F.col("tokens") % 3 == 0, "missing_tool").otherwise("ready").alias("status"), F.coalesce(F.when(F.col("tokens") % 2 == 0, F.lit("new")), "lang").alias("plan"), (F.col("tokens") - F.col("n_chars")).alias("ignored"))


@query(with_sql(RESPONSES, "c AS (SELECT * FROM responses WHERE ok)", "b AS (SELECT doc_id AS id, length(text) AS n FROM documents)") + "SELECT id, n < 200 AS too_short, tokens > 3000 AS too_long, concat_ws(',', CASE WHEN n < 200 THEN 'too_short' END, CASE WHEN tokens > 3000 THEN 'too_long' END) AS errors FROM b JOIN c USING (id)")
def j10_contract_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles that have an accepted contract, with what is wrong with the pair."""
    c = responses(spark, sf_dir).filter("ok").select("id", "tokens")
    b = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n"))
    short, long = F.col("n") < 200, F.col("tokens") > 3000
    return b.join(c, "id").select("id", short.alias("too_short"), long.alias("too_long"), F.concat_ws(",", F.when(short, "too_short"), F.when(long, "too_long")).alias("errors"))


@query("""WITH seeds AS (SELECT doc_id AS id, sha256(text) AS h, [substr(text, 1, 20), substr(text, CAST(length(text) // 2 AS BIGINT) + 1, 30), substr(text, greatest(length(text) - 14, 1), 15), source] AS spans FROM documents)
SELECT s.id, sha256(d.text) = s.h AS same_source, CAST(len(list_filter(spans, lambda x: NOT contains(d.text, x))) AS BIGINT) AS unsupported, sha256(d.text) = s.h AND len(list_filter(spans, lambda x: NOT contains(d.text, x))) = 0 AND length(d.text) >= 60 AS valid FROM seeds s JOIN documents d ON d.doc_id = s.id""")
def v13_seed_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds whose source is the same text and whose every evidence span stands in it: its head, middle and tail, and the
    name of its source."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    n = F.length("text")
    spans = F.array(F.substring("text", 1, 20), F.substring("text", F.floor(n / 2).cast("int") + 1, F.lit(30)), F.substring("text", F.greatest(n - 14, F.lit(1)), F.lit(15)), F.col("source"))
    seeds = d.select("id", F.sha2("text", 256).alias("h"), spans.alias("spans"))
    same = F.sha2("text", 256) == F.col("h")
    missing = F.size(F.filter("spans", lambda s: ~F.col("text").contains(s))).cast("long")
    return seeds.join(d.select("id", "text"), "id").select("id", same.alias("same_source"), missing.alias("unsupported"), (same & (missing == 0) & (F.length("text") >= 60)).alias("valid"))


@query(with_sql(VALIDATIONS, "a AS (SELECT doc_id AS id, sha256(lower(text)) AS t FROM documents WHERE doc_id IN (SELECT id FROM validations WHERE validator = 'length' AND valid))", "b AS (SELECT l.doc_id AS id, sha256(CASE WHEN l.toxic = 1 THEN upper(lang) ELSE lower(text) END) AS t FROM labels l JOIN documents d ON d.doc_id = l.doc_id)") + """SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'only_audit' WHEN b.id IS NULL THEN 'only_row' WHEN a.t = b.t THEN 'same' ELSE 'differs' END AS verdict FROM a FULL JOIN b ON a.id = b.id""")
def j12_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (texts of a good length) and audits (labelled texts; a toxic one was taken down to its language) one to one by
    id, with equal canonical content; what either lacks shows."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    good = validations(spark, sf_dir).filter("validator = 'length' and valid").select("id")
    n = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    a = d.join(good, "id", "left_semi").select("id", F.sha2(F.lower("text"), 256).alias("a"))
    b = n.join(d, "id").select("id", F.sha2(F.when(F.col("toxic") == 1, F.upper("lang")).otherwise(F.lower("text")), 256).alias("b"))
    verdict = F.when(F.col("a").isNull(), "only_audit").when(F.col("b").isNull(), "only_row").when(F.col("a") == F.col("b"), "same").otherwise("differs")
    return a.join(b, "id", "full_outer").select("id", verdict.alias("verdict"))


@query(with_sql(VALIDATIONS, "n AS (SELECT id, list_sort(list(DISTINCT validator) FILTER (NOT valid)) AS bad FROM validations WHERE validator <> 'length' GROUP BY id)", "o AS (SELECT id, list_sort(list(DISTINCT validator) FILTER (NOT valid)) AS bad FROM validations GROUP BY id)") + "SELECT o.id, len(list_filter(coalesce(n.bad, []), lambda x: NOT list_contains(coalesce(o.bad, []), x))) = 0 AND len(coalesce(n.bad, [])) < len(coalesce(o.bad, [])) AS accepted FROM o JOIN n ON n.id = o.id")
def r26_repair_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repair counts if its errors are a strict subset of those before it (here the length rule is what it mends)."""
    none = F.array().cast("array<string>")
    v = validations(spark, sf_dir)
    bad = lambda rows, name: rows.groupBy("id").agg(F.coalesce(F.collect_set(F.when(~F.col("valid"), F.col("validator"))), none).alias(name))
    j = bad(v, "old").join(bad(v.filter("validator <> 'length'"), "new"), "id")
    return j.select("id", ((F.size(F.array_except("new", "old")) == 0) & (F.size("new") < F.size("old"))).alias("accepted"))
