"""Algebra over validation results: joins by id, merges, set operations, summaries and the quality gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.plans.catalog import query
from tracequarry.sources.tables import REQUESTS, RESPONSES, VALIDATIONS, requests, responses, table, validations, with_sql

# Buckets of a first error, the first that matches wins.
BUCKETS = [
    ("json_parse", ["json", "unterminated string", "expecting"]),
    ("environment_branch_miss", ["no executable branch matched"]),
    ("duplicate_tool_call", ["duplicate tool call"]),
    ("tool_loop_guard", ["already been called"]),
    ("missing_final_verification", ["finalization rejected", "last tool call"]),
    ("grounding", ["grounded"]),
    ("workflow_coverage", ["workflow tools not used"]),
]
GATE = {"completion": 0.8, "strict": 0.8, "execution": 0.95, "final_yield": 0.7}


def of(v: DataFrame, name: str) -> DataFrame:
    return v.filter(F.col("validator") == name)


def passed_by_all(v: DataFrame, names: list[str]) -> DataFrame:
    """Ids that every named validator saw and accepted: one aggregate instead of a join for each validator."""
    each = [F.bool_or(F.when(F.col("validator") == n, F.col("valid")).otherwise(False)).alias(n) for n in names]
    return v.filter(F.col("validator").isin(*names)).groupBy("id").agg(*each).filter(reduce(lambda a, b: a & b, [F.col(n) for n in names])).select("id")


def failed_by_any(v: DataFrame) -> DataFrame:
    return v.filter(~F.col("valid")).select("id").distinct()


@query(with_sql(VALIDATIONS) + "SELECT doc_id AS id, lang FROM documents WHERE doc_id IN (SELECT id FROM validations WHERE validator = 'quality' AND valid)")
def j1_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = of(validations(spark, sf_dir), "quality").filter("valid").select(F.col("id").alias("doc_id"))
    return table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "lang")


@query(with_sql(VALIDATIONS) + "SELECT id FROM validations WHERE validator = 'quality' AND valid INTERSECT SELECT id FROM validations WHERE validator = 'toxic' AND valid INTERSECT SELECT id FROM validations WHERE validator = 'length' AND valid")
def j2_valid_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passed_by_all(validations(spark, sf_dir), ["quality", "toxic", "length"])


@query(with_sql(VALIDATIONS) + "SELECT DISTINCT id FROM validations WHERE NOT valid")
def j3_invalid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed_by_any(validations(spark, sf_dir))


def replace_by_id(base: DataFrame, replacement: DataFrame, order: str, key: str = "id") -> DataFrame:
    """base with the columns of the last replacement of each id where there is one."""
    others = [c for c in base.columns if c != key]
    last = replacement.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("__new"))
    return base.join(last, key, "left").select(key, *[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in others])


@query(with_sql(RESPONSES) + "SELECT doc_id AS id, coalesce(r.request_hash, lang) AS mark FROM documents LEFT JOIN (SELECT id % 500 AS id, arg_max(request_hash, id) AS request_hash FROM responses WHERE ok GROUP BY id % 500) r ON r.id = doc_id")
def j4_replace_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several responses fall on one id; the last wins."""
    base = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("mark"))
    new = responses(spark, sf_dir).filter("ok").select((F.col("id") % 500).alias("id"), F.col("request_hash").alias("mark"), F.col("id").alias("at"))
    return replace_by_id(base, new, "at")


@query(with_sql(VALIDATIONS, "p AS (SELECT doc_id AS id, 'p' || doc_id AS row FROM documents WHERE lang <> 'es')", "f AS (SELECT doc_id AS id, 'f' || doc_id AS row FROM labels)", "ok AS (SELECT id FROM validations WHERE validator = 'length' AND valid)") + """
SELECT coalesce(p.id, f.id) AS id, CASE WHEN p.id IS NULL OR (ok.id IS NULL AND f.id IS NOT NULL) THEN f.row ELSE p.row END AS row, p.id IS NULL OR (ok.id IS NULL AND f.id IS NOT NULL) AS fallback
FROM p FULL JOIN f ON p.id = f.id LEFT JOIN ok ON ok.id = coalesce(p.id, f.id)""")
def j5_fallback_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that aren't valid are replaced by the fallback's, rows only the fallback has are added; both are marked.

    The run didn't do Spanish texts; the fallback has the labelled ones.
    """
    p = table(spark, sf_dir, "documents").filter("lang <> 'es'").select(F.col("doc_id").alias("id"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("p"))
    f = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("f"))
    ok = of(validations(spark, sf_dir), "length").filter("valid").select("id", F.lit(True).alias("ok"))
    use = F.col("p").isNull() | (F.col("ok").isNull() & F.col("f").isNotNull())
    return p.join(f, "id", "full_outer").join(ok, "id", "left").select("id", F.when(use, F.col("f")).otherwise(F.col("p")).alias("row"), use.alias("fallback"))


@query(with_sql(VALIDATIONS, "e AS (SELECT id, validator, unnest(errors) AS e FROM validations WHERE NOT valid)") + "SELECT id, string_agg(validator || ': ' || e, ';' ORDER BY validator, e) AS errors FROM e GROUP BY id")
def j6_combine_validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every invalid id with all its errors, each with its validator's name; validators are few, so a list is short."""
    bad = validations(spark, sf_dir).filter(~F.col("valid")).select("id", "validator", F.explode("errors").alias("e"))
    listed = F.array_sort(F.collect_list(F.struct("validator", "e")))
    return bad.groupBy("id").agg(F.array_join(F.transform(listed, lambda s: F.concat(s["validator"], F.lit(": "), s["e"])), ";").alias("errors"))


@query(with_sql(VALIDATIONS) + "SELECT doc_id AS id, coalesce(len(v.errors), 0)::BIGINT AS n_errors, coalesce(v.valid, true) AS valid FROM documents LEFT JOIN validations v ON v.id = doc_id AND v.validator = 'quality'")
def j7_left_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = of(validations(spark, sf_dir), "quality")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return d.join(v, "id", "left").select("id", F.coalesce(F.size("errors"), F.lit(0)).cast("long").alias("n_errors"), F.coalesce("valid", F.lit(True)).alias("valid"))


@query(with_sql(RESPONSES) + "SELECT doc_id AS id, lang, r.tokens FROM documents JOIN responses r ON r.id = doc_id AND r.ok")
def j8_response_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = responses(spark, sf_dir).filter("ok").select("id", "tokens")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang").join(ok, "id")


@query(with_sql(REQUESTS, RESPONSES) + "SELECT id, stage, request_hash FROM requests q WHERE NOT EXISTS (SELECT 1 FROM responses r WHERE r.id = q.id AND r.request_hash = q.request_hash AND r.ok)")
def j9_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests without an accepted answer to the same request."""
    done = responses(spark, sf_dir).filter("ok").select("id", "request_hash")
    return requests(spark, sf_dir).join(done, ["id", "request_hash"], "left_anti").select("id", "stage", "request_hash")


@query(with_sql(VALIDATIONS) + "SELECT id FROM validations WHERE validator = 'length' AND valid EXCEPT SELECT id FROM validations WHERE validator = 'toxic' AND valid")
def u3_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = validations(spark, sf_dir).filter("valid")
    return of(v, "length").select("id").subtract(of(v, "toxic").select("id"))


@query(with_sql(VALIDATIONS) + "SELECT id FROM validations WHERE validator = 'quality' AND valid INTERSECT SELECT id FROM validations WHERE validator = 'toxic' AND NOT valid")
def u2_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = validations(spark, sf_dir)
    return of(v, "quality").filter("valid").select("id").intersect(of(v, "toxic").filter(~F.col("valid")).select("id"))


@query("SELECT 'd' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'p', page_id FROM pages UNION ALL SELECT 'b', item_id FROM benchmark")
def u1_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("d", "documents", "doc_id"), ("p", "pages", "page_id"), ("b", "benchmark", "item_id")]
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).select(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, t, c in parts])


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang HAVING count(*) > 1")
def u4_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur more than once: the rows a strict load rejects."""
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT source, min(doc_id) AS id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
def u5_first_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key, by an aggregate that combines before the shuffle."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("id"), F.min_by("lang", "doc_id").alias("lang"))


@query("SELECT min(doc_id) AS id, sha256(text) AS fingerprint, count(*) AS copies FROM documents GROUP BY sha256(text)")
def u6_fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))


@query("""WITH e AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS tools FROM events GROUP BY user_id)
SELECT user_id AS id, array_to_string(list_sort(list_filter(['click', 'purchase', 'view', 'delete'], lambda x: NOT list_contains(tools, x))), ',') AS missing, array_to_string(list_sort(list_filter(tools, lambda x: NOT list_contains(['click', 'purchase', 'view', 'delete'], x))), ',') AS extra FROM e""")
def u8_symmetric_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that only the rules or only the episode have."""
    rules = F.array(*map(F.lit, ["click", "purchase", "view", "delete"]))
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.collect_set("event_type").alias("tools"))
    shown = lambda a: F.array_join(F.array_sort(a), ",")
    return e.select("id", shown(F.array_except(rules, "tools")).alias("missing"), shown(F.array_except("tools", rules)).alias("extra"))


def first_error_bucket(errors: Column) -> Column:
    first = F.lower(F.get(errors, F.lit(0)))
    out = F.lit("other")
    for name, marks in reversed(BUCKETS):
        out = F.when(reduce(lambda a, b: a | b, [first.contains(m) for m in marks]), name).otherwise(out)
    return F.when(F.size(errors) == 0, "none").otherwise(out)


_BUCKET = "CASE WHEN len(errors) = 0 THEN 'none' " + " ".join("WHEN " + " OR ".join(f"contains(lower(errors[1]), '{m}')" for m in marks) + f" THEN '{name}'" for name, marks in BUCKETS) + " ELSE 'other' END"


@query(with_sql(VALIDATIONS) + f"SELECT validator, {_BUCKET} AS bucket, count(*) AS n FROM validations WHERE NOT valid GROUP BY 1, 2")
def a5_error_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validations(spark, sf_dir).filter(~F.col("valid")).groupBy("validator", first_error_bucket(F.col("errors")).alias("bucket")).agg(F.count("*").alias("n"))


@query(with_sql(VALIDATIONS) + "SELECT validator, count(*) AS checked, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid, min(id) FILTER (NOT valid) AS first_invalid FROM validations GROUP BY validator")
def a6_validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(~F.col("valid"), F.col("id"))
    return validations(spark, sf_dir).groupBy("validator").agg(F.count("*").alias("checked"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.min(bad).alias("first_invalid"))


@query(with_sql(RESPONSES) + "SELECT count(*) AS checked, count(*) FILTER (ok) AS completed, count(*) FILTER (NOT ok) AS failed, round(count(*) FILTER (ok) / count(*), 4) AS completion_rate, round(avg(tokens) FILTER (ok), 3) AS avg_tokens FROM responses")
def a7_generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.count_if("ok")
    return responses(spark, sf_dir).agg(F.count("*").alias("checked"), done.alias("completed"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.try_divide(done, F.count("*")), 4).alias("completion_rate"), F.round(F.avg(F.when(F.col("ok"), F.col("tokens"))), 3).alias("avg_tokens"))


def quality_gate(rows: DataFrame, v: DataFrame, strict: str, execution: str, gate: dict[str, float] = GATE) -> DataFrame:
    """One row: rates of completed, strictly valid and executable rows, of rows valid throughout, and failed thresholds.

    rows: id, completed. A validator that saw nothing passes its threshold.
    """
    flag = lambda n: F.bool_or(F.when(F.col("validator") == n, F.col("valid")).otherwise(False))
    by = v.groupBy("id").agg(flag(strict).alias("s"), flag(execution).alias("e"))
    joined = rows.join(by, "id", "left").withColumn("s", F.coalesce("s", F.lit(False))).withColumn("e", F.coalesce("e", F.lit(False)))
    counts = joined.agg(F.count("*").alias("total"), F.count_if("completed").alias("completed"), F.count_if(F.col("completed") & F.col("s")).alias("strict"), F.count_if(F.col("completed") & F.col("e")).alias("execution"), F.count_if(F.col("completed") & F.col("s") & F.col("e")).alias("final"))
    seen = v.agg(F.count_if(F.col("validator") == strict).alias("has_s"), F.count_if(F.col("validator") == execution).alias("has_e"))
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 4)
    out = counts.crossJoin(seen).select("total", "completed", "has_s", "has_e", ratio("completed", "total").alias("completion_rate"), ratio("strict", "completed").alias("strict_rate"), ratio("execution", "completed").alias("execution_rate"), ratio("final", "total").alias("final_yield_rate"))
    failed = F.array_compact(
        F.array(
            F.when(F.col("completion_rate") < gate["completion"], "completion_rate"),
            F.when((F.col("has_s") > 0) & (F.col("strict_rate") < gate["strict"]), "strict_rate_over_completed"),
            F.when((F.col("has_e") > 0) & (F.col("execution_rate") < gate["execution"]), "execution_rate_over_completed"),
            F.when(F.col("final_yield_rate") < gate["final_yield"], "final_yield_rate"),
        )
    )
    return out.select("total", "completed", "completion_rate", "strict_rate", "execution_rate", "final_yield_rate", F.array_join(failed, ",").alias("failed_thresholds"), (F.size(failed) == 0).alias("passed"))


@query(with_sql(VALIDATIONS, "r AS (SELECT doc_id AS id, doc_id % 6 <> 0 AS completed FROM documents)", "b AS (SELECT id, bool_or(validator = 'toxic' AND valid) AS s, bool_or(validator = 'length' AND valid) AS e FROM validations GROUP BY id)", """c AS (
  SELECT count(*) AS total, count(*) FILTER (completed) AS completed, count(*) FILTER (completed AND s) AS st, count(*) FILTER (completed AND e) AS ex, count(*) FILTER (completed AND s AND e) AS fi FROM r LEFT JOIN b USING (id))""", "q AS (SELECT total, completed, round(completed / total, 4) AS completion_rate, round(st / completed, 4) AS strict_rate, round(ex / completed, 4) AS execution_rate, round(fi / total, 4) AS final_yield_rate FROM c)") + """
SELECT *, concat_ws(',', CASE WHEN completion_rate < 0.8 THEN 'completion_rate' END, CASE WHEN strict_rate < 0.8 THEN 'strict_rate_over_completed' END, CASE WHEN execution_rate < 0.95 THEN 'execution_rate_over_completed' END, CASE WHEN final_yield_rate < 0.7 THEN 'final_yield_rate' END) AS failed_thresholds,
  completion_rate >= 0.8 AND strict_rate >= 0.8 AND execution_rate >= 0.95 AND final_yield_rate >= 0.7 AS passed FROM q""")
def a8_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 6 != 0).alias("completed"))
    return quality_gate(rows, validations(spark, sf_dir), "toxic", "length")
