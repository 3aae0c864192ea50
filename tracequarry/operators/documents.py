"""Document projections, filters and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions import text as T
from tracequarry.operators.ordering import global_ordinal
from tracequarry.plans.catalog import query
from tracequarry.sources.tables import DOCUMENTS, documents, table, with_sql

#: The lists that the registered queries use: common words of the tables' invented text beside the fixed lists.
WORDS = ["the", "and", "is", "for", "que", "die", "license", "of the", "des", "est"]
STRONG = ["the", "and", "que", "license"]
MARKERS = [" in ", " les ", " ein ", " el ", " then "]
STEPS = ["on", "en", "er"]
# Signals of procedural text, by name.
SIGNALS = {
    "observe": r"\b(open|list|view|check|find|search|select|inspect|look|read|click)\b",
    "mutate": r"\b(create|add|set|save|upload|download|delete|change|update|enter|type|paste|send|install|enable|disable|export|import|format|rename)\b",
    "branch": r"\b(if|otherwise|either|option|depending|unless|when|alternative)\b",
    "failure": r"\b(error|fail|wrong|problem|cannot|retry|undo|recover|fix|troubleshoot)\b",
    "async": r"\b(wait|progress|complete|finish|download|upload|scan|processing|restart|reopen)\b",
    "verify": r"\b(verify|confirm|make sure|should see|check|test|available|appears|display|view)\b",
    "artifact": r"\b(file|document|email|account|map|signature|setting|record|link|photo|video|track|spreadsheet|folder|app)\b",
}
#: Signals that the tables' text has.
OWN_SIGNALS = {"observe": T.whole_words("the|le|der|el"), "mutate": T.whole_words("and|et|und|que"), "branch": T.whole_words("is|est|ist|es"), "failure": T.whole_words("for|pour|für|por"), "async": T.whole_words("was|des|den|los"), "verify": T.whole_words("of|de|in|en"), "artifact": T.whole_words("a|un|ein|una|the")}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_hits(text: str, phrases: list[str]) -> str:
    low = f"(' ' || lower({text}) || ' ')"
    return " + ".join(f"CAST(contains({low}, {_q(p)}) AS BIGINT)" if " " in p else f"CAST(regexp_matches({low}, {_q(T.phrase_pattern(p))}) AS BIGINT)" for p in phrases)


def sql_score(text: str, keywords: list[str], markers: list[str], steps: list[str]) -> str:
    low = f"(' ' || lower({text}) || ' ')"
    marks = " + ".join(f"CAST(contains({low}, {_q(m)}) AS BIGINT)" for m in markers)
    words = "|".join(steps)
    return f"2 * ({sql_hits(text, keywords)}) + ({marks}) + len(regexp_extract_all({low}, {_q(rf'(^|[^a-z0-9_])({words})($|[^a-z0-9_])')}))"


def row_text(title, body, summary=None):
    """Title:, Steps: and Summary: lines of what isn't empty; line feeds become spaces."""
    clean = lambda c: F.trim(F.replace(c, F.lit("\n"), F.lit(" ")))
    parts = [("Title", title), ("Steps", body)] + ([("Summary", summary)] if summary is not None else [])
    return F.concat_ws("\n", *[F.when(F.length(clean(c)) > 0, F.concat(F.lit(f"{label}: "), clean(c))) for label, c in parts])


@query(with_sql(DOCUMENTS) + """SELECT id, concat_ws(chr(10), CASE WHEN trim(replace(title, chr(10), ' ')) <> '' THEN 'Title: ' || trim(replace(title, chr(10), ' ')) END,
  CASE WHEN trim(replace(body, chr(10), ' ')) <> '' THEN 'Steps: ' || trim(replace(body, chr(10), ' ')) END) AS row_text FROM documents_rel""")
def p1_row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", row_text(F.col("title"), F.col("body")).alias("row_text"))


@query("SELECT doc_id AS id, printf('doc_%09d', doc_id) AS by_source, printf('sel_%09d', row_number() OVER (ORDER BY doc_id) - 1) AS by_ordinal FROM documents WHERE length(text) >= 500")
def p2_stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = global_ordinal(table(spark, sf_dir, "documents").filter(F.length("text") >= 500).select("doc_id"), "doc_id")
    return picked.select(F.col("doc_id").alias("id"), F.format_string("doc_%09d", "doc_id").alias("by_source"), F.format_string("sel_%09d", F.col("ordinal") - 1).alias("by_ordinal"))


@query("SELECT doc_id AS id, length(text) AS n FROM documents WHERE length(text) >= 300 AND length(text) <= 5000")
def f1_length_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    return table(spark, sf_dir, "documents").filter(n.between(300, 5000)).select(F.col("doc_id").alias("id"), n.alias("n"))


def selected(df: DataFrame, keywords=T.COMPUTER_KEYWORDS, strong=T.STRONG_KEYWORDS, core=T.CORE_KEYWORDS, markers=T.PROCEDURAL_MARKERS, steps=T.STEP_WORDS, least: int = 8) -> DataFrame:
    """id and the four measures of rows whose score, strong and core hits and title make them procedural.

    A text is lowered and cut into words once for all measures. They come out of a generator, so that the filter can't be
    pushed below it, which would evaluate them twice.
    """
    text = T.prepared(row_text(F.col("title"), F.col("body")))
    measure = lambda p: F.struct(T.score_of(p, keywords, markers, steps).alias("score"), T.found_in(p["low"], p["words"], strong).alias("strong"), T.found_in(p["low"], p["words"], core).alias("core"), T.hits(F.col("title"), core).alias("title_core"))
    scored = df.select("id", F.explode(F.transform(F.array(text), measure)).alias("m")).select("id", "m.*")
    return scored.filter((F.col("score") >= least) & (F.col("strong") >= 1) & (F.col("core") >= 1) & (F.col("title_core") >= 1))


_ROW = "concat_ws(chr(10), CASE WHEN trim(replace(title, chr(10), ' ')) <> '' THEN 'Title: ' || trim(replace(title, chr(10), ' ')) END, CASE WHEN trim(replace(body, chr(10), ' ')) <> '' THEN 'Steps: ' || trim(replace(body, chr(10), ' ')) END)"


@query(with_sql(DOCUMENTS, f"texts AS (SELECT id, title, {_ROW} AS t FROM documents_rel)", f"scored AS (SELECT id, {' + '.join(['2 * (' + sql_hits('t', WORDS) + ')', *[f'CAST(contains((chr(32) || lower(t) || chr(32)), {_q(m)}) AS BIGINT)' for m in MARKERS]])} AS score, {sql_hits('t', STRONG)} AS strong, {sql_hits('t', WORDS)} AS core, {sql_hits('title', WORDS)} AS title_core FROM texts)") + "SELECT * FROM scored WHERE score >= 8 AND strong >= 1 AND core >= 1 AND title_core >= 1")
def f2_procedural_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selected(documents(spark, sf_dir), WORDS, STRONG, WORDS, MARKERS, ["zzzz"])
    return out.select("id", "score", "strong", "core", "title_core")


@query("""SELECT doc_id AS id, CASE WHEN contains(lower(text), 'tion') OR contains(lower(text), 'printer') THEN 'multimedia_processing'
  WHEN contains(lower(text), 'keit') OR contains(lower(text), 'return') THEN 'ecommerce_and_retail' WHEN contains(lower(text), 'eaux') THEN 'education_elearning' ELSE 'customer_support' END AS task
  FROM documents WHERE CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'ein') AS INT) + CAST(contains(lower(text), 'qu') AS INT) + CAST(contains(lower(text), 'en') AS INT) >= 2""")
def f3_stage1_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least two markers, then the first class with a hit."""
    low = F.lower("text")
    rules = [("multimedia_processing", ["tion", "printer"]), ("ecommerce_and_retail", ["keit", "return"]), ("education_elearning", ["eaux"])]
    task = F.lit("customer_support")
    for name, marks in reversed(rules):
        task = F.when(T.any_marker(F.col("text"), marks), name).otherwise(task)
    enough = T.total([low.contains(m) for m in ("the", "ein", "qu", "en")]) >= 2
    return table(spark, sf_dir, "documents").filter(enough).select(F.col("doc_id").alias("id"), task.alias("task"))


@query(f"SELECT doc_id AS id, {sql_hits('text', WORDS)} AS hits, {sql_hits('text', T.STRONG_KEYWORDS)} AS strong, {sql_hits('text', T.CORE_KEYWORDS)} AS core FROM documents")
def f4_phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.struct(*[T.found_in(p["low"], p["words"], w).alias(n) for n, w in (("hits", WORDS), ("strong", T.STRONG_KEYWORDS), ("core", T.CORE_KEYWORDS))])
    found = F.explode(F.transform(F.array(T.prepared(F.col("text"))), count)).alias("m")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), found).select("id", "m.*")


@query("WITH s AS (SELECT doc_id, ' ' || lower(text) || ' ' AS low FROM documents) SELECT doc_id AS id, 2 * (" + sql_hits("low", WORDS) + ") + " + " + ".join(f"CAST(contains(low, {_q(m)}) AS BIGINT)" for m in MARKERS) + r" + len(regexp_extract_all(low, '\b(license|version)\b')) AS score FROM s")
def x1_procedural_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = T.procedural_score(F.col("text"), WORDS, MARKERS, ["license", "version"])
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), score.alias("score"))


@query("SELECT doc_id AS id, sha256(text) AS source_sha256, substr(sha256(text), 1, 6) AS short FROM documents")
def x4_source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), h.alias("source_sha256"), F.substring(h, 1, 6).alias("short"))


@query(r"SELECT item_id AS id, trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g')) AS normalized FROM benchmark")
def x7_normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), T.normalized(F.col("text")).alias("normalized"))


@query("SELECT p_partkey AS id, lower(p_name) AS low, upper(p_name) AS up, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS snake, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, 'part_' || p_partkey || '_' || substr(sha256(p_name), 1, 6) AS alias FROM part")
def x8_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    alias = F.concat_ws("_", F.lit("part"), F.col("p_partkey").cast("string"), F.substring(F.sha2("p_name", 256), 1, 6))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("low"), F.upper("p_name").alias("up"), T.snake_case(F.col("p_type")).alias("snake"), T.slug(F.col("p_name")).alias("slug"), alias.alias("alias"))


@query(r"WITH s AS (SELECT item_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM benchmark) SELECT item_id AS id, CAST(len(s) AS BIGINT) AS n, s[1] AS first, s[len(s)] AS last FROM s")
def x10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), T.sentences(F.col("text")).alias("s"))
    return cut.select("id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0)).alias("first"), F.element_at("s", -1).alias("last"))


@query("SELECT o_orderkey AS id, CASE WHEN o_totalprice <= 1000 THEN 'le_1000' WHEN o_totalprice <= 50000 THEN 'le_50000' WHEN o_totalprice <= 200000 THEN 'le_200000' ELSE 'gt_200000' END AS cell FROM orders")
def x16_bucketize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.bucketize(F.col("o_totalprice"), [1000, 50000, 200000]).alias("cell"))


def source_audit(df: DataFrame, signals: dict[str, str] = SIGNALS) -> DataFrame:
    """One row: rows, signal counts, least, upper-median and greatest step count, and two readiness heuristics.

    Steps are the pieces of the text after its last 'summary:' between full stops with white space around them, with two
    words or more. Counts are kept by step count, so texts are read once; the median is read off that table, which has at
    most as many rows as the longest text has steps.
    """
    low = F.lower("text")
    steps = F.size(F.filter(F.split(low, r"\s*\.\s+"), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= 2)).cast("long")
    marks = df.select(steps.alias("steps"), *[low.rlike(p.replace(r"\b", r"(?U:\b)")).alias(n) for n, p in signals.items()])
    core = (F.col("steps") >= 4) & F.col("observe") & F.col("mutate") & F.col("artifact") & F.col("verify")
    more = F.col("branch") | F.col("failure") | F.col("async")
    by = marks.groupBy("steps").agg(F.count("*").alias("n"), *[F.count_if(n).alias(n) for n in signals], F.count_if(core).alias("core"), F.count_if(core & more).alias("recursive"))
    whole = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in signals], F.min("steps").alias("least"), F.max("steps").alias("most"), F.coalesce(F.sum("core"), F.lit(0)).alias("core"), F.coalesce(F.sum("recursive"), F.lit(0)).alias("recursive"), F.array_sort(F.collect_list(F.struct("steps", "n"))).alias("a"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("value"))
    median = F.aggregate("a", start, lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.coalesce(s["value"], F.when(s["seen"] + x["n"] > F.floor(F.col("rows") / 2), x["steps"])).alias("value")))["value"]
    return whole.withColumn("median", median).drop("a")


@query(r"""WITH s AS (SELECT CAST(len(list_filter(string_split(regexp_replace(lower(text), '\s*\.\s+', chr(1), 'g'), chr(1)), lambda s: len(list_filter(string_split(regexp_replace(s, '\s+', ' ', 'g'), ' '), lambda w: w <> '')) >= 2)) AS BIGINT) AS steps, """ + ", ".join(f"regexp_matches(lower(text), {_q(p)}) AS {n}" for n, p in OWN_SIGNALS.items() if n != "async") + ", regexp_matches(lower(text), " + _q(OWN_SIGNALS["async"]) + ''') AS "async" FROM documents),
 m AS (SELECT *, steps >= 4 AND observe AND mutate AND artifact AND verify AS c FROM s)
 SELECT count(*) AS rows, ''' + ", ".join(f'count(*) FILTER ("{n}") AS "{n}"' for n in OWN_SIGNALS) + ''', min(steps) AS least, max(steps) AS most, count(*) FILTER (c) AS core, count(*) FILTER (c AND (branch OR failure OR "async")) AS recursive, (list_sort(list(steps)))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM m''')
def a13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(table(spark, sf_dir, "documents"), OWN_SIGNALS)


@query(f"WITH s AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS ordinal FROM documents WHERE doc_id < 800 AND ({sql_hits('text', STRONG)}) >= 2) SELECT id, ordinal FROM s WHERE ordinal <= 100")
def o2_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 accepted rows of the first 800: a target and a scan limit, which are the operator."""
    d = table(spark, sf_dir, "documents").filter(F.col("doc_id") < 800).filter(T.hits(F.col("text"), STRONG) >= 2).select(F.col("doc_id").alias("id"))
    return global_ordinal(d, "id").filter("ordinal <= 100").select("id", "ordinal")
