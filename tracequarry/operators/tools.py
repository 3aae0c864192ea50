"""Tool schemas: lint, conformance, identifiability, renderings. Parts stand for tools in the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions.text import snake_case
from tracequarry.plans.catalog import query
from tracequarry.sources.tables import table

# Names and name parts that the lint refuses; sentence templates by verb.
GENERIC_NAMES = ["print", "search", "update", "run", "call", "execute", "process", "handle", "manage"]
HIGH_LEVEL_NAMES = ["login_student", "authenticate_scanner", "dreambox_login", "scan_to_email", "upload_file_to_cloud", "create_assignment_with_link", "download_offline_map", "export_gpx_track"]
BUNDLED_TOKENS = ["and", "if", "workflow", "complete", "process", "handle", "manage", "orchestrate", "all"]
TEMPLATES = {
    "inspect": "Inspect the observable state of {}.",
    "observe": "Observe the current public state of {}.",
    "open": "Open {} using the supplied public inputs.",
    "find": "Find {} from the supplied public criteria.",
    "resolve": "Resolve {} from the supplied public criteria.",
    "choose": "Choose {} from the currently available options.",
    "select": "Select {} from the currently available options.",
    "start": "Start {} using the supplied public inputs.",
    "create": "Create {} from the supplied public inputs.",
    "set": "Set {} to the supplied public value.",
    "login": "Access {} using supplied account or session evidence.",
    "logout": "End the current {} session.",
    "send": "Send {} using the supplied public object reference.",
    "place": "Place {} according to the supplied public settings.",
    "poll": "Observe the current lifecycle state of {}.",
    "diagnose": "Diagnose the observed failure affecting {}.",
    "repair": "Repair the diagnosed state of {}.",
    "reserve": "Reserve {} using current public evidence.",
}
VERBS = ["open", "set", "send", "poll", "update", "Merge", "handle", "find"]


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, description, arg_type: a tool for every part, its verb by key, its target from the part's type."""
    p = table(spark, sf_dir, "part")
    verb = F.get(F.array(*map(F.lit, VERBS)), (F.col("p_partkey") % len(VERBS)).cast("int"))
    name = F.when(F.col("p_partkey") % 11 == 0, "search").otherwise(F.concat_ws("_", verb, snake_case(F.col("p_type")), F.when(F.col("p_partkey") % 7 == 0, F.lit("and_more_parts"))))
    arg = F.get(F.array(*map(F.lit, ["string", "integer", "date", "array"])), (F.col("p_size") % 4).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), name.alias("name"), F.concat(F.lit("About "), F.col("p_brand")).alias("description"), arg.alias("arg_type"))


TOOLS = """tools AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'search' ELSE concat_ws('_', ['open', 'set', 'send', 'poll', 'update', 'Merge', 'handle', 'find'][p_partkey % 8 + 1],
  trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_'), CASE WHEN p_partkey % 7 = 0 THEN 'and_more_parts' END) END AS name, 'About ' || p_brand AS description,
  ['string', 'integer', 'date', 'array'][p_size % 4 + 1] AS arg_type FROM part)"""


def lint(name: Column, arg_type: Column, has_items: Column) -> Column:
    """Codes of what is wrong with a tool, in the order of the rules."""
    parts = F.filter(F.split(name, "_"), lambda t: t != "")
    return F.array_compact(
        F.array(
            F.when(~name.rlike("^[a-z][a-z0-9_]*$"), "snake_case"),
            F.when(name.isin(*GENERIC_NAMES), "generic"),
            F.when(name.isin(*HIGH_LEVEL_NAMES), "high_level"),
            F.when(F.size(parts) > 4, "too_long"),
            F.when(F.arrays_overlap(parts, F.array(*map(F.lit, BUNDLED_TOKENS))), "bundled"),
            F.when(~arg_type.isin("string", "integer", "number", "boolean", "array", "object"), "type"),
            F.when((arg_type == "array") & ~has_items, "items"),
        )
    )


_LINT = """concat_ws(',', CASE WHEN NOT regexp_full_match(name, '[a-z][a-z0-9_]*') THEN 'snake_case' END, CASE WHEN name IN ('print', 'search', 'update', 'run', 'call', 'execute', 'process', 'handle', 'manage') THEN 'generic' END,
 CASE WHEN len(list_filter(string_split(name, '_'), lambda t: t <> '')) > 4 THEN 'too_long' END, CASE WHEN list_has_any(string_split(name, '_'), ['and', 'if', 'workflow', 'complete', 'process', 'handle', 'manage', 'orchestrate', 'all']) THEN 'bundled' END,
 CASE WHEN arg_type NOT IN ('string', 'integer', 'number', 'boolean', 'array', 'object') THEN 'type' END, CASE WHEN arg_type = 'array' AND id % 2 = 1 THEN 'items' END)"""


@query(f"WITH {TOOLS} SELECT id, name, {_LINT} AS errors, {_LINT} = '' AS valid FROM tools")
def v5_tool_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = lint(F.col("name"), F.col("arg_type"), F.col("id") % 2 == 0)
    return tools(spark, sf_dir).select("id", "name", F.array_join(errors, ",").alias("errors"), (F.size(errors) == 0).alias("valid"))


@query(f"WITH {TOOLS}, bank AS (SELECT name, min(arg_type) AS arg_type, min(description) AS description FROM tools WHERE id % 3 = 0 GROUP BY name) SELECT t.id, b.name IS NOT NULL AS in_bank, coalesce(b.arg_type = t.arg_type, false) AS same_signature, coalesce(b.description = t.description, false) AS same_description FROM tools t LEFT JOIN bank b ON b.name = t.name")
def v6_bank_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected tools against a bank: known, same signature, same description."""
    t = tools(spark, sf_dir)
    bank = t.filter(F.col("id") % 3 == 0).groupBy("name").agg(F.min("arg_type").alias("b_type"), F.min("description").alias("b_text"), F.lit(True).alias("known"))
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return t.join(bank, "name", "left").select("id", F.coalesce("known", F.lit(False)).alias("in_bank"), same("b_type", "arg_type").alias("same_signature"), same("b_text", "description").alias("same_description"))


@query(f"WITH {TOOLS} SELECT description, arg_type, count(*) AS n, count(DISTINCT name) AS names FROM tools GROUP BY description, arg_type HAVING count(DISTINCT name) > 1")
def v17_identifiability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools that an agent can't tell apart: several names with one description and signature."""
    return tools(spark, sf_dir).groupBy("description", "arg_type").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names")).filter("names > 1")


def description(name: Column, existing: Column) -> Column:
    """A sentence for the verb that a name begins with, then what was said before."""
    words = F.trim(F.regexp_replace(name, r"[_\s]+", " "))
    verb = F.substring_index(words, " ", 1)
    rest = F.when(words.contains(" "), F.substring(words, F.length(verb) + 2, F.length(words))).otherwise("current object")
    out = F.concat(F.lit("Perform the public operation: "), words, F.lit("."))
    for v, t in TEMPLATES.items():
        before, after = t.split("{}")
        out = F.when(verb == v, F.concat(F.lit(before), rest, F.lit(after))).otherwise(out)
    return F.concat_ws(" ", out, F.when(F.length(F.trim(existing)) > 0, F.trim(existing)))


_VERB_CASES = " ".join(f"WHEN v = '{v}' THEN '{t.split('{}')[0]}' || r || '{t.split('{}')[1]}'" for v, t in TEMPLATES.items())


@query(f"WITH {TOOLS}, w AS (SELECT id, description, replace(name, '_', ' ') AS w FROM tools), s AS (SELECT *, split_part(w, ' ', 1) AS v, CASE WHEN contains(w, ' ') THEN substr(w, length(split_part(w, ' ', 1)) + 2) ELSE 'current object' END AS r FROM w) SELECT id, CASE {_VERB_CASES} ELSE 'Perform the public operation: ' || w || '.' END || ' ' || description AS text FROM s")
def x20_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools(spark, sf_dir).select("id", description(F.col("name"), F.col("description")).alias("text"))


def alias(kind: str, seed: Column, value: Column, index: Column) -> Column:
    """kind_index_ and six hex digits that seed, kind and value give."""
    return F.concat_ws("_", F.lit(kind), index.cast("string"), F.substring(F.sha2(F.concat_ws(":", seed, F.lit(kind), value), 256), 1, 6))


@query(f"WITH {TOOLS} SELECT t.id, 's' || v.i AS seed, 'tool_' || (t.id % 10) || '_' || substr(sha256('s' || v.i || ':tool:' || name), 1, 6) AS tool, 'arg_0_' || substr(sha256('s' || v.i || ':arg:' || arg_type), 1, 6) AS arg FROM tools t, (SELECT unnest([1, 2, 3]) AS i) v")
def r1_renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three seeded renderings of every tool: other names, same capability."""
    seed = F.concat(F.lit("s"), F.col("i").cast("string"))
    t = tools(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return t.select("id", seed.alias("seed"), alias("tool", seed, F.col("name"), F.col("id") % 10).alias("tool"), alias("arg", seed, F.col("arg_type"), F.lit(0)).alias("arg"))


def totalized(branches: Column) -> Column:
    """Conditional branches first, in their order, then one that always holds (added if there is none)."""
    conditional = F.filter(branches, lambda b: b["when"] != "true")
    always = F.slice(F.filter(branches, lambda b: b["when"] == "true"), 1, 1)
    fallback = F.array(F.struct(F.lit("fallback").alias("id"), F.lit("true").alias("when")))
    return F.concat(conditional, F.when(F.size(always) > 0, always).otherwise(fallback))


@query("""WITH b AS (SELECT l_orderkey AS id, 'b' || l_linenumber AS b, CASE WHEN l_quantity > 40 THEN 'true' ELSE 'q' || CAST(l_quantity AS BIGINT) END AS w, l_linenumber AS n FROM lineitem),
o AS (SELECT id, string_agg(b, ',' ORDER BY n, w) FILTER (w <> 'true') AS c, coalesce(arg_min(b, n) FILTER (w = 'true'), 'fallback') AS f FROM (SELECT DISTINCT * FROM b) GROUP BY id) SELECT id, concat_ws(',', c, f) AS branches FROM o""")
def r4_totalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    when = F.when(F.col("l_quantity") > 40, "true").otherwise(F.concat(F.lit("q"), F.col("l_quantity").cast("long").cast("string")))
    rows = li.select(F.col("l_orderkey").alias("oid"), F.col("l_linenumber").alias("n"), F.concat(F.lit("b"), F.col("l_linenumber").cast("string")).alias("id"), when.alias("when")).distinct()
    g = rows.groupBy("oid").agg(F.array_sort(F.collect_list(F.struct("n", "id", "when"))).alias("b"))
    shaped = F.transform("b", lambda x: F.struct(x["id"].alias("id"), x["when"].alias("when")))
    return g.select(F.col("oid").alias("id"), F.array_join(F.transform(totalized(shaped), lambda x: x["id"]), ",").alias("branches"))
