"""Statistics and order-sensitive checks over messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tracequarry.functions import text as T
from tracequarry.operators.ordering import global_ordinal, values_at
from tracequarry.operators.tools import TOOLS, alias, tools
from tracequarry.plans.catalog import query
from tracequarry.sources.tables import MESSAGES, TRACE, messages, trace, with_sql


def turns() -> WindowSpec:
    """A conversation's messages in order."""
    return Window.partitionBy("id").orderBy("idx")


def message_stats(m: DataFrame) -> DataFrame:
    """Per conversation: messages, user turns, assistant turns, distinct roles, role of the last message, first user text length."""
    return m.groupBy("id").agg(
        F.count("*").alias("messages"),
        F.count_if(F.col("role") == "user").alias("user_turns"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
        F.countDistinct("role").alias("roles"),
        F.max_by("role", "idx").alias("final_role"),
        F.min_by(F.length("text").cast("long"), "idx").alias("first_length"),
    )


@query(with_sql(MESSAGES) + "SELECT id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns, count(DISTINCT role) AS roles, arg_max(role, idx) AS final_role, arg_min(length(text), idx) AS first_length FROM messages GROUP BY id")
def a1_message_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_stats(messages(spark, sf_dir))


def trajectory_profile(t: DataFrame, canonical: list[str], failures: Column, verifications: list[str]) -> DataFrame:
    """Per episode: calls, distinct tools, failures, final tool and whether it verifies, tools outside the bank."""
    final = F.max_by("tool", "step")
    return t.groupBy("episode_id").agg(
        F.count("*").alias("calls"),
        F.countDistinct("tool").alias("tools"),
        F.count_if(failures).alias("failures"),
        final.alias("final_tool"),
        (final.isin(*verifications) | T.is_verification_tool(final)).alias("final_verifies"),
        F.array_join(F.array_sort(F.array_except(F.collect_set("tool"), F.array(*map(F.lit, canonical)))), ",").alias("outside"),
    )


@query(with_sql(TRACE) + "SELECT episode_id, count(*) AS calls, count(DISTINCT tool) AS tools, count(*) FILTER (error_code IS NOT NULL) AS failures, arg_max(tool, step) AS final_tool, arg_max(tool, step) = 'view' AS final_verifies, coalesce(string_agg(DISTINCT tool, ',' ORDER BY tool) FILTER (tool NOT IN ('click', 'view', 'purchase')), '') AS outside FROM trace GROUP BY episode_id")
def a2_trajectory_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory_profile(trace(spark, sf_dir), ["click", "view", "purchase"], F.col("error_code").isNotNull(), ["view"])


def nearest_rank(df: DataFrame, column: str, fractions: list[float]) -> DataFrame:
    """The value at rank round((n - 1) * p), ties to even, for each p; one row, nulls where there is no value."""
    known = df.filter(F.col(column).isNotNull())
    n = known.count()
    found = values_at(known, column, [round((n - 1) * p) for p in fractions]) if n else [None] * len(fractions)
    kind = df.schema[column].dataType
    return df.sparkSession.range(1).select(*[F.lit(v).cast(kind).alias(f"p{round(p * 100)}") for p, v in zip(fractions, found, strict=True)])


@query(with_sql(MESSAGES, "s AS (SELECT id, count(*) AS n FROM messages GROUP BY id)") + "SELECT (list_sort(list(n)))[CAST(round_even((count(*) - 1) * CAST(0.5 AS DOUBLE), 0) AS BIGINT) + 1] AS p50, (list_sort(list(n)))[CAST(round_even((count(*) - 1) * CAST(0.9 AS DOUBLE), 0) AS BIGINT) + 1] AS p90 FROM s")
def a4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rank(messages(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n")), "n", [0.5, 0.9])


@query(with_sql(MESSAGES, "s AS (SELECT id, count(*) AS n, count(*) FILTER (role = 'user') AS u, arg_max(role, idx) AS f FROM messages GROUP BY id)") + "SELECT count(*) AS items, round(avg(n), 3) AS avg_messages, round(avg(u), 3) AS avg_user_turns, max(u) AS max_user_turns, round(count(*) FILTER (f = 'assistant') / count(*), 3) AS final_assistant_rate FROM s")
def a3_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = message_stats(messages(spark, sf_dir))
    return s.agg(F.count("*").alias("items"), F.round(F.avg("messages"), 3).alias("avg_messages"), F.round(F.avg("user_turns"), 3).alias("avg_user_turns"), F.max("user_turns").alias("max_user_turns"), F.round(F.try_divide(F.count_if(F.col("final_role") == "assistant"), F.count("*")), 3).alias("final_assistant_rate"))


@query(with_sql(TRACE) + "SELECT tool, count(*) AS n, min(episode_id * 1000000 + step) AS first_seen FROM trace GROUP BY tool ORDER BY n DESC, first_seen")
def o9_frequency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent first; ties as first seen."""
    return trace(spark, sf_dir).groupBy("tool").agg(F.count("*").alias("n"), F.min(F.col("episode_id") * 1000000 + F.col("step")).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


@query(with_sql(TRACE, "s AS (SELECT episode_id, count(*) AS calls, count(DISTINCT tool) AS tools FROM trace GROUP BY episode_id)") + "SELECT episode_id, greatest(calls + 2, 6) AS min_calls, least(4, greatest(tools + 1, 3)) AS min_unique_tools FROM s")
def p10_complexity_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a bank of four tools."""
    s = trace(spark, sf_dir).groupBy("episode_id").agg(F.count("*").alias("calls"), F.countDistinct("tool").alias("tools"))
    return s.select("episode_id", F.greatest(F.col("calls") + 2, F.lit(6)).alias("min_calls"), F.least(F.lit(4), F.greatest(F.col("tools") + 1, F.lit(3))).alias("min_unique_tools"))


@query(with_sql(TRACE) + """SELECT episode_id, count(*) - count(*) FILTER (step <= 10) AS d_calls, count(DISTINCT tool) - count(DISTINCT tool) FILTER (step <= 10) AS d_tools,
  count(error_code) - count(error_code) FILTER (step <= 10) AS d_failures, count(produced) - count(produced) FILTER (step <= 10) AS d_produced, count(consumed) - count(consumed) FILTER (step <= 10) AS d_consumed FROM trace GROUP BY episode_id""")
def p15_complexity_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the whole episode less those of its first ten steps."""
    t, early = trace(spark, sf_dir), F.col("step") <= 10
    gap = lambda c: (F.count(c) - F.count(F.when(early, F.col(c))))
    distinct = F.countDistinct("tool") - F.countDistinct(F.when(early, F.col("tool")))
    return t.groupBy("episode_id").agg(gap("step").alias("d_calls"), distinct.alias("d_tools"), gap("error_code").alias("d_failures"), gap("produced").alias("d_produced"), gap("consumed").alias("d_consumed"))


@query(with_sql(MESSAGES) + "SELECT id, idx, role, lag(role) OVER w AS before, lead(role) OVER w AS after, coalesce(lag(role) OVER w = role, false) AS repeated FROM messages WINDOW w AS (PARTITION BY id ORDER BY idx)")
def w1_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("role").over(turns())
    return messages(spark, sf_dir).select("id", "idx", "role", before.alias("before"), F.lead("role").over(turns()).alias("after"), F.coalesce(before == F.col("role"), F.lit(False)).alias("repeated"))


@query(with_sql(MESSAGES, "words AS (SELECT id, idx, unnest(string_split(lower(text), ' ')) AS word FROM messages)", "first AS (SELECT id, word, min(idx) AS at FROM words GROUP BY 1, 2)") + "SELECT m.id, m.idx, coalesce(sum(length(text) + 1) OVER (PARTITION BY m.id ORDER BY m.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0)::BIGINT AS context_length, coalesce(f.at < m.idx, false) AS grounded FROM messages m LEFT JOIN first f ON f.id = m.id AND f.word = split_part(lower(text), ' ', 1)")
def w2_running_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of the text of all messages before one, and whether its first word is among their words.

    Where a word first stands in a conversation is one aggregate, so the context itself is never built.
    """
    m = messages(spark, sf_dir)
    before = F.sum(F.length("text").cast("long") + 1).over(turns().rowsBetween(Window.unboundedPreceding, -1)) - 1
    seen = m.select("id", "idx", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word")).groupBy("id", "word").agg(F.min("idx").alias("at"))
    own = m.select("id", "idx", F.coalesce(before, F.lit(0)).alias("context_length"), F.substring_index(F.lower("text"), " ", 1).alias("word"))
    return own.join(seen, ["id", "word"], "left").select("id", "idx", "context_length", F.coalesce(F.col("at") < F.col("idx"), F.lit(False)).alias("grounded"))


@query(with_sql(TRACE) + "SELECT episode_id, step, tool, coalesce(tool = 'purchase' AND max(CASE WHEN error_code IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS recovered FROM trace")
def w3_failure_then_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("episode_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.max(F.col("error_code").isNotNull()).over(w)
    return trace(spark, sf_dir).select("episode_id", "step", "tool", F.coalesce((F.col("tool") == "purchase") & failed, F.lit(False)).alias("recovered"))


@query(with_sql(TRACE) + "SELECT episode_id, step, printf('call_%04d', step) AS call_id FROM trace")
def w8_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).select("episode_id", "step", F.format_string("call_%04d", "step").alias("call_id"))


@query(with_sql(MESSAGES) + "SELECT id, idx, lead(role) OVER (PARTITION BY id ORDER BY idx) = 'assistant' AS answered FROM messages WHERE role IS NOT NULL QUALIFY role = 'user' AND lead(role) OVER (PARTITION BY id ORDER BY idx) IS NOT NULL")
def j14_next_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls (user turns here) with whether the next message answers them."""
    after = messages(spark, sf_dir).withColumn("next", F.lead("role").over(turns()))
    return after.filter((F.col("role") == "user") & F.col("next").isNotNull()).select("id", "idx", (F.col("next") == "assistant").alias("answered"))


def structure_errors(m: DataFrame, max_user_turns: int, least: int) -> DataFrame:
    """id, valid, errors: the first message isn't a system message, an answer doesn't follow a user, too many user turns,
    too few answers; errors in the order of the messages, then of the rules."""
    seen = m.withColumn("before", F.lag("role").over(turns())).withColumn("first", F.row_number().over(turns()) == 1)
    own = F.array_compact(
        F.array(
            F.when(F.col("first") & (F.col("role") != "system"), F.struct(F.lit(-1).cast("long").alias("at"), F.lit("missing system message").alias("e"))),
            F.when((F.col("role") == "assistant") & (F.col("before").isNull() | (F.col("before") != "user")), F.struct(F.col("idx").alias("at"), F.concat(F.lit("message "), F.col("idx").cast("string"), F.lit(": answer doesn't follow a user")).alias("e"))),
        )
    )
    rows = seen.withColumn("own", own).groupBy("id").agg(F.flatten(F.collect_list("own")).alias("all"), F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("answers"))
    late = F.array_compact(
        F.array(
            F.when(F.col("answers") < least, F.format_string(f"answer count %d is below required minimum {least}", "answers")),
            F.when(F.col("users") > max_user_turns, F.format_string(f"user turn count %d exceeds maximum {max_user_turns}", "users")),
        )
    )
    errors = F.concat(F.transform(F.array_sort("all"), lambda s: s["e"]), late)
    return rows.select("id", (F.size(errors) == 0).alias("valid"), errors.alias("errors"))


@query(with_sql(MESSAGES, """seen AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w = 1 AS f FROM messages WINDOW w AS (PARTITION BY id ORDER BY idx))""", """e AS (
  SELECT id, -1 AS at, 'missing system message' AS e FROM seen WHERE f AND role <> 'system'
  UNION ALL SELECT id, idx, 'message ' || idx || ': answer doesn''t follow a user' FROM seen WHERE role = 'assistant' AND (before IS NULL OR before <> 'user')
  UNION ALL SELECT id, 1000000, 'answer count ' || count(*) FILTER (role = 'assistant') || ' is below required minimum 2' FROM messages GROUP BY id HAVING count(*) FILTER (role = 'assistant') < 2
  UNION ALL SELECT id, 1000001, 'user turn count ' || count(*) FILTER (role = 'user') || ' exceeds maximum 3' FROM messages GROUP BY id HAVING count(*) FILTER (role = 'user') > 3)""") + "SELECT i.id, count(e.e) = 0 AS valid, coalesce(string_agg(e.e, ';' ORDER BY e.at, e.e), '') AS errors FROM (SELECT DISTINCT id FROM messages) i LEFT JOIN e USING (id) GROUP BY i.id")
def v1_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_errors(messages(spark, sf_dir), 3, 2).withColumn("errors", F.array_join("errors", ";"))


@query("""SELECT doc_id AS id, regexp_matches(lower(text), 'tion|keit') AS failure, regexp_matches(text, 'license|License') AS success,
  doc_id % 2 = 0 AND contains(lower(text), 'pour') AS recovery, length(split_part(text, ' ', 2)) >= 3 AND regexp_matches(split_part(text, ' ', 2), '[_/0-9]') AS identifier FROM documents""")
def f5_response_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure, success, recovery and identifier tests with the tables' own markers."""
    t = F.col("text")
    word = F.coalesce(F.get(F.split(t, " "), F.lit(1)), F.lit(""))
    return table_of(spark, sf_dir).select(F.col("doc_id").alias("id"), T.any_marker(t, ["tion", "keit"]).alias("failure"), t.rlike("license|License").alias("success"), ((F.col("doc_id") % 2 == 0) & T.any_marker(t, ["pour"])).alias("recovery"), T.is_identifier_like(word).alias("identifier"))


def table_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.sources.tables import table

    return table(spark, sf_dir, "documents")


_NAMES = TOOLS + ", n AS (SELECT id, 'own' AS origin, name FROM tools UNION ALL SELECT id, 'alias', 'tool_' || (id % 10) || '_' || substr(sha256('s1:tool:' || name), 1, 6) FROM tools UNION ALL SELECT id, 'argument', lower(replace(description, '#', '_')) || CASE WHEN id % 9 = 0 THEN '_api_key' ELSE '' END FROM tools)"


@query("WITH " + _NAMES + """ SELECT id, origin, regexp_matches(name, '^(verify|read|get|list|search|poll)_') OR list_has_any(string_split(name, '_'), ['verify', 'status']) AS verifies,
  regexp_matches(name, '^(operation|tool|function)_[0-9]+_[0-9a-f]+$') AS opaque, regexp_matches(lower(name), 'password|secret|credential|api_key|private_key') AS sensitive FROM n""")
def f7_tool_name_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of the tools' own names, of their aliases and of argument names."""
    t = tools(spark, sf_dir)
    argument = F.concat(F.lower(F.replace("description", F.lit("#"), F.lit("_"))), F.when(F.col("id") % 9 == 0, "_api_key").otherwise(""))
    one = lambda origin, name: F.struct(F.lit(origin).alias("origin"), name.alias("name"))
    n = t.select("id", F.explode(F.array(one("own", F.col("name")), one("alias", alias("tool", F.lit("s1"), F.col("name"), F.col("id") % 10)), one("argument", argument))).alias("n")).select("id", "n.*")
    return n.select("id", "origin", T.is_verification_tool(F.col("name")).alias("verifies"), T.is_opaque_name(F.col("name")).alias("opaque"), T.is_sensitive(F.col("name")).alias("sensitive"))


@query(with_sql(MESSAGES) + "SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 16 AS BIGINT) AS shard FROM (SELECT DISTINCT id FROM messages)")
def o8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 16 conversations in order."""
    ids = global_ordinal(messages(spark, sf_dir).select("id").distinct(), "id")
    return ids.select("id", F.floor((F.col("ordinal") - 1) / 16).alias("shard"))


@query(with_sql(TRACE, "g AS (SELECT episode_id, string_agg('(' || tool || ')', ' -> ' ORDER BY step) AS graph FROM trace GROUP BY episode_id)") + r"SELECT episode_id, CAST(len(regexp_extract_all(graph, '\(([a-zA-Z_][a-zA-Z0-9_]*)\)', 1)) AS BIGINT) AS n, array_to_string(list_sort(list_distinct(regexp_extract_all(graph, '\(([a-zA-Z_][a-zA-Z0-9_]*)\)', 1))), ',') AS names FROM g")
def x3_graph_tool_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.array_sort(F.collect_list(F.struct("step", "tool")))
    graph = F.array_join(F.transform(steps, lambda s: F.concat(F.lit("("), s["tool"], F.lit(")"))), " -> ")
    g = trace(spark, sf_dir).groupBy("episode_id").agg(graph.alias("graph"))
    names = T.graph_tool_names(F.col("graph"))
    return g.select("episode_id", F.size(names).cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("names"))
