"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

import json
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm.chat import json_string
from tracequarry.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def surrogate_key(spark: SparkSession) -> str:
    """The session's setting spark.tracequarry.pii.key; unset: a fresh key, so surrogates hold for one run."""
    return spark.conf.get("spark.tracequarry.pii.key", None) or secrets.token_hex(32)


#: What the assistants of the table may call: a look-up, and a note about a call.
TOOLS = {
    "tools": [
        {"function": {"name": "lookup", "parameters": {"additionalProperties": False, "properties": {"after": {"type": "string"}, "n": {"type": "integer"}, "q": {"type": ["string", "null"]}}, "required": ["n", "q"], "type": "object"}}},
        {"function": {"name": "note", "parameters": {"properties": {"meta": {"properties": {"size": {"type": "integer"}}, "required": ["size"], "type": "object"}, "of": {"type": "string"}}, "required": ["of"], "type": "object"}}},
    ]
}


def with_calls(conversations: DataFrame) -> DataFrame:
    """The conversations as ones of tool use, as the table itself holds no calls.

    Every conversation declares TOOLS before its first turn. An assistant's message at turn t makes two calls: a look-up
    a<t> of its first word after the note b<t-2>, and a note b<t> on it. A user's message at turn t is also the result of
    a<t-1>. Texts of several lines give a look-up a wrong type, texts that don't end in a full stop a note an empty meta.
    """
    c = conversations.select("conv_id", "turn", "role", "text")
    declared = c.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit(json.dumps(TOOLS)).alias("text"))
    turn = F.col("turn").cast("string")
    ref = lambda k, t: F.concat(F.lit("${" + k), t, F.lit("}"))
    call = lambda i, name, arguments: F.concat(F.lit('{"id":'), json_string(i), F.lit(f',"type":"function","function":{{"name":"{name}","arguments":'), arguments, F.lit("}}"))
    n = F.when(F.col("text").contains("\n"), F.lit('"lines"')).otherwise(F.length("text").cast("string"))
    first = F.concat(F.lit('{"q":'), json_string(F.substring_index("text", " ", 1)), F.lit(',"n":'), n, F.lit(',"after":'), json_string(ref("b", (F.col("turn") - 2).cast("string"))), F.lit("}"))
    size = F.when(F.col("text").endswith("."), F.concat(F.lit('{"size":'), F.length("text").cast("string"), F.lit("}"))).otherwise("{}")
    second = F.concat(F.lit('{"of":'), json_string(ref("a", turn)), F.lit(',"meta":'), size, F.lit("}"))
    spoken = F.concat(F.lit('{"content":'), json_string(F.col("text")), F.lit(',"name":"helper","tool_calls":['), call(F.concat(F.lit("a"), turn), "lookup", first), F.lit(","), call(F.concat(F.lit("b"), turn), "note", second), F.lit("]}"))
    own = c.withColumn("text", F.when((F.col("role") == "assistant") & F.col("text").isNotNull() & F.col("turn").isNotNull(), spoken).otherwise(F.col("text")))
    answer = F.concat(F.lit('{"tool_call_id":'), json_string(F.concat(F.lit("a"), (F.col("turn") - 1).cast("string"))), F.lit(',"content":'), json_string(F.col("text")), F.lit("}"))
    told = c.filter("role = 'user' and text is not null and turn is not null").select("conv_id", "turn", F.lit("tool").alias("role"), answer.alias("text"))
    return declared.unionByName(own).unionByName(told)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.chat import format_messages

    return format_messages(with_calls(table(spark, sf_dir, "conversations")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.decontamination import scan

    hits = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.secret_scan import secrets

    return secrets(table(spark, sf_dir, "documents"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.pii import replace_private

    return replace_private(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark))


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.language_model import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of documents. Where 5 divides the id's crc32, the text's capital letters were made small ones later."""
    from tracequarry.llm.merkle import audit, leaf_digest, manifest, proof_digest

    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_digest([*[F.col(c) for c in columns[:-1]], small]))
    rows = manifest(table(spark, sf_dir, "documents"), columns, keep={"touched": touched})
    return audit(rows, F.col("touched")).select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op12_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.odd_sketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.whitening import by_component, whiten

    return by_component(whiten(table(spark, sf_dir, "embeddings")))


QUERIES = {f.__name__: f for f in (op1_chat, op2_simhash, op3_decontaminate, op4_secrets, op5_pack, op6_toxicity, op7_pii, op9_mpeg_audio, op8_pitman_yor, op10_substring_dedup, op11_merkle, op12_odd_sketch, op13_whitening)}

def _tree_sql(leaves: str, name: str, levels: int) -> str:
    """CTEs <name>0.. of (g, i, d, n), each with its runs' strings l and r beside every node, from leaves (g, i, d, n)."""
    siblings = "coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN {}), '')"
    left, right = siblings.format("UNBOUNDED PRECEDING AND 1 PRECEDING"), siblings.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
    sides = f"CASE WHEN n > 1 THEN {left} ELSE '' END AS l, CASE WHEN n > 1 THEN {right} ELSE '' END AS r"
    out = [f"{name}0 AS (SELECT *, {sides} FROM {leaves})"]
    for k in range(levels):
        out.append(f"{name}{k + 1} AS (SELECT *, {sides} FROM (SELECT g, i // 16 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d, (any_value(n) + 15) // 16 AS n FROM {name}{k} GROUP BY g, i // 16))")
    return ",\n        ".join(out)


def _climb_sql(start: str, levels: int, digest: str, name: str) -> tuple[str, str, str]:
    """The joins along a leaf's ancestors, all siblings' digests, and what `digest` leads to."""
    joins = "".join(f" JOIN {name}{k} ON {name}{k}.g = {start}.g AND {name}{k}.i = {start}.i // {16**k}" for k in range(levels))
    proof = " || ".join(f"{name}{k}.l || {name}{k}.r" for k in range(levels))
    for k in range(levels):
        digest = f"CASE WHEN {name}{k}.n > 1 THEN sha256({name}{k}.l || {digest} || {name}{k}.r) ELSE {digest} END"
    return joins, proof, digest


def _merkle_sql(levels: int = 5, top: int = 3) -> str:
    """op11 for sources of up to 16**levels rows and up to 16**top sources."""
    item = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(item(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    joins, proof, folded = _climb_sql("leaves", levels, "touched", "a")
    up, rest, whole = _climb_sql("groups", top, "folded", "b")
    return f"""
        WITH docs AS (
          SELECT doc_id, coalesce('=' || source, '') AS g, {leaf("text")} AS d,
            CASE WHEN {crc} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf("text")} END AS touched FROM documents),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM docs),
        {_tree_sql("(SELECT g, i, d, n FROM leaves)", "a", levels)},
        groups AS (SELECT '' AS g, g AS name, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM a{levels}),
        {_tree_sql("(SELECT g, i, d, n FROM groups)", "b", top)},
        own AS (SELECT doc_id, leaves.g AS name, leaves.d AS leaf, {proof} AS proof, {folded} AS folded FROM leaves{joins})
        SELECT doc_id, leaf, groups.d AS subroot, b{top}.d AS root, sha256(proof || {rest}) AS proof_sha256, {whole} AS folded_root, {whole} = b{top}.d AS verified
        FROM own JOIN groups USING (name){up} CROSS JOIN b{top}
    """


#: Only what SQL expresses whole.
ORACLE_SQL: dict[str, str] = {
    "op11_merkle": _merkle_sql(),
    "op12_odd_sketch": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
        items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        common AS (SELECT x, count(*) AS k FROM items GROUP BY x),
        ranked AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY k, x) AS r FROM items JOIN common USING (x)),
        rare AS (SELECT doc_id, n, x FROM ranked WHERE r <= n - (4 * n + 4) // 5 + 1),
        candidates AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM rare a JOIN rare b ON a.x = b.x AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
        shared AS (SELECT a, b, len(list_intersect(p.s, q.s)) AS i, len(p.s) AS n, len(q.s) AS m FROM candidates JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b),
        links AS (SELECT a, b FROM shared WHERE 100 * i >= 80 * (n + m - i)),
        edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT a AS doc_id, a AS other FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other),
        least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM sets LEFT JOIN least USING (doc_id)
    """,
    "op1_chat": """
        WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS i FROM conversations WHERE role = 'assistant'),
        depth AS (SELECT conv_id, turn, 2 * (row_number() OVER (PARTITION BY conv_id, turn % 2, turn - 2 * i ORDER BY turn) - 1) AS level FROM s),
        calls AS (
          SELECT a.conv_id, a.turn, a.text, d.level, u.text AS answer, contains(a.text, chr(10)) AS bad_a, NOT ends_with(a.text, '.') AS bad_b
          FROM conversations a JOIN depth d USING (conv_id, turn) LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn + 1 AND u.role = 'user' WHERE a.role = 'assistant')
        SELECT DISTINCT conv_id, -1::BIGINT AS turn, 'system' AS role, 0::BIGINT AS n_calls, 0::BIGINT AS n_linked, 0::BIGINT AS n_invalid, NULL::BIGINT AS level, '"""
    + json.dumps(TOOLS, sort_keys=True, separators=(",", ":"))
    + """' AS canonical FROM conversations
        UNION ALL SELECT conv_id, turn, role, 0, 0, 0, NULL, to_json({'content': text, 'role': role})::VARCHAR FROM conversations WHERE role <> 'assistant'
        UNION ALL SELECT conv_id, turn, 'tool', 0, 0, 0, NULL, to_json({'content': text, 'tool_call_id': 'a' || (turn - 1)})::VARCHAR FROM conversations WHERE role = 'user'
        UNION ALL SELECT conv_id, turn, 'assistant', 2, (answer IS NOT NULL)::BIGINT, bad_a::BIGINT + bad_b::BIGINT, level + 1,
          '{"content":' || to_json(text)::VARCHAR || ',"name":"helper","role":"assistant","tool_calls":[{"arguments":{"after":"${b' || (turn - 2) || '}","n":' || CASE WHEN bad_a THEN '"lines"' ELSE length(text)::VARCHAR END || ',"q":' || to_json(split_part(text, ' ', 1))::VARCHAR
          || '},"id":"a' || turn || '","level":' || level || ',"name":"lookup","result":' || coalesce(to_json(answer)::VARCHAR, 'null') || ',"type":"function"},{"arguments":{"meta":' || CASE WHEN bad_b THEN '{}' ELSE '{"size":' || length(text) || '}' END
          || ',"of":"${a' || turn || '}"},"id":"b' || turn || '","level":' || (level + 1) || ',"name":"note","result":null,"type":"function"}]}' FROM calls
    """,
    "op3_decontaminate": r"""
        WITH w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
        b AS (
          SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
        item_windows AS (
          SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM item_windows),
        doc_windows AS (
          SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, sizes WHERE len(w) >= n)),
        hits AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, k)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op10_substring_dedup": r"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        windows AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
        later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
        gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later) GROUP BY doc_id),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w) ANTI JOIN (SELECT doc_id, unnest(p) AS i FROM gone) g USING (doc_id, i) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(g.p), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN gone g USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
}
