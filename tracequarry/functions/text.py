"""Text predicates and scores as column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword and marker lists of the document scores.
COMPUTER_KEYWORDS = ["app", "browser", "click", "computer", "download", "email", "export", "file", "folder", "google", "install", "internet", "keyboard", "login", "log in", "online", "open", "password", "photo", "print", "printer", "save", "search", "settings", "software", "upload", "url", "website"]
STRONG_KEYWORDS = ["app", "browser", "computer", "download", "email", "export", "file", "folder", "google", "install", "internet", "login", "log in", "online", "password", "printer", "software", "upload", "url", "website"]
CORE_KEYWORDS = ["app", "browser", "click", "computer", "download", "email", "export", "facebook", "file", "folder", "google", "install", "ipad", "iphone", "keyboard", "login", "log in", "password", "printer", "software", "upload", "url", "website", "youtube"]
PROCEDURAL_MARKERS = [" first ", " then ", " after ", " before ", " next ", " select ", " choose ", " click ", " open ", " go to ", " type "]
STEP_WORDS = ["step", "steps", "method"]
TOY_MARKERS = ["first", "then", "after", "before", "if ", "checking", "choose", "schedule"]
FAILURE_MARKERS = ["failed", "failure", "error", "not available", "offline"]
STATS_FAILURE_MARKERS = ["error", "failed", "failure", "not found", "not available", "cannot"]
SUCCESS_MARKERS = ['"success"', '"queued"', '"scheduled"', '"enrolled"', '"ok"']
RECOVERY_MARKERS = ["fail", "fallback", "retry", "try another", "not available", "offline"]
VERIFICATION_PREFIXES = ["verify_", "read_", "get_", "list_", "search_", "poll_"]
VERIFICATION_TOKENS = ["verify", "status"]
SENSITIVE_NAMES = ["password", "secret", "credential", "api_key", "private_key"]


#: Marks of answers that no retry changes, and arguments that steer a tool.
PERMANENT_MARKERS = ["PROHIBITED_CONTENT", "blockReason", "finishReason': 'SAFETY'", '"finishReason": "SAFETY"']
CONTROL_ARGUMENTS = ["channel", "collection", "constraint_type", "credential_type", "destination", "expected_status", "format", "job_type", "provider", "relationship", "resource_type", "service", "target_collection", "view", "visibility"]


def total(flags: list[Column]) -> Column:
    return reduce(add, [f.cast("long") for f in flags], F.lit(0).cast("long"))


def phrase_pattern(word: str) -> str:
    """A word not beside [a-z0-9]; written without look-around, which is the same for a yes/no test."""
    return f"(^|[^a-z0-9]){re.escape(word)}([^a-z0-9]|$)"


def whole_words(alternatives: str) -> str:
    r"""\b(...)\b over all letters and digits, in a form that other regular expression engines read alike."""
    return rf"(^|[^\p{{L}}\p{{N}}_])({alternatives})([^\p{{L}}\p{{N}}_]|$)"


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def found_in(lowered: Column, words: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur: single words among the text's words, others as they stand."""
    single = [p for p in phrases if re.fullmatch("[a-z0-9]+", p)]
    others = [lowered.contains(p) if " " in p else lowered.rlike(phrase_pattern(p)) for p in phrases if p not in single]
    own = F.size(F.array_intersect(words, F.array(*map(F.lit, single)).cast("array<string>"))).cast("long")
    return own + total(others)


def prepared(text: Column) -> Column:
    """struct<low, words>: the text in small letters between spaces, and its different runs of a-z and 0-9."""
    lowered = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return _let(lowered, lambda low: F.struct(low.alias("low"), F.array_distinct(F.split(low, "[^a-z0-9]+")).alias("words")))


def hits(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur."""
    return _let(prepared(text), lambda p: found_in(p["low"], p["words"], phrases))


def score_of(p: Column, keywords: list[str], markers: list[str], steps: list[str]) -> Column:
    """Two for each keyword that occurs, one for each marker, one for each occurrence of a step word."""
    words = F.regexp_count(p["low"], F.lit(rf"(?U)\b({'|'.join(steps)})\b")).cast("long")
    return 2 * found_in(p["low"], p["words"], keywords) + total([p["low"].contains(m) for m in markers]) + words


def procedural_score(text: Column, keywords: list[str] = COMPUTER_KEYWORDS, markers: list[str] = PROCEDURAL_MARKERS, steps: list[str] = STEP_WORDS) -> Column:
    return _let(prepared(text), lambda p: score_of(p, keywords, markers, steps))


def any_marker(text: Column, markers: list[str]) -> Column:
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, [lowered.contains(m) for m in markers])


def is_verification_tool(name: Column) -> Column:
    prefix = reduce(lambda a, b: a | b, [name.startswith(p) for p in VERIFICATION_PREFIXES])
    return prefix | F.arrays_overlap(F.split(name, "_"), F.array(*map(F.lit, VERIFICATION_TOKENS)))


def is_identifier_like(value: Column) -> Column:
    return (F.length(value) >= 3) & value.rlike("[_/0-9]")


def is_failure(text: Column) -> Column:
    return any_marker(text, FAILURE_MARKERS)


def is_success(text: Column) -> Column:
    """Markers stand as they are, in quotation marks."""
    return reduce(lambda a, b: a | b, [text.contains(m) for m in SUCCESS_MARKERS])


def expects_recovery(text: Column) -> Column:
    return any_marker(text, RECOVERY_MARKERS)


def is_completed(status: Column) -> Column:
    """A rollout without a status is a completed one."""
    return F.coalesce(status, F.lit("completed")) == "completed"


def is_permanent_error(message: Column) -> Column:
    """A rejection that no retry will mend; markers stand as they are."""
    return F.coalesce(reduce(lambda a, b: a | b, [message.contains(m) for m in PERMANENT_MARKERS]), F.lit(False))


def is_scaffolding(tool: Column, capability: Column, tools: list[str], prefix: str = "audit.") -> Column:
    return F.coalesce(tool.isin(*tools) | capability.startswith(prefix), F.lit(False))


def is_control_argument(name: Column) -> Column:
    """Arguments that need no source in the conversation."""
    return name.isin(*CONTROL_ARGUMENTS)


def is_opaque_name(name: Column) -> Column:
    return name.rlike(r"^(operation|tool|function)_\d+_[0-9a-f]+$")


def is_sensitive(name: Column) -> Column:
    return any_marker(name, SENSITIVE_NAMES)


def normalized(text: Column) -> Column:
    """Lower case, white space runs as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r]+", " "))


def snake_case(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def sentences(text: Column) -> Column:
    """Pieces between white space that follows . ! or ?"""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")


def bucketize(value: Column, bounds: list[int]) -> Column:
    """le_b for the first bound that isn't exceeded, else gt_ the last."""
    out = F.lit(f"gt_{bounds[-1]}")
    for b in reversed(bounds):
        out = F.when(value <= b, f"le_{b}").otherwise(out)
    return out


def graph_tool_names(graph: Column) -> Column:
    """Names in parentheses."""
    return F.regexp_extract_all(graph, F.lit(r"\(([a-zA-Z_][a-zA-Z0-9_]*)\)"), F.lit(1))


def paths_overlap(a: Column, b: Column) -> Column:
    """Either string begins with the other; segments don't matter."""
    return a.startswith(b) | b.startswith(a)


def redacted(text: Column, secret: Column, mark: str = "***") -> Column:
    return F.when(F.length(secret) > 0, F.replace(text, secret, F.lit(mark))).otherwise(text)


def pointer_token(name: Column) -> Column:
    """A JSON pointer segment."""
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def is_safe_name(name: Column) -> Column:
    """A portable relative path: not absolute, no drive, no empty, '.' or '..' segment, no backslash."""
    return (F.length(name) > 0) & ~name.rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.{0,2}(/|$)")
