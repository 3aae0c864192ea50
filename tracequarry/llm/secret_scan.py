"""Secret scans: pattern spans, and tokens that pass a battery of randomness tests. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.llm.columns import let, starts

# The three base patterns. The assignment keeps its short matches until they are filtered, for a match that
# fails still uses up its text; for the other two a shorter run can't hide a longer one, so the length is in the pattern.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
#: Runs that the tests look at; shorter ones carry too little evidence.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: Alphabets by inferred encoding, the narrowest that holds the token first.
ENCODINGS = (("hex", r"^[0-9a-f]+$"), ("HEX", r"^[0-9A-F]+$"), ("base32", r"^[A-Z2-7]+$"), ("base36", r"^[0-9a-z]+$"), ("base64", r""))
# Shares of a-z in ordinary text, in percent, the mean of English, German, French and Spanish.
LETTERS = dict(zip(string.ascii_lowercase, (8.7, 1.3, 3.2, 4.4, 15.2, 1.1, 1.8, 2.9, 7.1, 0.4, 0.4, 4.0, 2.9, 7.7, 5.4, 2.2, 0.6, 6.8, 7.0, 6.9, 4.0, 1.1, 0.9, 0.2, 0.7, 0.4), strict=True))
_SHARES = [x / sum(LETTERS.values()) for x in LETTERS.values()]
_SQUARES, _CUBES = sum(x**2 for x in _SHARES), sum(x**3 for x in _SHARES)
#: How often the kind of character changes between neighbours of an ordinary identifier, and how often a vowel stands
#: beside a consonant among the letters of ordinary words.
TURNS, ALTERNATION = 0.2, 0.62
#: Length classes are [16, 24), [24, 32), [32, 48), ...; evidence is counted in steps of 1/STEPS decimal places up to TOP.
LENGTHS = (16, 24, 32, 48, 64, 96, 128)
STEPS, TOP = 4, 200
FALSE_DISCOVERIES = 0.01
SPAN = "array<struct<start:int,end:int,kind:string,value:string>>"


def matches(text: Column, pattern: str, kind: str, hint: Column | None = None, value_group: int | None = None, least: int = 0) -> Column:
    """array<struct<start, end, kind, value>> of a pattern's leftmost non-overlapping matches, in code points.

    A text cut at the matches gives the stretches between them, so starts are sums of lengths. hint: what holds for every
    text with a match, and is cheaper to test. value_group: the group whose text is the value (else the match); matches
    with shorter values than `least` are dropped afterwards.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else None
    found = F.struct(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), *([] if value is None else [value.alias("value")]))

    def spans(x: Column) -> Column:
        sizes = F.zip_with(x["gap"], x["hit"], lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))
        rows = F.arrays_zip(F.slice(x["gap"], F.lit(1), F.size(x["hit"])).alias("gap"), x["hit"].alias("hit"), (x["hit"] if value is None else x["value"]).alias("value"), F.slice(starts(sizes), F.lit(1), F.size(x["hit"])).alias("at"))
        good = F.filter(rows, lambda r: F.length(r["value"]) >= least) if least else rows
        begin = lambda r: r["at"] + F.length(r["gap"])
        return F.transform(good, lambda r: F.struct(begin(r).alias("start"), (begin(r) + F.length(r["hit"])).alias("end"), F.lit(kind).alias("kind"), r["value"].alias("value")))

    there = text.rlike(pattern)
    return F.when(there if hint is None else hint & there, let(found, spans)).otherwise(F.array().cast(SPAN))


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by its logistic approximation (within 0.0002)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def binomial_tail(x: Column, n: Column, p: float) -> Column:
    """P(X >= x) of a binomial law: summed up to n = 512, beyond that Chernoff's bound of it."""

    def summed(k: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            return F.struct((s["mass"] * (k["n"] - i) / (i + 1) * (p / (1 - p))).alias("mass"), (s["tail"] + F.when(i >= k["x"], s["mass"]).otherwise(0.0)).alias("tail"))

        begin = F.struct(F.pow(F.lit(1 - p), k["n"]).alias("mass"), F.lit(0.0).alias("tail"))
        exact = F.least(F.aggregate(F.sequence(F.lit(0), F.least(k["n"], F.lit(512))), begin, step)["tail"], F.lit(1.0))
        share = k["x"] / k["n"]
        far = F.when(share <= p, 1.0).when(share >= 1, F.pow(F.lit(p), k["n"])).otherwise(F.exp(-k["n"] * (share * F.log(share / p) + (1 - share) * F.log((1 - share) / (1 - p)))))
        return F.when(k["n"] <= 512, exact).otherwise(far)

    return let(F.struct(x.alias("x"), n.alias("n")), summed)


def battery(token: Column) -> Column:
    """struct<encoding, chi, turns, serial, p>: how unlikely an ordinary token is to look this random; p combines the tests.

    The hypothesis is ordinary writing: words, numbers and names of several words. Each test takes the direction in which
    random tokens differ from it, and its p-value is that of the test's law under the hypothesis, at the token's length.
    chi: the chi-squared statistic of the letters against equal shares, small for random tokens; its law is that of
    multinomial counts with the shares of ordinary text. Of tokens in hex digits, whose alphabet is narrower than any
    text's, it is the chance that all letters fall in a-f. turns: runs of capitals, small letters and digits, where a
    capital that begins a word ends none, against a binomial law. serial: correlation of neighbours, vowel or consonant;
    ordinary words alternate, against a binomial law. p: Fisher's combination of the three. A token of the same form is
    judged alike in every corpus.
    """
    name = F.lit(ENCODINGS[-1][0])
    for encoding, pattern in reversed(ENCODINGS[:-1]):
        name = F.when(token.rlike(pattern), encoding).otherwise(name)
    upper, lower, digits, rest = string.ascii_uppercase, string.ascii_lowercase, string.digits, "+/_-"
    kinds = F.translate(token, upper + lower + digits + rest, "U" * 26 + "l" * 26 + "d" * 10 + "s" * 4)
    sounds = F.translate(F.lower(token), lower + digits + rest, "".join("v" if c in "aeiouy" else "c" for c in lower) + "." * 14)
    letters = F.regexp_replace(F.lower(token), "[^a-z]", "")
    count = lambda text, what: F.regexp_count(text, F.lit(f"(?={what})"))

    def tests(x: Column) -> Column:
        n = F.length(x["letters"]).cast("double")
        squares = F.aggregate(F.split(F.lit(lower), ""), F.lit(0.0), lambda a, c: a + let(n - F.length(F.replace(x["letters"], c, F.lit(""))), lambda k: k * k))
        variance = 2 * n * (n - 1) * (_SQUARES + 2 * (n - 2) * _CUBES - (2 * n - 3) * _SQUARES**2)
        score = (n + n * (n - 1) * _SQUARES - squares) / F.sqrt(F.greatest(variance, F.lit(1e-9)))
        spread = F.when(n >= 2, F.greatest(_normal_tail(F.greatest(F.least(score, F.lit(4.0)), F.lit(-4.0))), F.lit(1e-3))).otherwise(1.0)
        narrow = F.greatest(F.pow(F.lit(sum(_SHARES[:6])), n), F.lit(1e-12))
        pairs = count(x["sounds"], "[vc][vc]")
        return F.struct(
            x["encoding"].alias("encoding"),
            F.when(x["encoding"].isin("hex", "HEX"), narrow).otherwise(spread).alias("chi"),
            binomial_tail(count(x["kinds"], "Ud|Ul(?!l)|lU|ld|dU|dl"), count(x["kinds"], "[Uld][Uld]"), TURNS).alias("turns"),
            binomial_tail(pairs - count(x["sounds"], "vc|cv"), pairs, 1 - ALTERNATION).alias("serial"),
        )

    def combined(t: Column) -> Column:
        half = -sum((F.log(F.greatest(t[k], F.lit(1e-300))) for k in ("chi", "turns", "serial")), F.lit(0.0))
        p = let(half, lambda h: F.least(F.exp(-h) * (1 + h + h * h / 2), F.lit(1.0)))
        return F.struct(*[t[k].alias(k) for k in ("encoding", "chi", "turns", "serial")], p.alias("p"))

    return let(let(F.struct(name.alias("encoding"), kinds.alias("kinds"), sounds.alias("sounds"), letters.alias("letters")), tests), combined)


def length_class(n: Column) -> Column:
    out = F.lit(-1)
    for i, least in enumerate(LENGTHS):
        out = F.when(n >= least, i).otherwise(out)
    return out


def evidence(token: Column) -> Column:
    """The battery's p-value in steps of 1/STEPS decimal places, rounded down."""
    return F.least(F.floor(-F.log10(F.greatest(battery(token)["p"], F.lit(1e-60))) * STEPS), F.lit(TOP)).cast("int")


def _candidates(text: Column) -> Column:
    """Candidate spans that hold a letter."""
    return F.filter(matches(text, CANDIDATE, "random"), lambda s: s["value"].rlike("[A-Za-z]"))


def thresholds(docs: DataFrame, q: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """Length class -> least evidence that counts as random.

    Benjamini-Hochberg at level q within each length class, over the p-values of all different candidates of the corpus,
    words included, so long tokens aren't held back by the many short ones. It needs only counts by class and step: a table
    of at most 7 * 201 rows, whatever the corpus.
    """
    words = docs.select(F.explode(F.array_distinct(F.transform(_candidates(F.col("text")), lambda s: s["value"]))).alias("token")).distinct()
    seen = words.select(length_class(F.length("token")).alias("len"), evidence(F.col("token")).alias("step")).groupBy("len", "step").agg(F.count("*").alias("n"))
    w = Window.partitionBy("len").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = seen.select("len", "step", F.sum("n").over(w).alias("rank"), F.sum("n").over(Window.partitionBy("len")).alias("m"))
    good = ranked.filter(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= q * F.col("rank") / F.col("m"))
    return {r["len"]: r["step"] for r in good.groupBy("len").agg(F.min("step").alias("step")).collect()}


def _ordered(spans: Column) -> Column:
    """By start, then by kind as listed."""
    kinds = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("order"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _outside(base: Column, tokens: Column) -> Column:
    """The tokens that no base span covers: in order of starts, one is covered if a span before it ends no sooner."""
    both = F.array_sort(F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("own"), s["end"].alias("end"))), F.transform(tokens, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("own"), s["end"].alias("end")))))
    begin = F.struct(F.lit(-1).alias("to"), F.lit("").alias("flags"))
    flags = F.aggregate(both, begin, lambda a, s: F.struct(F.when(s["own"] == 0, F.greatest(a["to"], s["end"])).otherwise(a["to"]).alias("to"), F.when(s["own"] == 1, F.concat(a["flags"], F.when(a["to"] >= s["end"], "1").otherwise("0"))).otherwise(a["flags"]).alias("flags")))["flags"]
    return F.when(F.size(base) == 0, tokens).otherwise(let(F.struct(flags.alias("f"), tokens.alias("t")), lambda x: F.filter(x["t"], lambda _, i: F.substring(x["f"], i + 1, F.lit(1)) == "0")))


def scan(docs: DataFrame, q: float = FALSE_DISCOVERIES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with base (pattern spans) and spans (those and random tokens outside them).

    Spans are structs kind, start, end, value, with starts and ends in code points. Null text: empty. Repeated rows and
    null ids stay, an empty table gives no rows. Two passes over the texts and no shuffle but of different candidates and
    of counts.
    """
    texts = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    limits = thresholds(texts, q)
    t = F.col("text")
    assigned = matches(t, ASSIGN, "assign", t.contains("=") | t.contains(":"), 2, 8)
    found = texts.select(*keep, F.concat(assigned, matches(t, ACCESS, "access", t.contains("AKIA")), matches(t, HEX, "hex")).alias("base"), _candidates(t).alias("tokens"))
    enough = lambda s: evidence(s["value"]) >= let(length_class(F.length(s["value"])), lambda n: _level(n, limits))
    judged = found.select(*keep, "base", (F.filter("tokens", enough) if limits else F.array().cast(SPAN)).alias("tokens"))
    return judged.select(*keep, _ordered(F.col("base")).alias("base"), _ordered(F.concat("base", _outside(F.col("base"), F.col("tokens")))).alias("spans"))


def _level(cls: Column, limits: dict[int, int]) -> Column:
    out = F.lit(TOP + 1)
    for n, step in limits.items():
        out = F.when(cls == n, step).otherwise(out)
    return out


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans."""
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
