"""PII surrogates: every detected entity gets a keyed replacement of its own kind and form. DataFrame functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.columns import let, starts
from tracequarry.llm.common import materialize

# One pattern for all kinds, so that entities don't overlap; earlier alternatives win where two begin at one place.
# Repeated groups are possessive or short: the engine matches others by recursion, whose depth would be the text's.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?=[A-Za-z0-9])[A-Za-z0-9.-]{1,252}\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP = rf"(?<![A-Za-z0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![A-Za-z0-9]|\.[0-9])"
CARD = r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])"
SSN = r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
# A plus and 7 to 15 digits in any groups, then national forms: (030) 555-0001, 06 12 34 56 78, 030/1234567.
_PLUS = r"(?<![A-Za-z0-9+(])\+(?:[0-9](?:[ ./-]?\(|\)[ ./-]?|[ ./-])?){6,14}[0-9](?![A-Za-z0-9])"
_PAIRS = r"(?<![A-Za-z0-9+(.,/-])0[1-9](?:[ .-][0-9]{2}){4}(?![A-Za-z0-9])"
_AREA = r"(?<![A-Za-z0-9+(.,/-])(?:\(0[1-9][0-9]{1,4}\)[ /-]?|0[1-9][0-9]{1,4}(?:\x20/\x20|[ /-]))(?:[0-9][ -]?){3,8}[0-9](?![A-Za-z0-9])"
PHONE = rf"{_PLUS}|{_PAIRS}|{_AREA}|" r"(?<![A-Za-z0-9+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![A-Za-z0-9])"
# Country codes of one and two digits; all others have three.
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
# Titles that say a person's gender, by gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "г-н", "господин", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "г-жа", "госпожа", "κυρία")
NEUTRAL = ("Dr", "Prof", "Mx")
TITLE = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
#: Six titles at most: each place in a run of titles would be tried to the run's end.
TITLES = rf"(?:(?:{TITLE})\.?\x20){{1,6}}+"
_WORD = r"(?:\p{Lu}(?:\p{L}{1,40}+|(?=['’]\p{L}{2}))(?:['’-]\p{L}{2,40}+){0,3}+|\p{Lu}\.(?=\x20\p{Lu}))"
_PARTICLE = r"(?:\x20(?:von|vom|van|zu|zum|zur|den|der|ter|ten|de|del|della|di|da|du|des|la|le|dos|y))"
NAME = rf"(?<![\p{{L}}-]){TITLES}{_WORD}(?:{_PARTICLE}{{0,3}}\x20{_WORD})*+"
ENTITY = "|".join((EMAIL, IP, CARD, SSN, PHONE, NAME))
#: What a text must hold for the pattern to be tried at all.
HINT = rf"[0-9@]|(?:{TITLE})\.?\x20"

# Given names by script and gender; the syllables that surnames and mailboxes are made of, by script.
GIVEN = {
    "latin": {"m": ("Adam", "Bruno", "David", "Erik", "Felix", "Hugo", "Leon", "Martin", "Oscar", "Paul", "Simon", "Victor"), "f": ("Alma", "Bianca", "Clara", "Diana", "Elena", "Flora", "Ida", "Julia", "Laura", "Nora", "Olga", "Vera"), "n": ("Alex", "Andrea", "Chris", "Dana", "Jules", "Kim", "Lou", "Noa", "Robin", "Sacha", "Sam", "Toni")},
    "cyrillic": {"m": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Лев", "Олег"), "f": ("Алла", "Вера", "Дарья", "Елена", "Инна", "Нина", "Ольга", "Юлия"), "n": ("Валя", "Женя", "Саша", "Шура")},
    "greek": {"m": ("Αλέξης", "Γιώργος", "Νίκος", "Πέτρος"), "f": ("Άννα", "Ελένη", "Μαρία", "Σοφία"), "n": ("Αλεξ", "Δανάη", "Κρις", "Σάσα")},
}
SYLLABLES = {
    "latin": tuple(c + v for c in "bdfgklmnprst" for v in "aeiou"),
    "cyrillic": tuple(c + v for c in "бвгдзклмнпрст" for v in "аеиоу"),
    "greek": tuple(c + v for c in "βγδζκλμνπρστ" for v in "αειου"),
}
ROUNDS = 6
SPAN = "array<struct<kind:string,start:int,end:int,value:string,surrogate:string>>"


def kind_of(value: Column) -> Column:
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(r"\p{L}"), "name")
        .when(value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
        .when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(value.rlike(r"^[0-9](?:[ -]?[0-9]){12,18}$"), "card")
        .otherwise("phone")
    )


def mac(key: str, *parts: Column) -> Column:
    """HMAC-SHA256 of the parts, joined by unit separators, in 64 hex digits."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in secret))
    inner = F.sha2(F.concat(pad(0x36), F.concat_ws("\x1f", *parts).cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def _number(digest: Column, modulus: Column) -> Column:
    """A number below modulus (at most 10**10) from a digest's first 13 digits."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % modulus


def _part(digest: Column, at: int) -> Column:
    """A number below 65536 from the four hex digits of the digest that begin at `at`."""
    return F.conv(F.substring(digest, at, 4), 16, 10).cast("int")


def permuted(key: str, kind: Column, digits: Column) -> Column:
    """Another string of as many digits: a keyed Feistel permutation, so different inputs never meet."""
    n = F.length(digits)
    a = (n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k.cast("double")).cast("long")

    state = F.struct(F.coalesce(F.substring(digits, F.lit(1), a).try_cast("long"), F.lit(0).cast("long")).alias("l"), F.substring(digits, a + 1, n).cast("long").alias("r"), power(a).alias("p"), power(n - a).alias("q"))
    return let(_rounds(key, kind, state, n), lambda s: F.concat(F.lpad(s["l"].cast("string"), a, F.lit("0")), F.lpad(s["r"].cast("string"), n - a, F.lit("0"))))


def _rounds(key: str, kind: Column, state: Column, n: Column) -> Column:
    def one(i: int):
        return lambda s: _feistel_round(key, kind, s, n, i)

    for i in range(ROUNDS):
        state = let(state, one(i))
    return state


def _feistel_round(key: str, kind: Column, s: Column, n: Column, i: int) -> Column:
    left, right = s["l"], s["r"]
    label = F.concat(kind, F.lit(str(i)))
    if i % 2:
        right = (right + _number(mac(key, label, n.cast("string"), left.cast("string")), s["q"])) % s["q"]
    else:
        left = (left + _number(mac(key, label, n.cast("string"), right.cast("string")), s["p"])) % s["p"]
    return F.struct(left.alias("l"), right.alias("r"), s["p"].alias("p"), s["q"].alias("q"))


def refill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced in turn, everything else kept."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct((s["i"] + digit.cast("int")).alias("i"), F.concat(s["out"], F.when(digit, F.substring(digits, s["i"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(template, ""), start, step)["out"]


def luhn(digits: Column) -> Column:
    """The check digit that makes digits + check digit pass Luhn's test."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: let(F.substring(digits, i, F.lit(1)).cast("int"), lambda d: F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)))
    return (10 - F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10) % 10


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _by_script(script: Column, tables: dict) -> Column:
    """The script's table as one string, words or syllables."""
    joined = {name: (" " if isinstance(next(iter(t)), str) and len(next(iter(t))) > 2 else "").join(t) for name, t in tables.items()}
    return F.when(script == "cyrillic", joined["cyrillic"]).when(script == "greek", joined["greek"]).otherwise(joined["latin"])


def _syllables(digest: Column, at: int, script: Column, count: int) -> Column:
    """So many syllables of two letters of the script."""
    picked = lambda t: F.concat(*[F.substring(t, 2 * (_part(digest, at + 4 * i) % (F.length(t) / 2).cast("int")) + 1, F.lit(2)) for i in range(count)])
    return let(_by_script(script, SYLLABLES), picked)


def _as_written(word: Column, new: Column) -> Column:
    """new in capitals if the word is."""
    return F.when((F.length(word) > 1) & (word == F.upper(word)), F.upper(new)).otherwise(new)


def _bare(name: Column) -> Column:
    return F.regexp_replace(name, rf"^{TITLES}", "")


def gender_of(name: Column) -> Column:
    """What the titles say: m, f, or n."""
    titles = F.split(F.regexp_extract(name, rf"^{TITLES}", 0), "[. ]+")
    return F.when(F.arrays_overlap(titles, F.array(*map(F.lit, MALE))), "m").when(F.arrays_overlap(titles, F.array(*map(F.lit, FEMALE))), "f").otherwise("n")


def given_key(name: Column) -> Column:
    """A name's given name in small letters; null if there is only a surname or an initial."""
    parts = F.split(_bare(name), " ")
    return F.when((F.size(parts) > 1) & ~parts[0].endswith("."), F.lower(parts[0]))


def surrogate(key: str, kind: Column, value: Column, gender: Column) -> Column:
    """The keyed replacement of an entity; gender: m, f or n, of a person.

    Card, phone and SSN digits and addresses are permuted (see permuted), so their surrogates differ just if they do.
    Separators stay, and so does whether a card number passes Luhn's test. Of a phone number the country code stays, with
    or without separators, and so do a trunk zero and whether the number after it begins with a zero; that number's
    surrogate is the same in every notation. A mailbox becomes syllables (of 60**8 words), in two parts if it had a dot,
    with digits if it had some, and its domain one of 60**6 names under the reserved example.org: addresses of one domain
    share it; case is ignored. A person keeps the titles. Each given name becomes one of its gender in its script, with
    five syllables more (an initial becomes an initial), and the last word a surname of six syllables; each depends on its
    own word alone, in small letters, and is written in capitals where that was.
    """

    def phone(v: Column) -> Column:
        """The parts of a phone number: code, whether a trunk zero in brackets follows, and the subscriber's digits."""
        plus = v.startswith("+")
        trunk = plus & v.contains("(0)")
        plain = F.regexp_replace(F.when(trunk, F.replace(v, F.lit("(0)"), F.lit(""))).otherwise(v), "[^0-9]", "")
        code = F.when(plus, F.regexp_extract(plain, COUNTRY, 0)).otherwise(F.regexp_extract(plain, "^0", 0))
        return let(F.struct(code.alias("code"), trunk.alias("trunk"), plain.alias("d")), lambda x: F.struct(x["code"].alias("code"), F.when(x["trunk"], "0").otherwise("").alias("trunk"), F.substring(x["d"], F.length(x["code"]) + 1, F.length(x["d"])).alias("d")))

    def plain(v: Column) -> Column:
        d = F.regexp_replace(v, "[^0-9]", "")
        return F.struct(F.lit("").alias("code"), F.lit("").alias("trunk"), d.alias("d"))

    def numbered(x: Column) -> Column:
        # what is permuted: all but a card's check digit, and all but a subscriber's first digit
        body = F.when(kind == "card", F.substring(x["d"], F.lit(1), F.length(x["d"]) - 1)).when(kind == "phone", F.substring(x["d"], F.lit(2), F.length(x["d"]))).otherwise(x["d"])
        first = F.substring(x["d"], 1, 1).cast("int")

        def checked(b: Column) -> Column:
            shift = F.substring(x["d"], -1, 1).cast("int") - luhn(b["old"]) + 10
            return F.concat(b["new"], ((luhn(b["new"]) + shift) % 10).cast("string"))

        def led(b: Column) -> Column:
            moved = (1 + (first - 1 + _number(mac(key, F.lit("phone"), b["old"]), F.lit(9))) % 9).cast("string")
            return F.concat(x["code"], x["trunk"], F.when(first == 0, "0").otherwise(moved), b["new"])

        both = let(body, lambda d: F.struct(d.alias("old"), permuted(key, kind, d).alias("new")))
        return let(both, lambda b: refill(value, F.when(kind == "card", checked(b)).when(kind == "phone", led(b)).otherwise(b["new"])))

    def ip(v: Column) -> Column:
        octets = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
        state = let(octets, lambda o: F.struct((o[0] * 256 + o[1]).alias("l"), (o[2] * 256 + o[3]).alias("r"), F.lit(65536).cast("long").alias("p"), F.lit(65536).cast("long").alias("q")))
        return let(_rounds(key, F.lit("ip"), state, F.lit(32)), lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)]))

    def email(v: Column) -> Column:
        low, box = F.lower(v), F.substring_index(F.lower(v), "@", 1)

        def made(d: Column) -> Column:
            words = F.concat(_syllables(d["own"], 1, F.lit("latin"), 4), F.when(box.contains("."), ".").otherwise(""), _syllables(d["own"], 17, F.lit("latin"), 4))
            tail = F.when(box.rlike("[0-9]"), (_part(d["own"], 33) % 90 + 10).cast("string")).otherwise("")
            return F.concat(words, tail, F.lit("@"), _syllables(d["domain"], 1, F.lit("latin"), 6), F.lit(".example.org"))

        return let(F.struct(mac(key, F.lit("mail"), low).alias("own"), mac(key, F.lit("domain"), F.substring_index(low, "@", -1)).alias("domain")), made)

    def given(word: Column, g: Column) -> Column:
        def made(x: Column) -> Column:
            names = F.when(x["g"] == "m", _by_script(x["script"], {s: t["m"] for s, t in GIVEN.items()})).when(x["g"] == "f", _by_script(x["script"], {s: t["f"] for s, t in GIVEN.items()})).otherwise(_by_script(x["script"], {s: t["n"] for s, t in GIVEN.items()}))
            first = let(F.split(names, " "), lambda t: F.get(t, _part(x["d"], 1) % F.size(t)))
            return let(first, lambda f: F.when(word.endswith("."), F.concat(F.substring(f, 1, 1), F.lit("."))).otherwise(let(F.concat(f, _syllables(x["d"], 5, x["script"], 5)), lambda w: _as_written(word, w))))

        known = F.struct(mac(key, F.lit("given"), F.lower(word)).alias("d"), _script(word).alias("script"), g.alias("g"))
        return F.when(word.rlike(r"^\p{Ll}"), word).otherwise(let(known, made))

    def surname(word: Column) -> Column:
        known = F.struct(mac(key, F.lit("surname"), F.lower(word)).alias("d"), _script(word).alias("script"))
        return let(known, lambda x: let(F.initcap(_syllables(x["d"], 1, x["script"], 6)), lambda w: _as_written(word, w)))

    def name(v: Column) -> Column:
        title = F.regexp_extract(v, rf"^{TITLES}", 0)
        parts = F.split(F.substring(v, F.length(title) + 1, F.length(v)), " ")

        def full(x: Column) -> Column:
            before = F.transform(F.slice(x["parts"], F.lit(1), F.size(x["parts"]) - 1), lambda w: given(w, x["gender"]))
            return F.concat(x["title"], F.array_join(F.concat(before, F.array(surname(F.element_at(x["parts"], -1)))), " "))

        return let(F.struct(title.alias("title"), parts.alias("parts"), gender.alias("gender")), full)

    return (
        F.when(kind == "email", email(value))
        .when(kind == "name", name(value))
        .when(kind == "ip", ip(value))
        .otherwise(let(F.when(kind == "phone", phone(value)).otherwise(plain(value)), numbered))
    )


def _names(hits: Column) -> Column:
    return F.filter(hits, lambda v: v.rlike(rf"^{TITLES}"))


def pattern(hits: Column) -> Column:
    """ENTITY, and after titled names among the hits also these names and their last words without a title."""
    bare = F.transform(_names(hits), _bare)
    forms = F.array_distinct(F.concat(bare, F.transform(bare, lambda v: F.substring_index(v, " ", -1))))
    longest = F.transform(F.array_sort(F.transform(forms, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda x: F.concat(F.lit("\\Q"), x["v"], F.lit("\\E")))
    again = F.concat(F.lit(ENTITY + r"|(?<![\p{L}-])(?=\p{Lu})(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}-])"))
    return F.when(F.size(bare) > 0, again).otherwise(F.lit(ENTITY))


def titled(text: Column) -> Column:
    """Matches of ENTITY, in order, for texts that hold a hint of one."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(none)


def made_up(docs: DataFrame) -> DataFrame:
    """value, kind: the different addresses and titled names of the corpus, whose surrogates are drawn and could meet."""
    hits = docs.select(F.filter(titled(F.col("text")), lambda v: v.contains("@") | v.rlike(rf"^{TITLES}")).alias("hits"))
    found = hits.select(F.explode("hits").alias("value")).distinct()
    return materialize(found.select("value", kind_of(F.col("value")).alias("kind")), "pii-entities")


def genders(found: DataFrame) -> DataFrame:
    """word, gender: given names that stand behind a neutral title, and behind titles of just one gender."""
    seen = found.filter("kind = 'name'").select(given_key(F.col("value")).alias("word"), gender_of(F.col("value")).alias("g")).filter("word is not null")
    by = seen.groupBy("word").agg(*[F.bool_or(F.col("g") == g).alias(g) for g in "mfn"])
    return by.filter("n and m <> f").select("word", F.when(F.col("m"), "m").otherwise("f").alias("gender"))


def collisions(found: DataFrame, key: str) -> int:
    """How many surrogates different addresses or names share; names as a whole without titles, and last words.

    The different entities are dealt by their number of partitions, as the work is in the hashing, not in the bytes.
    """
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = found.filter("kind = 'name'").select(F.substring_index("value", " ", -1).alias("value"), "kind")
    bare = F.when(F.col("kind") == "name", _bare(F.col("value"))).otherwise(F.col("value"))
    each = found.unionByName(last).repartition(parts, "value")
    made = each.select("kind", F.lower(bare).alias("who"), F.lower(_bare(surrogate(key, F.col("kind"), F.col("value"), gender_of(F.col("value"))))).alias("as"))
    shared = made.groupBy("kind", "as").agg(F.min("who").alias("a"), F.max("who").alias("b")).filter("a <> b")
    return shared.count()


def _with_genders(tried: DataFrame, known: DataFrame) -> DataFrame:
    """tried with __who: given name -> gender for those of a text's neutral names that `known` lists.

    Texts without such a name aren't moved; of the others those with equal names share one row of the lookup.
    """
    kind = "map<string,string>"
    neutral = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.filter(_names(F.col("__first")), lambda v: gender_of(v) == "n"), given_key))))
    if known.isEmpty():
        return tried.withColumn("__who", F.lit(None).cast(kind))
    asked = tried.withColumn("__asked", neutral)
    lists = asked.filter(F.size("__asked") > 0).select("__asked").distinct().withColumn("__set", F.sha2(F.array_join("__asked", " "), 256))
    told = lists.select("__set", F.explode("__asked").alias("word")).join(known, "word").groupBy("__set").agg(F.map_from_entries(F.collect_list(F.struct("word", "gender"))).alias("__who"))
    few = asked.filter(F.size("__asked") == 0).withColumn("__who", F.lit(None).cast(kind)).drop("__asked")
    some = asked.filter(F.size("__asked") > 0).withColumn("__set", F.sha2(F.array_join("__asked", " "), 256)).join(told, "__set", "left").drop("__asked", "__set")
    return few.unionByName(some)


def replace_private(docs: DataFrame, key: str, tries: int = 8) -> DataFrame:
    """docs with text replaced and a column entities: kind, start, end (code points of the original), value, surrogate.

    key is a secret: whoever has it can invert the permutations. The same entity gets the same surrogate wherever it
    occurs, as HMACs under the key decide and no table, so mentions still refer to each other across documents. Before
    that the corpus's different addresses and names are checked: if two share a surrogate, the next key is tried. Permuted
    kinds can't collide; for the others a collision is as likely as n**2 / 2 / 60**8 (mailboxes) or / 60**6 (surnames), so
    a corpus too large for surnames ends in an error after `tries` keys, never in a silent merge.

    A name is found behind its titles, over all capitalised words that follow. In the same document the whole name and its
    last word are then replaced without a title too, with the same given and last names. Behind a neutral title a given
    name takes the gender that other titles of the corpus give it, if they agree; a name that stands behind titles of both
    genders is two people. Addresses end after 64 + 277 characters.

    Null text stays null, texts without entities and all other columns are unchanged (a column named entities is
    replaced). Repeated rows stay. Empty table: no rows. Narrow, but for the check, which moves only distinct entities,
    and for texts whose neutral names have a gender to look up.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    entities = made_up(docs)
    for i in range(tries):
        used = f"{key}/{i}"
        if not collisions(entities, used):
            break
    else:
        raise ValueError(f"surrogates collide under {tries} keys")
    known = materialize(genders(entities), "pii-genders")
    others = [c for c in docs.columns if c != "entities"]
    first = docs.select(*others, titled(F.col("text")).alias("__first"))
    tried = _with_genders(first, known).select("*", _names(F.col("__first")).alias("__names"))
    tried = tried.select("*", F.when(F.size("__names") > 0, pattern(F.col("__first"))).alias("__again"), F.transform("__names", _bare).alias("__bare"))
    hits = F.when(F.col("__again").isNotNull(), F.regexp_extract_all("text", F.col("__again"), F.lit(0))).otherwise(F.col("__first"))
    found = tried.select("*", hits.alias("__hits"))
    gaps = F.when(F.size("__hits") > 0, F.split("text", F.coalesce("__again", F.lit(ENTITY)), -1))

    def replaced(v: Column) -> Column:
        # A name without a title is one of the document's titled names, the first of which tells its gender.
        own = F.when(v.rlike(rf"^{TITLES}"), v).otherwise(F.get(F.col("__names"), (F.array_position(F.col("__bare"), v) - 1).cast("int")))

        def one(x: Column) -> Column:
            gender = F.when(x["kind"] == "name", let(gender_of(x["own"]), lambda g: F.when(g == "n", F.coalesce(F.try_element_at(F.col("__who"), given_key(x["own"])), g)).otherwise(g))).otherwise("n")
            return F.struct(x["kind"].alias("kind"), v.alias("value"), surrogate(used, x["kind"], v, gender).alias("surrogate"))

        return let(F.struct(kind_of(v).alias("kind"), F.coalesce(own, v).alias("own")), one)

    cut = found.select("*", gaps.alias("__gaps"), F.when(F.size("__hits") > 0, F.transform("__hits", replaced)).alias("__made"))
    lengths = F.zip_with("__gaps", "__hits", lambda g, v: F.length(g) + F.coalesce(F.length(v), F.lit(0)))
    at = F.when(F.size("__hits") > 0, starts(lengths))
    placed = cut.select("*", at.alias("__at"))
    zipped = F.arrays_zip(F.col("__gaps").alias("gap"), F.col("__made").alias("m"), F.col("__at").alias("at"))

    def span(x: Column) -> Column:
        start = x["at"] + F.length(x["gap"])
        return F.struct(x["m"]["kind"].alias("kind"), start.alias("start"), (start + F.length(x["m"]["value"])).alias("end"), x["m"]["value"].alias("value"), x["m"]["surrogate"].alias("surrogate"))

    spans = F.when(F.size("__hits") > 0, F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), span)).otherwise(F.array().cast(SPAN))
    text = F.when(F.size("__hits") > 0, F.array_join(F.zip_with("__gaps", "__made", lambda g, m: F.concat(g, F.coalesce(m["surrogate"], F.lit("")))), "")).otherwise(F.col("text"))
    return placed.select(*[text.alias("text") if c == "text" else F.col(c) for c in others], spans.alias("entities"))
