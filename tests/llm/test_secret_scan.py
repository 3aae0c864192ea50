import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tracequarry.llm.secret_scan import ALTERNATION, TURNS, battery, binomial_tail, scan, secrets
from tracequarry.llm.secret_scan import LETTERS as SHARES

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute(text):
    text = text or ""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ("assign", "access", "hex")
    found.sort(key=lambda s: (s[1], order.index(s[0])))
    return [sum(s[0] == k for s in found) for k in order] + [hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()], found


def cases():
    rng = random.Random(3)
    bits = ["token=", "TOKEN = \"", "api_key: '", "ApiKey:", "secret", "password", "passwd==", "abcdef12", "short", "AKIA", "AKIAABCDEFGH1234", "AKIAABC", "0123456789abcdef" * 2, "f" * 31, "é", "😀", " ", "\n", ".", "=", "token=secret:abcdefgh12", "x" * 70, "A1b2C3d4", "ſecret=", "toKen=12345678"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(20)]
    texts += [f"😀 é token = \"{h}\" und {h}" for h in hexes] + ["token=abcdefgh " * 300]
    return texts


def test_base_against_brute_force(spark, odd_docs, no_docs):
    docs = list(enumerate(cases()))
    out = secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(out) == len(docs)
    for r in out:
        counts, found = brute(docs[r.doc_id][1])
        assert [r.n_assign, r.n_access, r.n_hex, r.base_sha256] == counts
        own = r.spans.split(",") if r.spans else []
        assert [s for s in own if not s.startswith("random")] == [f"{k}:{a}:{b}" for k, a, b in found]
    assert secrets(no_docs).count() == 0
    assert sorted(str(r.doc_id) for r in secrets(odd_docs).collect()) == sorted(str(r.doc_id) for r in odd_docs.collect())


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ALPHABETS = {"base62": LETTERS + "0123456789", "base64": LETTERS + "0123456789+/", "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF"}


def planted(texts, rng, n):
    """The texts with keys of 20 to 64 characters put between words of some: (doc, start, end) of each."""
    keys = []
    for k in range(n):
        key = "".join(rng.choice(list(ALPHABETS.values())[k % 4]) for _ in range(rng.randrange(20, 65)))
        i = rng.randrange(len(texts))
        at = rng.choice([0, *[m.end() for m in re.finditer(r"(?<=[a-z]) ", texts[i])]])
        if any(d == i for d, _, _ in keys):
            continue
        texts[i] = texts[i][:at] + key + " " + texts[i][at:]
        keys.append((i, at, at + len(key)))
    return keys


def test_planted_keys_are_found(spark):
    """Recall of 0.9 or more over lengths 20 to 64, at most 1 % of what is added besides the planted keys."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()


    texts = [re.sub(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}", "gone", r.text or "") for r in docs]
    keys = planted(texts, random.Random(11), 240)
    out = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {(r.doc_id, s.start, s.end) for r in out for s in r.spans if s.kind in ("random", "hex")}
    assert len(keys) > 150
    assert sum(k in found for k in keys) >= 0.9 * len(keys)
    assert len(found - set(keys)) <= 0.01 * len(found)


def test_one_key_among_few_words(spark):
    key = "".join(random.Random(5).choice(ALPHABETS["base62"]) for _ in range(40))
    docs = [(1, f"the key is {key} so internationalization stays"), (2, "https://example.org/getUserNameById/2024/annual-report-final-version")]
    spans = [(s.kind, s.value) for r in scan(spark.createDataFrame(docs, "doc_id long, text string")).collect() for s in r.spans]
    assert spans == [("random", key)]


def brute_p(token):
    """The battery in plain Python."""
    low = token.lower()
    kinds = "".join("U" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "s" for c in token)
    sounds = "".join(("v" if c in "aeiouy" else "c") if c.isalpha() else "." for c in low)
    count = lambda text, what: len(re.findall(f"(?={what})", text))
    tail = lambda x, n, p: min(1.0, sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x, n + 1)))
    turns = tail(count(kinds, "Ud|Ul(?!l)|lU|ld|dU|dl"), count(kinds, "[Uld][Uld]"), TURNS)
    pairs = count(sounds, "[vc][vc]")
    serial = tail(pairs - count(sounds, "vc|cv"), pairs, 1 - ALTERNATION)
    letters = [c for c in low if c.isalpha()]
    n, share = len(letters), {k: v / sum(SHARES.values()) for k, v in SHARES.items()}
    two, three = sum(v**2 for v in share.values()), sum(v**3 for v in share.values())
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token):
        chi = max(sum(share[c] for c in "abcdef") ** n, 1e-12)
    elif n < 2:
        chi = 1.0
    else:
        z = (n + n * (n - 1) * two - sum(v * v for v in Counter(letters).values())) / math.sqrt(2 * n * (n - 1) * (two + 2 * (n - 2) * three - (2 * n - 3) * two**2))
        chi = max(math.erfc(min(4, max(-4, z)) / math.sqrt(2)) / 2, 1e-3)
    h = -math.log(chi) - math.log(turns) - math.log(serial)
    return chi, turns, serial, min(1.0, math.exp(-h) * (1 + h + h * h / 2))


def test_battery_against_its_laws(spark):
    rng = random.Random(2)
    tokens = ["".join(rng.choice(a) for _ in range(n)) for a in (*ALPHABETS.values(), LETTERS, "eenratison", "aZ09-/") for n in (16, 21, 40, 130)] + ["internationalization", "get_user_name_by_id_2024", "0000000000000000a", "getUserNameById0"]
    got = {r.t: r.b for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", battery(F.col("t")).alias("b")).collect()}
    for t in tokens:
        for mine, own, loose in zip((got[t].chi, got[t].turns, got[t].serial, got[t].p), brute_p(t), (1e-3, 1e-9, 1e-9, None), strict=True):
            assert loose is None or abs(mine - own) <= loose
    assert got["internationalization"].p > 0.1 < got["get_user_name_by_id_2024"].p
    assert got["getUserNameById0"].p > 0.01  # seven turns in 15 places: one ordinary token in fifty has as many
    assert spark.range(1).select(binomial_tail(F.lit(700), F.lit(2000), 0.15).alias("p")).first().p < 1e-50


def test_ordinary_words_are_judged_fairly(spark):
    """Under the hypothesis p-values below a level come about no more often than the level says."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.explode(F.expr(r"regexp_extract_all(text, '(?<![A-Za-z0-9+/_-])[A-Za-z+/_-]{16,}', 0)")).alias("t")).distinct()
    ps = sorted(r.p for r in docs.select(battery(F.col("t"))["p"].alias("p")).collect())
    assert len(ps) > 500 and all(sum(p <= level for p in ps) <= level * len(ps) for level in (0.1, 0.05, 0.01))


def test_many_spans_in_one_text(spark):
    text = " ".join(f"token={i:08d}xyz {i:032x}" for i in range(6000))
    row = secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row.n_assign == row.n_hex == 6000 and row.base_sha256 == brute(text)[0][3]
