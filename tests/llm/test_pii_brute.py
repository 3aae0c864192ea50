"""The whole operator against a plain Python version, and the texts that are hard on a regular expression engine."""

import hashlib
import hmac
import time

import pytest
import regex
from test_pii import cases, check_digit

from tracequarry.llm import pii
from tracequarry.llm.pii import replace_private

TITLES = regex.compile(pii.TITLES)


def mac(key, *parts):
    return hmac.new(key.encode(), "\x1f".join(parts).encode(), hashlib.sha256).hexdigest()


def pick(d, at, table):
    return table[int(d[at - 1 : at + 3], 16) % len(table)]


def number(d, m):
    return int(d[:13], 16) % m


def rounds(key, kind, left, right, p, q, n):
    for i in range(pii.ROUNDS):
        if i % 2:
            right = (right + number(mac(key, f"{kind}{i}", str(n), str(left)), q)) % q
        else:
            left = (left + number(mac(key, f"{kind}{i}", str(n), str(right)), p)) % p
    return left, right


def permuted(key, kind, s):
    n, a = len(s), len(s) // 2
    left, right = rounds(key, kind, int(s[:a] or 0), int(s[a:]), 10**a, 10 ** (n - a), n)
    return (f"{left:0{a}d}" if a else "") + f"{right:0{n - a}d}"


def refill(template, digits):
    it = iter(digits)
    return "".join(next(it, "") if c in "0123456789" else c for c in template)


def script(w):
    return "cyrillic" if regex.match(r"\p{IsCyrillic}", w) else "greek" if regex.match(r"\p{IsGreek}", w) else "latin"


def syllables(d, at, s, n):
    return "".join(pick(d, at + 4 * i, pii.SYLLABLES[s]) for i in range(n))


def caps(word, new):
    return new.upper() if len(word) > 1 and word == word.upper() else new


def gender_of(v):
    m = TITLES.match(v)
    titles = regex.split("[. ]+", m[0]) if m else []
    return "m" if set(titles) & set(pii.MALE) else "f" if set(titles) & set(pii.FEMALE) else "n"


def bare(v):
    return TITLES.sub("", v, count=1) if TITLES.match(v) else v


def surrogate(key, kind, v, gender):
    digits = regex.sub("[^0-9]", "", v)
    if kind == "email":
        low = v.lower()
        box, d, dom = low.split("@")[0], mac(key, "mail", low), mac(key, "domain", low.split("@")[-1])
        tail = str(int(d[32:36], 16) % 90 + 10) if regex.search("[0-9]", box) else ""
        return syllables(d, 1, "latin", 4) + ("." if "." in box else "") + syllables(d, 17, "latin", 4) + tail + "@" + syllables(dom, 1, "latin", 6) + ".example.org"
    if kind == "ip":
        o = [int(x) for x in v.split(".")]
        left, right = rounds(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, 32)
        return ".".join(map(str, (left // 256, left % 256, right // 256, right % 256)))
    if kind == "ssn":
        return refill(v, permuted(key, "ssn", digits))
    if kind == "card":
        body = permuted(key, "card", digits[:-1])
        last = next(c for c in "0123456789" if check_digit(body + c))
        good = next(c for c in "0123456789" if check_digit(digits[:-1] + c))
        return refill(v, body + str((int(last) + int(digits[-1]) - int(good)) % 10))
    if kind == "phone":
        trunk = v.startswith("+") and "(0)" in v
        plain = regex.sub("[^0-9]", "", v.replace("(0)", "") if trunk else v)
        m = regex.match(pii.COUNTRY if v.startswith("+") else "0", plain)
        code = m[0] if m else ""
        rest = plain[len(code) :]
        first = rest[0] if rest[0] == "0" else str(1 + (int(rest[0]) - 1 + number(mac(key, "phone", rest[1:]), 9)) % 9)
        return refill(v, code + ("0" if trunk else "") + first + permuted(key, "phone", rest[1:]))
    title = TITLES.match(v)
    parts, out = bare(v).split(" "), []
    for w in parts[:-1]:
        d = mac(key, "given", w.lower())
        first = pick(d, 1, pii.GIVEN[script(w)][gender])
        out.append(w if regex.match(r"\p{Ll}", w) else first[0] + "." if w.endswith(".") else caps(w, first + syllables(d, 5, script(w), 5)))
    d = mac(key, "surname", parts[-1].lower())
    return (title[0] if title else "") + " ".join([*out, caps(parts[-1], syllables(d, 1, script(parts[-1]), 6).capitalize())])


def kind_of(v):
    if "@" in v:
        return "email"
    if regex.search(r"\p{L}", v):
        return "name"
    if regex.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", v):
        return "ip"
    if regex.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", v):
        return "ssn"
    return "card" if regex.fullmatch(r"[0-9](?:[ -]?[0-9]){12,18}", v) else "phone"


def brute(docs, key):
    first = {i: [m[0] for m in regex.finditer(pii.ENTITY, t)] for i, t in docs}
    names = {i: [v for v in hits if TITLES.match(v)] for i, hits in first.items()}
    seen = {}
    for v in (v for vs in names.values() for v in vs):
        parts = bare(v).split(" ")
        if len(parts) > 1 and not parts[0].endswith("."):
            seen.setdefault(parts[0].lower(), set()).add(gender_of(v))
    known = {w: min(g - {"n"}) for w, g in seen.items() if "n" in g and len(g) == 2}
    out = []
    for i, t in docs:
        full = pii.ENTITY
        forms = {x for v in names[i] for x in (bare(v), bare(v).split(" ")[-1])}
        if forms:
            full += r"|(?<![\p{L}-])(?=\p{Lu})(?:" + "|".join(map(regex.escape, sorted(forms, key=lambda x: (-len(x), x)))) + r")(?![\p{L}-])"
        spans, text, at = [], "", 0
        for m in regex.finditer(full, t):
            v, kind = m[0], kind_of(m[0])
            own = v if TITLES.match(v) else next((n for n in names[i] if bare(n) == v), v)
            gender = "n"
            if kind == "name":
                word = bare(own).split(" ")[0].lower() if " " in bare(own) else None
                gender = gender_of(own) if gender_of(own) != "n" else known.get(word, "n")
            new = surrogate(key, kind, v, gender)
            spans.append((kind, m.start(), m.end(), v, new))
            text, at = text + t[at : m.start()] + new, m.end()
        out.append((i, text + t[at:], spans))
    return out


def test_whole_operator(spark):
    docs, _ = cases()
    docs += [
        (1000, "Mr. Otto Meier, Dr. Otto Meier and Mr. Meier; later Otto Meier and MEIER. Prof. ANNA Wu"),
        (1001, "Dr. Otto Meier of O'Brien & Sons: Mrs. Mary O'Brien's phone is +15551234567 or +1 555 123 4567 or (555) 123-4567"),
        (1002, "Ms Anna Wu, Dr. Kim Wu, Ms Kim Li, Mr Kim Li, Dr Kim Li; +49 (0)30 1234567, +49 30 1234567, 030/1234567, +4930 1234567"),
        (1003, "a..b@x..y.org x@a.b.c1 Q.Q@EXAMPLE.com q.q@example.com 1.2.3.4.5 10.0.0.1. 😀 é"),
    ]
    got = [(r.doc_id, r.text, [tuple(e) for e in r.entities]) for r in replace_private(spark.createDataFrame(docs, "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert got == brute(docs, "k/0")


def test_same_person_and_same_number(spark):
    docs = [(0, "Mr. Otto Meier"), (1, "Dr. Otto Meier"), (2, "Mr. Meier"), (3, "+15551234567"), (4, "+1 555 123 4567"), (5, "(555) 123-4567"), (6, "+49 (0)30 1234567"), (7, "030 1234567")]
    out = {r.doc_id: r.text for r in replace_private(spark.createDataFrame(docs, "doc_id long, text string"), "k").collect()}
    assert out[0].split()[1:] == out[1].split()[1:] and out[0].split()[0] == "Mr." and out[2].split()[1] == out[0].split()[2]
    number = [regex.sub("[^0-9]", "", out[i]) for i in range(3, 8)]
    assert number[0] == number[1] == "1" + number[2] and number[0][0] == "1" and out[3].startswith("+1")
    assert number[3].startswith("490") and number[4] == "0" + number[3][3:]


def test_a_key_is_needed(spark):
    with pytest.raises(ValueError):
        replace_private(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "")


def test_texts_that_are_hard_on_the_engine(spark):
    texts = ["x@" + "a." * 1_000_000 + "1", "Mr " * 300_000, "Mr " + "Abc " * 20_000, "+1" * 300_000, "1-" * 300_000, "a@" * 300_000, "(0" * 300_000, "1." * 300_000]
    out = {r.doc_id: r.text for r in replace_private(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    assert len(out) == len(texts) and all(len(out[i]) >= 300_000 for i in (0, 1, 3, 4, 5, 6, 7)) and "Abc" not in out[2]


def test_many_entities_in_one_text(spark):
    text = " ".join(f"user{i}@mail{i % 7}.example.com" for i in range(30_000))
    began = time.time()
    row = replace_private(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").collect()[0]
    assert len(row.entities) == 30_000 and all(text[e.start : e.end] == e.value for e in row.entities[:: 999])
    assert time.time() - began < 60
