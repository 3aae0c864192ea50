import re

from tracequarry.llm.pii import collisions, made_up, replace_private

WORD = "[A-Z][a-z]+"


def replaced(spark, *texts):
    rows = list(enumerate(texts))
    out = {r.doc_id: r for r in replace_private(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, text in rows:
        assert all(text[e.start : e.end] == e.value for e in out[i].entities)
    return [out[i].text for i, _ in rows]


def test_whole_names(spark):
    a, b, c = replaced(spark, "ask Dr. Anna Maria Schmidt, please", "Prof. Dr. Otto von Weber came", "Dr. J. Smith is in")
    assert re.fullmatch(rf"ask Dr\. {WORD} {WORD} {WORD}, please", a) and not re.search("Anna|Maria|Schmidt", a)
    assert re.fullmatch(rf"Prof\. Dr\. {WORD} von {WORD} came", b) and not re.search("Otto|Weber", b)
    assert re.fullmatch(rf"Dr\. [A-Z]\. {WORD} is in", c) and "Smith" not in c


def test_mentions_refer_to_each_other(spark):
    a, b = replaced(spark, "Ms Jane Smith met Ms Smith. Later Jane Smith left, and Smith's car too. Smithson stays.", "Ms Joan Smith")
    given, last = re.match(rf"Ms ({WORD}) ({WORD}) met", a).groups()
    assert a == f"Ms {given} {last} met Ms {last}. Later {given} {last} left, and {last}'s car too. Smithson stays."
    other = b.split()
    assert other[2] == last and other[1] != given


def test_given_names_of_one_surname_differ(spark):
    names = [f"Mr {chr(65 + i % 26)}{chr(97 + i // 26)}na Smith" for i in range(300)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "doc_id long, text string")
    assert collisions(made_up(df), "k/0") == 0


def test_european_phones(spark):
    phones = ["+49 30 1234567", "+33 1 23 45 67 89", "06 12 34 56 78", "06.12.34.56.78", "030/1234567", "(030) 1234567", "0171 1234567", "+49 (0)30 123 45678", "+44 20 7946 0958", "+34 612 34 56 78"]
    out = replaced(spark, *[f"tel {p}, ok" for p in phones])
    for p, text in zip(phones, out, strict=True):
        assert p not in text and re.sub(r"\d", "0", text) == re.sub(r"\d", "0", f"tel {p}, ok")
    kept = ["on 01-02-2024", "2024-01-02 10:30", "0.0123 45678", "in 2023 and 2024"]
    assert replaced(spark, *kept) == kept
