import random
import re

from pyspark.sql import functions as F

from tracequarry.llm.pii import collisions, luhn, made_up, permuted, replace_private


def check_digit(s):
    total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s)))
    return total % 10 == 0


def cases():
    rng = random.Random(4)
    emails = [f"User.Name{i}@mail{i % 3}.example.com" for i in range(40)]
    phones = [f"+1 ({rng.randrange(1000):03d}) 555-{i:04d}" for i in range(40)]
    cards = [f"{rng.randrange(10**15):015d}{rng.randrange(10)}" for _ in range(60)]
    ips = [f"{rng.randrange(256)}.{rng.randrange(256)}.{i}.{rng.randrange(256)}" for i in range(60)]
    names = ["Mr. Otto Meier", "Frau Meier", "Mme Claire Dupont", "г-жа Иванова", "κύριος Παππάς", "Dr. Who"]
    pool = emails + phones + cards + ips + names + ["123-45-6789", "4111 1111 1111 1111"]
    docs = [(i, " ".join(x for j in range(rng.randrange(1, 5)) for x in ("wörd 😀", rng.choice(pool) + rng.choice(["", ".", ",", "!!", "***", "\n"])))) for i in range(300)]
    return docs, pool


def test_surrogates(spark):
    docs, pool = cases()
    out = replace_private(spark.createDataFrame(docs, "doc_id long, text string"), "k").collect()
    texts, mapping = dict(docs), {}
    for r in out:
        rebuilt, at = "", 0
        for e in r.entities:
            assert texts[r.doc_id][e.start : e.end] == e.value
            rebuilt += texts[r.doc_id][at : e.start] + e.surrogate
            at = e.end
            assert mapping.setdefault((e.kind, e.value), e.surrogate) == e.surrogate
        assert r.text == rebuilt + texts[r.doc_id][at:]
        assert not any(x in r.text for x in pool if len(x) > 8)
    assert {e.value for r in out for e in r.entities} >= {x for x in pool if any(x in t for t in texts.values())}
    assert len(set(mapping.values())) == len(mapping)
    for (kind, value), made in mapping.items():
        if kind in ("card", "phone", "ssn", "ip"):
            assert re.sub(r"\d+" if kind == "ip" else r"\d", "0", value) == re.sub(r"\d+" if kind == "ip" else r"\d", "0", made)
        if kind == "card":
            assert check_digit(re.sub(r"\D", "", value)) == check_digit(re.sub(r"\D", "", made))
        if kind == "phone":
            assert made.startswith("+1 (")
        if kind == "ip":
            assert all(0 <= int(x) <= 255 for x in made.split("."))
    assert re.fullmatch(r"Mr\. [A-Z][a-z]+ [A-Z][a-z]+", mapping["name", "Mr. Otto Meier"])
    assert re.fullmatch(r"г-жа [А-Я][а-я]+", mapping["name", "г-жа Иванова"])
    assert re.fullmatch(r"κύριος [Α-Ω][α-ω]+", mapping["name", "κύριος Παππάς"])


def test_permutation_is_one_to_one(spark):
    for n in (3, 4, 5):
        df = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        got = df.select(permuted("k", F.lit("x"), F.col("d")).alias("p"))
        assert got.distinct().count() == 10**n and got.filter(F.length("p") != n).count() == 0
    rows = spark.createDataFrame([("7992739871",), ("411111111111111",), ("0",)], "d string").select(F.concat("d", luhn(F.col("d")).cast("string")).alias("x")).collect()
    assert all(check_digit(r.x) for r in rows)


def test_keys_and_case(spark):
    df = spark.createDataFrame([(1, "A.b@x.org a.B@X.org c@x.org")], "doc_id long, text string")
    a = replace_private(df, "one").collect()[0].text.split()
    b = replace_private(df, "two").collect()[0].text.split()
    assert a[0] == a[1] != a[2] and a[0].split("@")[1] == a[2].split("@")[1] and a != b and collisions(made_up(df), "one/0") == 0


def test_odd_and_empty(odd_docs, no_docs):
    out = replace_private(odd_docs, "k")
    assert out.columns == [*odd_docs.columns, "entities"]
    assert sorted(map(str, (r.text for r in out.collect()))) == sorted(map(str, (r.text for r in odd_docs.collect())))
    assert replace_private(no_docs, "k").count() == 0
    clash = odd_docs.withColumn("entities", F.lit(1)).withColumn("value", F.lit("v"))
    assert set(replace_private(clash, "k").columns) == {*odd_docs.columns, "entities", "value"}
