import hashlib
import random
import re

from pyspark.sql import functions as F

from tracequarry.llm.decontamination import scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window=10):
    low = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc, text in docs:
        ws, hit, found = low(text), set(), set()
        for item, other in items:
            its = low(other)
            if item is None or not its:
                continue
            n = min(window, len(its))
            for a in range(len(its) - n + 1):
                for b in range(len(ws) - n + 1):
                    if ws[b : b + n] == its[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(ws), len(hit), len(found), digest, len(hit) > 0))
    return out


def cases():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["ÉCOLE", "naïve", "x1"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.choice((3, 4, 9, 10, 11, 25)))) for i in range(30)] + [(99, None), (98, "..."), (None, "w1 w2"), (11, make(12))]
    docs = [(i, make(rng.randrange(0, 60))) for i in range(40)]
    docs += [(100 + n, make(15) + ", " + (t or "").upper().replace(" ", " -- ") + "; " + make(5)) for n, (_, t) in enumerate(items)]
    docs += [(300, None), (301, ""), (302, "?!"), (None, items[0][1]), (5, docs[5][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    expected = sorted(brute(docs, items), key=key)
    for block in (1 << 20, 700):
        out = scan(d, i, block_bytes=block)
        got = sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=key)
        assert got == expected
        for r, text in [(r, dict(docs)[r.doc_id]) for r in out.filter("contaminated").collect()]:
            for words, chars in zip(r.ranges, r.spans, strict=True):
                low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
                assert WORD.findall(low[chars.start : chars.end]) == WORD.findall(low)[words.start : words.end]


def test_odd_and_empty(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert scan(odd_docs, none).filter("contaminated").count() == 0
    assert scan(odd_docs, none).count() == odd_docs.count()
    assert scan(no_docs, none).count() == 0
