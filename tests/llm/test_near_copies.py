import itertools
import random

import corpus_pipeline
from test_simhash import union

from tracequarry.llm.near_copies import keep_one

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_kept(docs):
    """Least id of every class of texts linked at a Jaccard similarity of 0.8 of their five-word shingles, and the pairs."""
    sets = {}
    for i, text in docs:
        words = text.encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    near = []
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
            near.append((a, b))
    return set(union(sets, near).values()), near


def kept(spark, docs):
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    return {r.doc_id for r in keep_one(spark.createDataFrame(rows, COLUMNS)).collect()}


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_copies_beyond_the_fingerprint(spark):
    rng = random.Random(5)
    docs = []
    for i in range(0, 400, 4):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        docs += [(i, " ".join(words)), (i + 1, edited(rng, words, 4)), (i + 2, edited(rng, words, 12)), (i + 3, " ".join(words[:150]))]
    expected, near = brute_kept(docs)
    assert len(near) >= 95
    assert kept(spark, docs) == expected


def test_a_large_class_and_texts_just_below(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    copies = [(i, edited(rng, base, 3)) for i in range(10, 210)]
    below = [(i, edited(rng, base, 20)) for i in range(300, 340)]
    docs = [(5, " ".join(base)), *copies, *below]
    expected, _ = brute_kept(docs)
    assert kept(spark, docs) == expected and len(expected) > 30


def test_recall_on_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").collect()]
    expected, near = brute_kept(docs)
    got = kept(spark, docs)
    assert len(near) > 50 and not [p for p in near if p[0] in got and p[1] in got]
    assert got == expected


def test_stage_and_odd_rows(spark, odd_docs, no_docs):
    rows = corpus_pipeline.drop_near_duplicates(spark, odd_docs, "").collect()
    assert [r.text for r in rows if not (r.text or "").split()] == [None]
    assert all(r.doc_id is not None for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    assert keep_one(no_docs).count() == 0
    loose = odd_docs.filter("doc_id is null")
    assert len(keep_one(loose).collect()) == 2
