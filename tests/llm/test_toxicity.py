import itertools
import random
import zlib

import numpy as np

from tracequarry.llm.toxicity import LevenshteinTrie, Lexicon, features, fit, toxicity


def edit(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    return d[len(a), len(b)]


def test_automaton_is_all_words_within_one_edit():
    rng = random.Random(7)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 7))) for _ in range(25)]
    trie = LevenshteinTrie(words)
    for n in range(0, 7):
        for _ in range(150):
            w = "".join(rng.choice("abcd") for _ in range(n))
            best = min(edit(w, x) for x in words)
            got = trie.match(w)
            assert (got is not None) == (best <= 1)
            if got:
                assert got[0] == best == edit(w, got[1])


def test_kinds_and_quotation():
    lexicon = Lexicon({"stupid": 3.0}, {"achlich": 1.0}, {"stupor"})
    assert lexicon.look("stupid") == (0, 3.0) and lexicon.look("stuppid") == (1, 3.0) and lexicon.look("stupor") is None
    assert lexicon.look("achlichkeit") == (2, 1.0) and lexicon.look("achlich") is None and lexicon.look("") is None
    plain, quoted = features("you are stupid really", lexicon, {}), features('they said "stupid" once', lexicon, {})
    assert plain[10] == 0 and quoted[10] > 0 and plain[1] == quoted[1] > 0
    assert features(None, lexicon, {}) == features("", lexicon, {}) and len(plain) == 12


def test_fit_separates():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(400), rng.normal(size=400)])
    y = (x[:, 1] + 0.02 * rng.normal(size=400) > 0).astype(float)
    w = fit(x, y)
    assert ((x @ w > 0) == (y > 0)).mean() > 0.95


def test_held_out_rows(spark):
    rng = random.Random(3)
    plain = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu") for b in ("ra", "se", "ti", "vo", "xu", "ya")]
    bad = ["trashy", "moronic", "idiotic", "pathetic"]
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        toxic = i % 6 == 0
        for _ in range(4 if toxic else 0):
            w = rng.choice(bad)
            words.insert(rng.randrange(len(words)), w[:3] + "x" + w[4:] if rng.random() < 0.2 else w)
        docs.append((i, " ".join(words)))
        if i % 10 != 9:
            labels.append((i, 0, int(toxic)))
    docs += [(None, "moronic trashy idiotic"), (5000, None), (5001, ""), docs[6], docs[6]]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as toxic", "'x' as score")
    out = toxicity(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(docs)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    away = [r for r in out if r.held_out and r.doc_id < 900]
    assert len(away) > 100 and sum(r.predicted == int(r.doc_id % 6 == 0) for r in away) > 0.97 * len(away)


def test_without_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity(odd_docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(7, 1, 1), (14, 0, 0), (None, 1, 1), (21, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity(odd_docs, some).count() == odd_docs.count() and toxicity(no_docs, some).count() == 0


def test_held_out_quality_on_the_tables(spark):
    """Rows that taught nothing: most toxic ones found, clean ones left alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.collect()}
    away = [(r.score, known[r.doc_id]) for r in toxicity(docs, labels).collect() if r.held_out and r.doc_id in known]
    bad, good = [s for s, t in away if t], [s for s, t in away if not t]
    auc = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    assert len(bad) > 50 and auc > 0.93
    assert sum(s >= 0.3 for s in bad) >= 0.85 * len(bad) and sum(s >= 0.3 for s in good) <= 0.02 * len(good)
