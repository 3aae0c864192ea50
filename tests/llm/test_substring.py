import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tracequarry.llm import blocks, substring
from tracequarry.llm.substring import remove_repeats


def brute(docs, window=20):
    first, rows = {}, []
    for doc, text in docs:
        words = (text or "").encode().split()
        rows.append((doc, words))
        for s in range(len(words) - window + 1):
            k = tuple(words[s : s + window])
            first[k] = min(first.get(k, (doc, s)), (doc, s))
    out = []
    for doc, words in rows:
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (doc, s):
                gone.update(range(s, s + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def cases():
    rng = random.Random(9)
    make = lambda n, v=4000: [f"w{rng.randrange(v)}" for _ in range(n)]
    shared = [make(n) for n in (19, 20, 21, 45, 70)]
    docs = []
    for i in range(150):
        words = make(rng.randrange(0, 40))
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(0, 8)
            words += s[a:] + make(rng.randrange(0, 30))
        if i % 17 == 0:
            words += words + make(3, 2) * 20
        docs.append((rng.randrange(-50, 400) * 1000 + i, " ".join(words)))
    docs += [(i + 1_000_000, docs[i][1]) for i in range(0, 60, 3)]
    docs += [(5_000_000, None), (5_000_001, ""), (5_000_002, " \n"), (docs[3][0], docs[3][1]), (docs[4][0], docs[9][1]), (5_000_003, "a " * 500)]
    return docs


def test_against_brute_force(spark):
    docs = cases()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = remove_repeats(df, with_text=True).collect()
    assert sorted(tuple(r[:4]) for r in out) == brute(docs)
    texts = {}
    for doc, text in docs:
        texts.setdefault(doc, []).append((text or "").split())
    for r in out:
        for f in r.factors:
            assert (f.source_doc, f.source_start) < (r.doc_id, f.start)
            own = [ws[f.start : f.start + f.length] for ws in texts[r.doc_id] if len(ws) == r.n_words]
            assert any(ws[f.source_start : f.source_start + f.length] in own for ws in texts[f.source_doc])
        covered = {i for f in r.factors for i in range(f.start, f.start + f.length)}
        assert len(covered) == r.n_removed and all(f.length >= 20 for f in r.factors)
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_odd_and_empty(odd_docs, no_docs):
    assert remove_repeats(odd_docs).count() == odd_docs.count()
    known = [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None]
    assert sorted(tuple(r[:4]) for r in remove_repeats(odd_docs.filter("doc_id is not null")).collect()) == brute(known)
    assert remove_repeats(no_docs).count() == 0


def test_a_factor_ends_where_its_source_does(spark):
    words = [f"w{i}" for i in range(200)]
    docs = [(1, " ".join(words[:60])), (2, " ".join(words[40:120])), (3, " ".join(words[10:110])), (4, " ".join(words[10:55] + ["x"] + words[56:100]))]
    for block in (1 << 20, 100):
        out = {r.doc_id: r.factors for r in remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), block_bytes=block).collect()}
        assert [tuple(f) for f in out[2]] == [(0, 20, 1, 40)]
        assert [tuple(f) for f in out[3]] == [(0, 50, 1, 10), (31, 69, 2, 1)]
        assert [tuple(f) for f in out[4]] == [(0, 45, 1, 10), (46, 44, 2, 16)]
        assert out[1] == []


@pytest.mark.parametrize("least", [1, 3, 64])
def test_sources_at_several_places_of_one_block(spark, monkeypatch, least):
    """A run of windows may stand in one document first, then in another, or elsewhere in the same one."""
    monkeypatch.setattr(blocks, "LEAST", least)
    w = [f"w{i}" for i in range(90)]
    docs = [(5, " ".join(w[:30])), (38, " ".join(w[8:50])), (229, " ".join(w[:60]))]
    docs += [(300, " ".join(w[60:85] + ["x"] + w[40:70])), (301, " ".join(w[40:90])), (302, " ".join(w[50:80] + w[:30] + w[20:60]))]
    rng = random.Random(11)
    pool = [f"p{rng.randrange(900)}" for _ in range(400)]
    for i in range(120):
        words = []
        for _ in range(rng.randrange(1, 5)):
            a = rng.randrange(350)
            words += pool[a : a + rng.randrange(10, 60)]
        docs.append((rng.randrange(10**6) + 1000, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = remove_repeats(df, with_text=True).collect()
    assert sorted(tuple(r[:4]) for r in got) == brute(docs)
    assert {r.doc_id: r.n_removed for r in got}[229] == 50


def test_bytes_of_a_window_in_the_index(spark):
    """A window goes to the index in 7 bytes of hash, and comes back as if in 8."""
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 1 << 40, 300))) for _ in range(4)]
    docs = pa.table({"doc_id": [3, 1, 2, 4], "text": [*texts[:3], texts[0]], "block": pa.array([0] * 4, pa.int32())})
    sent = substring._send(20, 1, 1)(docs)
    assert sum(len(x) for x in sent.column("hashes").to_pylist()) == 7 * 3 * 281
    parsed = substring.Parsed([3, 1, 2, 4], [*texts[:3], texts[0]], 0, 1, 20)
    own = substring._long(b"".join(sent.column("hashes").to_pylist()))
    assert (own == parsed.hashes[parsed.kept] & np.uint64((1 << 56) - 1)).all()
    other = substring._send(20, 2, 1)(pa.table({"doc_id": [9], "text": [texts[1]], "block": pa.array([1], pa.int32())}))
    found = substring._lookup(pa.concat_tables([other, sent])).to_pylist()
    assert [r["block"] for r in found] == [1] and np.unpackbits(np.frombuffer(found[0]["earlier"], np.uint8), count=281).all()
    assert (substring._walked(found[0]["starts"]) == np.arange(281)).all() and set(substring._unpacked(found[0]["docs"], "<i8").tolist()) == {1}
