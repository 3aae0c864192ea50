import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracequarry.llm import odd_sketch as steps
from tracequarry.llm.odd_sketch import BANDS, BITS, ROWS, SAMPLES, bands, near_duplicates, odd_sketch, samples, shingle_set
from tracequarry.llm.queries import op12_odd_sketch

COLUMNS = "doc_id long, text string"


def set_of(text, shingle):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))) if words else frozenset()


def brute(rows, shingle=2):
    """Sorted (doc_id, size, component, kept), over all pairs of texts."""
    sets = [(i, set_of(t, shingle)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for k, (i, _) in enumerate(sets):
        groups.setdefault(root(k), []).append(i)
    least = {k: min((i for i in ids if i is not None), default=None) for k, ids in groups.items()}
    out = [(i, len(s), least[root(k)] if s else i) for k, (i, s) in enumerate(sets)]
    return sorted(((*r, r[0] == r[2]) for r in out), key=repr)


def found(spark, rows, shingle=2):
    return sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, COLUMNS), shingle).collect()), key=repr)


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def test_whole_table(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    out = op12_odd_sketch(spark, folder)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_with_shuffled_ids(spark, seed):
    """Every text is near to the one before it, and the first far from the last: no link may be lost."""
    rng = random.Random(seed)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 150, 300]))]
        for _ in range(rng.randrange(2, 9)):
            texts.append(" ".join(words))
            words = edited(rng, words, max(1, len(words) // rng.choice([18, 22, 30])))
    ids = rng.sample(range(10000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, 5) == brute(rows, 5)


def test_large_groups_with_others_just_below(spark):
    """Two groups of some hundreds, ring upon ring of texts just below, and links that only outer members have."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base)]
    texts += [" ".join(edited(rng, base, 5)) for _ in range(250)]
    outer = [edited(rng, base, 28) for _ in range(40)]
    texts += [" ".join(w) for w in outer]
    texts += [" ".join(edited(rng, w, 14)) for w in outer for _ in range(2)]
    texts += [" ".join(base[:k]) for k in range(200, 300, 4)]
    rows = list(zip(rng.sample(range(5000), len(texts)), texts, strict=True))
    assert found(spark, rows) == brute(rows)


def test_copies_and_short_texts(spark):
    rng = random.Random(4)
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base if i % 3 else base.upper()) for i in range(200)]
    rows += [(1000 + i, " ".join(f"s{rng.randrange(4)}" for _ in range(rng.randrange(7)))) for i in range(150)]
    assert found(spark, rows) == brute(rows)


def test_sketches_tell_similarity():
    rng = np.random.default_rng(5)
    for share in (0.7, 0.8, 0.9, 0.97):
        errors, met = [], 0
        for _ in range(60):
            n = int(rng.choice([6, 60, 600]))
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            k = round(2 * n * share / (1 + share))
            x, y = samples(pool[:n]), samples(np.concatenate([pool[:k], pool[n : 2 * n - k]]))
            true = k / (2 * n - k)
            differ = int(sum(int(a).bit_count() for a in odd_sketch(x) ^ odd_sketch(y)))
            errors.append(1 + BITS / (4 * SAMPLES) * np.log(1 - 2 * differ / BITS) - true)
            met += bool(set(bands(x[: BANDS * ROWS])) & set(bands(y[: BANDS * ROWS])))
        assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.08
        assert met == 60 or share < 0.8
    assert (odd_sketch(samples(shingle_set("A b c", 2))) == odd_sketch(samples(shingle_set("a  B\tc", 2)))).all()


def test_odd_rows_and_clashing_columns(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted(map(tuple, near_duplicates(odd_docs).collect()), key=repr)
    assert [(r[:3]) for r in got] == [(r[:3]) for r in brute(rows)]
    clashing = odd_docs.select("*", *[F.lit("x").alias(c) for c in ("id", "n", "key", "band", "c", "class", "hashes", "sketch", "kept")])
    assert sorted(map(tuple, near_duplicates(clashing).collect()), key=repr) == got
    assert near_duplicates(no_docs).count() == 0
    loose = near_duplicates(odd_docs.filter("doc_id is null")).collect()
    assert len(loose) == 2 and all(r.component_id is None and r.kept for r in loose)


def test_cells_of_any_size_lose_no_link(spark, monkeypatch):
    """Groups dealt to many cells give the same classes as brute force."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(edited(rng, base, rng.randrange(14))) for _ in range(150)]
    rows = list(zip(rng.sample(range(5000), len(texts)), texts, strict=True))
    monkeypatch.setattr(steps, "PART", 20_000)
    monkeypatch.setattr(steps, "CHUNK", 10_000)
    assert found(spark, rows) == brute(rows)


def test_cells_name_one_link_a_class():
    """A row just below 0.8 to 300 near copies gives nothing, one above gives one link, whatever the group's size."""
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    members = [np.sort(np.concatenate([pool[:196], pool[200 + 4 * k : 204 + 4 * k]])) for k in range(300)]
    below, above = np.sort(np.concatenate([pool[:173], pool[1500:1527]])), np.sort(np.concatenate([pool[:185], pool[1600:1615]]))
    sets = [*members, below, above]
    n, outer = len(sets), np.arange(302) >= 300
    sketches = np.stack([odd_sketch(samples(s)) for s in sets])
    links = steps.cell_links(np.arange(n), np.where(outer, np.arange(n), 0), outer, outer, ~outer, sets, sketches)
    assert len(links) == 1 and links[0][0] == 301
    apart = steps.cell_links(np.arange(n), np.arange(n), np.ones(n, bool), np.ones(n, bool), np.ones(n, bool), sets, sketches)
    assert len(apart) == 300 and 300 not in {i for pair in apart for i in pair}


def test_few_jobs(spark):
    """The driver keeps plans and code of every job: a table of chains and groups takes a bounded number of them."""
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for _ in range(8):
            texts.append(" ".join(words))
            words = edited(rng, words, 6)
    base = [f"v{i}" for i in range(300)]
    texts += [" ".join(edited(rng, base, rng.randrange(30))) for _ in range(100)]
    spark.sparkContext.setJobGroup("few", "few")
    try:
        near_duplicates(spark.createDataFrame(list(enumerate(texts)), COLUMNS)).count()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 300


def test_marks_keep_all_ids(spark):
    """The bitmap that tells whose sets are needed loses no id, full or not, and rows without an id always pass."""
    ids = [-5, 0, 2**62, *range(7, 3000, 7)]
    for most in (64, 1 << 26):
        marks = steps._marks(spark.createDataFrame([(i,) for i in ids], "id long"), most)
        assert len(marks) * 64 <= most and all(steps._marked(marks, i) for i in [*ids, None])
    assert sum(steps._marked(marks, i) for i in range(10_000, 20_000)) < 1000
    assert not any(steps._marked(steps._marks(spark.createDataFrame([], "id long")), i) for i in range(100))
