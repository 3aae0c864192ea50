import itertools
import random

import xxhash

from tracequarry.llm.graph import components
from tracequarry.llm.simhash import covering_masks, fingerprint, links, near_duplicates


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_masks_cover():
    for radius in (1, 2):
        masks = covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for d in itertools.combinations(range(64), radius):
            bits = sum(1 << i for i in d)
            assert any(m & bits == 0 for m in masks)


def test_fingerprint():
    for text in (None, "", " ", "a", "A b", "a b c", "a b c d A B C", "x\x0by\x1cz é", "one two three " * 50):
        assert fingerprint(text) == brute_fingerprint(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_keep_every_class(spark):
    rng = random.Random(2)
    fps = {0}
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randrange(6)):
            for _ in range(rng.choice((1, 2, 2, 3))):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    centre = rng.getrandbits(64)
    fps |= {centre ^ 1 << i for i in range(64)}
    nodes = list(enumerate(sorted(fps)))
    for radius in (1, 2):
        df = spark.createDataFrame([(signed(f), i) for i, f in nodes], "fp long, id long")
        got = links(df, radius).collect()
        near = {(a, b) for (a, x), (b, y) in itertools.combinations(nodes, 2) if (x ^ y).bit_count() <= radius}
        assert all((min(r.a, r.b), max(r.a, r.b)) in near for r in got)
        ids = [i for i, _ in nodes]
        assert union(ids, near) == union(ids, [(r.a, r.b) for r in got])


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(501, 540)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = sorted({x for e in edges for x in e})
    expected = union(ids, edges)
    assert all(got.get(i, i) == expected[i] for i in ids)


def test_query_on_odd_rows(odd_docs, no_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    docs = odd_docs.collect()
    f = [(d.doc_id, brute_fingerprint(d.text)) for d in docs]
    assert sorted((str(r.doc_id), r.fingerprint) for r in rows) == sorted((str(i), f"{x:016x}") for i, x in f)
    values = {x for _, x in f}
    pairs = [(x, y) for x, y in itertools.combinations(sorted(values), 2) if (x ^ y).bit_count() <= 2]
    cls = union(values, pairs)
    least = {}
    for i, x in f:
        if i is not None:
            least[cls[x]] = min(least.get(cls[x], i), i)
    for r in rows:
        assert r.component_id == least.get(cls[int(r.fingerprint, 16)])
    assert near_duplicates(no_docs).count() == 0
