import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tracequarry.llm import blocks, language_model
from tracequarry.llm.language_model import STRENGTH, Alone, discount, held_out, moved, score_documents, seat


def brute_base(docs):
    split = [(i, (t or "").encode().lower().split() + [b"\n end"]) for i, t in docs]
    c = Counter(w for i, ws in split if not held_out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((i is None, i or 0, held_out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in split)


def rows(out):
    return sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)


def test_base_counts(spark, odd_docs, no_docs):
    assert score_documents(no_docs).count() == 0
    out = score_documents(odd_docs).collect()
    assert rows(out) == brute_base([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert all(r.score < 0 for r in out)


def test_beats_the_base_on_held_out_text(spark):
    rng = random.Random(8)
    follow = {w: [f"w{rng.randrange(300)}" for _ in range(6)] for w in (f"w{i}" for i in range(300))}
    docs = []
    for i in range(600):
        w, ws = f"w{rng.randrange(300)}", []
        for _ in range(rng.randrange(1, 60)):
            ws.append(w.upper() if rng.random() < 0.1 else w)
            w = rng.choice(follow[w])
        docs.append((i, " ".join(ws) + (f" rare{i}" if i % 5 == 0 else "")))
    out = score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert rows(out) == brute_base(docs)
    away = [r for r in out if r.held_out]
    assert len(away) > 50
    assert sum(r.score for r in away) > 0.6 * sum(r.base_score for r in away)


def chains(rng, n):
    """Texts in which a few words follow each word."""
    follow = {w: [f"w{rng.randrange(60)}" for _ in range(4)] for w in (f"w{i}" for i in range(60))}
    docs = []
    for i in range(n):
        w, ws = f"w{rng.randrange(60)}", []
        for _ in range(rng.randrange(1, 40)):
            ws.append(w)
            w = rng.choice(follow[w])
        docs.append((i, " ".join(ws)))
    return docs


def test_same_scores_however_the_work_is_dealt(spark):
    df = spark.createDataFrame(chains(random.Random(3), 300), "doc_id long, text string")
    one = {r.doc_id: r for r in score_documents(df).collect()}
    for buckets, block in ((1, 1 << 30), (29, 4000)):
        for r in score_documents(df.repartition(3), block_bytes=block, buckets=buckets).collect():
            assert abs(r.score - one[r.doc_id].score) < 1e-6 and abs(r.base_score - one[r.doc_id].base_score) < 1e-6


def gibbs(docs, sweeps=40, burn_in=10):
    """The model with every table kept, every customer moved in every sweep, and all totals up to date."""
    rng = random.Random(1)
    split = {i: [b"^", *t.lower().encode().split(), b"$"] for i, t in docs}
    pairs = Counter((a if a != b"^" else b"$", b) for i, ws in split.items() if not held_out(i) for a, b in zip(ws, ws[1:], strict=False))
    d = discount(sum(n == 1 for n in pairs.values()), sum(n == 2 for n in pairs.values()))
    types = Counter(w for _, w in pairs)
    d0 = discount(sum(n == 1 for n in types.values()), sum(n == 2 for n in types.values()))
    vocabulary = len(types)
    child, root = defaultdict(lambda: defaultdict(list)), defaultdict(list)
    at = defaultdict(int)  # tables of a context

    def p_root(w):
        n, t = sum(map(sum, root.values())), sum(map(len, root.values()))
        return (sum(root[w]) - d0 * len(root[w]) + (STRENGTH + d0 * t) / (vocabulary + 1)) / (n + STRENGTH)

    def sit(tables, own, opens):
        k = rng.choices(range(len(tables) + 1), [max(x - own, 1e-12) for x in tables] + [opens])[0]
        if k == len(tables):
            tables.append(1)
            return True
        tables[k] += 1
        return False

    def leave(tables):
        k = rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    def enter(u, w):
        if sit(child[u][w], d, (STRENGTH + d * at[u]) * p_root(w)):
            at[u] += 1
            t = sum(map(len, root.values()))
            sit(root[w], d0, (STRENGTH + d0 * t) / (vocabulary + 1))

    customers = [p for p, n in pairs.items() for _ in range(n)]
    rng.shuffle(customers)
    for u, w in customers:
        enter(u, w)
    total, kept = Counter(), defaultdict(list)
    for u, w in customers:
        total[u] += 1
    for sweep in range(sweeps):
        for u, w in customers:
            if leave(child[u][w]):
                at[u] -= 1
                leave(root[w])
            enter(u, w)
        if sweep >= burn_in:
            seen = {w: p_root(w) for ws in split.values() for w in ws[1:]}
            for ws in split.values():
                for a, b in set(zip(ws, ws[1:], strict=False)):
                    u = a if a != b"^" else b"$"
                    kept[u, b].append((sum(child[u][b]) - d * len(child[u][b]) + (STRENGTH + d * at[u]) * seen[b]) / (total[u] + STRENGTH))
                    kept[u, b] = kept[u, b] if len(kept[u, b]) <= sweep - burn_in + 1 else kept[u, b][: sweep - burn_in + 1]
    mean = {k: sum(v) / len(v) for k, v in kept.items()}
    return {i: sum(math.log10(mean[a if a != b"^" else b"$", b]) for a, b in zip(ws, ws[1:], strict=False)) for i, ws in split.items()}


def test_agrees_with_a_full_sampler(spark):
    docs = chains(random.Random(5), 60)
    brute = gibbs(docs)
    out = score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    gaps = [abs(r.score - brute[r.doc_id]) / r.n_tokens for r in out]
    assert sum(gaps) / len(gaps) < 0.02 and max(gaps) < 0.15


def partitions(n):
    if n == 0:
        yield []
        return
    for p in partitions(n - 1):
        for i in range(len(p)):
            yield [*p[:i], p[i] + [n], *p[i + 1 :]]
        yield [*p, [n]]


def test_chance_to_sit_alone():
    d = 0.4
    weight = lambda p: math.prod(math.prod(i - d for i in range(1, len(b))) for b in p)
    for c in range(2, 8):
        for t in range(1, c + 1):
            own = [p for p in partitions(c) if len(p) == t]
            chance = sum(weight(p) for p in own if [1] in p) / sum(map(weight, own))
            assert abs(Alone(d)(np.array([c]), np.array([t]))[0] - chance) < 1e-9
    assert abs(Alone(d)(np.array([300]), np.array([9]))[0] - Alone(d)(np.array([256]), np.array([9]))[0]) < 0.01


def test_sweeps_keep_the_seating_law():
    """One dish in a restaurant: many sweeps come to the mean number of tables that enumeration gives."""
    d, c, a = 0.4, 6, 0.9
    weight = {t: sum(math.prod(math.prod(i - d for i in range(1, len(b))) for b in p) for p in partitions(c) if len(p) == t) for t in range(1, c + 1)}
    law = {t: w * math.prod((STRENGTH + d * i) * a for i in range(t)) for t, w in weight.items()}
    mean = sum(t * w for t, w in law.items()) / sum(law.values())
    n, key = 4000, np.arange(4000, dtype=np.uint64) * np.uint64(7919)
    counts, t = np.full(n, c), np.full(n, 1)
    for sweep in range(1, 13):
        t = moved(counts, t, t.astype(float), np.full(n, a), d, Alone(d), key, sweep)
    assert abs(t.mean() - mean) < 0.1


def test_all_customers_of_a_dish_move():
    """A sweep over a dish of a thousand customers is a thousand moves: the same mean as one by one."""
    n, c, d, a, alone = 2000, 1000, 0.6, 0.02, Alone(0.6)
    rng, t = np.random.default_rng(1), np.full(2000, 30)
    for _ in range(c):
        left = t - (rng.random(n) < alone(np.full(n, c), t))
        opens = (STRENGTH + d * (20 + left)) * a
        t = left + (rng.random(n) * (opens + c - 1 - d * left) < opens)
    got = moved(np.full(n, c), np.full(n, 30), np.full(n, 50.0), np.full(n, a), d, alone, np.arange(n, dtype=np.uint64), 1)
    assert abs(got.mean() - t.mean()) < 0.4 and abs(got.std() - t.std()) < 0.3
    # where tables are many, few or all of the customers, the large counts go on where the exact ones end
    for t in (2, 20, 100, 200, 256):
        r = (t - 1) / 255
        assert abs(np.interp(r, alone.ratios, alone.shares) - alone.table[256, t]) < 0.005


def test_first_seating():
    key = np.arange(4000, dtype=np.uint64)
    got = seat(np.full(4000, 12), np.full(4000, 0.7), 0.4, key).mean()
    rng = random.Random(1)

    def one():
        t = 1
        for i in range(1, 12):
            t += rng.random() < 0.7 / (0.7 + i - 0.4 * t)
        return t

    assert abs(got - np.mean([one() for _ in range(4000)])) < 0.1
    assert (seat(np.array([0, 1, 1]), np.ones(3), 0.4, key[:3]) == [0, 1, 1]).all()


def test_hot_words_are_dealt_by_context(spark):
    df = spark.createDataFrame([(i, f"the a{i} the b{i} the c{i}") for i in range(2000)], "doc_id long, text string")
    size, hot, buckets = language_model.hot_words(df)
    assert size == df.selectExpr("sum(octet_length(text)) n").first().n and language_model.xxhash.xxh64_intdigest(b"the") in hot
    contexts = np.arange(6000, dtype=np.uint64)
    to = language_model.bucket_of(np.full(6000, language_model.xxhash.xxh64_intdigest(b"the"), dtype=np.uint64), contexts, 64, np.array(hot, dtype=np.uint64))
    assert np.bincount(to, minlength=64).max() < 200
    clash = df.withColumn("block", F.lit(1)).withColumn("bucket", F.lit("x")).withColumn("words", F.lit(None).cast("string"))
    assert score_documents(clash).count() == 2000


def test_parts_of_a_block():
    """Pairs and contexts of a block by counting, each bucket's in one place and in order; without sorting all pairs anew."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 80))) for _ in range(30)]
    ids, buckets, hot = list(range(30)), 5, np.sort(blocks.word_hashes([b"w1", b"\n end"]))
    block = language_model.Block(ids, texts, buckets, hot)
    expected, end = Counter(), language_model.END_WORD
    for i, t in zip(ids, texts):
        words = [*t.encode().split(), end]
        for a, b in zip([end, *words], words):
            expected[b, a] += not held_out(i)
    h = lambda w: int(blocks.word_hashes([w])[0])
    by_hash = {(h(b), h(a) >> 24): n for (b, a), n in expected.items()}
    assert {(int(block.words[w]), int(c)): int(n) for w, c, n in zip(block.pair_word, block.pair_context, block.counts)} == by_hash
    assert block.contexts.tolist() == sorted({c for _, c in by_hash})
    for bucket in range(buckets):
        p, words, sizes = block.part(bucket)
        of = language_model.bucket_of(block.words[block.pair_word[p]], block.pair_context[p], buckets, hot)
        assert (of == bucket).all() and words.tolist() == sorted(set(block.pair_word[p].tolist())) and sizes.sum() == p.stop - p.start
        assert np.repeat(words, sizes).tolist() == block.pair_word[p].tolist()
    assert blocks.sorted_places(np.array([70000, 3, 70000, 3]), 70001).tolist() == blocks.sorted_places(np.array([7, 3, 7, 3]), 8).tolist() == [1, 3, 0, 2]
