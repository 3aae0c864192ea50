import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tracequarry.llm import packing
from tracequarry.llm.packing import SumOfSquares, WordTokenizer, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole_ids(text):
    model = Tokenizer.from_file(PATH)
    model.encode_special_tokens = True
    return [*model.encode(text or "", add_special_tokens=False).ids, 2]


def check(docs, out, capacity):
    ids_of = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids_of[r.doc_id].append(whole_ids(r.text))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out.collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, lists in ids_of.items():
        assert sum(r.length for r in pieces[doc]) == sum(map(len, lists))
        for r in pieces[doc]:
            assert any(zlib.crc32(np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and len(ids) == r.doc_tokens for ids in lists)
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding == 0


def test_pieces_and_ids(odd_docs, no_docs):
    for capacity in (64, 4096):
        check(odd_docs, pack(odd_docs, PATH, capacity), capacity)
    assert pack(no_docs, PATH).count() == 0


def test_texts_of_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    check(docs, pack(docs, PATH), 4096)


def test_tricky_words(spark):
    texts = ["ÉCOLE Éa, ñÑ. ß ÿŸ ŀ ǅ ª º ĲSSEL", "It's 'S end, İstanbul. ΣΑΣ, ﬁne.", "word*** (x)\" a-b- é!! ½, ²; naïve... #tag# o'clock's, 'tis' a\'\'. _x_ <|startoftext|>,", "a.b,c 3.14, 10,000. <|endoftext|> x", "é, é. ́, ,, .. ,. 'll,", " x y\u0085z \x1ca"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs, pack(docs, PATH), 4096)


def test_level_choice_is_least_sum_of_squares():
    rng = np.random.default_rng(3)
    packer = SumOfSquares(20)
    for _ in range(500):
        size = int(rng.integers(1, 20))
        counts = packer.counts.copy()

        def cost(level, counts=counts, size=size):
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + size < 20:
                c[level + size] += 1
            return int((c * c).sum())

        options = [h for h in range(20 - size + 1) if h == 0 or counts[h]]
        assert cost(packer.place(size)) == min(map(cost, options))
        packer.add([None], size)


def test_few_windows_stay_open(spark):
    docs = spark.createDataFrame([(i, " ".join(["word"] * (i % 97 + 1))) for i in range(400)], "doc_id long, text string").coalesce(1)
    check(docs, pack(docs, PATH, 64, open_windows=3), 64)


def test_few_words_held(monkeypatch):
    """However many words a batch has, few texts are looked up at once, and the cache stays within its bound."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    monkeypatch.setattr(packing, "ENCODED", 3)
    model, most, some = WordTokenizer(PATH), [], WordTokenizer._encode_some
    monkeypatch.setattr(WordTokenizer, "_encode_some", lambda self, texts: most.append(len(texts)) or some(self, texts))
    texts = [f"Word{i}, thing{i * i}! again again{i % 3}." for i in range(10)] + [None, ""]
    ids = list(model.encode(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [whole_ids(t)[:-1] for t in texts]
    assert len(model.known) == 20 and max(most) == 3
