"""Toxicity: a learnt lexicon, Levenshtein automata over its trie for misspellings, and context windows."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import arrow_schema, bounded_batches, materialize

#: At most so many labelled rows, the least by a hash of doc_id, teach the lexicon and the weights.
SAMPLE_ROWS = 20_000
#: Different words, entries or moves of the automaton that a worker holds at a time.
HELD = 100_000
STEM_SIZES = range(4, 9)
FUZZY_LEAST = 5
WINDOW = 6
THRESHOLD = 0.3

_STRIP = ".,;:!?\"'()[]{}<>|*&$%#«»“”„‘’…-–—"
_QUOTES = "\"'«»“”„‘’"
#: Words that introduce what someone else said, in four languages.
_CUES = frozenset("said says wrote quote quoted called calls reported sagte schrieb zitat nannte dit écrit cité appelé dijo escribió cita llamó".split())


def fold(word: str) -> str:
    return word.strip(_STRIP).lower()


class LevenshteinTrie:
    """Words within one edit of a lexicon word: the Levenshtein automaton of radius 1 run along the lexicon's trie.

    A state is a set of (trie node, edits so far). States get numbers as words lead to them, so every different word costs
    one lookup a letter, and most end in the dead state after a few letters.
    """

    def __init__(self, words: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        for word in words:
            node = 0
            for ch in word:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                node = self.children[node][ch]
            self.ends[node] = word
        self.sets: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[int, str] | None] = []
        self.learnt = 0
        self.start = self._state({(0, 0)})

    def _state(self, nodes: set) -> int:
        full = set(nodes)
        for node, edits in nodes:
            if edits == 0:  # a letter of the lexicon word is missing
                full.update((child, 1) for child in self.children[node].values())
        key = frozenset(full)
        if not key:
            return -1
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            hits = sorted((edits, self.ends[node]) for node, edits in key if node in self.ends)
            self.found.append(hits[0] if hits else None)
        return self.number[key]

    def _move(self, state: int, ch: str) -> int:
        after = set()
        for node, edits in self.sets[state]:
            if ch in self.children[node]:
                after.add((self.children[node][ch], edits))
            if edits == 0:  # another letter, or one too many
                after.update((child, 1) for child in self.children[node].values())
                after.add((node, 1))
        to = self.moves[state][ch] = self._state(after)
        self.learnt += 1
        return to

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, lexicon word) of the nearest lexicon word within one edit. Moves are learnt anew once there are many."""
        if self.learnt > HELD:
            self.learnt = 0
            for known in self.moves:
                known.clear()
        state, moves = self.start, self.moves
        for ch in word:
            to = moves[state].get(ch)
            state = self._move(state, ch) if to is None else to
            if state < 0:
                return None
        return self.found[state]


class Lexicon:
    """Words and stems with weights; exceptions are ordinary words that only look like a misspelling."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], exceptions: set[str]) -> None:
        self.words, self.stems, self.exceptions = words, stems, exceptions
        self.trie = LevenshteinTrie([w for w in words if len(w) >= FUZZY_LEAST])
        self.stem_sizes = sorted({len(s) for s in stems}, reverse=True)

    def look(self, word: str) -> tuple[int, float] | None:
        """(0 word, 1 misspelling or 2 stem; weight) or None."""
        if word in self.words:
            return 0, self.words[word]
        if len(word) >= FUZZY_LEAST - 1 and word not in self.exceptions:
            near = self.trie.match(word)
            if near:
                return 1, self.words[near[1]]
        for n in self.stem_sizes:
            if len(word) > n and word[:n] in self.stems:
                return 2, self.stems[word[:n]]
        return None


N_FEATURES = 12


def features(text: str | None, lexicon: Lexicon, memo: dict) -> list[float]:
    """Counts and weights of hits by kind, how dense they are, and how many stand in quotation."""
    raw = (text or "").split()
    hits = []
    for i, w in enumerate(raw):
        if w in memo:
            hit = memo[w]
        else:
            hit = memo[w] = lexicon.look(fold(w))
        if hit:
            hits.append((i, w, hit))
    count, weight, top, quoted, seen = [0, 0, 0], [0.0, 0.0, 0.0], 0.0, 0.0, set()
    for i, w, (kind, value) in hits:
        around = raw[max(0, i - WINDOW) : i + WINDOW + 1]
        marks = (w[0] in _QUOTES) + (w.rstrip(".,;:!?")[-1:] in _QUOTES) + sum(x[0] in _QUOTES for x in raw[max(0, i - WINDOW) : i])
        cue = any(fold(x) in _CUES for x in around)
        quoted += marks >= 2 or (marks == 1 and cue)
        count[kind] += 1
        top = max(top, value if kind != 1 else value / 2)
        folded = fold(w)
        if folded not in seen:
            seen.add(folded)
            weight[kind] += value
    n = len(raw)
    dense = 100.0 / (n + 20)
    return [
        1.0,
        *[math.log1p(x) for x in count],
        *[math.log1p(x) for x in weight],
        min(8.0, count[0] * dense) + min(4.0, count[1] * dense),
        min(8.0, (weight[2] + weight[0]) * dense),
        top,
        quoted / (len(hits) + 1.0),
        math.log1p(n) / 8.0,
    ]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton's method with a ridge on all but the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _entries(text: str | None) -> set[str]:
    """Words, and stems marked by a trailing '~', that a text holds."""
    words = {fold(w) for w in (text or "").split()}
    words.discard("")
    return words | {f"{w[:n]}~" for w in words for n in STEM_SIZES if len(w) > n}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, fold, toxic, documents) of a partition."""
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(seen)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], names=["entry", "half", "toxic", "n"])
        seen.clear()
        return out

    for batch in batches:
        for half, toxic, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            seen.update((e, half.as_py(), toxic.as_py()) for e in _entries(text.as_py()))
            if len(seen) > HELD:
                yield flush()
    yield flush()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, toxic and four least hashes of word triples, by which copies are told."""
    for batch in batches:
        rows = []
        for text in batch.column(2):
            words = (text.as_py() or "").lower().split()
            h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], dtype=np.uint64)
            with np.errstate(over="ignore"):
                rows.append([int(((h * np.uint64(m)) >> np.uint64(1)).min()) for m in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "toxic", "h"])


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray) -> None:
        self.lexicon, self.weights = lexicon, weights


def _lexicon(counts: DataFrame, halves: list[int], sizes: dict) -> Lexicon:
    """Entries over-represented in toxic rows: at least 3 of them, 4 standard errors and 4 times the share of others.

    All such entries, and all ordinary words near one: both are words of the sample's rows, which bound them.
    """
    nt, nc = sum(sizes.get((h, 1), 0) for h in halves), sum(sizes.get((h, 0), 0) for h in halves)
    if not nt or not nc:
        return Lexicon({}, {}, set())
    rows = counts.filter(F.col("half").isin(halves)).groupBy("entry").agg(F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("c"))
    rows = rows.withColumn("p", (F.col("t") + F.col("c")) / (nt + nc))
    z = (F.col("t") - nt * F.col("p")) / F.sqrt(nt * F.col("p") * (1 - F.col("p")) + 0.05)
    odds = F.log((F.col("t") + 0.5) / (nt + 1)) - F.log((F.col("c") + 0.5) / (nc + 1))
    strong = rows.withColumn("z", z).withColumn("w", odds).filter(f"t >= 3 and z >= 4 and w >= {math.log(4)}")
    top = strong.orderBy(F.desc("z"), "entry").collect()  # as many as the sample's words bear out
    words = {r["entry"]: r["w"] for r in top if not r["entry"].endswith("~")}
    stems = {r["entry"][:-1]: r["w"] for r in top if r["entry"].endswith("~")}
    # a stem has to say more than the words that were found with it
    trie_words = [w for w in words if len(w) >= FUZZY_LEAST]

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = LevenshteinTrie(trie_words)
        for batch in batches:
            keep = pa.array([trie.match(e) is not None for e in batch.column(0).to_pylist()], pa.bool_())
            yield batch.filter(keep)

    plain = rows.filter("c > 0 and t <= c and not endswith(entry, '~')").select("entry", "c")
    found = plain.mapInArrow(ordinary, "entry string, c long").collect()
    return Lexicon(words, stems, {r["entry"] for r in found} - words.keys())


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns lexicon and weights from at most sample_rows labelled rows for which `usable` holds.

    Of rows that share one of four min-hashes only the first teaches, so groups of copies don't make their words look
    telling. The weights are fitted on rows scored with the lexicon of the other half.
    """
    bounded_batches(docs.sparkSession)
    known = labels.filter("doc_id is not null and toxic is not null").filter(usable).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text"), "toxicity-sample")
    taken, seen, half_of = set(), [set(), set(), set(), set()], []
    for r in sorted(rows.mapInArrow(_sketch, "doc_id long, toxic int, h array<long>").collect(), key=lambda r: (r["doc_id"], r["h"])):
        if r["doc_id"] in taken or any(x in s for x, s in zip(r["h"], seen, strict=True)):
            continue
        taken.add(r["doc_id"])
        for x, s in zip(r["h"], seen, strict=True):
            s.add(x)
        half_of.append((r["doc_id"], xxhash.xxh64_intdigest(str(r["doc_id"])) & 1, r["toxic"]))
    sizes = Counter((h, t) for _, h, t in half_of)
    spark = docs.sparkSession
    halves = spark.createDataFrame([(d, h) for d, h, _ in half_of], "doc_id long, half int")
    rows = rows.dropDuplicates(["doc_id"]).join(F.broadcast(halves), "doc_id").select("half", "toxic", "text")
    rows = materialize(rows, "toxicity-rows")
    counts = materialize(rows.mapInArrow(_counts, "entry string, half int, toxic int, n long").groupBy("entry", "half", "toxic").agg(F.sum("n").alias("n")), "toxicity-counts")
    by_half = [_lexicon(counts, [1 - h], sizes) for h in (0, 1)]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos: list[dict] = [{}, {}]
        for batch in batches:
            half, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            x = []
            for h, text in zip(half, batch.column(2), strict=True):
                x.append(features(text.as_py(), by_half[h], memos[h]))
                if len(memos[h]) > HELD:
                    memos[h].clear()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(toxic, pa.int32())], names=["x", "toxic"])

    got = rows.mapInArrow(measured, "x array<double>, toxic int").collect()
    if len({r["toxic"] for r in got}) < 2:
        return Model(Lexicon({}, {}, set()), np.zeros(N_FEATURES))
    order = sorted((r["x"], r["toxic"]) for r in got)
    weights = fit(np.array([x for x, _ in order]), np.array([y for _, y in order], dtype=float))
    return Model(_lexicon(counts, [0, 1], sizes), weights)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns with toxicity (0 to 1). Null and empty texts get the score of a text without hits."""
    keep = keep or ["doc_id"]
    bounded_batches(docs.sparkSession)
    df = docs.select(*keep, *([] if "text" in keep else ["text"]))  # texts go through once
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[: len(keep)]) + ", toxicity double"
    target, n, at_text = arrow_schema(ddl), len(keep), df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = []
                for text in part.column(at_text):
                    x.append(features(text.as_py(), model.lexicon, memo))
                    if len(memo) > HELD:
                        memo.clear()
                p = 1 / (1 + np.exp(-np.clip(np.array(x).reshape(-1, N_FEATURES) @ model.weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(p)], schema=target)

    return df.mapInArrow(run, ddl)


def usable_fold() -> Column:
    """Rows whose labels may be learnt from: crc32 of the id as text, modulo 4, is not 2."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Lexicon entries (words, and stems that many toxic words share) are learnt from labels; words within one edit of a
    lexicon word that aren't ordinary words themselves count as misspelt; every hit's window of words tells whether it
    stands in quotation. A logistic regression over these counts gives the score, so quotation counts as much as the
    labels say. Without labels of both kinds every score is 0.5. Rows without an id aren't held out. Repeated rows stay,
    empty table: no rows.
    """
    out = score(docs, train(docs, labels, usable_fold()))
    return out.select("doc_id", F.coalesce(~usable_fold(), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))
