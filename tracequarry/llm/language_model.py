"""A hierarchical Pitman-Yor language model, seated by Gibbs sampling, and its scores for every document.

Every previous word is a restaurant of its own, whose dishes are the words that follow; their common parent is the
restaurant of all words. A pair is a dish in a restaurant. Pairs are dealt to buckets by their word, those of hot words by
word and context. All that buckets have to learn from each other goes by notes to owners (of contexts, and of hot words),
who send totals back, once a sweep. Random numbers hang on the pair and the sweep alone, and totals are sums over all
buckets, so scores don't depend on how the work is dealt.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.blocks import dealt, parts, sorted_places, with_block, word_hashes
from tracequarry.llm.common import arrow_schema, bounded_batches

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
STRENGTH = 1.0
#: Sweeps after the first seating, of which the last SAMPLES are averaged.
SWEEPS, SAMPLES = 2, 2
#: Words with this share of all tokens or of a bucket's are hot: their pairs are dealt by context too.
HOT_SHARE = 1e-5
#: Different words that a worker counts at a time.
HELD = 1_000_000
END_WORD = b"\n end"
END = np.uint64(xxhash.xxh64_intdigest(END_WORD))
#: Contexts are told apart by this many bits of the previous word's hash.
CONTEXT_BITS = 40
_MASK = np.uint64((1 << CONTEXT_BITS) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)

SENT = "bucket int, block int, words binary, sizes binary, contexts binary, counts binary"
NOTE = "owner int, bucket int, ids binary, customers binary, tables binary, wanted int, hot binary, sums array<double>"
TOTAL = "bucket int, round int, owner int, ids binary, customers binary, tables binary, hot binary, sums array<double>, extra array<double>"
ANSWER = "block int, bucket int, counts binary, parents binary, pairs binary, customers binary, tables binary, sums array<double>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: What a bucket's sums are: customers, words, tables, root tables, dishes ordered once and twice, and words so in the root.
N, V, T, T0, ONCE, TWICE, ROOT_ONCE, ROOT_TWICE = range(8)


def held_out(doc_id: int | None) -> bool:
    """Rows without an id count as training rows."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def _packed(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpacked(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype=kind)


def _short(ids: np.ndarray) -> bytes:
    """Context ids in five bytes each."""
    return np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : CONTEXT_BITS // 8]).tobytes()


def _long(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) * 8 // CONTEXT_BITS, 8), dtype=np.uint8)
    out[:, : CONTEXT_BITS // 8] = np.frombuffer(b, dtype=np.uint8).reshape(-1, CONTEXT_BITS // 8)
    return out.view("<u8").ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, *at: int) -> np.ndarray:
    """Random numbers that the keys and the place in the sampler give."""
    with np.errstate(over="ignore"):
        for i in at:
            key = _mix(key + np.uint64(i + 1) * _ODD)
    return (key >> np.uint64(11)).astype(np.float64) / (1 << 53)


def discount(once: float, twice: float) -> float:
    """From how many dishes were ordered once and twice."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def seat(customers: np.ndarray, openness: np.ndarray, d: float, key: np.ndarray) -> np.ndarray:
    """First tables of each dish: the mean number when its customers come one after another, rounded at random.

    openness is (strength + discount * tables of the restaurant) * the parent's probability of the dish. From the 16th on
    customers come in groups of a 16th of those seated.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    active = np.flatnonzero(customers > 1)
    seated = np.ones(len(active))
    while len(active):
        n, a, t = customers[active], openness[active], tables[active]
        group = np.minimum(np.maximum(1, seated // 16), n - seated)
        tables[active] = t + group * a / (a + np.maximum(seated - d * t, 1e-9))
        seated = seated + group
        left = seated < n
        active, seated = active[left], seated[left]
    low = np.floor(tables)
    return np.clip(low + (uniform(key, 0) < tables - low), np.minimum(customers, 1), customers)


class Alone:
    """Chance that one of c customers of a dish at t tables sits alone: S(c-1, t-1) / S(c, t), where S are the generalised
    Stirling numbers of the discount, which count the ways to seat c customers at t tables with their weights. Beyond SIZE
    customers their saddle point: with r = (t-1) / (c-1) and g(x) = (1 - (1-x)^d) / d, the x where g(x) / (x g'(x)) = r gives
    r x / g(x). It is d r for few tables and 1 for as many as customers."""

    SIZE = 256

    def __init__(self, d: float) -> None:
        self.d, n = d, self.SIZE + 1
        with np.errstate(divide="ignore"):
            log = np.full((n, n), -np.inf)
            log[0, 0] = 0.0
            t = np.arange(n)
            for c in range(1, n):
                log[c, 1:] = np.logaddexp(log[c - 1, :-1], np.log(np.maximum(c - 1 - d * t[1:], 1e-300)) + log[c - 1, 1:])
            below = np.full((n, n), -np.inf)
            below[1:, 1:] = log[:-1, :-1]
            self.table = np.where(np.isfinite(log), np.exp(below - np.where(np.isfinite(log), log, 0.0)), 0.0)
        y = np.concatenate([np.logspace(-300, -3, 4000), np.linspace(1e-3, 1 - 1e-4, 2000)[1:]])  # 1 - x
        g = -np.expm1(d * np.log(y)) / d
        r = g / (1 - y) * y ** (1 - d)
        self.ratios, self.shares = np.concatenate([[0.0], r, [1.0]]), np.concatenate([[0.0], r * (1 - y) / g, [1.0]])

    def __call__(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        inside = c <= self.SIZE
        small = self.table[np.where(inside, c, 0), np.where(inside, t, 0)]
        if inside.all():
            return small
        return np.where(inside, small, np.interp((t - 1) / np.maximum(c - 1, 1), self.ratios, self.shares))


def moved(c: np.ndarray, t: np.ndarray, restaurant: np.ndarray, parent: np.ndarray, d: float, alone: Alone, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables after a sweep: as many times as a dish has customers, one of them leaves, and is seated given all that stay.

    It leaves an empty table with the chance that it sat alone, which the numbers of customers and tables give. It then
    opens a table in proportion to (strength + discount * tables of the restaurant) * the parent's probability, or joins
    one in proportion to customers less discounts. The restaurant's other dishes are those after the sweep before. Moves
    that leave the number of tables as it was are passed over together: how many there are before the next that doesn't is
    geometric, and what is drawn is that number and then up or down.
    """
    t, own = t.astype(np.int64), t.astype(np.int64)
    active = np.flatnonzero(c > 1)
    left, step = c[active].astype(np.float64), 0
    while len(active):
        n, now, k = c[active], t[active], key[active]

        def opening(tables: np.ndarray, n: np.ndarray = n, active: np.ndarray = active) -> np.ndarray:
            opens = (STRENGTH + d * np.maximum(restaurant[active] - own[active] + tables, 0)) * parent[active]
            return opens / (opens + np.where(tables > 0, n - 1 - d * tables, 0.0))

        gone = alone(n, now)
        with np.errstate(divide="ignore", invalid="ignore"):
            down = np.where(gone > 0, gone * (1 - opening(now - 1)), 0.0)
            up = np.where(now < n, (1 - gone) * opening(now), 0.0)
            change = np.minimum(down + up, 1.0)
            wait = np.where(change > 0, np.floor(np.log1p(-uniform(k, sweep, step, 0)) / np.log1p(-change)) + 1, np.inf)
        left = left - wait
        rising = uniform(k, sweep, step, 1) * (down + up) < up
        on = left >= 0
        t[active[on]] = now[on] + np.where(rising[on], 1, -1)
        active, left, step = active[left > 0], left[left > 0], step + 1
    return np.clip(t, np.minimum(c, 1), c)


def hot_words(docs: DataFrame) -> tuple[int, list[int], int]:
    """Bytes of all texts, the hashes of words that have a share of HOT_SHARE of all tokens or of a bucket's, and buckets.

    A partition reports words with half that share of its own tokens, so there are at most a few times 1 / HOT_SHARE.
    """
    h = xxhash.xxh64_intdigest
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        size = tokens = 0

        def flush() -> pa.RecordBatch:
            often = {h(w): n for w, n in seen.items() if n >= max(2, tokens * HOT_SHARE / 2)}
            return pa.RecordBatch.from_arrays([pa.array(np.array(list(often), dtype=np.uint64).view(np.int64)), pa.array(list(often.values()), pa.int64()), pa.array([size] + [0] * (len(often) - 1) if often else [], pa.int64()), pa.array([tokens] + [0] * (len(often) - 1) if often else [], pa.int64())], names=["word", "n", "size", "tokens"])

        for batch in batches:
            for text in batch.column(0):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                words = raw.lower().split()
                seen.update(words)
                size, tokens = size + len(raw), tokens + len(words) + 1
            seen[b"\n end"] += batch.num_rows
            if len(seen) > HELD:
                yield flush()
                seen.clear()
                size = tokens = 0
        seen[b"\n end"] += 2  # the sizes go with some row
        yield flush()

    by = docs.select("text").mapInArrow(count, "word long, n long, size long, tokens long")
    whole = by.groupBy("word").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.sum("tokens").alias("tokens")).checkpoint()
    sums = whole.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens")).first()
    buckets = parts(sums["size"] or 0, BUCKET_BYTES)
    least = (sums["tokens"] or 0) * max(HOT_SHARE, 1 / (4 * buckets))
    return sums["size"] or 0, sorted(r["word"] & (2**64 - 1) for r in whole.filter(F.col("n") >= least).select("word").collect()), buckets


class Block:
    """A block's tokens as hashes, its different words, pairs and contexts, and what of them goes to which bucket."""

    def __init__(self, ids: list, texts: list, buckets: int, hot: np.ndarray) -> None:
        self.rows = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
        tokens, sizes = [], []
        for r in self.rows:
            words = (texts[r] or "").encode("utf-8", "replace").lower().split()
            tokens += words
            tokens.append(END_WORD)
            sizes.append(len(words) + 1)
        self.sizes = np.array(sizes, dtype=np.int64)
        hashes = word_hashes(tokens)
        train = np.repeat(np.array([not held_out(ids[r]) for r in self.rows], dtype=bool), self.sizes)
        self.words, self.word = np.unique(hashes, return_inverse=True)
        contexts, context_of = np.unique(self.words >> np.uint64(64 - CONTEXT_BITS), return_inverse=True)
        before = np.concatenate([[np.searchsorted(self.words, END)], self.word[:-1]])  # the token before a text's first is the end of another
        self.context = context_of[before]
        pairs, self.pair = np.unique(self.word * len(contexts) + self.context, return_inverse=True)
        word, context = pairs // len(contexts), contexts[pairs % len(contexts)]
        to = bucket_of(self.words[word], context, buckets, hot)
        order = sorted_places(to, buckets)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.pair = place[self.pair]
        self.pair_word, self.pair_context = word[order], context[order]
        self.counts = np.bincount(self.pair[train], minlength=len(pairs)).astype("<u4")
        self.pair_cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        self.contexts = contexts

    def part(self, bucket: int) -> tuple[slice, np.ndarray, np.ndarray]:
        """The bucket's pairs, and their different words (as places among the block's) with pairs of each."""
        p = slice(self.pair_cuts[bucket], self.pair_cuts[bucket + 1])
        own = self.pair_word[p]  # in order
        first = np.flatnonzero(np.diff(own, prepend=-1))
        return p, own[first], np.diff(first, append=len(own)).astype("<u4")


def home_of(words: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a word that isn't hot, and the owner of the word as a context: both by the context's bits."""
    return ((words >> np.uint64(64 - CONTEXT_BITS)) % np.uint64(buckets)).astype(np.int64)


def asked_of(words: np.ndarray, bucket: int, buckets: int, hot: np.ndarray) -> np.ndarray:
    """The contexts that a block asks a bucket for: the words it sends there, and the bucket's hot ones."""
    return np.concatenate([words[~np.isin(words, hot)], hot[home_of(hot, buckets) == bucket]]) >> np.uint64(64 - CONTEXT_BITS)


def bucket_of(words: np.ndarray, contexts: np.ndarray, buckets: int, hot: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        spread = (_mix(words + contexts * _ODD) % np.uint64(buckets)).astype(np.int64)
    return np.where(np.isin(words, hot), spread, home_of(words, buckets))


def _table(rows: list[tuple], target: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in target]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)


def _send(buckets: int, hot: np.ndarray):
    target = arrow_schema(SENT)

    def run(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        block = Block(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), buckets, hot)
        rows = []
        for bucket in range(buckets):  # every bucket hears from every block, and answers it
            p, words, sizes = block.part(bucket)
            rows.append((bucket, number, block.words[words].tobytes(), _packed(sizes), _short(block.pair_context[p]), _packed(block.counts[p])))
        return _table(rows, target)

    return run


class Bucket:
    """The pairs of a bucket with their training counts, and their tables after each round of totals.

    Of hot words it holds a part of the pairs, but the whole root table, which hangs on totals alone; the bucket that owns
    a hot word counts that table.
    """

    def __init__(self, sent: pa.Table, buckets: int, hot: np.ndarray) -> None:
        self.number, self.buckets, self.hot = sent.column("bucket")[0].as_py(), buckets, hot
        self.home = home_of(hot, buckets)
        self.sent = sent.sort_by("block")
        self.own_words = [np.frombuffer(x, dtype=np.uint64) for x in self.sent.column("words").to_pylist()]
        self.own_sizes = [_unpacked(x, "<u4") for x in self.sent.column("sizes").to_pylist()]
        contexts = np.concatenate([_long(x) for x in self.sent.column("contexts").to_pylist()])
        counts = np.concatenate([_unpacked(x, "<u4") for x in self.sent.column("counts").to_pylist()])
        listed = np.concatenate(self.own_words)
        self.words, word = np.unique(np.concatenate([listed, hot[self.home == self.number]]), return_inverse=True)
        self.word = word[: len(listed)]
        code = (np.repeat(self.word, np.concatenate(self.own_sizes)).astype(np.uint64) << np.uint64(CONTEXT_BITS)) | contexts
        pairs, self.pair = np.unique(code, return_inverse=True)
        self.c = np.bincount(self.pair, weights=counts, minlength=len(pairs)).astype(np.int64)
        self.owner, context = (pairs >> np.uint64(CONTEXT_BITS)).astype(np.int64), pairs & _MASK
        self.count = np.bincount(self.owner, weights=self.c, minlength=len(self.words)).astype(np.int64)
        self.is_hot = np.isin(self.words, hot)
        self.hot_at = np.searchsorted(hot, self.words[self.is_hot])
        self.mine = ~self.is_hot
        self.mine[self.is_hot] = self.home[self.hot_at] == self.number
        with np.errstate(over="ignore"):
            self.key = _mix(self.words[self.owner] + context * _ODD)
        # contexts, those with a dish that has several customers first: only their totals are asked for
        trained = self.c > 0
        names, at = np.unique(context[trained], return_inverse=True)
        several = np.zeros(len(names), dtype=bool)
        several[at[self.c[trained] > 1]] = True
        order = sorted_places(~several, 2)  # names are in order
        self.names, self.several = names[order], int(several.sum())
        self.owners = (self.names % np.uint64(buckets)).astype(np.int64)
        self.context = np.zeros(len(self.c), dtype=np.int64)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.context[trained] = place[at]
        self.tables = np.minimum(self.c, 1)
        self.root = np.where(self.is_hot, 0, np.minimum(self.arrived(), 1))
        self.states: list[tuple[np.ndarray, np.ndarray]] = []  # tables and the parent's probabilities, by round

    def arrived(self) -> np.ndarray:
        """Customers of each word in the root: its tables in all contexts (in this bucket's, for hot words)."""
        return np.bincount(self.owner, weights=self.tables, minlength=len(self.words)).astype(np.int64)

    def sums(self) -> list[float]:
        """The bucket's part of the corpus's sums. Owners add what hangs on the totals of hot words."""
        arrived, plain = self.arrived()[~self.is_hot], self.count[~self.is_hot]
        return [float(x) for x in (self.c.sum(), (plain > 0).sum(), self.tables.sum(), self.root[self.mine].sum(), (self.c == 1).sum(), (self.c == 2).sum(), (arrived == 1).sum(), (arrived == 2).sum())]

    def replay(self, totals: pa.Table, last: int | None = None) -> None:
        """The rounds so far, one after another; what was learnt in each is in the totals. In round `last` none move."""
        rounds: dict[int, list[dict]] = {}
        for row in totals.to_pylist():
            if row["owner"] >= 0:
                rounds.setdefault(row["round"], []).append(row)
        asked = self.owners[: self.several]
        order = sorted_places(asked, self.buckets)
        cuts = np.searchsorted(asked[order], np.arange(self.buckets + 1))
        for number in sorted(rounds):
            restaurant, hot = np.zeros(max(len(self.names), 1)), np.zeros((len(self.hot), 2))
            for row in rounds[number]:
                o = row["owner"]
                restaurant[order[cuts[o] : cuts[o + 1]]] = _unpacked(row["tables"], "<i8")
                hot[self.home == o] = _unpacked(row["hot"], "<f8").reshape(-1, 2)
            total = np.array(rounds[number][0]["sums"]) + np.sum([r["extra"] for r in sorted(rounds[number], key=lambda r: r["owner"])], axis=0)
            self.step(number, total, restaurant, hot, number != last)

    def step(self, number: int, sums: np.ndarray, restaurant: np.ndarray, hot: np.ndarray, move: bool) -> None:
        d, d0, base = discount(sums[ONCE], sums[TWICE]), discount(sums[ROOT_ONCE], sums[ROOT_TWICE]), 1 / (sums[V] + 1)
        arrived = self.arrived()
        arrived[self.is_hot] = hot[self.hot_at, 0].astype(np.int64)
        self.count[self.is_hot] = hot[self.hot_at, 1].astype(np.int64)
        if number == 0:
            self.root = seat(arrived, np.full(len(arrived), (STRENGTH + d0 * sums[T0]) * base), d0, self.words).astype(np.int64)
        else:
            root = np.clip(self.root, np.minimum(arrived, 1), arrived)
            self.root = moved(arrived, root, np.full(len(arrived), sums[T0]), np.full(len(arrived), base), d0, Alone(d0), self.words, number)
        parent = (arrived - d0 * self.root + (STRENGTH + d0 * sums[T0]) * base) / (sums[T] + STRENGTH)
        self.states.append((self.tables, parent))
        self.discount = d
        if move:
            many = np.flatnonzero(self.c > 1)
            own, rest, c = parent[self.owner[many]], restaurant[self.context[many]], self.c[many]
            t = self.tables.copy()
            t[many] = seat(c, (STRENGTH + d * rest) * own, d, self.key[many]) if number == 0 else moved(c, t[many], rest, own, d, Alone(d), self.key[many], number)
            self.tables = t


def _note(buckets: int, hot: np.ndarray):
    """What a bucket tells every owner: first its contexts' customers and tables, later how many tables were added."""
    target = arrow_schema(NOTE)

    def run(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
        if not left.num_rows:
            return _table([], target)
        b, first = Bucket(left, buckets, hot), right is None
        if right is not None:
            b.replay(right)
        upto = len(b.names) if first else b.several
        customers = np.bincount(b.context, weights=b.c, minlength=len(b.names)).astype("<i8")
        tables = np.bincount(b.context, weights=b.tables - (0 if first else np.minimum(b.c, 1)), minlength=len(b.names)).astype("<i8")
        told = np.zeros((len(hot), 2))
        told[b.hot_at, 0] = b.arrived()[b.is_hot]
        told[b.hot_at, 1] = np.bincount(b.owner, weights=b.c, minlength=len(b.words))[b.is_hot]
        order = sorted_places(b.owners[:upto], buckets)
        cuts = np.searchsorted(b.owners[:upto][order], np.arange(buckets + 1))
        sums, rows = b.sums(), []
        for o in range(buckets):
            at = order[cuts[o] : cuts[o + 1]]
            wanted = int((at < b.several).sum())
            if not first:
                at = at[tables[at] != 0]
            rows.append((o, b.number, _short(b.names[at]), _packed(customers[at] if first else customers[:0]), _packed(tables[at]), wanted, _packed(told[b.home == o]), sums))
        return _table(rows, target)

    return run


def _total(buckets: int, hot: np.ndarray, number: int, own: bool):
    """An owner adds up the notes, and tells every bucket what it wants to know; own: and itself, for the answers."""
    target = arrow_schema(TOTAL)

    def run(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
        if not left.num_rows:
            return _table([], target)
        first = left.sort_by("bucket").to_pylist()
        later = first if right is None else right.sort_by("bucket").to_pylist()
        owner = first[0]["owner"]
        asked = [_long(r["ids"]) for r in first]
        ids, at = np.unique(np.concatenate(asked), return_inverse=True)
        add = lambda i, rows, what: np.bincount(i, weights=np.concatenate([_unpacked(r[what], "<i8") for r in rows]), minlength=len(ids)).astype("<i8")
        customers, tables = add(at, first, "customers"), add(at, first, "tables")
        if right is not None:
            tables = tables + add(np.searchsorted(ids, np.concatenate([_long(r["ids"]) for r in later])), later, "tables")
        sums = np.sum([r["sums"] for r in later], axis=0).tolist()
        each = np.sum([_unpacked(r["hot"], "<f8").reshape(-1, 2) for r in later], axis=0)
        extra = [0.0] * 8
        extra[V], extra[ROOT_ONCE], extra[ROOT_TWICE] = float((each[:, 1] > 0).sum()), float((each[:, 0] == 1).sum()), float((each[:, 0] == 2).sum())
        extra[T0] = extra[V] if number == 0 else 0.0
        rows, cut = [], 0
        for r, names in zip(first, asked, strict=True):
            rows.append((r["bucket"], number, owner, b"", b"", _packed(tables[at[cut : cut + r["wanted"]]]), _packed(each), sums, extra))
            cut += len(names)
        if own:
            rows.append((owner, number, -1, _short(ids), _packed(customers), _packed(tables), b"", sums, extra))
        return _table(rows, target)

    return run


def _alone(fn):
    """The function of two tables for one."""
    return lambda table: fn(table)


def _answer(buckets: int, hot: np.ndarray):
    """Every block is told of its words the training count and the averaged probability in the root, of its pairs what the
    dish keeps after discounts, and of the contexts it asked for their customers and averaged discounted tables."""
    target = arrow_schema(ANSWER)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], target)
        b = Bucket(left, buckets, hot)
        b.replay(right, SWEEPS + 1)
        kept = np.mean([b.c - b.discount * t for t, _ in b.states[-SAMPLES:]], axis=0).astype("<f4")
        parents = np.mean([p for _, p in b.states[-SAMPLES:]], axis=0).astype("<f4")
        own = sorted((r for r in right.to_pylist() if r["owner"] < 0), key=lambda r: r["round"])[-SAMPLES:]
        ids, customers = _long(own[0]["ids"]), _unpacked(own[0]["customers"], "<i8")
        tables = b.discount * np.mean([_unpacked(r["tables"], "<i8") for r in own], axis=0)
        all_rows = [r for r in right.to_pylist() if r["round"] == SWEEPS + 1 and r["owner"] >= 0]
        sums = (np.array(all_rows[0]["sums"]) + np.sum([r["extra"] for r in all_rows], axis=0)).tolist()
        rows, w, p = [], 0, 0
        for block, words, sizes in zip(b.sent.column("block").to_pylist(), b.own_words, b.own_sizes, strict=True):
            word, pair = b.word[w : w + len(words)], b.pair[p : p + int(sizes.sum())]
            w, p = w + len(words), p + len(pair)
            name = asked_of(words, b.number, buckets, hot)
            at = np.minimum(np.searchsorted(ids, name), max(len(ids) - 1, 0))
            there = ids[at] == name if len(ids) else np.zeros(len(name), dtype=bool)
            served = lambda x: np.where(there, x[at] if len(ids) else 0, 0)
            rows.append((block, b.number, _packed(b.count[word].astype("<u4")), _packed(parents[word]), _packed(kept[pair]), _packed(served(customers).astype("<u4")), _packed(served(tables).astype("<f4")), sums))
        return _table(rows, target)

    return run


def _score(buckets: int, hot: np.ndarray):
    target = arrow_schema(SCORES)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows:
            ids = left.column("doc_id").to_pylist()
            block = Block(ids, left.column("text").to_pylist(), buckets, hot)
            count, parent = np.zeros(len(block.words)), np.zeros(len(block.words))
            kept, customers, tables = np.zeros(len(block.counts)), np.zeros(len(block.contexts)), np.zeros(len(block.contexts))
            for row in right.to_pylist():
                p, words, _ = block.part(row["bucket"])
                count[words], parent[words], kept[p] = _unpacked(row["counts"], "<u4"), _unpacked(row["parents"], "<f4"), _unpacked(row["pairs"], "<f4")
                names = asked_of(block.words[words], row["bucket"], buckets, hot)
                at = np.minimum(np.searchsorted(block.contexts, names), len(block.contexts) - 1)
                there = block.contexts[at] == names
                customers[at[there]], tables[at[there]] = _unpacked(row["customers"], "<u4")[there], _unpacked(row["tables"], "<f4")[there]
                sums = row["sums"]
            base = np.log10((count + 0.5) / (sums[N] + 0.5 * (sums[V] + 1)))
            ctx = block.context
            model = np.log10((kept[block.pair] + (STRENGTH + tables[ctx]) * parent[block.word]) / (customers[ctx] + STRENGTH))
            begin = np.concatenate([[0], np.cumsum(block.sizes)])[:-1]
            known, b, m = (np.add.reduceat(x, begin).tolist() for x in ((count[block.word] > 0).astype(np.int64), base[block.word], model))
            out = [(ids[r], held_out(ids[r]), n, k, int(sums[N]), x, y) for r, n, k, x, y in zip(block.rows, block.sizes.tolist(), known, b, m, strict=True)]
        return _table(out, target)

    return run


def score_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """Base and model log10 probabilities of every document; learnt from all rows that aren't held out.

    Tokens are words (A-Z lower-cased) and one end. A context restaurant belongs to the previous token (told apart by
    CONTEXT_BITS bits of its hash); its parent is the restaurant of all words, whose parent is uniform over the V training
    tokens and one event for all others. Discounts come from the counts, the strength is fixed. After a first seating,
    SWEEPS Gibbs sweeps move customers one by one, each given the totals of all restaurants after the sweep before; what
    each dish keeps after its discounts, the tables and the root's probabilities are averaged over the last SAMPLES.

    Blocks send each different pair once with its count, so a hot pair comes once from each block; hot words (see
    hot_words) are dealt by context too. All rounds are one plan that reads the same shuffled texts and pairs. Counts
    cover all training rows; words are told apart by 64-bit hashes. Null and empty texts: one end token. Rows without a
    doc_id are training rows. Repeated rows count as often as they are there. Empty table: no rows.
    """
    total, hot, own = hot_words(docs)
    blocks, buckets, hot = parts(total, block_bytes), buckets or own, np.array(hot, dtype=np.uint64)
    blocked = with_block(docs, blocks)
    sent = dealt(blocked.groupBy("block").applyInArrow(_send(buckets, hot), SENT), "bucket", buckets)
    owned = lambda notes: dealt(notes, "owner", buckets).groupBy("owner")
    first = sent.groupBy("bucket").applyInArrow(_alone(_note(buckets, hot)), NOTE)
    totals = [owned(first).applyInArrow(_alone(_total(buckets, hot, 0, False)), TOTAL)]
    for number in range(1, SWEEPS + 2):
        known = dealt(reduce(DataFrame.unionAll, totals), "bucket", buckets)
        note = sent.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_note(buckets, hot), NOTE)
        totals.append(owned(first).cogroup(owned(note)).applyInArrow(_total(buckets, hot, number, number > SWEEPS + 1 - SAMPLES), TOTAL))
    known = dealt(reduce(DataFrame.unionAll, totals), "bucket", buckets)
    answers = sent.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_answer(buckets, hot), ANSWER)
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(buckets, hot), SCORES)
