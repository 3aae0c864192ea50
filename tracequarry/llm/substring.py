"""Substring dedup by relative Lempel-Ziv parsing against every block of the corpus.

Blocks of documents are the references. An index of window hashes, dealt to buckets, tells for every window whether some
document has it earlier, and which block that is. A block asks the reference blocks for the passages that its runs of such
windows begin with, gets their words, and parses its documents against them: a factor starts where the reference has the
same window, grows word by word as long as the reference goes on alike, and ends at the first word that differs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tracequarry.llm.blocks import dealt, order_keys, parts, sorted_places, text_bytes, with_block, word_hashes
from tracequarry.llm.common import arrow_schema

#: Text of one block, and text whose windows one bucket of the index holds.
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20

SENT = "bucket int, block int, hashes binary, docs binary, counts binary, starts binary"
FOUND = "block int, bucket int, earlier binary, sources binary, docs binary, starts binary"
ASKED = "reference int, block int, anchors binary, lengths binary"
TOLD = "block int, reference int, keys binary, ids binary, starts binary, lengths binary, words binary"
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:bigint,length:bigint,source_doc:bigint,source_start:bigint>>"


#: Bytes of a window's hash that go to the index.
SENT_BYTES = 7
#: Of the window hashes over words as they are compared.
SHORT_SEED = 0xA0761D6478BD642F


def windows_of(h: np.ndarray, window: int, seed: int) -> np.ndarray:
    """A hash of every `window` words in a row: their hashes times odd weights that the seed gives, summed."""
    n = max(0, len(h) - window + 1)
    out = np.zeros(n, dtype=np.uint64)
    weight, factor = np.uint64(seed), np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for j in range(window if n else 0):
            out += h[j : j + n] * weight
            weight = (weight * factor) | np.uint64(1)
    out ^= out >> np.uint64(29)
    return out


def _packed(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpacked(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype=kind)


def _short(hashes: np.ndarray) -> bytes:
    """Hashes in SENT_BYTES bytes each."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT_BYTES]).tobytes()


def _long(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // SENT_BYTES, 8), dtype=np.uint8)
    out[:, :SENT_BYTES] = np.frombuffer(b, dtype=np.uint8).reshape(-1, SENT_BYTES)
    return out.view("<u8").ravel()


def _steps(a: np.ndarray) -> bytes:
    """Packed differences, byte plane by byte plane: places mostly rise by little, so their upper bytes are all alike."""
    return _packed(np.diff(a.astype("<u4"), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T)


def _walked(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_unpacked(b, "u1").reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def _table(rows: list[tuple], target: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in target]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)


class Parsed:
    """The windows of a block's documents, in order of (doc_id, start), each different one kept where it comes first."""

    def __init__(self, ids: list, texts: list, block: int, blocks: int, window: int) -> None:
        order = order_keys(ids, block, blocks)
        self.rows, self.block = np.argsort(order, kind="stable"), block
        self.ids = [ids[r] for r in self.rows]
        self.words = [(texts[r] or "").encode("utf-8", "replace").split() for r in self.rows]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        h = word_hashes([x for w in self.words for x in w])
        n = max(0, len(h) - window + 1)
        mixed, spread = windows_of(h, window, 0xD6E8FEB86659FD93), windows_of(h, window, 0xC2B2AE3D27D4EB4F)
        begin = np.concatenate([[0], np.cumsum(self.sizes)])
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)[:n]
        whole = np.flatnonzero(np.arange(n) + window <= begin[doc + 1]) if n else np.zeros(0, dtype=np.int64)
        self.at, self.hashes, self.doc = whole, mixed[whole], doc[whole]  # `at`: the window's first word in the block
        self.spread = spread[whole]
        self.short = (h >> np.uint64(32)).astype("<u4")  # words as they are compared
        self.begin, self.window, self.order = begin, window, order[self.rows]
        key = self.order[self.doc]
        start = self.at - begin[self.doc]
        ranked = np.lexsort((start, key)) if len(np.unique(self.order)) < len(self.order) else np.arange(len(whole))
        if len(ranked):
            order = np.argsort(self.hashes[ranked])
            first = ranked[order]
            new = np.concatenate([[True], self.hashes[first][1:] != self.hashes[first][:-1]])
            heads = ranked[np.minimum.reduceat(order, np.flatnonzero(new))]
            head = heads[np.cumsum(new) - 1]
            # earlier in this block: later in (doc_id, start) than the head of its hash
            self.local = np.zeros(len(whole), dtype=bool)
            self.local[first] = (key[first] > key[head]) | ((key[first] == key[head]) & (start[first] > start[head]))
            self.head = np.empty(len(whole), dtype=np.int64)
            self.head[first] = head
            self.kept = np.sort(heads)
        else:
            self.local, self.head, self.kept = np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def by_bucket(self, buckets: int):
        """(bucket, windows kept that belong to it), in a fixed order.

        The bucket comes from a second hash, so windows that are taken for one another agree in it too.
        """
        to = (self.spread[self.kept] % np.uint64(buckets)).astype(np.int64)
        order = sorted_places(to, buckets)
        cuts = np.flatnonzero(np.diff(to[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            yield int(to[part[0]]), self.kept[part]


def _send(window: int, blocks: int, buckets: int):
    target = arrow_schema(SENT)

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        parsed = Parsed(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), block, blocks, window)
        out: list[list] = [[], [], [], [], [], []]
        for bucket, mine in parsed.by_bucket(buckets):
            key = parsed.order[parsed.doc[mine]]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            for column, value in zip(out, (bucket, block, _short(parsed.hashes[mine]), key[cut[:-1]].tobytes(), np.diff(cut).astype("<u4").tobytes(), _steps(parsed.at[mine] - parsed.begin[parsed.doc[mine]])), strict=True):
                column.append(value)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, target, strict=True)], schema=target)

    return run


def _lookup(table: pa.Table) -> pa.Table:
    """For each block's windows in a bucket: which of them some block has in an earlier document, and block, document and
    start of the earliest."""
    target = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("earlier", pa.binary()), ("sources", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary())])
    blocks = np.array(table.column("block").to_pylist(), dtype="<u4")
    hashes = [_long(x) for x in table.column("hashes").to_pylist()]
    docs = [np.repeat(np.frombuffer(d, dtype=np.int64), np.frombuffer(c, dtype="<u4")) for d, c in zip(table.column("docs").to_pylist(), table.column("counts").to_pylist(), strict=True)]
    h, d = np.concatenate(hashes), np.concatenate(docs)
    at = np.concatenate([_walked(s) for s in table.column("starts").to_pylist()])
    of = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    several = np.append(same, False) | np.insert(same, 0, False)  # hashes that more than one block has
    mine = order[several]
    order[several] = mine[np.lexsort((at[mine], d[mine], h[mine]))]
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    earlier, first = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=np.int64)
    earlier[order], first[order] = d[order] > d[head], head
    cuts = np.cumsum([len(x) for x in hashes])[:-1]
    rows = [(int(blocks[i]), table.column("bucket")[i].as_py(), np.packbits(e).tobytes(), _packed(blocks[of[x[e]]]), _packed(d[x[e]]), _steps(at[x[e]])) for i, (e, x) in enumerate(zip(np.split(earlier, cuts), np.split(first, cuts), strict=True)) if e.any()]
    return _table(rows, target)


class Sources:
    """Where every window first stands in the corpus, if that is earlier: block (-1: nowhere), document's order key, start."""

    def __init__(self, parsed: Parsed, found: list[dict], buckets: int) -> None:
        known = {r["bucket"]: r for r in found if r["earlier"] is not None}
        n = len(parsed.at)
        block, key, start = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for bucket, mine in parsed.by_bucket(buckets):
            if bucket in known:
                r = known[bucket]
                hit = mine[np.unpackbits(np.frombuffer(r["earlier"], dtype=np.uint8), count=len(mine)).astype(bool)]
                block[hit], key[hit], start[hit] = _unpacked(r["sources"], "<u4"), _unpacked(r["docs"], "<i8"), _walked(r["starts"])
        if n:
            block, key, start = block[parsed.head], key[parsed.head], start[parsed.head]
            own = (block < 0) & parsed.local
            block[own] = parsed.block
            key[own] = parsed.order[parsed.doc[parsed.head[own]]]
            start[own] = (parsed.at - parsed.begin[parsed.doc])[parsed.head[own]]
        self.block, self.key, self.start = block, key, start


def _runs(parsed: Parsed, source: Sources) -> list[tuple[int, int]]:
    """First and last window (by number) of every run of neighbouring windows whose first places are neighbours too."""
    seen = np.flatnonzero(source.block >= 0)
    if not len(seen):
        return []
    on = lambda x, by: np.diff(x[seen]) != by
    ends = np.flatnonzero(on(parsed.at, 1) | on(parsed.doc, 0) | on(source.block, 0) | on(source.key, 0) | on(source.start, 1))
    return list(zip(seen[np.concatenate([[0], ends + 1])].tolist(), seen[np.concatenate([ends, [len(seen) - 1]])].tolist(), strict=True))


def _ask(window: int, blocks: int, buckets: int):
    """Each reference block is asked for the passages that begin with the first window of a run, as long as the run."""
    target = arrow_schema(ASKED)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], target)
        parsed = Parsed(left.column("doc_id").to_pylist(), left.column("text").to_pylist(), left.column("block")[0].as_py(), blocks, window)
        source = Sources(parsed, right.to_pylist(), buckets)
        wanted: dict[int, dict[int, int]] = {}
        for a, b in _runs(parsed, source):
            own = wanted.setdefault(int(source.block[a]), {})
            own[int(parsed.hashes[a])] = max(own.get(int(parsed.hashes[a]), 0), int(parsed.at[b] - parsed.at[a]) + window)
        return _table([(to, parsed.block, np.array(list(own), dtype=np.uint64).tobytes(), _packed(np.array(list(own.values()), dtype="<u4"))) for to, own in sorted(wanted.items())], target)

    return run


def _tell(window: int, blocks: int):
    """A reference block answers each block with the passages it asked for, those that overlap as one."""
    target = arrow_schema(TOLD)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([], target)
        parsed = Parsed(left.column("doc_id").to_pylist(), left.column("text").to_pylist(), left.column("block")[0].as_py(), blocks, window)
        heads = np.unique(parsed.head)  # where each different window comes first
        heads = heads[np.argsort(parsed.hashes[heads], kind="stable")]
        names, rows = parsed.hashes[heads], []
        for r in right.to_pylist():
            anchors, lengths = np.frombuffer(r["anchors"], dtype=np.uint64), _unpacked(r["lengths"], "<u4")
            at = np.minimum(np.searchsorted(names, anchors), max(len(names) - 1, 0))
            there = names[at] == anchors if len(names) else np.zeros(len(anchors), dtype=bool)
            passages: list[list[int]] = []  # document, first word, word after the last; words counted through the block
            for w, n in sorted(zip(heads[at[there]].tolist(), lengths[there].tolist(), strict=True), key=lambda x: parsed.at[x[0]]):
                doc, a = int(parsed.doc[w]), int(parsed.at[w])
                b = min(a + n, int(parsed.begin[doc + 1]))
                if passages and passages[-1][0] == doc and a <= passages[-1][2]:
                    passages[-1][2] = max(passages[-1][2], b)
                else:
                    passages.append([doc, a, b])
            if passages:
                doc = np.array([p[0] for p in passages])
                begin = np.array([p[1] for p in passages]) - parsed.begin[doc]
                ids = np.array([[parsed.ids[d] is not None, parsed.ids[d] or 0] for d in doc], dtype="<i8")
                rows.append((r["block"], parsed.block, parsed.order[doc].astype("<i8").tobytes(), ids.tobytes(), _packed(begin.astype("<u4")), _packed(np.array([b - a for _, a, b in passages], dtype="<u4")), np.concatenate([parsed.short[a:b] for _, a, b in passages]).tobytes()))
        return _table(rows, target)

    return run


class Reference:
    """The passages that a block was told, and where their windows first stand in the order of the corpus."""

    def __init__(self, told: list[dict], window: int) -> None:
        parts: list[tuple] = []
        for r in told:
            lengths, words = _unpacked(r["lengths"], "<u4"), np.frombuffer(r["words"], dtype="<u4")
            cuts = np.cumsum(lengths)[:-1]
            ids = np.frombuffer(r["ids"], dtype="<i8").reshape(-1, 2).tolist()
            parts += zip(np.frombuffer(r["keys"], dtype="<i8").tolist(), _unpacked(r["starts"], "<u4").tolist(), ids, np.split(words, cuts), strict=True)
        parts.sort(key=lambda p: p[:3])
        self.parts = parts
        hashes = [windows_of(p[3].astype(np.uint64), window, SHORT_SEED) for p in parts]
        part = np.repeat(np.arange(len(parts)), [len(x) for x in hashes])
        at = np.concatenate([np.arange(len(x)) for x in hashes]) if parts else np.zeros(0, dtype=np.int64)
        flat = np.concatenate(hashes) if parts else np.zeros(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        first = order[np.concatenate([[True], flat[order][1:] != flat[order][:-1]])] if len(order) else order
        self.hashes, self.part, self.at = flat[first], part[first], at[first]

    def longest(self, words: np.ndarray, name: int, key: int, start: int) -> tuple[int, int | None, int] | None:
        """(length, doc_id, start) of the longest common run of words from the window's first place, if that is earlier."""
        i = int(np.searchsorted(self.hashes, name))
        if i >= len(self.hashes) or self.hashes[i] != name:
            return None
        own, begin, (known, doc), passage = self.parts[self.part[i]]
        at = int(self.at[i])
        if (own, begin + at) >= (key, start):
            return None
        n = min(len(words), len(passage) - at)
        differ = np.flatnonzero(words[:n] != passage[at : at + n])
        return (int(differ[0]) if len(differ) else n), (doc if known else None), begin + at


def _remove(window: int, blocks: int, buckets: int, with_text: bool, target: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], target)
        ids = left.column("doc_id").to_pylist()
        parsed = Parsed(ids, left.column("text").to_pylist(), left.column("block")[0].as_py(), blocks, window)
        told = right.to_pylist()
        source = Sources(parsed, told, buckets)
        reference = Reference([r for r in told if r["words"] is not None], window)
        names = windows_of(parsed.short.astype(np.uint64), window, SHORT_SEED)
        covered = np.zeros(int(parsed.begin[-1]), dtype=bool)
        factors: dict[int, list] = {}
        for first, last in _runs(parsed, source):
            doc, a, b = int(parsed.doc[first]), int(parsed.at[first]), int(parsed.at[last])
            zero, end = int(parsed.begin[doc]), b + window
            while a <= b:  # a: the first word of a window that no factor covers yet
                found = reference.longest(parsed.short[a:end], names[a], int(parsed.order[doc]), a - zero)
                if found is None or found[0] < window:
                    a += 1  # the index took two windows for one
                    continue
                n, source_doc, source_start = found
                covered[a : a + n] = True
                factors.setdefault(doc, []).append({"start": a - zero, "length": n, "source_doc": source_doc, "source_start": source_start})
                a += n - window + 1
        out = []
        for doc, (row, words) in enumerate(zip(parsed.rows, parsed.words, strict=True)):
            a, b = int(parsed.begin[doc]), int(parsed.begin[doc + 1])
            gone = covered[a:b]
            n = int(gone.sum())
            text = b" ".join(words if not n else [w for w, x in zip(words, gone.tolist(), strict=True) if not x])
            values = (ids[row], b - a, n, hashlib.sha256(text).hexdigest(), factors.get(doc, []))
            out.append((*values, text.decode()) if with_text else values)
        return _table(out, target)

    return run


def remove_repeats(docs: DataFrame, window: int = 20, with_text: bool = False, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Each document without the words of passages that also start earlier in the corpus.

    Relative Lempel-Ziv parsing with factors of at least `window` words: every block of documents is a reference, indexed
    by the hashes of its windows in buckets. Documents are parsed greedily, run by run of windows that stand earlier
    (smaller doc_id, or same document and earlier start): a factor starts at the first window that isn't covered, where
    the reference has it first, and grows while the words agree. Its words go. Factors may overlap by a window less one
    word, where one source ends and another goes on. The index tells windows apart by 56 bits and a bucket of a second
    hash, so n windows in b buckets have a chance of n^2 / (2^57 b) that two are taken for one; a factor then stands on the agreement of each of its words in 32 bits, 640 bits for the shortest, so a window
    that the index took for another removes nothing.

    Returned: doc_id, n_words, n_removed, kept_sha256, factors (start and length in words, source_doc, source_start),
    with_text also kept_text. Null, empty and shorter texts lose nothing. Rows of one doc_id are one document, so equal rows
    don't remove each other. Rows without an id come after all others and each block's apart. Empty table: no rows. A
    window goes once from each block to its bucket, and a passage once from its reference to each block that has it, so
    one in a third of all documents doesn't load one task.
    """
    total = text_bytes(docs)
    blocks, buckets = parts(total, block_bytes), parts(total, bucket_bytes)
    blocked = with_block(docs, blocks)
    sent = blocked.groupBy("block").applyInArrow(_send(window, blocks, buckets), SENT)
    found = dealt(dealt(sent, "bucket", buckets).groupBy("bucket").applyInArrow(_lookup, FOUND), "block", blocks)
    asked = dealt(blocked.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_ask(window, blocks, buckets), ASKED), "reference", blocks)
    told = blocked.groupBy("block").cogroup(asked.groupBy("reference")).applyInArrow(_tell(window, blocks), TOLD)
    known = dealt(found.unionByName(told, allowMissingColumns=True), "block", blocks)
    ddl = OUT + (", kept_text string" if with_text else "")
    return blocked.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_remove(window, blocks, buckets, with_text, arrow_schema(ddl)), ddl)
