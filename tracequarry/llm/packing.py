"""Token packing: sum-of-squares online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracequarry.llm.common import arrow_schema, bounded_batches

#: Words kept in a worker's token cache, which outlives a task; about 400 bytes each with their parts.
CACHE_WORDS = 300_000
#: Texts whose words are looked up at once.
ENCODED = 500
#: Open windows that a partition holds, of 16 kB at most; beyond these they are filled up by cutting, and packing goes on
#: with none. Most mixes of sizes keep far fewer open, but some grow in proportion to the documents.
OPEN = 8192
#: Letters below this one have one lower-case letter each and are composed already.
_PLAIN = "\u0130"
#: Marks that never join with letters; the apostrophe can (it begins contractions).
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_workers: dict = {}


class WordTokenizer:
    """Token ids of texts as little-endian uint32 bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its words in turn; each
    different word is encoded once. Marks after a letter or digit are a piece of their own and are looked up apart,
    and words of plain Latin letters are looked up in lower case, which the tokenizer's normaliser would
    do anyway. A word of only such letters is one piece, so it goes to the tokenizer's merges without its normaliser and
    splitter.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.known: dict[bytes, bytes] = {}
        self.letters = byte_letters()

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def _encode(self, words: list[bytes]) -> list[bytes]:
        merge, letters = self.model.model.tokenize, self.letters
        out, rest = [b""] * len(words), []
        for i, word in enumerate(words):
            text = word.decode()
            if text.isalpha() and (word.isascii() or max(text) < _PLAIN):
                pieces = merge(text if word.isascii() else "".join([letters[b] for b in word]))
                out[i] = np.array([p.id for p in pieces], dtype="<u4").tobytes()
            else:
                rest.append(i)
        found = self.model.encode_batch([words[i].decode() for i in rest], add_special_tokens=False)
        for i, x in zip(rest, found, strict=True):
            out[i] = np.asarray(x.ids, dtype="<u4").tobytes()
        return out

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for at in range(0, len(texts), ENCODED):
            yield from self._encode_some(texts[at : at + ENCODED])

    def _encode_some(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").encode("utf-8", "replace").split() for t in texts]
        words = set().union(*split) if split else set()
        known = self.known
        find = known.get
        table = {w: ids for w in words if (ids := find(w))}
        parts = {w: self._parts(w) for w in words if w not in table}
        need = list({x for pair in parts.values() for x in pair if x} - known.keys())
        # a lower-case form that is known is the same word, so words and their parts may share one dictionary
        fresh = dict(zip(need, self._encode(need), strict=True))
        for w, (core, tail) in parts.items():
            ids = fresh[core] if core in fresh else known[core]
            if tail:
                ids += fresh[tail] if tail in fresh else known[tail]
            table[w] = ids
        for new in (table, fresh):
            if len(known) < CACHE_WORDS:
                known.update(islice(new.items(), CACHE_WORDS - len(known)))
        return [b"".join(map(table.__getitem__, ws)) for ws in split]

    @staticmethod
    def _parts(word: bytes) -> tuple[bytes, bytes]:
        """(lower-case core, marks after it): marks that follow a letter or digit are a piece of their own."""
        if word.isascii():
            low = word.lower()
        else:
            text = word.decode()
            if max(text) >= _PLAIN:
                return word, b""
            low = text.lower().encode()
        core = low.rstrip(_MARKS)
        if len(core) == len(low) or not core or not (core[-1:].isalnum() or core.decode()[-1].isalpha()):
            return low, b""
        return core, low[len(core) :]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = [chr(b) for b in range(256)]
    for i, b in enumerate(hidden):
        table[b] = chr(256 + i)
    return table


class SumOfSquares:
    """Open windows by fill level. A piece goes to the level that keeps the sum of squared level counts least.

    counts[h] is the number of open windows filled to h; full windows and empty ones don't count. Ties go to the fullest
    window, and among windows of one level to the one that reached it last.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.stacks: dict[int, list] = defaultdict(list)

    def place(self, size: int) -> int:
        """The level to put a piece of this size on (0: a new window)."""
        top = self.capacity - size
        here = self.counts[: top + 1]
        after = 2 * self.counts[size : self.capacity + 1] + 1
        after[top] = 0  # the window would be full
        change = after - 2 * here + 1
        change[0] = after[0]
        change[1:][here[1:] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def add(self, pieces: list, size: int):
        """Puts one piece into a window; returns the window if that fills it."""
        level = self.place(size)
        if level:
            window = self.stacks[level].pop()
            self.counts[level] -= 1
        else:
            window = []
        window += pieces
        if level + size == self.capacity:
            return window
        self.stacks[level + size].append(window)
        self.counts[level + size] += 1
        return None

    def open(self) -> int:
        return int(self.counts.sum())

    def drain(self) -> list[tuple[int, list]]:
        return [(level, w) for level in sorted(self.stacks, reverse=True) for w in self.stacks[level]]


def _settle(left: list[tuple[int, list]], capacity: int) -> Iterator[list]:
    """Fills the fullest open windows with pieces cut from the emptiest; the last one is cut at powers of two."""
    windows = [w for _, w in left]
    fills = [level for level, _ in left]
    i, j = 0, len(windows) - 1
    while i < j:
        gap = capacity - fills[i]
        doc, start, ids, total = windows[j].pop()
        size = len(ids) // 4
        take = min(gap, size)
        windows[i].append((doc, start, ids[: 4 * take], total))
        if take < size:
            windows[j].append((doc, start + take, ids[4 * take :], total))
        fills[i] += take
        fills[j] -= take
        if fills[i] == capacity:
            yield windows[i]
            i += 1
        if fills[j] == 0:
            j -= 1
    if i == j and fills[i]:
        pieces, rest = windows[i][::-1], fills[i]
        while rest:
            room = 1 << (rest.bit_length() - 1)
            rest -= room
            window = []
            while room:
                doc, start, ids, total = pieces.pop()
                take = min(room, len(ids) // 4)
                window.append((doc, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    pieces.append((doc, start + take, ids[4 * take :], total))
                room -= take
            yield window


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, with_ids: bool = False, open_windows: int = OPEN) -> DataFrame:
    """Pieces of tokenised documents with their places in sequences of at most `capacity` tokens.

    One pass and no shuffle: each input partition packs its own rows as they come, holding only its open windows, of which
    there are at most `open_windows` (see OPEN). So pieces and sequence ids follow the input's splits. Sequence ids are the partition's number times 2**33 plus a
    counter. Texts longer than a window are cut at full windows and their rest is packed. What is open then or
    at the partition's end is filled up by cutting pieces of the emptiest windows, and the last of these is cut at powers of
    two, so no sequence needs padding. with_ids adds each piece's ids as little-endian uint32 bytes.

    Null text: empty, so only the end id. Null doc_id and repeated rows are packed like any other. Empty table: no rows.
    """
    ddl = PIECES + (", ids binary" if with_ids else "")
    target = arrow_schema(ddl)
    bounded_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 33
        model, packer, made = WordTokenizer.of(tokenizer_path), SumOfSquares(capacity), 0
        rows: list[tuple] = []

        def emit(window: list) -> None:
            nonlocal made
            offset = 0
            for doc, start, ids, total in window:
                n = len(ids) // 4
                row = (doc, start, n, zlib.crc32(ids), total, base + made, offset)
                rows.append((*row, ids) if with_ids else row)
                offset += n
            made += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in target]
            out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target, strict=True)], schema=target)
            rows.clear()
            return out

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), model.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                total = len(ids) // 4
                full = total - total % capacity
                for start in range(0, full, capacity):
                    emit([(doc, start, ids[4 * start : 4 * (start + capacity)], total)])
                if full < total:
                    window = packer.add([(doc, full, ids[4 * full :], total)], total - full)
                    if window:
                        emit(window)
                    elif packer.open() > open_windows:
                        for window in _settle(packer.drain(), capacity):
                            emit(window)
                        packer = SumOfSquares(capacity)
            if len(rows) >= 5000:
                yield flush()
        for window in _settle(packer.drain(), capacity):
            emit(window)
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, ddl)
