"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import arrow_schema, bounded_batches

#: Every byte that isn't part of a word becomes a space, A-Z become a-z; bytes from 0x80 on belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same words in an original text, where A-Z are still there.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of benchmark text in one automaton. A larger benchmark is scanned for in blocks of this size.
BLOCK_BYTES = 4 << 20
#: Code points that stand for words: from here on, without the surrogates.
_FIRST = 0xE000

_automata: dict = {}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class WindowMatcher:
    """The automaton. Each different word is one letter, so a window is a key and a match ends at a word's number."""

    def __init__(self, items: list[tuple], window: int) -> None:
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        keys: dict[str, set] = {}
        for item, text in items:
            ws = words(text)
            if item is None or not ws:
                continue
            line = "".join([self._letter(w) for w in ws])
            for at in range(max(1, len(line) - window + 1)):
                keys.setdefault(line[at : at + window], set()).add(item)
        self.machine = None
        if keys:
            self.machine = ahocorasick.Automaton()
            for key, owners in keys.items():
                self.machine.add_word(key, (len(key), tuple(owners)))
            self.machine.make_automaton()

    def _letter(self, word: bytes) -> str:
        return self.letters.setdefault(word, chr(_FIRST + len(self.letters)))

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit word ranges [start, end), merged and in order, and the items that occur."""
        if self.machine is None:
            return [], set()
        get = self.letters.get
        ranges: list[tuple[int, int]] = []
        items: set = set()
        for end, (n, owners) in self.machine.iter("".join([get(w, " ") for w in ws])):
            items.update(owners)
            start, stop = end - n + 1, end + 1
            while ranges and start <= ranges[-1][1]:
                low, high = ranges.pop()
                start, stop = min(low, start), max(high, stop)
            ranges.append((start, stop))
        return ranges, items


def _matcher(key: str, items: list[tuple], window: int) -> WindowMatcher:
    if key not in _automata:
        _automata.clear()
        _automata[key] = WindowMatcher(items, window)
    return _automata[key]


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def item_blocks(items: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The benchmark in blocks of at most block_bytes, whose sizes are known before any of them is collected.

    Items above a quarter of a block are cut into pieces that share a window less one word. Items are dealt to cells by a
    hash; neighbouring cells fill a block. A cell that is larger than a block is dealt into cells again.
    """
    rows = items.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    step = max(block_bytes // 64, 1)  # words of a piece: at most 16 bytes each, or the piece is cut again below
    pieces = _pieces(F.col("text"), step, window)
    rows = rows.select("item_id", F.explode(F.when(F.octet_length("text") > block_bytes // 4, pieces).otherwise(F.array("text"))).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    yield from _dealt(rows, total, block_bytes, 0)


def _pieces(text: Column, step: int, window: int) -> Column:
    ws = F.regexp_extract_all(text, F.lit(_WORD.pattern), F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - window, F.lit(0)), F.lit(step)), lambda i: F.array_join(F.slice(ws, i + 1, F.lit(step + window - 1)), " "))


def _dealt(rows: DataFrame, total: int, block_bytes: int, depth: int) -> Iterator[list[tuple]]:
    cells = 1 if total <= block_bytes else 4 * -(-total // block_bytes)
    cell = F.pmod(F.xxhash64(F.lit(depth), "item_id", "text"), F.lit(cells))
    sizes = sorted((r["cell"], r["n"] or 0) for r in rows.groupBy(cell.alias("cell")).agg(F.sum(F.octet_length("text")).alias("n")).collect())
    own: list[int] = []
    filled = 0
    for number, size in [*sizes, (None, block_bytes + 1)]:
        if own and filled + size > block_bytes:
            part = rows.filter(cell.isin(own))
            if filled <= block_bytes or depth > 8:
                yield sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (str(x[0]), x[1]))
            else:
                yield from _dealt(part, filled, block_bytes, depth + 1)
            own, filled = [], 0
        own.append(number)
        filled += size
    if not sizes:
        yield []


def scan(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, keep: list[Column | str] | None = None) -> DataFrame:
    """docs' kept columns with n_words, hit ranges in words and characters, and the items that occur.

    Columns added: n_words, n_hit, ranges (array of struct start, end: word numbers), spans (the same as code points of
    the original text), items (item ids as strings, sorted), n_items, items_sha256, contaminated. The benchmark goes to
    the executors in blocks of checked size, by broadcast variables (each a pass over the rows, without a shuffle). Texts are scanned once per
    block, whole. Null text: no words. Null item ids and items without words match nothing. Repeated rows stay.
    """
    keep = keep or ["doc_id"]
    bounded_batches(docs.sparkSession)
    own = "text" in keep  # then texts go through once
    df = docs.select(*keep, *([] if own else [F.col("text").alias("__text")]), F.lit(None).cast("array<long>").alias("__ranges"), F.lit(None).cast("array<string>").alias("__items"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[: len(keep)])
    middle = f"{head}, {'' if own else '__text string, '}__ranges array<bigint>, __items array<string>"
    at_text = keep.index("text") if own else len(keep)
    final = f"{head}, {HITS}"
    block = next(blocks := item_blocks(items, window, block_bytes))
    while block is not None:
        after = next(blocks, None)
        df = _scanned(df, block, window, final if after is None else middle, len(keep) if after is None else None, at_text)
        block = after
    return df


HITS = "n_words bigint, n_hit bigint, ranges array<struct<start:bigint,end:bigint>>, spans array<struct<start:bigint,end:bigint>>, items array<string>, n_items bigint, items_sha256 string, contaminated boolean"


def _scanned(df: DataFrame, block: list[tuple], window: int, ddl: str, kept: int | None, at_text: int) -> DataFrame:
    """One pass for one block: adds its hits to the ranges and items so far. The last pass (kept: how many columns it
    keeps) forms the result."""
    key = hashlib.sha256(repr((block, window)).encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(block)
    target = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, shared.value, window)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n = part.num_columns - 2
                rows = []
                for text, before, owners in zip(part.column(at_text), part.column(n).to_pylist(), part.column(n + 1).to_pylist(), strict=True):
                    text = text.as_py()
                    ws = words(text)
                    ranges, found = matcher.scan(ws)
                    if before:
                        ranges = _merged(ranges + list(zip(before[::2], before[1::2], strict=True)))
                    names = sorted({*map(str, found), *(owners or ())})
                    rows.append(_hits(text, len(ws), ranges, names) if kept else ([x for r in ranges for x in r], names))
                columns = zip(*rows, strict=True)
                fixed = part.columns[: kept or n]
                made = [pa.array(list(c), target.field(len(fixed) + i).type) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([*fixed, *made], schema=target)

    return df.mapInArrow(run, ddl)


def _hits(text: str | None, n_words: int, ranges: list[tuple[int, int]], items: list[str]) -> tuple:
    n_hit = sum(b - a for a, b in ranges)
    spans = []
    if ranges:
        at = [m.span() for m in _WORD.finditer(text)]
        spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges]
    digest = hashlib.sha256(",".join(items).encode()).hexdigest()
    return n_words, n_hit, [{"start": a, "end": b} for a, b in ranges], spans, items, len(items), digest, n_hit > 0
