"""MinHash near-duplicates with odd sketches: banded candidates, parity bitmaps, links confirmed on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.llm.blocks import word_hashes
from tracequarry.llm.common import arrow_schema, bounded_batches, materialize
from tracequarry.llm.graph import components

#: Links have 100 * intersection >= 80 * union; compared as SHARED of OF.
SHARED, OF = 4, 5
#: Two sets at 0.8 share no band with (1 - 0.8**6)**60 = 1.2e-8.
BANDS, ROWS = 60, 6
#: Samples that odd sketches fold, and bits they are folded into.
SAMPLES, BITS = 1024, 2048
#: Pairs whose sketches say less than this aren't confirmed; at 0.8 the estimate's deviation is 0.015.
LEAST_ESTIMATE = 0.72
#: Differing bits of two sketches that say just that.
MOST_DIFFERENT = int(BITS / 2 * (1 - math.exp((LEAST_ESTIMATE - 1) * 4 * SAMPLES / BITS)))
#: Comparisons with one lead a set before groups are compared whole.
TURNS = 1
#: Bytes of sets that a task compares at once: of a group, and of its rows outside the largest class.
PART, CHUNK = 1 << 19, 1 << 22
#: Bits of the largest bitmap of ids.
MARKS = 1 << 26
_RNG = np.random.default_rng(12)
_ODD = _RNG.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_PLACE = _RNG.integers(0, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TO_BIT = _RNG.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALT = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; none for a text without words.

    A-Z become a-z, words are cut at ASCII white space; a text shorter than a shingle is one shingle.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = word_hashes(words)
    n = min(shingle, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = (h + w[k : len(w) - n + 1 + k]) * _PLACE[k]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def samples(hashes: np.ndarray, some: int = SAMPLES) -> np.ndarray:
    """The first `some` MinHashes of a set, one for each function."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(some, np.iinfo(np.uint32).max, dtype=np.uint32)
    room = np.empty((min(len(x), 64), some), dtype=np.uint32)
    for at in range(0, len(x), 64):
        part = x[at : at + 64, None]
        own = room[: len(part)]
        np.multiply(part, _ODD[:some], out=own)
        own += _ADD[:some]
        np.minimum(least, own.min(axis=0), out=least)
    return least


def bands(least: np.ndarray) -> list[int]:
    """One 64-bit key a band."""
    raw, width = least.tobytes(), 4 * ROWS
    return [xxhash.xxh64_intdigest(raw[i * width : (i + 1) * width], i) for i in range(BANDS)]


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """The parity, bit by bit, of the (function, MinHash) pairs that hash to it: BITS bits as numbers of 64."""
    at = ((least ^ _SALT) * _TO_BIT) >> np.uint32(32 - BITS.bit_length() + 1)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _marks(ids: DataFrame, most: int = MARKS) -> np.ndarray:
    """A bitmap, of 32 bits an id and `most` bits at most, with the places of the hashes of all values of id."""
    bits = min(most, 1 << max(6, (32 * ids.count() - 1).bit_length()))
    place = F.xxhash64("id").bitwiseAND(F.lit(bits - 1))
    words = ids.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("w")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("w").to_numpy()
    return out.view(np.uint64)


def _marked(marks: np.ndarray, i: int | None) -> bool:
    """Whether id i may be among the marked; rows without an id always."""
    if i is None:
        return True
    place = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42) & (64 * len(marks) - 1)
    return bool(int(marks[place >> 6]) >> (place & 63) & 1)


def _sets(docs: DataFrame, shingle: int, marks: np.ndarray | None = None) -> DataFrame:
    """doc_id, key (128-bit digest of the set), n and bands of every row; of marked rows hashes and sketch if there are marks."""
    whole = marks is not None
    ddl = "doc_id bigint, key string, n bigint, " + ("hashes array<bigint>, sketch array<bigint>" if whole else "bands array<bigint>")
    target = arrow_schema(ddl)
    bounded_batches(docs.sparkSession)
    none = np.zeros(0, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for at in range(0, all_rows.num_rows, 250):
                batch = all_rows.slice(at, 250)
                if whole:
                    batch = batch.filter(pa.array([_marked(marks, i) for i in batch.column(0).to_pylist()], pa.bool_()))
                sets = [shingle_set(t.as_py(), shingle) for t in batch.column(1)]
                made = [pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]), pa.array([len(s) for s in sets], pa.int64())]
                if whole:
                    made += [_lists(sets), _lists([odd_sketch(samples(s)) if len(s) else none for s in sets])]
                else:
                    made.append(_lists([np.array(bands(samples(s, BANDS * ROWS)), dtype=np.uint64) if len(s) else none for s in sets]))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *made], schema=target)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, ddl)


def keyed(docs: DataFrame, shingle: int) -> DataFrame:
    """key of every row's set, and the row as a struct of c0, c1, ... in the order of docs' columns."""
    df = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), "text")
    ddl = f"row {df.schema['row'].dataType.simpleString()}, key string"
    target = arrow_schema(ddl)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([xxhash.xxh3_128_hexdigest(shingle_set(t.as_py(), shingle).tobytes()) for t in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(target.field(0).type), keys], schema=target)

    return df.mapInArrow(run, ddl)


def _unsettled(rows: DataFrame) -> DataFrame:
    """rows (band, id, c, ...) of bands with several classes, with m and top."""
    counts = rows.groupBy("band", "c").agg(F.count("*").alias("k"))
    stats = counts.groupBy("band").agg(F.sum("k").alias("m"), F.count("*").alias("classes"), F.max(F.struct("k", "c")).alias("t"))
    return rows.join(stats.filter("classes > 1").select("band", "m", F.col("t.c").alias("top")), "band")


def _renamed(df: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.join(names.select(F.col("id").alias(c), F.col("component").alias("__new")), c, "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
    return df


def _leads(rows: DataFrame, turn: int) -> DataFrame:
    """Groups for _linked: every set with the best lead of all its bands that is of another class, one a set.

    A band's lead is the set that meets most others, so that of a group of near copies the one in their middle; in later
    turns any. Leads are the groups' outer rows.
    """
    met = rows.groupBy("id").agg(F.sum("m").alias("w")).select("id", F.struct((-F.col("w")).alias("a"), F.col("id").alias("b")).alias("rank"))
    ranked = rows.join(met, "id") if turn == 0 else rows.withColumn("rank", F.struct(F.xxhash64("id", F.lit(turn)).alias("a"), F.col("id").alias("b")))
    first = ranked.groupBy("band").agg(F.min(F.struct("rank", "id", "n", "c")).alias("l"))
    alike = OF * F.least("n", "l.n") >= SHARED * F.greatest("n", "l.n")
    pairs = rows.join(first, "band").filter((F.col("c") != F.col("l.c")) & alike).groupBy("id", "n", "c").agg(F.min("l").alias("l"))
    pairs = materialize(pairs, "leads")
    inner = pairs.select(F.col("l.id").alias("g"), "id", "n", "c", F.lit(False).alias("outer"))
    return inner.unionByName(pairs.select(F.col("l.id").alias("g"), "l.id", "l.n", "l.c", F.lit(True).alias("outer")).distinct())


def _cells(groups: DataFrame) -> DataFrame:
    """groups (g, id, n, c, outer) dealt to cells (g, p, q): every outer row meets every row of its group in one cell.

    A row is on the right in all cells of its part p; an outer row is on the left in all cells of its chunk q too. So a cell
    holds some PART + CHUNK bytes of sets, however large the group. Most groups are one cell; only the others, of which
    there are fewer than the bytes of all sets by PART, are sent to all tasks with their numbers.
    """
    size = 8 * F.col("n") + BITS // 8
    sums = groups.groupBy("g").agg(F.sum(size).alias("a"), F.sum(F.when(F.col("outer"), size).otherwise(0)).alias("b"))
    dealt = sums.filter(F.col("a") > PART).select("g", F.ceil(F.col("a") / PART).cast("int").alias("ps"), F.ceil(F.greatest("b", F.lit(1)) / CHUNK).cast("int").alias("qs"))
    one = F.lit(1)
    rows = groups.join(F.broadcast(dealt), "g", "left").withColumns({"ps": F.coalesce("ps", one), "qs": F.coalesce("qs", one)})
    rows = rows.withColumns({"own_p": F.pmod(F.xxhash64("id"), F.col("ps")).cast("int"), "own_q": F.pmod(F.xxhash64("id", one), F.col("qs")).cast("int")})

    def cell(p: Column, q: Column) -> Column:
        return F.struct(p.alias("p"), q.alias("q"))

    right = F.transform(F.sequence(F.lit(0), F.col("qs") - 1), lambda q: cell(F.col("own_p"), q))
    left = F.transform(F.sequence(F.lit(0), F.col("ps") - 1), lambda p: cell(p, F.col("own_q")))
    every = rows.withColumn("cell", F.explode(F.when(F.col("outer"), F.array_union(right, left)).otherwise(right)))
    sides = [(F.col("outer") & (F.col("cell.q") == F.col("own_q"))).alias("left"), (F.col("cell.p") == F.col("own_p")).alias("right")]
    return every.select("g", "cell.p", "cell.q", "id", "c", "outer", *sides)


def cell_links(ids: np.ndarray, classes: np.ndarray, outer: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], sketches: np.ndarray) -> list[tuple[int, int]]:
    """Links between rows on the left and rows on the right that connect just the classes that all their links connect.

    A pair is counted on its full sets if sizes and sketches let it be a link, the likeliest of a row first, until its two
    classes are one. Two outer rows are compared where the lesser id is on the left.
    """
    sizes, names, found = np.array([len(s) for s in sets]), classes.copy(), []
    others, codes, marks = np.flatnonzero(right), None, None
    for i in np.flatnonzero(left):
        fit = (names[others] != names[i]) & (~outer[others] | (ids[others] > ids[i]))
        fit &= OF * np.minimum(sizes[others], sizes[i]) >= SHARED * np.maximum(sizes[others], sizes[i])
        some = others[fit]
        differ = np.bitwise_count(sketches[some] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(differ <= MOST_DIFFERENT)
        some = some[near[np.argsort(differ[near], kind="stable")]]
        if len(some) and codes is None:
            ends = np.cumsum(sizes)
            flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
            codes, marks = [flat[e - n : e] for e, n in zip(ends, sizes, strict=True)], np.zeros(int(flat.max()) + 1, dtype=np.int8)
        taken = 1
        while len(some):
            now, some, taken = some[:taken], some[taken:], min(8 * taken, 512)
            marks[codes[i]] = 1
            starts = np.concatenate([[0], np.cumsum(sizes[now])[:-1]])
            both = np.add.reduceat(marks[np.concatenate([codes[k] for k in now])], starts, dtype=np.int64)
            marks[codes[i]] = 0
            for k in now[OF * both >= SHARED * (sizes[now] + sizes[i] - both)]:
                if names[k] != names[i]:
                    found.append((int(ids[i]), int(ids[k])))
                    names[names == names[k]] = names[i]
            some = some[names[some] != names[i]]
    return found


def _linked(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, c, b, lc) of outer rows with rows of other classes c in their groups (g, id, n, c, outer)."""
    ddl = "a bigint, c bigint, b bigint, lc bigint"
    target = arrow_schema(ddl)
    bounded_batches(groups.sparkSession)

    def of_cell(cell: pa.Table) -> pa.RecordBatch:
        ids, names, outer, left, right = (cell.column(k).to_numpy() for k in ("id", "c", "outer", "left", "right"))
        hashes, sketches = cell.column("hashes").combine_chunks(), cell.column("sketch").combine_chunks()
        ends, flat = hashes.offsets.to_numpy(), hashes.values.to_numpy().view(np.uint64)
        full = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        edges = cell_links(ids, names, outer, left, right, full, sketches.flatten().to_numpy().view(np.uint64).reshape(len(ids), -1))
        of = dict(zip(ids.tolist(), names.tolist(), strict=True))
        return pa.RecordBatch.from_pydict({"a": [a for a, _ in edges], "c": [of[a] for a, _ in edges], "b": [b for _, b in edges], "lc": [of[b] for _, b in edges]}, schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if held and tuple(keys[:, a]) != last:
                    yield of_cell(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(keys[:, a])
        if held:
            yield of_cell(pa.Table.from_batches(held))

    # Cells grow with the table: the same join at any size.
    cells = _cells(groups).hint("merge").join(sets, "id").select("g", "p", "q", "id", "c", "outer", "left", "right", "hashes", "sketch")
    return cells.repartition("g", "p", "q").sortWithinPartitions("g", "p", "q").mapInArrow(run, ddl)


def links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) that connect just the sets that links connect.

    rows: band, id, n; sets: id, hashes, sketch. First, TURNS times, every set is compared with one lead: so groups of
    thousands become classes at a few comparisons a member. Then every band that still holds several classes is compared
    whole but for pairs within a class, which needn't be. Bands whose most frequent class is the same are one group, so
    that sets that share many bands meet once; members of other classes are its outer rows.
    """
    rows, found = rows.withColumn("c", F.col("id")), None
    for turn in range(TURNS + 1):
        rows = materialize(_unsettled(rows), "bands")
        groups = _leads(rows, turn) if turn < TURNS else materialize(rows.groupBy(F.col("top").alias("g"), "id").agg(F.min("n").alias("n"), F.min("c").alias("c")).withColumn("outer", F.col("c") != F.col("g")), "groups")
        edges = materialize(_linked(groups, sets), "edges")
        found = edges.select("a", "b") if found is None else found.unionByName(edges.select("a", "b"))
        if turn < TURNS:
            rows = _renamed(rows.select("band", "id", "n", "c"), components(edges.select(F.col("c").alias("a"), F.col("lc").alias("b"))), "c")
    return found


def classes(docs: DataFrame, shingle: int = 2) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id, key and n; and for every key of a set with words the least id of its class (null: no row has one).

    A key whose rows all lack ids stands in the comparisons under a number above all ids.
    """
    marked = materialize(_sets(docs, shingle), "sketches")
    highest = marked.agg(F.max("doc_id")).first()[0] or 0
    grouped = marked.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    nodes = materialize(grouped.select("key", F.coalesce("doc_id", F.lit(highest) + 1 + F.monotonically_increasing_id()).alias("id"), F.col("doc_id").isNull().alias("loose")), "nodes")
    # Of the rows of one key any speaks for it: all have the same bands. Repeated rows do no harm.
    made = ["id", "key", "n", "bands"]
    once = marked.withColumnRenamed("doc_id", "id").join(nodes.filter("not loose").select("key", "id"), ["key", "id"], "left_semi").select(*made)
    some_loose = not nodes.filter("loose").isEmpty()
    if some_loose:
        once = once.unionByName(marked.filter("doc_id is null").join(nodes.filter("loose").select("key", "id"), "key").select(*made))
    once = materialize(once, "once")
    beside = Window.partitionBy("band").orderBy("id")
    crowded = F.lag("id").over(beside).isNotNull() | F.lead("id").over(beside).isNotNull()
    banded = once.select(F.explode("bands").alias("band"), "id", "n").withColumn("crowded", crowded)
    rows = materialize(banded.filter("crowded").select("band", "id", "n"), "bands")
    busy = materialize(once.select("id", "key").join(rows.select("id").distinct(), "id", "left_semi").distinct(), "busy")
    # Texts aren't moved: a bitmap tells most rows that are not needed, the join the others.
    full = _sets(docs, shingle, _marks(busy)).join(busy.hint("merge"), "key").dropDuplicates(["key"])
    sets = materialize(full.select("id", "hashes", "sketch"), "hashes")
    keys = _renamed(nodes.select("key", F.col("id").alias("class")), components(links(rows, sets)), "class")
    return marked.select("doc_id", "key", "n"), keys.select("key", F.when(F.col("class") <= highest, F.col("class")).alias("class"))


def near_duplicates(docs: DataFrame, shingle: int = 2) -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id (the smallest doc_id reachable over links), kept.

    A document's set: its distinct shingles of `shingle` words, lower-cased; with fewer words the whole sequence as one.
    Sets are linked at a Jaccard similarity of 0.8 or more, counted on the full sets. Null, empty and blank texts have
    empty sets, are linked with nothing and are their own components. Equal sets are one node, so copies never make pairs.
    Rows without an id link others; their component is null unless it has an id. kept: doc_id is component_id, and true
    where both are null. Repeated rows stay. Empty table: no rows. Other columns don't matter. A link is missed only if its
    two sets share none of 60 bands (1e-8 at 0.8) or if their sketches err by 0.08 (5 deviations).
    """
    marked, keys = classes(docs, shingle)
    out = marked.join(keys, "key", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("class")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
