"""SimHash near-duplicates: 64-bit fingerprints, covering bit masks, and linked classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import arrow_schema, bounded_batches, materialize
from tracequarry.llm.graph import components

BITS = 64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if over half of the text's shingle hashes have it; 0 for a text without words.

    A-Z become a-z, words are cut at ASCII white space, shingles are `shingle` words joined by one space (repeats count;
    a shorter text is one shingle).
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= shingle:
        return hashed(line, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    h = np.array([hashed(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 65536):
        counts += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * counts > len(h)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keep: list[Column | str] | None = None) -> DataFrame:
    """The kept columns with fp, the fingerprint as a signed 64-bit number. Null text: 0."""
    df = docs.select(*(keep or ["doc_id"]), F.col("text").alias("__text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]) + ", fp bigint"
    target = arrow_schema(ddl)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(n)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(fps.view(np.int64))], schema=target)

    return df.mapInArrow(run, ddl)


def covering_masks(radius: int) -> list[int]:
    """2**(radius+1)-1 masks; for any `radius` bit positions at least one mask leaves them all out.

    Bit i carries the non-zero vector m(i) of radius+1 bits; the mask of v holds the bits whose m(i) has an odd overlap
    with v. For positions D with |D| <= radius there is a v != 0 orthogonal to every m(i) of D, so fingerprints that
    differ only in D agree under that mask.
    """
    size = (1 << (radius + 1)) - 1
    vectors = [1 + i % size for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints within `radius` (1 or 2) bits, without listing all pairs.

    nodes: distinct fp with an id. Covering masks find the fingerprints that collide with another in some table. Of
    those, two lie within 2 bits just if some value lies within 1 bit of both (within 1 bit: if one lies within 1 bit
    of the other), so each one sends itself to its 65 neighbours and every neighbour links its senders to the least:
    any two senders of one value are within 2 bits, so each such edge is a true link and no link between classes is
    lost. The rows are 65 a colliding fingerprint, whatever the size of a group.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(covering_masks(radius))]))
    masked = nodes.select("fp", tables.alias("m")).select("fp", F.col("m.t").alias("t"), F.col("m.key").alias("key"))
    crowded = masked.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").select("t", "key")
    colliding = materialize(masked.join(crowded, ["t", "key"], "left_semi").select("fp").distinct().join(nodes, "fp"), "colliding")
    if radius == 1:
        near = F.array(*[F.struct(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))).alias("z")) for i in range(BITS)])
        sent = colliding.select("id", F.explode(near).alias("s")).select("id", F.col("s.z").alias("z"))
        return sent.join(nodes.select(F.col("fp").alias("z"), F.col("id").alias("b")), "z").select(F.col("id").alias("a"), "b").filter("a > b")
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])
    sent = colliding.select("id", F.explode(near).alias("z"))
    least = sent.groupBy("z").agg(F.min("id").alias("b"), F.count("*").alias("n")).filter("n > 1").select("z", "b")
    return sent.join(least, "z").filter("id > b").select(F.col("id").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links).

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Documents with equal fingerprints are
    one node, so copies are never expanded into pairs. Rows with null doc_id are kept with a null component unless others
    share their class. Repeated rows stay. Empty table: no rows. Other columns are ignored.
    """
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("id")).filter("id is not null")
    nodes = materialize(nodes, "nodes")
    classes = components(links(nodes, radius))
    heads = nodes.join(classes, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return marked.join(heads, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of docs less all but one document of each class of near-duplicates.

    The least doc_id of a class stays; of several rows with that id the least one. Rows without an id stay only if no row
    with one has their fingerprint, one for each fingerprint. Texts are moved once, by doc_id; copies of a document meet
    as numbers, and only aggregates that combine before the shuffle see a class together.
    """
    columns = docs.columns
    classes = near_duplicates(docs.filter("doc_id is not null"), radius, shingle)
    kept = classes.filter("doc_id = component_id").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*[c for c in columns if c != "doc_id"])).alias("r"))
    known = rows.select(*["doc_id" if c == "doc_id" else F.col(f"r.{c}").alias(c) for c in columns])
    loose = fingerprints(docs.filter("doc_id is null"), shingle, keep=list(columns))
    seen = classes.select(F.col("fingerprint").alias("hex")).distinct()
    loose = loose.join(seen, F.lpad(F.lower(F.hex("fp")), 16, "0") == F.col("hex"), "left_anti")
    loose = loose.groupBy("fp").agg(F.min(F.struct(*columns)).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in columns])
    return known.unionByName(loose)
