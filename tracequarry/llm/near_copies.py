"""One document of each class of near copies: SimHash within two bits, or five-word shingle sets at a Jaccard of 0.8."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm import odd_sketch, simhash
from tracequarry.llm.common import materialize
from tracequarry.llm.graph import components

SHINGLE = 5


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = 2) -> DataFrame:
    """The rows of docs less all but one document of each class of near copies.

    Texts are linked if their SimHash fingerprints differ in `radius` bits at most (simhash.near_duplicates), or if their
    sets of `shingle`-word shingles have a Jaccard similarity of 0.8 or more (odd_sketch.classes: at 0.8 fingerprints
    differ in some ten bits, which covering masks can't reach). Classes are what both kinds of links connect. The least
    doc_id of a class stays; of several rows with that id the least one. Texts without words are one class. Rows without an
    id come after all others: they stay only if no text of their class has an id, one for each set of shingles.
    """
    columns = docs.columns
    marked, keys = odd_sketch.classes(docs, shingle)
    by_set = marked.join(keys, "key").select("doc_id", F.col("class").alias("to"))
    prints = simhash.near_duplicates(docs.filter("doc_id is not null").select("doc_id", "text"), radius, shingle).select("doc_id", F.col("component_id").alias("to"))
    edges = by_set.unionByName(prints).filter("doc_id <> to").select(F.col("doc_id").alias("a"), F.col("to").alias("b"))
    dropped = materialize(components(edges).filter("id <> component").select(F.col("id").alias("doc_id")), "dropped")
    held = docs.filter("doc_id is not null").join(dropped, "doc_id", "left_anti")
    held = held.groupBy("doc_id").agg(F.min(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns) if c != "doc_id"])).alias("r"))
    known = held.select(*["doc_id" if c == "doc_id" else F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)])
    loose = docs.filter("doc_id is null")
    if loose.isEmpty():
        return known
    # Keys of rows without ids, less those whose class or whose blankness is met with ids.
    blank = marked.filter("n = 0 and doc_id is not null").select("key")
    free = keys.filter("class is null").select("key").unionByName(marked.filter("n = 0").select("key").distinct().join(blank.distinct(), "key", "left_anti"))
    rest = odd_sketch.keyed(loose, shingle).join(free, "key", "left_semi").groupBy("key").agg(F.min("row").alias("r"))
    return known.unionByName(rest.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)]))
