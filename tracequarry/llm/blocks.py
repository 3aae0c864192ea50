"""Documents dealt into blocks of bounded size by a hash of their id.

A block is what one task holds at a time. What blocks have to learn from each other (have these windows, these words been
seen elsewhere?) goes as packed arrays of hashes from every block to buckets, each bucket holding a slice of the hashes,
and comes back to the blocks. So no key lands in one task: a block sends each different hash once, however often it has it.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest blocks and buckets, so that small inputs are dealt over many tasks too.
LEAST = 64
LAST_ID = np.iinfo(np.int64).max


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0


def parts(total: int, each: int) -> int:
    return max(LEAST, -(-total // each))


def dealt(df: DataFrame, key: str, groups: int) -> DataFrame:
    """df over half as many partitions as it has groups, so that tasks stay as small as groups however much there is."""
    return df.repartition(-(-groups // 2), key)


def with_block(docs: DataFrame, blocks: int) -> DataFrame:
    """doc_id, text, block. Rows of one doc_id share a block; rows without one are dealt by their text."""
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return dealt(docs.select("doc_id", "text", F.pmod(spread, F.lit(blocks)).cast("int").alias("block")), "block", blocks)


def order_keys(ids: list, block: int, blocks: int) -> np.ndarray:
    """doc_ids as numbers to compare; rows without one come last, in the order of their blocks."""
    return np.array([LAST_ID - blocks + block if i is None else i for i in ids], dtype=np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def sorted_places(places: np.ndarray, below: int) -> np.ndarray:
    """The stable order of numbers less than `below`; NumPy sorts short ones by their digits."""
    return np.argsort(places.astype(np.uint16) if below <= 1 << 16 else places, kind="stable")
