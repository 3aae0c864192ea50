"""One-by-one greedy assignment of rows to operators, run over ranges of rows at once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators.ordering import ranged
from tracequarry.plans.catalog import query
from tracequarry.sources.tables import table

HIT, USE, FAMILY_USE = 5, 4, 2


class Card(NamedTuple):
    """An operator of the catalogue: its family, and the strings in a text that speak for it."""

    id: str
    family: str
    hints: tuple[str, ...]


def hits(text: Column, cards: list[Card]) -> Column:
    """How often each card's hints stand in the lower-cased text, as an array in the order of cards. Null has none."""
    low = F.coalesce(F.lower(text), F.lit(""))
    count = lambda hint: ((F.length(low) - F.length(F.replace(low, F.lit(hint), F.lit("")))) / len(hint)).cast("long")
    return F.array(*[sum((count(h) for h in c.hints), F.lit(0).cast("long")) for c in cards])


class _Counts:
    """How often each card was chosen so far."""

    def __init__(self, cards: list[Card], used: tuple[int, ...]) -> None:
        names = sorted({c.family for c in cards})
        self.family = [names.index(c.family) for c in cards]
        self.used, self.families = list(used), [0] * len(names)
        for family, n in zip(self.family, used):
            self.families[family] += n
        # Of equal cards the greatest id wins, so the last of the sorted ones.
        self.order = sorted(range(len(cards)), key=lambda j: cards[j].id, reverse=True)

    def choose(self, found: list[int]) -> int:
        """The best card for a row: unused, of an unused family, by score; it counts from then on."""
        used, families, family = self.used, self.families, self.family
        best = max(self.order, key=lambda j: (not used[j], not families[family[j]], HIT * found[j] - USE * used[j] - FAMILY_USE * families[family[j]]))
        used[best] += 1
        families[family[best]] += 1
        return best


def assign(rows: DataFrame, cards: list[Card], parts: int | None = None) -> DataFrame:
    """id, operator: each row, in the order of ids, gets the card that is best after all choices before it.

    rows: id (unique; rows without one come last), hits (array in the order of cards). A card that was never chosen goes
    before others, then one of a family never chosen, then the higher 5 hits - 4 uses - 2 uses of its family, then the
    greater id.

    Each choice hangs on all before it, yet only through one count a card. Rows are dealt by ranges of ids; every range
    is run at once from guessed counts, and the counts that it ends with are the next guess for the range behind it. A range whose counts at its start come out as guessed, as do all before it, is settled; only ranges with a
    new guess run again. Guesses that differ draw nearer with each row, as a card that one run has used more often is
    chosen there less, so a few rounds settle all ranges; and each round settles one at least, so the result is exact
    whatever the rows are. The driver holds one count a card and range, never rows.
    """
    if len({c.id for c in cards}) < len(cards) or not cards:
        raise ValueError("cards need ids of their own")
    dealt = ranged(rows.select("id", "hits"), "id", parts).select("id", "hits", "__part")
    none = tuple([0] * len(cards))

    def added(starts: dict[int, tuple[int, ...]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, counts, before = None, None, none
            for batch in batches:
                if batch.num_rows and part is None:
                    part = batch.column(1)[0].as_py()
                    before = starts[part]
                    counts = _Counts(cards, before)
                for found in batch.column(0).to_pylist():
                    counts.choose(found)
            if part is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([[a - b for a, b in zip(counts.used, before)]], pa.list_(pa.int64()))], names=["part", "added"])

        return run

    def chosen(starts: dict[int, tuple[int, ...]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = None
            for batch in batches:
                if batch.num_rows and counts is None:
                    counts = _Counts(cards, starts[batch.column(2)[0].as_py()])
                picked = [cards[counts.choose(found)].id for found in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(picked, pa.string())], names=["id", "operator"])

        return run

    ranges = sorted(r[0] for r in dealt.select("__part").distinct().collect())
    starts = {p: none for p in ranges}
    todo, ends, first = set(ranges), {}, True
    while todo:
        some = dealt.filter(F.col("__part").isin(*todo)) if len(todo) < len(ranges) else dealt
        found = some.select("hits", "__part").mapInArrow(added(starts), "part bigint, added array<bigint>").collect()
        ends |= {r["part"]: tuple(a + b for a, b in zip(starts[r["part"]], r["added"])) for r in found}
        at, todo = none, set()
        for p in ranges:
            if starts[p] != at:
                starts[p] = at
                todo.add(p)
            # All began at zero in the first round, so what they added is summed; then a range's end is the next one's start.
            at = tuple(a + b for a, b in zip(at, ends[p])) if first else ends[p]
        first = False
    return dealt.select("id", "hits", "__part").mapInArrow(chosen(starts), f"id {dealt.schema['id'].dataType.simpleString()}, operator string")


#: A catalogue for the documents' invented words.
CARDS = [
    Card("branch", "control", ("an", "or")),
    Card("loop", "control", ("re", "on")),
    Card("merge", "data", ("me", "en")),
    Card("revise", "data", ("vi", "is")),
    Card("rollback", "recovery", ("ro", "ba")),
    Card("verify", "evidence", ("ve", "ri")),
]


def _sql(cards: list[Card]) -> str:
    count = lambda h: f"(length(t) - length(replace(t, '{h}', ''))) // {len(h)}"
    found = ", ".join(" + ".join(count(h) for h in c.hints) for c in cards)
    family = lambda c: " + ".join(f"used[{j}]" for j, d in enumerate(cards, 1) if d.family == c.family)
    ranked = ", ".join(f"{{'a': used[{j}] = 0, 'b': {family(c)} = 0, 's': {HIT} * hits[{j}] - {USE} * used[{j}] - {FAMILY_USE} * ({family(c)}), 'id': '{c.id}', 'j': {j}}}" for j, c in enumerate(cards, 1))
    kept = ", ".join(f"used[{j}] + CASE WHEN best.j = {j} THEN 1 ELSE 0 END" for j in range(1, len(cards) + 1))
    return f"""WITH RECURSIVE h AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS n, [{found}] AS hits FROM (SELECT doc_id AS id, lower(coalesce(text, '')) AS t FROM documents)),
  s AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS operator, [{", ".join(["0::BIGINT"] * len(cards))}] AS used
  UNION ALL SELECT n, id, best.id, [{kept}] FROM (SELECT h.n, h.id, used, list_max([{ranked}]) AS best FROM s JOIN h ON h.n = s.n + 1))
  SELECT id, operator FROM s WHERE n > 0"""


@query(_sql(CARDS))
def o4_operator_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's operator: the one its words speak for, unless others were used less."""
    d = table(spark, sf_dir, "documents")
    return assign(d.select(F.col("doc_id").alias("id"), hits(F.col("text"), CARDS).alias("hits")), CARDS)
