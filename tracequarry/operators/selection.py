"""Ranked and quota-bound selection."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.functions.text import bucketize
from tracequarry.plans.catalog import query
from tracequarry.sources.tables import table


@query("""WITH best AS (SELECT o_custkey AS source, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS id, max(o_totalprice) AS score FROM orders GROUP BY o_custkey)
SELECT source, id, score FROM best ORDER BY score DESC, id LIMIT 25""")
def o3_topk_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of each source, then the best 25 sources (the report's size)."""
    best = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("n"))).alias("b"))
    return best.select("source", (-F.col("b.n")).alias("id"), F.col("b.o_totalprice").alias("score")).orderBy(F.desc("score"), "id").limit(25)


@query("""WITH r AS (SELECT p_partkey AS id, p_brand AS brand, p_retailprice AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) SELECT * FROM r WHERE place <= 3""")
def o7_best_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of each group; Spark keeps only three rows a group and task before the shuffle."""
    w = Window.partitionBy("brand").orderBy(F.desc("score"), "id")
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("score"))
    return r.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 3")


#: Candidates of the first prefix that quotas are decided in; the next holds twice as many, and so on.
PREFIX = 20_000
#: Candidates that one task decides one by one; longer prefixes are decided in rounds.
FOLDED = 100_000
#: Full groups are sent to all tasks up to this many; beyond it they are joined by shuffles.
SENT_GROUPS = 100_000


def quota_select(candidates: DataFrame, per_cell: int = 1, per_parent: int = 2, per_operator: int = 100, prefix: int = PREFIX, folded: int = FOLDED) -> DataFrame:
    """id, reason (null if selected) of candidates taken in descending score under quotas.

    A candidate is refused if its fingerprint was selected already, or its cell, parent or operator has reached its
    quota, by the first of these that holds. Each decision hangs on those before it alone, so the best are decided first: a
    prefix of the order, all candidates from some score on. What follows it loses every candidate of a group that is full
    then, in one pass, before the next prefix, twice as long, is decided. So all candidates are read once a prefix, and
    only those that no full group has refused yet are ever ranked. A prefix of at most `folded` rows is one task's loop,
    longer ones take rounds over all tasks, so where quotas refuse few, no task holds more than that. Rows without an id are refused. With the selection
    known, a group is full for a refused candidate if the worst of its quota-many selected is better.
    """
    groups = [("fingerprint", 1, "semantic_duplicate"), ("cell", per_cell, "archive_cell_full"), ("parent", per_parent, "parent_quota"), ("operator", per_operator, "operator_quota")]
    columns = ["id", "score", *[g for g, _, _ in groups]]
    whole = candidates.select(*columns).checkpoint()
    left = whole.filter("id is not null")
    done, n = left.limit(0), left.count()
    while n:
        # Rows without a score come last, and a prefix that reaches none of them has a score to end at.
        end = left.agg(F.percentile_approx("score", 1 - prefix / n, 10_000)).first()[0] if n > prefix else None
        first = (left if end is None else left.filter(F.col("score") >= end)).checkpoint()
        done = (_folded if first.count() <= folded else _decided)(first, done, groups)
        if end is None:
            break
        rest = whole.filter("id is not null").filter(~F.coalesce(F.col("score") >= end, F.lit(False)))
        left, prefix = _open(rest, done, groups), prefix * 2
        n = left.count()
    taken = done.select("id").withColumn("taken", F.lit(True))
    rest = whole.join(_sent(taken, done.count()), "id", "left").filter("taken is null").drop("taken")
    reason = F.when(F.col("id").isNull(), "no_id")
    for g, quota, name in reversed(groups):
        full = done.groupBy(g).agg(F.count("*").alias("n"), F.max(F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"))).alias(f"worst_{g}")).filter(F.col("n") >= quota).drop("n")
        rest = rest.join(_sent(full, done.count()), g, "left")
        reason = F.when(F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")) > F.col(f"worst_{g}"), name).otherwise(reason)
    refused = rest.select("id", "score", reason.alias("reason"))
    return done.select("id", "score", F.lit(None).cast("string").alias("reason")).unionByName(refused)


def _sent(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SENT_GROUPS else df


def _open(rows: DataFrame, done: DataFrame, groups: list[tuple[str, int, str]]) -> DataFrame:
    """The rows that no full group refuses."""
    n = done.count()
    for g, quota, _ in groups:
        full = done.groupBy(g).agg(F.count("*").alias("n")).filter(F.col("n") >= quota).select(g)
        rows = rows.join(_sent(full, n), g, "left_anti")
    return rows


def _folded(left: DataFrame, done: DataFrame, groups: list[tuple[str, int, str]]) -> DataFrame:
    """done and those selected of `left`, the candidates that come next, one by one. Missing values are in no group."""
    rows, names, target = left, [g for g, _, _ in groups], done.schema
    for g in names:
        rows = rows.join(done.groupBy(g).agg(F.count("*").alias(f"taken_{g}")), g, "left")
    quotas = [quota for _, quota, _ in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            own = zip(*[batch.column(g).to_pylist() for g in names], strict=True)
            before = zip(*[batch.column(f"taken_{g}").to_pylist() for g in names], strict=True)
            kept = []
            for values, taken in zip(own, before, strict=True):
                keys = [(i, v) for i, v in enumerate(values) if v is not None]
                kept.append(all((taken[i] or 0) + seen[i, v] < quotas[i] for i, v in keys))
                if kept[-1]:
                    seen.update(keys)
            yield batch.filter(pa.array(kept, pa.bool_())).select(target.names)

    picked = rows.repartition(1).sortWithinPartitions(F.desc("score"), F.asc("id")).mapInArrow(run, target)
    return done.unionByName(picked).checkpoint()


def _decided(left: DataFrame, done: DataFrame, groups: list[tuple[str, int, str]]) -> DataFrame:
    """done and those selected of `left`, the candidates that come next, in rounds.

    A candidate that isn't among the best quota-many undecided of every group it is in waits. One that is can't be refused
    by any candidate before it, and is selected; one whose group is full is out. Every round decides at least the best
    undecided candidate and usually a large share. Of a group only the quota's best are ranked, and each task keeps no
    more than these before the shuffle, so a few large groups load no task.
    """
    order, columns = [F.desc("score"), F.asc("id")], done.columns
    while not left.isEmpty():
        top = None
        for g, quota, _ in groups:
            taken = done.groupBy(g).agg(F.count("*").alias("taken"))
            best = left.withColumn("place", F.row_number().over(Window.partitionBy(g).orderBy(*order))).filter(F.col("place") <= quota)
            best = best.join(taken, g, "left").filter(F.col("place") + F.coalesce("taken", F.lit(0)) <= quota).select("id")
            top = best if top is None else top.unionByName(best)
        sure = top.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(groups)).select("id").checkpoint()
        done = done.unionByName(left.join(sure, "id", "left_semi")).checkpoint()
        left = _open(left.join(sure, "id", "left_anti"), done, groups).select(*columns).checkpoint()
    return done


@query()
def o5_quota_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates: parent customer, operator priority, cell status, price band and clerk bucket, fingerprint price."""
    o = table(spark, sf_dir, "orders")
    cell = F.concat_ws("/", "o_orderstatus", bucketize(F.col("o_totalprice"), [50000, 100000, 200000, 300000]), (F.col("o_orderkey") % 50).cast("string"))
    c = o.select(F.col("o_orderkey").alias("id"), F.round("o_totalprice", 0).alias("score"), F.round("o_totalprice", 0).cast("long").alias("fingerprint"), cell.alias("cell"), F.col("o_custkey").alias("parent"), F.col("o_orderpriority").alias("operator"))
    return quota_select(c)
