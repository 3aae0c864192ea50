"""Merkle manifest of a table: every row a leaf, a tree for each group, a tree over the groups' roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.llm.common import materialize

FANOUT = 16
#: l and r: digests to the left and to the right of one's own in a run, as one string each.
PATH = "array<struct<l:string,r:string>>"
_NO_PATH = f"from_json('[]', '{PATH}')"


def leaf_digest(columns: list[Column]) -> Column:
    """Lowercase hex sha256 of the columns in a row, each `-` if null, else its UTF-8 byte count, `:` and its value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def proof_digest(path: Column) -> Column:
    """Lowercase hex sha256 of all siblings on the path, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.flatten(F.transform(path, lambda p: F.array(p["l"], p["r"])))), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda digest, p: F.sha2(F.concat(p["l"], digest, p["r"]), 256))


def group_key(group: Column) -> Column:
    """A key that is never null and sorts null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _numbered(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """nodes with i, their place from 0 within g by `order`, and n, how many nodes g has.

    Nodes are dealt by range of (g, order), so a group of any size spreads over tasks. A range numbers its rows itself;
    how many rows of a group stand in ranges before it comes from the counts of (group, range).
    """
    dealt = nodes.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("row", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("part", F.shiftright("row", 33)), name)
    counts = dealt.groupBy("g", "part").agg(F.min("row").alias("first"), F.count("*").alias("k"))
    by_part = Window.partitionBy("g").orderBy("part")
    starts = counts.select("g", "part", "first", F.coalesce(F.sum("k").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("k").over(Window.partitionBy("g")).alias("n"))
    return dealt.join(starts, ["g", "part"]).withColumn("i", F.col("before") + F.col("row") - F.col("first")).drop("part", "row", "first", "before")


def _runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes of unfinished groups with their parent's place and digest and their siblings l and r.

    One full frame for each (group, parent): at most `fanout` nodes, whatever the group holds.
    """
    run = Window.partitionBy("g", "up").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = nodes.filter("n > 1").withColumn("up", F.floor(F.col("i") / fanout)).withColumn("run", F.collect_list("digest").over(run))
    at = F.pmod("i", F.lit(fanout)).cast("int")
    cut = lambda start, size: F.concat_ws("", F.slice("run", start, size))
    return held.select("*", F.sha2(F.concat_ws("", "run"), 256).alias("parent"), cut(F.lit(1), at).alias("l"), cut(at + 2, F.lit(fanout)).alias("r")).drop("run")


def _parents(runs: DataFrame, fanout: int) -> DataFrame:
    """One node for each run: of its rows, which all carry the parent's digest, the first speaks for it."""
    return runs.filter(F.pmod("i", F.lit(fanout)) == 0).select("g", F.col("up").alias("i"), F.ceil(F.col("n") / fanout).alias("n"), F.col("parent").alias("digest"))


def _above(nodes: DataFrame, fanout: int, name: str) -> tuple[DataFrame, DataFrame]:
    """For the parents of numbered leaves: (g, up, path from the parent to its group's root), and (g, root).

    Bottom up, each level's nodes are written with their siblings; top down, a node's path is its own siblings and then
    its parent's path. The last level is the parents of the leaves, a `fanout`th of them, so long strings are never made
    for more rows than that.
    """
    largest = nodes.agg(F.max("n")).first()[0] or 0
    roots = nodes.filter("n = 1").select("g", F.col("digest").alias("root"))
    levels, now = [], nodes
    while largest > 1:
        largest = -(-largest // fanout)
        parents = materialize(_parents(_runs(now, fanout), fanout), name)
        roots = roots.unionByName(parents.filter("n = 1").select("g", F.col("digest").alias("root")))
        levels.append(parents)
        now = parents
    paths = None
    for parents in reversed(levels):
        done = parents.filter("n = 1").select("g", F.col("i").alias("up"), F.expr(_NO_PATH).alias("path"))
        if paths is not None:
            own = _runs(parents, fanout).join(paths, ["g", "up"])
            done = done.unionByName(own.select("g", F.col("i").alias("up"), F.concat(F.array(F.struct("l", "r")).cast(PATH), "path").alias("path")))
        paths = done
    if paths is None:
        paths = nodes.sparkSession.createDataFrame([], f"g string, up bigint, path {PATH}")
    return paths, roots


def manifest(docs: DataFrame, columns: list[str], group: str = "source", order: str = "doc_id", keep: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row for each row of docs: the order column, the kept ones, leaf, subroot, root and path.

    Leaves are digests of `columns` (leaf_digest). A group's leaves stand by `order`, null first, equal ones by digest;
    while a level has several nodes, each run of `fanout` (the last may have fewer, even one) becomes the sha256 of its
    hex digests. What remains is the group's subroot; subroots by group, null first and then by UTF-8 bytes, become the
    root likewise. path: the siblings {l, r} of every level from the leaf to the root; a group or table of one node adds
    none. fold(leaf, path) is the root; proof_digest(path) names the siblings.

    Repeated rows are leaves of their own; equal leaves of one id may stand in either order, which changes no digest
    above them. Null values are `-`. Empty table: no rows. Columns not named don't matter. Texts are read once, to make
    leaves; only digests are shuffled. Groups of any size are numbered by ranges and folded run by run.
    """
    made = {"leaf": leaf_digest([F.col(c) for c in columns])} | (keep or {})
    rows = docs.select(group_key(F.col(group)).alias("g"), F.col(order).alias("__id"), *[c.alias(f"__{k}") for k, c in made.items()])
    leaves = materialize(_numbered(rows, ["__id", "__leaf"], "leaves").withColumnRenamed("__leaf", "digest"), "numbered")
    paths, subroots = _above(leaves.select("g", "i", "n", "digest"), fanout, "levels")
    top = _numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("__group"), F.col("root").alias("digest")), ["__group"], "subroots")
    top_paths, root = _above(top.select("g", "i", "n", "digest"), fanout, "top-levels")
    root = root.first()
    one = top.filter("n = 1").select(F.col("__group").alias("g"), F.col("digest").alias("subroot"), F.expr(_NO_PATH).alias("rest"))
    many = _runs(top, fanout).join(top_paths, ["g", "up"]).select(F.col("__group").alias("g"), F.col("digest").alias("subroot"), F.concat(F.array(F.struct("l", "r")).cast(PATH), "path").alias("rest"))
    groups = one.unionByName(many).withColumn("root", F.lit(root["root"] if root else None).cast("string"))
    single = leaves.filter("n = 1").withColumn("path", F.expr(_NO_PATH))
    several = _runs(leaves, fanout).join(paths, ["g", "up"]).withColumn("path", F.concat(F.array(F.struct("l", "r")).cast(PATH), "path"))
    own = [F.col("__id").alias(order), F.col("digest").alias("leaf"), *[F.col(f"__{k}").alias(k) for k in keep or {}]]
    both = single.select("g", *own, "path").unionByName(several.select("g", *own, "path"))
    return both.join(groups, "g").select(*[c for c in (order, *(keep or {}), "leaf", "subroot", "root")], F.concat("path", "rest").alias("path"))


def audit(rows: DataFrame, tampered: Column, path: str = "path") -> DataFrame:
    """manifest's rows with folded_root (what `tampered`, else the leaf, leads to) and verified (whether it is the root)."""
    folded = rows.withColumn("folded_root", fold(F.coalesce(tampered, F.col("leaf")), F.col(path)))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
