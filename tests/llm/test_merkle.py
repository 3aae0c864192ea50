import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tracequarry.llm.merkle import audit, fold, leaf_digest, manifest, proof_digest
from tracequarry.llm.queries import op11_merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def tree(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def path_of(levels, i, fanout):
    for level in levels[:-1]:
        a = i // fanout * fanout
        yield level[a:i], level[i + 1 : a + fanout]
        i //= fanout


def brute(rows, fanout=16):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    trees = [tree([leaf_of(r) for r in groups[s]], fanout) for s in order]
    top = tree([t[-1][0] for t in trees], fanout)
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            path = [*path_of(trees[k], i, fanout), *path_of(top, k, fanout)]
            now = leaf_of(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                now = leaf_of(r.asDict() | {"text": r["text"] and r["text"].translate(SMALL)})
            for left, right in path:
                now = digest("".join(left) + now + "".join(right))
            proof = digest("".join("".join(a) + "".join(b) for a, b in path))
            out.append((r["doc_id"], leaf_of(r), trees[k][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=repr)


def small():
    return F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def found(docs, fanout=16):
    touched = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_digest([*[F.col(c) for c in COLUMNS[:-1]], small()]))
    rows = audit(manifest(docs, COLUMNS, keep={"touched": touched}, fanout=fanout), F.col("touched"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")), "folded_root", "verified")
    return sorted(map(tuple, rows.collect()), key=repr)


def test_whole_table(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = op11_merkle(spark, folder)
    assert rows.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, rows.collect()), key=repr)
    assert got == brute(docs) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [1, 1, 1], [16, 17, 1, 2], [5] * 20, [300, 4]])
def test_shapes_of_groups(spark, sizes):
    rows = [(1000 * k + i, f"Text {i}", "en", f"s{k:03}", i) for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(docs) == brute(docs.collect())


def test_fanout_of_three(spark):
    rows = [(i, f"Text {i}", "en", "ab"[i % 7 > 1], i) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(docs, 3) == brute(docs.collect(), 3)


def test_odd_rows_and_clashing_columns(spark, odd_docs, no_docs):
    expected = brute(odd_docs.collect())
    assert found(odd_docs) == expected
    clashing = odd_docs.select("*", *[F.lit("x").alias(c) for c in ("g", "i", "n", "up", "leaf", "digest", "path", "root", "row", "part", "l", "r")])
    assert found(clashing) == expected
    assert found(no_docs) == []


def test_null_sources_come_before_all_others(spark):
    rows = [(1, "a", "en", "", 1), (2, "b", "en", None, 1), (3, "c", "en", "é", 1), (4, "d", "en", "z", 1), (5, "e", "en", "A", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(docs) == brute(docs.collect())


def test_one_large_group_spreads_over_tasks(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("T"), "id").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    rows = manifest(docs, COLUMNS)
    assert rows.filter(fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert rows.select(F.size("path")).distinct().collect()[0][0] == 4
    assert found(docs) == brute(docs.collect())
