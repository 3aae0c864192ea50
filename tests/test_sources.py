import json

import pytest

from tracequarry.sources import jsonl


def test_lenient_and_strict(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "t": "é"}\n\n  \n[1]\nnot json\n{"id": 2}\n{"id": "x"}\n', encoding="utf-8")
    assert sorted((r.id, r.t) for r in jsonl.read_lenient(spark, str(p), "id long, t string").filter("id is not null").collect()) == [(1, "é"), (2, None)]
    good, bad = jsonl.read_strict(spark, str(p), "id long, t string")
    assert sorted(r.id for r in good.collect()) == [1, 2]
    assert sorted(r.line for r in bad.collect()) == ["[1]", "not json", '{"id": "x"}']
    assert jsonl.read_lenient(spark, str(tmp_path / "none"), "id long").count() == 0


def test_write_and_shards(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "id long, v double")
    jsonl.write(df, str(tmp_path / "o0"), sanitize=True)
    jsonl.write(df, str(tmp_path / "o1"), sanitize=True)
    back = jsonl.read_shards(spark, [str(tmp_path / "o0"), str(tmp_path / "o1")], "id long, v double").collect()
    assert sorted((r.shard, r.id, r.v is None) for r in back) == [(0, 1, True), (0, 2, False), (1, 1, True), (1, 2, False)]


def test_bundles(spark, tmp_path):
    for name, manifest, files in (("a", {"task_id": "a", "plan_file": "p/plan.json"}, {"p/plan.json": "[1]"}), ("b", {"plan_file": "../x.json", "env_file": "gone.json"}, {}), ("c", {}, {})):
        d = tmp_path / "in" / name
        d.mkdir(parents=True)
        (d / "manifest.json").write_text(json.dumps(manifest))
        for f, text in files.items():
            (d / f).parent.mkdir(exist_ok=True)
            (d / f).write_text(text)
    rows = {r.folder.rsplit("/", 1)[1]: r for r in jsonl.read_bundles(spark, str(tmp_path / "in")).collect()}
    assert rows["a"].members == {"plan_file": "[1]"} and rows["a"].errors == []
    assert rows["b"].errors == ["missing gone.json", "unsafe path ../x.json"] and rows["c"].errors == []
    assert [r.folder.rsplit("/", 1)[1] for r in jsonl.discover(spark, str(tmp_path / "in")).collect()] == ["a", "b", "c"]
    df = spark.createDataFrame([("t1", "x"), ("t2", "y")], "task_id string, plan string")
    jsonl.write_bundles(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exists"):
        jsonl.write_bundles(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    before = jsonl.digest(spark, str(tmp_path / "in"))
    assert before == jsonl.digest(spark, str(tmp_path / "in"))
    (tmp_path / "in" / "c" / "manifest.json").write_text("{ }")
    assert before != jsonl.digest(spark, str(tmp_path / "in"))


def test_archive(spark):
    old = spark.createDataFrame([("a", 1)], "task_id string, score int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4), ("c", 5)], "task_id string, score int")
    add, rejected = jsonl.archive_add(old, new)
    assert [(r.task_id, r.score) for r in add.collect()] == [("b", 3)]
    assert sorted((r.task_id, r.reason) for r in rejected.collect()) == [("a", "in_archive"), ("c", "repeated"), ("c", "repeated")]
    assert add.columns == old.columns


