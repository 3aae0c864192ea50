from pyspark.sql import functions as F

from tracequarry.functions.json_walk import forbidden_keys, handles, leaves, schema_signature


def test_walks(spark):
    rows = [(1, '{"b": [1, 1.0, "x"], "a": {"file_id": "f1", "n": null, "t": true, "page_handle": 3}}'), (2, "not json"), (3, None), (4, "5"), (5, '{"description": "d", "p": [{"description": {"x": 1}, "k": 2}]}')]
    df = spark.createDataFrame(rows, "id int, j string")
    got = {r.id: r for r in df.select("id", leaves(F.col("j")).alias("l"), handles(F.col("j")).alias("h"), forbidden_keys(F.col("j"), ["n", "x"]).alias("f"), schema_signature(F.col("j")).alias("s")).collect()}
    assert [(x.path, x.key, x.value, x.kind) for x in got[1].l] == [
        ("$.a.file_id", "file_id", '"f1"', "string"), ("$.a.n", "n", "null", "null"), ("$.a.page_handle", "page_handle", "3", "integer"), ("$.a.t", "t", "true", "boolean"),
        ("$.b[0]", "b", "1", "integer"), ("$.b[1]", "b", "1.0", "number"), ("$.b[2]", "b", '"x"', "string"),
    ]
    assert [(h.value, h.path) for h in got[1].h] == [('"f1"', "$.a.file_id")] and got[1].f == ["$.a.n"]
    assert got[2].l == got[3].l == got[4].l == [] and got[2].s is None and got[4].s == "5"
    assert got[5].s == '{"p":[{"k":2}]}' and got[5].f == ["$.p[0].description.x"]
