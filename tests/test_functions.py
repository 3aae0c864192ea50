import pytest
from pyspark.sql import functions as F

from tracequarry.functions import text as T
from tracequarry.functions.predicates import Compiler, paths, syntax_errors
from tracequarry.operators.ordering import global_ordinal


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).collect()[0].x


def test_text(spark):
    t = "First open the App, then click Log In. Step 1: choose. Steps!"
    assert one(spark, T.hits(F.col("t"), T.STRONG_KEYWORDS), t=t) == 2  # app, log in
    assert one(spark, T.procedural_score(F.col("t")), t=t) == 2 * 4 + 4 + 2
    assert one(spark, T.sentences(F.col("t")), t="A b. C? D!  e") == ["A b.", "C?", "D!", "e"]
    assert one(spark, T.bucketize(F.col("n"), [1, 5]), n=6) == "gt_5" and one(spark, T.bucketize(F.col("n"), [1, 5]), n=5) == "le_5"
    assert one(spark, T.paths_overlap(F.col("a"), F.col("b")), a="$state.a", b="$state.ab")
    assert one(spark, T.pointer_token(F.col("a")), a="a/b~c") == "a~1b~0c"
    assert one(spark, T.redacted(F.col("a"), F.col("b")), a="x key y key", b="key") == "x *** y ***"
    for name, safe in (("a/b.txt", True), ("/a", False), ("a/../b", False), ("C:x", False), ("a\\b", False), ("a//b", False), ("", False), ("..a", True)):
        assert one(spark, T.is_safe_name(F.col("a")), a=name) is safe
    assert one(spark, T.graph_tool_names(F.col("g")), g="a (x_1) -> (b) -> (2c)") == ["x_1", "b"]


STATE = '{"a": {"b": 3, "s": "x", "n": null, "l": [1, 2]}, "t": true}'


@pytest.mark.parametrize(
    ("predicate", "strict", "loose"),
    [
        ({"eq": ["$state.a.b", 3.0]}, True, True),
        ({"gt": ["$state.a.b", 3]}, False, False),
        ({"in": ["$state.a.s", ["y", "x"]]}, True, True),
        ({"eq": ["$state.t", "true"]}, False, False),
        ({"exists": "$state.a.n"}, True, True),
        ({"not_exists": "$state.z"}, True, True),
        ({"eq": ["$state.z", 1]}, None, False),
        ({"all": [{"gte": ["$state.a.l[1]", 2]}, {"not": {"lt": ["$state.a.b", 1]}}]}, True, True),
        ({"any": [{"ne": ["$state.a.s", "x"]}, {"lte": ["$state.a.s", "x"]}]}, True, True),
        (True, True, True),
    ],
)
def test_predicates(spark, predicate, strict, loose):
    df = spark.createDataFrame([(STATE,)], "j string").select(F.parse_json("j").alias("state"))
    row = df.select(Compiler("state")(predicate).alias("s"), Compiler("state", strict=False)(predicate).alias("l")).collect()[0]
    assert (row.s, row.l) == (strict, loose)
    assert syntax_errors(predicate) == []


def test_predicate_errors():
    assert syntax_errors({"all": []}) and syntax_errors({"eq": [1]}) and syntax_errors({"eq": [1, 2], "ne": [1, 2]}) and syntax_errors({"what": 1}) and syntax_errors(3)
    assert paths({"all": [{"eq": ["$state.a", "$args.b"]}, {"exists": "$state.c"}]}) == {"$state.a", "$args.b", "$state.c"}
    with pytest.raises(ValueError):
        Compiler("state")({"eq": [1, 2], "ne": [1, 2]})


def test_global_ordinal(spark):
    df = spark.range(0, 3000, 3).repartition(7)
    got = {r.id: r.ordinal for r in global_ordinal(df, "id").collect()}
    assert got == {i: i // 3 + 1 for i in range(0, 3000, 3)}
    assert global_ordinal(df.limit(0), "id").count() == 0
