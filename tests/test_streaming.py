from pyspark.sql import functions as F

from tracequarry.operators.trace import recoveries
from tracequarry.sources.tables import trace
from tracequarry.streaming.episodes import STEPS, streaming_recoveries, windowed_failures


def run(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_stream_equals_batch_in_any_order(spark, sf_dir, tmp_path):
    t = trace(spark, sf_dir)
    steps = t.select(*[c.split()[0] for c in STEPS.split(", ")])
    expected = sorted(tuple(r) for r in recoveries(t).collect())
    # several files, out of order, some steps twice
    steps.union(steps.filter("step % 5 = 0")).orderBy(F.xxhash64("episode_id", "step")).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, streaming_recoveries(stream), "found")
    assert sorted(tuple(r) for r in got.collect()) == expected and expected


def test_windows(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got = run(spark, windowed_failures(stream), "windows", "complete")
    assert got.agg(F.sum("n")).first()[0] == e.count()
