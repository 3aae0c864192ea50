"""JSON-lines sources and sinks, bundle folders, and append-only archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def read_lenient(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of a JSONL path; blank lines and lines that aren't objects are left out, a missing path has no rows."""
    parsed = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], parsed)
    rows = lines.filter(F.trim("value").startswith("{")).select(F.from_json("value", parsed, {"columnNameOfCorruptRecord": "__bad"}).alias("r"))
    return rows.filter("r is not null").select("r.*")


def read_strict(spark: SparkSession, path: str, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines with file and text): what isn't a JSON object of the schema is data for the caller to refuse."""
    parsed = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    wide = StructType([*parsed.fields]).add("__bad", "string")
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).filter(F.trim("value") != "")
    rows = lines.withColumn("r", F.from_json("value", wide, {"columnNameOfCorruptRecord": "__bad"}))
    broken = F.col("r").isNull() | F.col("r.__bad").isNotNull() | ~F.trim("value").startswith("{")
    return rows.filter(~broken).select(*[F.col(f"r.{f.name}") for f in parsed.fields]), rows.filter(broken).select("file", F.col("value").alias("line"))


def write(df: DataFrame, path: str, sanitize: bool = False) -> None:
    """One JSON object a line; sanitize writes maps' NaN values as null instead of failing readers."""
    out = df
    if sanitize:
        for name, kind in df.dtypes:
            if kind in ("double", "float"):
                out = out.withColumn(name, F.when(F.isnan(name), None).otherwise(F.col(name)))
    out.write.mode("overwrite").json(path)


def read_shards(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Shard outputs as one table, with the shard's number."""
    parts = [read_lenient(spark, p, schema).withColumn("shard", F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def discover(spark: SparkSession, root: str, name: str = "manifest.json") -> DataFrame:
    """path, folder and size of every file of that name below root, sorted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    return files.select("path", F.regexp_replace("path", r"/[^/]+$", "").alias("folder"), F.col("length").alias("size")).orderBy("path")


def read_bundles(spark: SparkSession, root: str) -> DataFrame:
    """One row a folder that has a manifest: folder, members (name -> text), errors.

    A member that the manifest names by a *_file key has to be a portable relative path and exist.
    """
    from tracequarry.functions.text import is_safe_name

    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("wholetext", "true").text(root).withColumn("path", F.input_file_name())
    heads = files.filter(F.col("path").endswith("/manifest.json")).select(F.regexp_replace("path", r"/manifest\.json$", "").alias("folder"), F.col("value").alias("manifest"))
    listed = F.map_filter(F.from_json("manifest", "map<string,string>"), lambda k, _: k.endswith("_file"))
    wanted = heads.select("folder", "manifest", F.explode_outer(listed).alias("role", "member")).withColumn("path", F.concat_ws("/", "folder", "member"))
    got = wanted.join(files.select("path", "value"), "path", "left")
    error = F.when(F.col("member").isNotNull() & ~is_safe_name(F.col("member")), F.concat(F.lit("unsafe path "), F.col("member"))).when(F.col("member").isNotNull() & F.col("value").isNull(), F.concat(F.lit("missing "), F.col("member")))
    return got.groupBy("folder").agg(
        F.first("manifest").alias("manifest"),
        F.map_from_entries(F.collect_list(F.when(error.isNull() & F.col("role").isNotNull(), F.struct("role", "value")))).alias("members"),
        F.array_sort(F.array_compact(F.collect_list(error))).alias("errors"),
    )


def write_bundles(bundles: DataFrame, path: str) -> None:
    """One folder a bundle; an existing target is refused."""
    bundles.write.mode("errorifexists").partitionBy("task_id").json(path)


def archive_add(archive: DataFrame, candidates: DataFrame, key: str = "task_id") -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected): a key that the archive has, or that comes again among the candidates, is rejected."""
    counted = candidates.join(candidates.groupBy(key).agg(F.count("*").alias("__n")), key)
    known = archive.select(key).distinct().withColumn("__known", F.lit(True))
    marked = counted.join(known, key, "left")
    fresh = F.col("__known").isNull() & (F.col("__n") == 1)
    reason = F.when(F.col("__known"), "in_archive").otherwise("repeated")
    return marked.filter(fresh).drop("__n", "__known"), marked.filter(~fresh).withColumn("reason", reason).drop("__n", "__known")


#: Parts of a folder that are hashed on their own.
CELLS = 4096


def digest(spark: SparkSession, root: str) -> str:
    """SHA-256 over the names and SHA-256 of the files below root; file contents never leave the executors.

    Files are dealt to CELLS by their names' hash; each cell's sorted list is hashed, then the cells' hashes are in order.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    hashed = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    each = files.select(F.pmod(F.xxhash64("path"), F.lit(CELLS)).alias("cell"), F.concat_ws(":", "path", F.sha2("content", 256)).alias("d"))
    cells = each.groupBy("cell").agg(F.concat_ws(":", F.format_string("%08d", "cell"), hashed("d")).alias("d"))
    return cells.agg(hashed("d").alias("h")).first()["h"]
