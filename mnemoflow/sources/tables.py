"""Reading instances and conversations; writing results, and finding what is done already."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INSTANCE = "question_id string, question string, haystack_sessions array<array<struct<role:string,content:string>>>"
RESULT = (
    "question_id string, hypothesis string, memory_input_tokens bigint, memory_output_tokens bigint, memory_cost double, memory_time double, "
    "query_input_tokens bigint, query_output_tokens bigint, query_cost double, query_time double, question_input_tokens bigint, "
    "question_output_tokens bigint, question_cost double, question_time double, error string, traceback string"
)
SUMMARY_NAME = "run_summary.json"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, text."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """A vector collection: any table with an id and an array of floats."""
    return spark.read.parquet(path)


def keep_vectors(rows: DataFrame, name: str) -> DataFrame:
    """An in-memory collection for this session: cached, and a view of that name."""
    held = rows.persist()
    held.createOrReplaceTempView(name)
    return held


def store_messages(messages: DataFrame, path: str) -> None:
    """Appends messages(session_id, seq, role, text), a folder for each session."""
    messages.write.partitionBy("session_id").mode("append").parquet(path)


def stored_messages(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    """The messages of one session, read from its folder alone, or of all."""
    df = spark.read.schema("seq bigint, role string, text string, session_id string").parquet(path)
    return df if session_id is None else df.where(F.col("session_id") == session_id)


def instances(spark: SparkSession, path: str, lines: bool = False, first: int = 0, count: int | None = None) -> DataFrame:
    """Evaluation instances of a JSON array (or of files of JSON lines), with their position, cut by position.

    A JSON array is one task's work, by its format.  Lines are read in parallel; a row's position is its place in its
    partition plus the rows of the partitions before, which is one small row for each partition.
    """
    df = spark.read.schema(INSTANCE).option("multiLine", not lines).json(path).withColumn("id_", F.monotonically_increasing_id())
    df = df.withColumns({"part_": F.shiftright("id_", 33), "place_": F.col("id_").bitwiseAND(F.lit((1 << 33) - 1))}).drop("id_")
    sizes = df.groupBy("part_").agg(F.count("*").alias("n_"))
    ahead = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("ahead_"))
    df = df.join(F.broadcast(ahead), "part_").withColumn("pos", F.col("ahead_") + F.col("place_")).drop("part_", "place_", "ahead_")
    return df.where((F.col("pos") >= first) & (F.lit(True) if count is None else F.col("pos") < first + count))


def turns(instances: DataFrame) -> DataFrame:
    """question_id, session, turn, role, text: a row for each turn of each session."""
    sessions = instances.select("question_id", F.posexplode("haystack_sessions").alias("session", "s"))
    each = sessions.select("question_id", "session", F.posexplode("s").alias("turn", "t"))
    return each.select("question_id", F.col("session").cast("long").alias("session"), F.col("turn").cast("long").alias("turn"), "t.role", F.col("t.content").alias("text"))


def write_results(results: DataFrame, path: str, append: bool) -> None:
    """JSON lines; nulls are left out."""
    results.write.mode("append" if append else "overwrite").json(path)


def completed_ids(spark: SparkSession, path: str, retry_errors: bool = False) -> DataFrame:
    """question_id of every result that can be read; none if there is no such path.  retry_errors: those without an error."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "question_id string")
    df = spark.read.schema(RESULT).json(path).where("question_id is not null")
    if retry_errors:
        df = df.where("error is null")
    return df.select("question_id").distinct()


def remaining(instances: DataFrame, completed: DataFrame) -> DataFrame:
    return instances.join(completed, "question_id", "left_anti")


def write_summary(summary: DataFrame, folder: str) -> str:
    """The one row as indented JSON beside the results, through Spark's file system; its path."""
    spark, path = summary.sparkSession, f"{folder.rstrip('/')}/{SUMMARY_NAME}"
    body = json.dumps(summary.first().asDict(), indent=4)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()
    return path
