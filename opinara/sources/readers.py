"""Typed sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.sources.dumps import read_dumps

COMMENT = T.StructType([T.StructField(n, T.LongType() if n in ("created_utc", "score") else T.StringType()) for n in ("author", "author_fullname", "body", "created_utc", "id", "parent_id", "permalink", "score", "subreddit")])
SUBMISSION = T.StructType([T.StructField(n, T.LongType() if n in ("created_utc", "score", "num_comments") else T.StringType()) for n in ("author", "author_fullname", "title", "selftext", "created_utc", "id", "num_comments", "permalink", "score", "subreddit")])


def ndjson(spark: SparkSession, path: str, schema: T.StructType = COMMENT, keep: list[str] | None = None) -> DataFrame:
    """Compressed lines of JSON, with an explicit schema and, where given, only the rows of some communities."""
    df = spark.read.schema(schema).json(path)
    return df.where(F.col("subreddit").isin(keep)) if keep is not None else df


def long_window_zst(spark: SparkSession, path: str, schema: T.StructType = COMMENT, keep: list[str] | None = None) -> DataFrame:
    """For dumps with a window of 2**31 bytes, which the built-in reader refuses: one task a file, read as a stream."""
    return read_dumps(spark, path, schema, keep)


def year_month(path: Column) -> Column:
    """The YYYY-MM of a file name, null without one."""
    return F.nullif(F.regexp_extract(path, r"(\d{4}-\d{2})", 1), F.lit(""))


def pending(raw: DataFrame, done: DataFrame, key: str = "year_month") -> DataFrame:
    """Months that have a raw file and no processed one."""
    return raw.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")


def write_months(df: DataFrame, path: str, time: str = "created_utc") -> None:
    """Gzip Parquet, a folder for each month."""
    month = F.date_format(F.timestamp_seconds(time), "yyyy-MM")
    df.withColumn("year_month", month).write.mode("overwrite").partitionBy("year_month").option("compression", "gzip").parquet(path)


def write_samples(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def typed_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with a header; ids stay strings, as the schema is never inferred."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """topic and stance rows of a catalogue {topic_stances: [{topics, stances}]}."""
    schema = "topic_stances array<struct<topics:array<int>,stances:array<string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("topic_stances").alias("x"))
    return rows.select(F.explode("x.topics").alias("topic"), "x.stances").select("topic", F.explode("stances").alias("stance"))


def write_graph(edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet."""
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().write.mode("overwrite").parquet(f"{path}/nodes")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges without self-loops."""
    return spark.read.parquet(f"{path}/edges").where("src <> dst")


def write_once(df_of, spark: SparkSession, path: str) -> DataFrame:
    """A stored result: computed by df_of() and written where path holds none."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df_of().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path and year_month of the files whose name matches a pattern; the files themselves are not read."""
    found = spark.read.format("binaryFile").load(folder).select("path")
    return found.where(F.element_at(F.split("path", "/"), -1).rlike(pattern)).select("path", year_month(F.element_at(F.split("path", "/"), -1)).alias("year_month"))


def scan(spark: SparkSession, found: DataFrame, schema: str | T.StructType) -> DataFrame:
    """The rows of listed Parquet files with the year_month of their file. Columns are aligned with the schema by name: those
    that a file lacks are null, others are not read."""
    paths = [r["path"] for r in found.select("path").orderBy("path").collect()]  # names of files, not their rows
    if not paths:
        return spark.createDataFrame([], schema).withColumn("year_month", F.lit(None).cast("string"))
    return spark.read.schema(schema).parquet(*paths).withColumn("year_month", year_month(F.element_at(F.split(F.input_file_name(), "/"), -1)))


VIDEO = "video_id string, author_id string, author_name string, createtime timestamp, `desc` string, hashtags string, mentions string, share_video_id string, share_video_user_id string, share_type string"
VIDEO_COMMENT = "comment_id string, video_id string, author_id string, author_name string, createtime timestamp, text string, comment_language string, mentions string, reply_comment_id string"


def _lists(df: DataFrame, *columns: str) -> DataFrame:
    """Lists that a CSV cell holds as text, in either kind of quotes; an empty or unreadable cell is an empty list."""
    read = lambda c: F.coalesce(F.from_json(F.col(c), "array<string>"), F.array().cast("array<string>"))
    return df.withColumns({c: F.filter(read(c), lambda x: x.isNotNull()) for c in columns})


def videos(spark: SparkSession, path: str) -> DataFrame:
    """Videos with lists of hashtags and mentions, one row an id (the first by time)."""
    from opinara.operators.cohort import dedup_keyed

    rows = _lists(typed_csv(spark, path, VIDEO), "hashtags", "mentions")
    return dedup_keyed(rows.where(F.col("video_id").isNotNull()), ["video_id"], ["createtime", "author_id", "desc"])


def video_comments(spark: SparkSession, path: str) -> DataFrame:
    """Comments on videos with a list of mentions; without an id or a video they are left out."""
    rows = _lists(typed_csv(spark, path, VIDEO_COMMENT), "mentions")
    return rows.where(F.col("comment_id").isNotNull() & F.col("video_id").isNotNull())


def paired(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """Files of comments with the file of submissions of the same month; a month that lacks either is left out."""
    return comments.withColumnRenamed("path", "comments").join(submissions.withColumnRenamed("path", "submissions"), "year_month")


def file_sample(found: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """A share of the files that follows from their names."""
    return found.where(F.pmod(F.xxhash64(F.element_at(F.split("path", "/"), -1), F.lit(seed)), F.lit(1_000_000)) < fraction * 1_000_000)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics, or cases, of runs as lines of JSON."""
    metrics.write.mode("overwrite").json(path)


def finished_runs(spark: SparkSession, path: str, schema: str | T.StructType, state: str = "finished") -> DataFrame:
    """Runs in a state, from lines of JSON that hold a column `state`."""
    return spark.read.schema(schema).json(path).where(F.col("state") == state)


def write_sequences(events: DataFrame, path: str, key: str, time: str) -> None:
    """A row an event, sorted by key and time within files, so that a key's sequence is read as it stands."""
    events.repartitionByRange(key, time).sortWithinPartitions(key, time).write.mode("overwrite").option("compression", "zstd").parquet(path)


def topics_of(stances: DataFrame, known: DataFrame) -> DataFrame:
    """Stances with their topics of a catalogue; those that it does not hold have none."""
    return stances.join(known.select("topic", "stance"), "stance", "left")
