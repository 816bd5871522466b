"""Adapters that project the driver's tables onto the engine's data model (all deterministic)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per observed opinion: user, target (stance), time, predicted in -1/0/1, classifier, community."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.col("event_type").alias("stance"),
        "ts",
        k.alias("k"),
        F.when(k < 33, -1).when(k < 66, 0).otherwise(1).alias("predicted"),
        (F.col("event_id") % 3).alias("classifier_id"),
        (F.col("user_id") % 4).alias("community"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threaded comments: id, parent id of the previous turn (t1_, or t3_ for the first reply), permalinks, text."""
    conv = F.col("conv_id").cast("string")
    prev = F.col("turn") - 1
    return table(spark, sf_dir, "conversations").select(
        F.concat(conv, F.lit("x"), F.col("turn").cast("string")).alias("id"),
        F.when(F.col("turn") == 0, None).when(F.col("turn") == 1, F.concat(F.lit("t3_"), conv)).otherwise(F.concat(F.lit("t1_"), conv, F.lit("x"), prev.cast("string"))).alias("parent_id"),
        F.concat(F.lit("/r/sub/comments/"), conv, F.lit("/title/"), F.when(F.col("turn") > 0, F.concat(F.col("turn").cast("string"), F.lit("/"))).otherwise("")).alias("permalink"),
        F.col("role").alias("author"),
        F.col("text").alias("body"),
        "conv_id",
        "turn",
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of each conversation as a post."""
    conv = F.col("conv_id").cast("string")
    return table(spark, sf_dir, "conversations").where("turn = 0").select(conv.alias("id"), F.concat(F.lit("/r/sub/comments/"), conv, F.lit("/title/")).alias("permalink"), F.col("role").alias("title"), F.col("text").alias("selftext"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content with an embedding, an author, a time and the content it replies to."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(v.alias("content_id"), (v % 25).alias("author"), v.alias("t"), F.col("label").alias("topic"), F.floor(v / 2).cast("bigint").alias("viewed_id"), "embedding")


def profiles(spark: SparkSession) -> DataFrame:
    """Confusion of three classifiers: diagonal 0.9, 0.8, 0.7, the remainder split equally."""
    rows = [(c, t, p, d if t == p else round((1 - d) / 2, 4)) for c, d in ((0, 0.9), (1, 0.8), (2, 0.7)) for t in (-1, 0, 1) for p in (-1, 0, 1)]
    return spark.createDataFrame(rows, "classifier_id long, actual int, predicted int, prob double")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population variance of opinions for each half of the month, user and target."""
    from opinara.operators.opinions import moments

    half = F.when(F.dayofmonth("ts") <= 15, 1).otherwise(2).alias("snapshot")
    return moments(opinions(spark, sf_dir).select(half, "user_id", "stance", "predicted"), "snapshot", "user_id", "stance")


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions: customer to supplier, typed by return flag."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate")
    return lines.join(orders, "l_orderkey").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.col("l_returnflag").alias("type"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("unix_time"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table of labels: doc_id, annotator 1 to 3, label."""
    side = lambda yes, a, b: F.when(yes, a).otherwise(b)
    wide = table(spark, sf_dir, "labels").select(
        "doc_id",
        side(F.col("quality") == 1, "favor", "against").alias("a1"),
        side(F.col("toxic") == 1, "against", "favor").alias("a2"),
        F.when(F.col("doc_id") % 3 == 0, "favor").when(F.col("doc_id") % 3 == 1, "neutral").otherwise("against").alias("a3"),
    )
    return wide.select("doc_id", F.explode(F.array(*(F.struct(F.lit(i).alias("annotator"), F.col(f"a{i}").alias("label")) for i in (1, 2, 3)))).alias("x")).select("doc_id", "x.annotator", "x.label")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold (annotator 1) and predicted (annotator 3) labels."""
    a = annotations(spark, sf_dir)
    gold = a.where("annotator = 1").select("doc_id", F.col("label").alias("gold"))
    return gold.join(a.where("annotator = 3").select("doc_id", F.col("label").alias("predicted")), "doc_id")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos and comments with an embedding: content_id, author, kind, t, viewed_id (what a comment answers)."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(v.alias("content_id"), (v % 40).alias("author"), F.when(v % 3 == 0, "video").otherwise("comment").alias("kind"), v.alias("t"), F.floor(v / 2).cast("bigint").alias("viewed_id"), "embedding")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments with the kind and author of what they answer."""
    p = posts(spark, sf_dir)
    seen = p.select(F.col("content_id").alias("viewed_id"), "kind", F.col("author").alias("viewed_author"))
    said = p.where("kind = 'comment'").select("content_id", F.col("author").alias("user_id"), "t", "viewed_id", "embedding")
    return said.join(seen, "viewed_id")


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every user up to a distance of three: user_id, neighbour, ring."""
    from opinara.operators.graph import rings as around

    edges = interactions(spark, sf_dir).select(F.col("user_id").alias("src"), F.col("viewed_author").alias("dst")).distinct()
    users = edges.select(F.col("src").alias("user")).distinct()
    return around(edges, users).select(F.col("user").alias("user_id"), F.col("node").alias("neighbour"), "ring")
