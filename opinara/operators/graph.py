"""Edges of interaction graphs, degrees and neighbour rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interaction_edges(videos: DataFrame, comments: DataFrame) -> DataFrame:
    """The five kinds of edges between authors, null-filled where a kind lacks a column."""
    edge = lambda df, src, dst, kind: df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), F.unix_timestamp("createtime").alias("unix_time"))
    on_video = comments.join(videos.select("video_id", F.col("author_id").alias("video_author")), "video_id")
    mentions = comments.where(F.size("mentions") > 0).withColumn("mention", F.explode("mentions")).select("author_id", "mention", "createtime").distinct()
    shares = videos.where(F.col("share_video_user_id").isNotNull())
    said = videos.where(F.size("mentions") > 0).withColumn("mention", F.explode("mentions"))
    roots = comments.select(F.col("comment_id").alias("reply_comment_id"), F.col("author_id").alias("root_author"))
    replies = comments.where(F.col("reply_comment_id").isNotNull()).join(roots, "reply_comment_id")
    parts = [edge(on_video, "author_id", "video_author", "video_comment"), edge(mentions, "author_id", "mention", "comment_mention"), edge(shares, "author_id", "share_video_user_id", "video_share"), edge(said, "author_id", "mention", "video_mention"), edge(replies, "author_id", "root_author", "comment_reply")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """How many nodes have each degree, for each type and over all; every edge counts at both ends."""
    ends = edges.where("src <> dst").select("type", F.explode(F.array("src", "dst")).alias("node"))
    each = ends.groupBy("type", "node").agg(F.count("*").alias("degree"))
    every = each.groupBy("node").agg(F.sum("degree").alias("degree")).withColumn("type", F.lit("all"))
    return each.unionByName(every).groupBy("type", "degree").agg(F.count("*").alias("n_nodes"))


def settled(df: DataFrame) -> DataFrame:
    """Written to the session's checkpoint folder, if it has one, so that a lost executor does not repeat earlier rings."""
    spark = df.sparkSession
    return df.checkpoint() if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() else df


def rings(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """user, node, ring: nodes at distance 1 to depth from each seed, regardless of direction."""
    both = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = settled(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    seen = seeds.select("user", F.col("user").alias("node"), F.lit(0).alias("ring"))
    front = seen
    for k in range(1, depth + 1):
        step = front.join(both, front["node"] == both["a"]).select("user", F.col("b").alias("node")).distinct()
        front = step.join(seen.select("user", "node"), ["user", "node"], "left_anti").withColumn("ring", F.lit(k))
        front = settled(front)
        seen = seen.unionByName(front)
    return seen.where("ring > 0")
