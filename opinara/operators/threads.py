"""Threaded context of comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions import text


def with_context(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """Each comment with its post and the comment it answers."""
    posts = submissions.select(F.col("permalink").alias("post_permalink"), "title", "selftext")
    parents = comments.select(F.col("id").alias("parent_specific_id"), F.col("body").alias("body_parent"), F.col("author").alias("author_parent"), F.col("permalink").alias("permalink_parent"))
    own = comments.withColumn("post_permalink", text.post_permalink(F.col("permalink"))).withColumn("is_base_comment", F.coalesce(F.col("parent_id").contains("t3_"), F.lit(False))).withColumn("parent_specific_id", text.parent_of(F.col("parent_id")))
    return own.join(posts, "post_permalink", "left").join(parents, "parent_specific_id", "left")


def with_root(replies: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Replies with the root they belong to, whose columns get the suffix _reply."""
    named = roots.select(F.col(key), *(F.col(c).alias(f"{c}_reply") for c in roots.columns if c != key))
    return replies.join(named, key, "left")
