"""What a user could have been moved by: six reference points of every interaction.

prev is what the user had said before, viewed the item that was answered, global all content of the viewed item's kind in
the time before, and ring 1, 2, 3 what the user's neighbours at those distances contributed to it. Each is compared with
what the user says now and with what the user had said before, by Euclidean distance and cosine similarity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions.scores import cosine, euclidean
from opinara.operators.scans import ROWS, asof
from opinara.operators.vector_windows import mean, plus, sums_before, trailing_sums, vector_sum


def instantaneous(interactions: DataFrame, content: DataFrame, rows: int = ROWS) -> DataFrame:
    """interactions with user_v, the vector of the interaction itself, and prev_v, that of the user's content before it."""
    said = content.select("user_id", F.col("t").alias("said_t"), "content_id", F.col("embedding").alias("prev_v"))
    out = asof(interactions, said, ["user_id"], "t", "said_t", ["prev_v"], tie=["content_id"], rows=rows)
    return out.withColumnRenamed("embedding", "user_v").where("prev_v IS NOT NULL")


def changepoint(interactions: DataFrame, content: DataFrame, rows: int = ROWS) -> DataFrame:
    """interactions with prev_v, the mean of all that the user had said before, and user_v, that of all from then on."""
    said = content.select("user_id", "t", "embedding")
    past = sums_before(interactions.drop("embedding"), said, ["user_id"], "t", "embedding", rows=rows).where("n_before > 0")
    whole = said.groupBy("user_id").agg(F.count("embedding").alias("n_all"), vector_sum("embedding").alias("sum_all"))
    both = past.join(whole, "user_id").withColumn("n_after", F.col("n_all") - F.col("n_before")).where("n_after > 0")
    after = both.withColumn("sum_after", plus("sum_all", "sum_before", -1))
    return after.withColumn("prev_v", mean("sum_before", "n_before")).withColumn("user_v", mean("sum_after", "n_after")).drop("n_before", "sum_before", "n_all", "sum_all", "n_after", "sum_after")


def windows(interactions: DataFrame, content: DataFrame, rings: DataFrame, width: float, rows: int = ROWS) -> DataFrame:
    """content_id, point (global, ring_1, ...), n and v: the mean of the content of the viewed kind in (t - width, t).
    content: author, kind, t, embedding; rings: user_id, neighbour, ring."""
    point = lambda name: F.struct("content_id", name.alias("point")).alias("key")
    asked = interactions.select(point(F.lit("global")), "kind", "t")
    everyone = trailing_sums(asked, content, "key", ["kind"], "t", "embedding", width, rows)
    writers = content.select("kind", "author").distinct()
    near = interactions.join(rings, "user_id").select(point(F.concat(F.lit("ring_"), F.col("ring").cast("string"))), "kind", F.col("neighbour").alias("author"), "t")
    ringed = trailing_sums(near.join(writers, ["kind", "author"], "left_semi"), content, "key", ["kind", "author"], "t", "embedding", width, rows)
    return everyone.unionByName(ringed).select("key.*", "n", mean("sum", "n").alias("v"))


def reference_points(interactions: DataFrame, content: DataFrame, rings: DataFrame, width: float, mode: str = "instantaneous", digits: int = 4, rows: int = ROWS) -> DataFrame:
    """A row for each interaction with a past and each of its reference points that has content: content_id, point, n,
    dist_user, cos_user, dist_prev, cos_prev (null for prev itself).

    interactions: content_id, user_id, t, viewed_id, kind (of what is viewed) and embedding; content: content_id, author,
    kind, t, embedding; own content of a user is what the interactions say."""
    said = interactions.select("content_id", "user_id", "t", "embedding")
    own = (instantaneous if mode == "instantaneous" else changepoint)(interactions, said, rows)
    base = own.select("content_id", "user_id", "t", "kind", "viewed_id", "user_v", "prev_v")
    seen = content.select(F.col("content_id").alias("viewed_id"), "kind", F.col("embedding").alias("v"))
    viewed = base.join(seen, ["viewed_id", "kind"]).select("content_id", F.lit("viewed").alias("point"), F.lit(1).cast("long").alias("n"), F.col("v").cast("array<double>").alias("v"))
    around = windows(base.select("content_id", "user_id", "kind", "t"), content, rings, width, rows)
    vectors = base.select("content_id", "user_v", "prev_v")
    others = viewed.unionByName(around).join(vectors, "content_id")
    past = base.select("content_id", F.lit("prev").alias("point"), F.lit(1).cast("long").alias("n"), F.col("prev_v").cast("array<double>").alias("v"), "user_v", F.lit(None).cast("array<double>").alias("prev_v"))
    each = others.withColumn("prev_v", F.col("prev_v").cast("array<double>")).unionByName(past)
    return each.select("content_id", "point", "n", *(F.round(f(F.col("v"), F.col(f"{who}_v")), digits).alias(f"{name}_{who}") for who in ("user", "prev") for name, f in (("dist", euclidean), ("cos", cosine))))
