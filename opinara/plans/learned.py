"""Queries over fitted models: topics, principal components, a stance classifier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.operators import classifier, cohort, reduction, topics
from opinara.plans.register import Registry
from opinara.sources.fixtures import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

TOPICS, STEPS = 10, 3


def _lloyd_sql() -> str:
    """A query a step: rows to their nearest centroid, centroids to the means of their rows."""
    parts = [
        "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)",
        f"k0 AS (SELECT row_number() OVER (ORDER BY (vec_id * 2654435761) % 1000003, vec_id) - 1 AS c, v FROM e QUALIFY c < {TOPICS})",
    ]
    near = lambda i: f"n{i} AS (SELECT vec_id, v, c, d FROM (SELECT e.vec_id, e.v, k.c, list_distance(e.v, k.v) AS d, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(e.v, k.v), k.c) AS rn FROM e, k{i} k) WHERE rn = 1)"
    for i in range(STEPS):
        parts.append(near(i))
        parts.append(f"w{i} AS (SELECT c, unnest(range(len(v))) AS pos, unnest(v) AS x FROM n{i})")
        parts.append(f"m{i} AS (SELECT c, list(x ORDER BY pos) AS v FROM (SELECT c, pos, avg(x) AS x FROM w{i} GROUP BY c, pos) GROUP BY c)")
        parts.append(f"k{i + 1} AS (SELECT k.c, coalesce(m.v, k.v) AS v FROM k{i} k LEFT JOIN m{i} m USING (c))")
    parts.append(near(STEPS))
    parts.append(f"s AS (SELECT c, count(*) AS n, quantile_disc(d, 0.95) AS r FROM n{STEPS} GROUP BY c)")
    parts.append("t AS (SELECT c, r, row_number() OVER (ORDER BY n DESC, c) - 1 AS topic FROM s)")
    return f"WITH {', '.join(parts)} SELECT vec_id, cast(CASE WHEN d <= r THEN topic ELSE -1 END AS INT) AS topic, round(d, 4) AS distance FROM n{STEPS} JOIN t USING (c)"


@R.query(_lloyd_sql())
def topic_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten topics after three steps from ten given rows, the farthest twentieth of each being outliers."""
    e = table(spark, sf_dir, "embeddings")
    first = cohort.fixed_size(e, "vec_id", TOPICS).collect()  # ten rows
    rows = topics.rows_of(e, "vec_id", "embedding")
    model = topics.fit(rows, TOPICS, rounds=STEPS, least_share=0, trims=0, tolerance=0, start={0: np.array([r["embedding"] for r in first], float)})
    return model.transform(rows).select(F.col("id").alias("vec_id"), "topic", F.round("distance", 4).alias("distance"))


@R.query()
def topic_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of all rows, fitted on half of them, and topics within each topic."""
    rows = topics.rows_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topics.nested(rows, TOPICS, 4, fraction=0.5).withColumnRenamed("id", "vec_id")


@R.query("""WITH w AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT pos, avg(x) AS m FROM w GROUP BY pos)
SELECT a.pos AS i, b.pos AS j, round(avg(a.x * b.x) - any_value(ma.m) * any_value(mb.m), 6) AS value FROM w a JOIN w b ON a.vec_id = b.vec_id JOIN m ma ON ma.pos = a.pos JOIN m mb ON mb.pos = b.pos GROUP BY ALL""")
def embedding_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cov = reduction.covariance(reduction.known(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    cells = [(i, j, round(float(cov[i, j]), 6) + 0.0) for i in range(len(cov)) for j in range(len(cov))]
    return spark.createDataFrame(cells, "i int, j int, value double")


@R.query()
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two coordinates of every embedding, of directions fitted on a quarter of them."""
    e = table(spark, sf_dir, "embeddings")
    mean, lines, _ = reduction.components(reduction.known(e, "vec_id", "embedding"), 2)
    out = reduction.project(e, "vec_id", "embedding", mean, lines)
    return out.select(F.col("id").alias("vec_id"), F.round(F.col("v")[0], 4).alias("x"), F.round(F.col("v")[1], 4).alias("y"))


def stance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, stance, held_out: of good documents favor, of toxic ones against, of others neutral; a fifth is held out."""
    stance = F.when(F.col("toxic") == 1, "against").when(F.col("quality") == 1, "favor").otherwise("neutral")
    return table(spark, sf_dir, "labels").select("doc_id", stance.alias("stance"), (cohort.scatter("doc_id", 5) == 0).alias("held_out"))


@R.query()
def stance_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stance of every document, learned from the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = docs.join(stance_labels(spark, sf_dir).where("NOT held_out"), "doc_id")
    model = classifier.fit(train, "text", "stance")
    return model.predict(docs, "doc_id", "text").select(F.col("id").alias("doc_id"), "predicted", F.round("probability", 4).alias("probability"))
