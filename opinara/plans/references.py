"""Queries over reference points of interactions: as-of joins, vector windows, neighbours by similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.operators import reference_points, scans, similarity
from opinara.plans.register import Registry
from opinara.sources import fixtures
from opinara.sources.fixtures import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

WIDTH = 50
POSTS = """posts AS (SELECT vec_id AS content_id, vec_id % 40 AS author, CASE WHEN vec_id % 3 = 0 THEN 'video' ELSE 'comment' END AS kind, vec_id AS t, vec_id // 2 AS viewed_id, embedding::DOUBLE[] AS e FROM embeddings),
i AS (SELECT c.content_id, c.author AS user_id, c.t, c.viewed_id, v.kind, v.author AS viewed_author, c.e, v.e AS viewed FROM posts c JOIN posts v ON v.content_id = c.viewed_id WHERE c.kind = 'comment')"""
RINGS = """r0 AS (SELECT user_id AS a, viewed_author AS b FROM i WHERE user_id <> viewed_author), links AS (SELECT a, b FROM r0 UNION SELECT b, a FROM r0),
r1 AS (SELECT a, b FROM links WHERE a IN (SELECT user_id FROM i)),
r2 AS (SELECT DISTINCT x.a, y.b FROM r1 x JOIN links y ON x.b = y.a WHERE x.a <> y.b AND NOT EXISTS (SELECT 1 FROM r1 WHERE r1.a = x.a AND r1.b = y.b)),
r3 AS (SELECT DISTINCT x.a, y.b FROM r2 x JOIN links y ON x.b = y.a WHERE x.a <> y.b AND NOT EXISTS (SELECT 1 FROM r1 WHERE r1.a = x.a AND r1.b = y.b) AND NOT EXISTS (SELECT 1 FROM r2 WHERE r2.a = x.a AND r2.b = y.b)),
rings AS (SELECT a, b, 1 AS ring FROM r1 UNION ALL SELECT a, b, 2 FROM r2 UNION ALL SELECT a, b, 3 FROM r3)"""
POINTS = f"""near AS (SELECT b.content_id, 'global' AS point, p.e FROM base b JOIN posts p ON p.kind = b.kind AND p.t > b.t - {WIDTH} AND p.t < b.t
    UNION ALL SELECT b.content_id, 'ring_' || r.ring, p.e FROM base b JOIN rings r ON r.a = b.user_id JOIN posts p ON p.author = r.b AND p.kind = b.kind AND p.t > b.t - {WIDTH} AND p.t < b.t),
wide AS (SELECT content_id, point, unnest(range(len(e))) AS pos, unnest(e) AS x FROM near), means AS (SELECT content_id, point, pos, count(*) AS n, avg(x) AS x FROM wide GROUP BY ALL),
pts AS (SELECT content_id, point, max(n) AS n, list(x ORDER BY pos) AS v FROM means GROUP BY ALL UNION ALL SELECT content_id, 'viewed', 1, viewed FROM base UNION ALL SELECT content_id, 'prev', 1, p FROM base)
SELECT content_id, point, n, round(list_distance(v, u), 4) AS dist_user, round(list_cosine_similarity(v, u), 4) AS cos_user,
       CASE WHEN point <> 'prev' THEN round(list_distance(v, p), 4) END AS dist_prev, CASE WHEN point <> 'prev' THEN round(list_cosine_similarity(v, p), 4) END AS cos_prev
FROM pts JOIN (SELECT content_id, u, p FROM base) USING (content_id)"""


def _points(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    posts = fixtures.posts(spark, sf_dir)
    return reference_points.reference_points(fixtures.interactions(spark, sf_dir), posts, fixtures.rings(spark, sf_dir), WIDTH, mode)


@R.query(f"""WITH {POSTS}, {RINGS}, base AS (SELECT * FROM (SELECT *, e AS u, lag(e) OVER (PARTITION BY user_id ORDER BY t) AS p FROM i) WHERE p IS NOT NULL), {POINTS}""")
def reference_points_instantaneous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six reference points of every comment, against it and the user's comment before it."""
    return _points(spark, sf_dir, "instantaneous")


@R.query(f"""WITH {POSTS}, {RINGS}, d AS (SELECT content_id, user_id, t, unnest(range(len(e))) AS pos, unnest(e) AS x FROM i),
w AS (SELECT content_id, pos, avg(x) OVER (PARTITION BY user_id, pos ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, avg(x) OVER (PARTITION BY user_id, pos ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS u FROM d),
a AS (SELECT content_id, list(p ORDER BY pos) AS p, list(u ORDER BY pos) AS u FROM w WHERE p IS NOT NULL GROUP BY content_id), base AS (SELECT i.*, a.p, a.u FROM i JOIN a USING (content_id)), {POINTS}""")
def reference_points_changepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same against the means of what the user said before, and from then on."""
    return _points(spark, sf_dir, "changepoint")


SHIPMENTS = "s AS (SELECT o_custkey, l_shipdate, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@R.query(f"""WITH {SHIPMENTS}, j AS (SELECT o.o_orderkey, s.l_shipdate, s.l_orderkey, s.l_linenumber, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY s.l_shipdate DESC, s.l_orderkey DESC, s.l_linenumber DESC) AS rn
    FROM orders o LEFT JOIN s ON s.o_custkey = o.o_custkey AND s.l_shipdate < o.o_orderdate)
SELECT o_orderkey, l_shipdate AS last_shipdate, l_orderkey AS last_orderkey, l_linenumber AS last_linenumber FROM j WHERE rn = 1""")
def asof_shipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What had been shipped last to the customer before each order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    owners = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    shipped = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(owners, "l_orderkey")
    out = scans.asof(orders, shipped, ["o_custkey"], "o_orderdate", "l_shipdate", ["l_shipdate", "l_orderkey", "l_linenumber"], tie=["l_orderkey", "l_linenumber"])
    return out.select("o_orderkey", F.col("l_shipdate").alias("last_shipdate"), F.col("l_orderkey").alias("last_orderkey"), F.col("l_linenumber").alias("last_linenumber"))


@R.query(f"""WITH {POSTS}, s AS (SELECT c.content_id AS left_id, v.content_id AS right_id, round(list_cosine_similarity(c.e, v.e), 9) AS s FROM posts c, posts v WHERE c.kind = 'comment' AND v.kind = 'video')
SELECT left_id, right_id, round(s, 6) AS similarity, cast(row_number() OVER (PARTITION BY left_id ORDER BY s DESC, right_id) AS INT) AS rank FROM s QUALIFY rank <= 5""")
def similar_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five videos most like each comment, of all."""
    posts = fixtures.posts(spark, sf_dir)
    out = similarity.top_k(posts.where("kind = 'comment'"), posts.where("kind = 'video'"), "content_id", "content_id", "embedding", "embedding", 5)
    return out.withColumn("similarity", F.round("similarity", 6))


@R.query("""WITH s AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT left_id, right_id, round(s, 6) AS similarity, cast(row_number() OVER (PARTITION BY left_id ORDER BY s DESC, right_id) AS INT) AS rank FROM s QUALIFY rank <= 10""")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors most like each one, of all others, in blocks of 256 around pivots."""
    e = table(spark, sf_dir, "embeddings")
    out = similarity.top_k(e, e, "vec_id", "vec_id", "embedding", "embedding", 10, same=True, block_rows=256)
    return out.withColumn("similarity", F.round("similarity", 6))
