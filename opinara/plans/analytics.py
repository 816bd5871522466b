"""Queries over embeddings, movement, opinion time series, landscapes, polarization and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import scores
from opinara.operators import chains, graph, landscape, models, movement, opinions, polarization, vectors
from opinara.plans.register import CONTENTS, GRAPH, OPINIONS, PROFILES, SNAPSHOTS, Registry
from opinara.sources import fixtures
from opinara.sources.fixtures import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
TYPES = ["click", "error", "purchase", "signup", "view"]
DOUBLES = "list_transform({}, lambda x: x::DOUBLE)"


def _viewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixtures.contents(spark, sf_dir)
    return c.join(c.select(F.col("content_id").alias("viewed_id"), F.col("embedding").alias("viewed")), "viewed_id")


@R.query(f"""WITH {CONTENTS} SELECT a.content_id, round(list_distance({DOUBLES.format('a.embedding')}, {DOUBLES.format('b.embedding')}), 4) AS distance,
    round(list_cosine_similarity({DOUBLES.format('a.embedding')}, {DOUBLES.format('b.embedding')}), 4) AS similarity FROM contents a JOIN contents b ON a.viewed_id = b.content_id""")
def embedding_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _viewed(spark, sf_dir)
    return v.select("content_id", F.round(scores.euclidean(F.col("embedding"), F.col("viewed")), 4).alias("distance"), F.round(scores.cosine(F.col("embedding"), F.col("viewed")), 4).alias("similarity"))


CENTROIDS = """e AS (SELECT label AS topic, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings), cents AS (SELECT topic, pos, round(avg(x), 6) AS value FROM e GROUP BY ALL)"""


@R.query(f"WITH {CENTROIDS} SELECT topic, cast(pos AS INT) AS pos, value FROM cents")
def topic_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.centroids(fixtures.contents(spark, sf_dir), "topic")


@R.query(f"""WITH {CENTROIDS}, a AS (SELECT topic, list(value ORDER BY pos) AS c FROM cents GROUP BY topic),
d AS (SELECT vec_id AS content_id, topic, round(list_distance({DOUBLES.format('embedding')}, c), 4) AS distance FROM embeddings, a)
SELECT content_id, topic, distance FROM d QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY distance, topic) = 1""")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixtures.contents(spark, sf_dir)
    return vectors.nearest(c, vectors.assemble(vectors.centroids(c, "topic"), "topic"), "topic", "content_id")


@R.query(f"""WITH {CONTENTS}, p AS (SELECT *, lag(embedding) OVER (PARTITION BY author ORDER BY t) AS prev FROM contents)
SELECT content_id, author, round(list_distance({DOUBLES.format('embedding')}, {DOUBLES.format('prev')}), 4) AS distance FROM p WHERE prev IS NOT NULL""")
def prev_content_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vectors.with_previous(fixtures.contents(spark, sf_dir), "author", "t", "embedding").where("prev_embedding IS NOT NULL")
    return p.select("content_id", "author", F.round(scores.euclidean(F.col("embedding"), F.col("prev_embedding")), 4).alias("distance"))


@R.query(f"""WITH {CONTENTS}, x AS (SELECT content_id, author, t, embedding[1]::DOUBLE AS x FROM contents)
SELECT content_id, round(avg(x) OVER (PARTITION BY author ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS past_mean,
    round(avg(x) OVER (PARTITION BY author ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS future_mean FROM x""")
def changepoint_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fixtures.contents(spark, sf_dir).withColumn("x", F.col("embedding")[0].cast("double"))
    return movement.past_and_future(x, "author", "t", "x").select("content_id", "past_mean", "future_mean")


@R.query("""SELECT event_id, count(*) OVER w AS n_before, round(avg(value) OVER w, 6) AS mean_before FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 604799999999 PRECEDING AND 1 PRECEDING)""")
def trailing_window_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = movement.trailing(table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value"), "event_type", "ts", "value", 7)
    return out.select("event_id", "n_before", F.round("mean_before", 6).alias("mean_before"))


@R.query(f"""WITH {GRAPH}, {CONTENTS}, near AS (SELECT DISTINCT src, cast(substr(dst, 2) AS BIGINT) % 25 AS author FROM graph WHERE type = 'R'),
j AS (SELECT n.src, unnest(c.embedding)::DOUBLE AS x, unnest(range(len(c.embedding))) AS pos FROM near n JOIN contents c USING (author) WHERE c.t >= 50 AND c.t < 150)
SELECT src, cast(pos AS INT) AS pos, round(avg(x), 6) AS value FROM j GROUP BY ALL""")
def ring_window_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = fixtures.graph(spark, sf_dir).where("type = 'R'").select("src", (F.substring("dst", 2, 20).cast("long") % 25).alias("author"))
    c = fixtures.contents(spark, sf_dir).where("t >= 50 AND t < 150")
    return vectors.linked_centroids(near, c, "src", "author")


MOVES = f"""p AS (SELECT *, lag(embedding) OVER (PARTITION BY author ORDER BY t) AS prev FROM contents),
v AS (SELECT p.*, b.embedding AS viewed FROM p JOIN contents b ON p.viewed_id = b.content_id WHERE p.prev IS NOT NULL),
d AS (SELECT content_id, list_distance({DOUBLES.format('embedding')}, {DOUBLES.format('viewed')}) AS ou, list_distance({DOUBLES.format('prev')}, {DOUBLES.format('viewed')}) AS po, list_distance({DOUBLES.format('embedding')}, {DOUBLES.format('prev')}) AS up FROM v),
m AS (SELECT content_id, 1 / (1 + exp(ou - up)) AS between_, 1 / (1 + exp(-least(CASE WHEN po = 0 THEN ou ELSE (ou + up) / po - 1 END, 100.0))) AS away FROM d)"""


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors.with_previous(fixtures.contents(spark, sf_dir), "author", "t", "embedding").where("prev_embedding IS NOT NULL")
    viewed = fixtures.contents(spark, sf_dir).select(F.col("content_id").alias("viewed_id"), F.col("embedding").alias("viewed"))
    d = v.join(viewed, "viewed_id").select("content_id", scores.euclidean(F.col("embedding"), F.col("viewed")).alias("ou"), scores.euclidean(F.col("prev_embedding"), F.col("viewed")).alias("po"), scores.euclidean(F.col("embedding"), F.col("prev_embedding")).alias("up"))
    return d.select("content_id", scores.between(F.col("ou"), F.col("up")).alias("between_"), scores.away(F.col("ou"), F.col("po"), F.col("up")).alias("away"))


@R.query(f"WITH {CONTENTS}, {MOVES} SELECT content_id, round(between_, 6) AS between_, round(away, 6) AS away FROM m")
def movement_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves(spark, sf_dir).select("content_id", F.round("between_", 6).alias("between_"), F.round("away", 6).alias("away"))


HIST = """h AS (SELECT least(cast(floor((x - 0) / 0.01) AS BIGINT), 99) AS bin, count(*) AS n FROM x WHERE x BETWEEN 0 AND 1 GROUP BY 1)"""


@R.query("WITH x AS (SELECT value / 100 AS x FROM events), h AS (SELECT least(cast(floor(x / 0.01) AS BIGINT), 99) AS bin, count(*) AS n FROM x WHERE x BETWEEN 0 AND 1 GROUP BY 1) SELECT bin, n, round(n / (sum(n) OVER () * 0.01), 6) AS density FROM h")
def hist_density_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movement.density(table(spark, sf_dir, "events"), F.col("value") / 100, 0.0, 1.0, 100)


@R.query("""WITH x AS (SELECT count(*) AS x FROM orders GROUP BY o_custkey), s AS (SELECT ln(max(x)) / 19 AS step FROM x)
SELECT CASE WHEN step > 0 THEN least(cast(floor(round(ln(x) / step, 9)) AS BIGINT), 18) ELSE 0 END AS bin, count(*) AS n FROM x, s GROUP BY 1""")
def hist_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("c"))
    return movement.log_histogram(n, F.col("c"), 20)


@R.query("""WITH r AS (SELECT l_quantity AS x, l_discount * 100 AS y FROM lineitem), e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, count(*) AS total FROM r)
SELECT least(cast(floor((x - lx) / ((hx - lx) / 10)) AS BIGINT), 9) AS bx, least(cast(floor((y - ly) / ((hy - ly) / 10)) AS BIGINT), 9) AS by, count(*) AS n,
    round(count(*) * round(1.0::DOUBLE / (any_value(total) * ((any_value(hx) - any_value(lx)) / 10) * ((any_value(hy) - any_value(ly)) / 10)), 9), 6) AS density FROM r, e GROUP BY 1, 2""")
def hist_density_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movement.density_2d(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_discount") * 100, 10)


@R.query("""WITH h AS (SELECT cast(floor(l_quantity) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT min(bin) AS first_bin, max(bin) AS last_bin, arg_min(bin, (-n, bin)) AS peak_bin FROM h)
SELECT first_bin, last_bin, peak_bin, cast(sum(n) FILTER (bin >= last_bin - 10) AS BIGINT) AS n_most FROM h, e GROUP BY ALL""")
def hist_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movement.landmarks(table(spark, sf_dir, "lineitem").groupBy(F.floor("l_quantity").alias("bin")).agg(F.count("*").alias("n")))


@R.query(f"""WITH {OPINIONS} SELECT date_trunc('week', ts) AS week, user_id, stance, count(*) AS n, round(avg(predicted), 6) AS mean, round(var_pop(predicted), 6) AS variance FROM opinions GROUP BY ALL""")
def snapshot_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fixtures.opinions(spark, sf_dir).withColumn("week", F.date_trunc("week", F.col("ts")).cast("timestamp_ntz"))
    m = opinions.moments(o, "week", "user_id", "stance")
    return m.select("week", "user_id", "stance", "n", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@R.query(f"""WITH {OPINIONS}, w AS (SELECT user_id, stance, predicted, pow(2.0, -((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000) / 10.0) AS w FROM opinions WHERE ts < TIMESTAMP '2024-02-01')
SELECT user_id, stance, round(sum(predicted * w) / sum(w), 6) AS smoothed FROM w GROUP BY ALL""")
def exp_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opinions.smoothed(fixtures.opinions(spark, sf_dir), "2024-02-01 00:00:00", 10.0, "user_id", "stance")


ENDS = [f"2024-01-{d:02d} 00:00:00" for d in (6, 11, 16, 21, 26, 31)]


@R.query(f"WITH {OPINIONS}, e AS (SELECT unnest([" + ", ".join(f"'{e}'" for e in ENDS) + "]) AS until) SELECT stance, until, count(*) AS n, round(sum(predicted) / count(*), 6) AS mean FROM opinions JOIN e ON ts < cast(until AS TIMESTAMP) GROUP BY ALL")
def prefix_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opinions.prefixes(fixtures.opinions(spark, sf_dir), ENDS, "stance")


@R.query(f"""WITH {SNAPSHOTS}, r AS (SELECT user_id, stance, round(max(mean) - min(mean), 6) AS range FROM snapshots GROUP BY ALL)
SELECT stance, user_id, range, cast(row_number() OVER (PARTITION BY stance ORDER BY range DESC, user_id) AS INT) AS rank FROM r QUALIFY row_number() OVER (PARTITION BY stance ORDER BY range DESC, user_id) <= 3""")
def opinion_range_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = opinions.ranges(fixtures.snapshots(spark, sf_dir)).withColumn("range", F.round("range", 6))
    return opinions.top(r, "stance", "range", "user_id", 3)


@R.query(f"""WITH {SNAPSHOTS} SELECT * FROM (SELECT a.user_id, a.snapshot AS s1, b.snapshot AS s2, round(sqrt(sum(pow(a.mean - b.mean, 2))), 6) AS d FROM snapshots a JOIN snapshots b ON a.user_id = b.user_id AND a.stance = b.stance AND a.snapshot < b.snapshot
GROUP BY ALL HAVING count(*) = 5) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY d DESC, s1, s2) = 1""")
def max_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opinions.displacement(fixtures.snapshots(spark, sf_dir), 5)


PAIRS = SNAPSHOTS + """, pairs AS (SELECT a.snapshot, a.user_id, a.stance AS stance_x, b.stance AS stance_y, a.mean AS x, a.variance AS vx, b.mean AS y, b.variance AS vy
    FROM snapshots a JOIN snapshots b ON a.snapshot = b.snapshot AND a.user_id = b.user_id AND a.stance < b.stance)"""
KEYS = ("snapshot", "stance_x", "stance_y")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.stance_pairs(fixtures.snapshots(spark, sf_dir))


def _wls(where: str) -> str:
    return f"""WITH {PAIRS}, w AS (SELECT *, 1 / greatest((vx + vy) / 2, 0.01) AS w FROM pairs {where}),
s AS (SELECT snapshot, stance_x, stance_y, count(*) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy FROM w GROUP BY ALL),
c AS (SELECT *, sxy - sx * sy / sw AS cov, sxx - sx * sx / sw AS a, syy - sy * sy / sw AS b FROM s)
SELECT snapshot, stance_x, stance_y, n, round(cov / a, 6) AS slope, round((sy - cov / a * sx) / sw, 6) AS intercept, round(cov * cov / (a * b), 6) AS r2 FROM c"""


@R.query(_wls(""))
def stance_pair_wls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.regression(_pairs(spark, sf_dir), *KEYS)


@R.query(_wls("WHERE x <> 0 AND y <> 0"))
def stance_pair_wls_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.regression(_pairs(spark, sf_dir).where("x <> 0 AND y <> 0"), *KEYS)


@R.query(f"""WITH {PAIRS}, w AS (SELECT *, exp(-(vx + vy) / 2) AS w FROM pairs),
s AS (SELECT snapshot, stance_x, stance_y, count(*) AS n, corr(y, x) AS r, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy FROM w GROUP BY ALL)
SELECT snapshot, stance_x, stance_y, n, round(r, 6) AS pearson, round((sxy - sx * sy / sw) / sqrt((sxx - sx * sx / sw) * (syy - sy * sy / sw)), 6) AS weighted_pearson FROM s""")
def stance_pair_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.correlations(_pairs(spark, sf_dir), *KEYS)


@R.query()
def correlation_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = landscape.correlations(_pairs(spark, sf_dir), *KEYS).withColumn("t", F.round(landscape.t_statistic(F.col("pearson"), F.col("n")), 6))
    return c.withColumn("p_value", F.round(landscape.t_p_value(F.col("t"), F.col("n") - 2), 6))


@R.query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.bootstrap(_pairs(spark, sf_dir), 200, *KEYS)


def _kernel(m: str, v: str, bins: int) -> str:
    step = 2.0 / (bins - 1)
    return f"CASE WHEN {v} > 0 THEN exp(-pow(i * {step!r}::DOUBLE - 1 - {m}, 2) / (2 * greatest({v}, 1e-12))) WHEN floor(({m} + 1) / {step!r}::DOUBLE + 0.5) = i THEN 1.0 ELSE 0.0 END"


GAUSS = f"""k AS (SELECT snapshot, stance, user_id, i, {_kernel('mean', 'variance', 41)} AS v FROM snapshots, range(41) g(i)),
n AS (SELECT *, v / sum(v) OVER (PARTITION BY snapshot, stance, user_id) AS d FROM k),
g AS (SELECT snapshot, stance, cast(i AS INT) AS cell, round(i * {2.0 / 40!r}::DOUBLE - 1, 6) AS "at", round(sum(d) / count(*), 6) AS density FROM n GROUP BY ALL)"""


@R.query(f"WITH {SNAPSHOTS}, {GAUSS} SELECT * FROM g")
def gaussian_density_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.gaussian_density(fixtures.snapshots(spark, sf_dir), 41, "snapshot", "stance")


@R.query(f"""WITH {SNAPSHOTS}, {GAUSS} SELECT snapshot, stance, round(sum("at" * density) / sum(density), 6) AS density_mean FROM g GROUP BY ALL""")
def density_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.density_mean(landscape.gaussian_density(fixtures.snapshots(spark, sf_dir), 41, "snapshot", "stance"), "snapshot", "stance")


@R.query(f"""WITH {PAIRS}, kx AS (SELECT snapshot, stance_x, stance_y, user_id, i, {_kernel('x', 'vx', 25)} AS v FROM pairs, range(25) g(i)), ky AS (SELECT snapshot, stance_x, stance_y, user_id, i, {_kernel('y', 'vy', 25)} AS v FROM pairs, range(25) g(i)),
nx AS (SELECT *, v / sum(v) OVER (PARTITION BY snapshot, stance_x, stance_y, user_id) AS p FROM kx), ny AS (SELECT *, v / sum(v) OVER (PARTITION BY snapshot, stance_x, stance_y, user_id) AS p FROM ky)
SELECT nx.snapshot, nx.stance_x, nx.stance_y, cast(nx.i AS INT) AS cx, cast(ny.i AS INT) AS cy, round(sum(nx.p * ny.p) / count(*), 6) AS density FROM nx JOIN ny USING (snapshot, stance_x, stance_y, user_id) GROUP BY ALL""")
def gaussian_density_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.gaussian_density_2d(_pairs(spark, sf_dir), 25, *KEYS)


@R.query(f"""WITH {OPINIONS}, n AS (SELECT user_id, stance, predicted, count(*) AS c FROM opinions GROUP BY ALL), t AS (SELECT user_id, stance, sum(c) AS t FROM n GROUP BY ALL),
p AS (SELECT user_id, stance, predicted, c / t AS p FROM n JOIN t USING (user_id, stance)),
u AS (SELECT a.stance AS stance_x, b.stance AS stance_y, count(*) AS users FROM t a JOIN t b ON a.user_id = b.user_id AND a.stance < b.stance GROUP BY ALL)
SELECT a.stance AS stance_x, b.stance AS stance_y, a.predicted AS class_x, b.predicted AS class_y, round(sum(a.p * b.p) / any_value(users), 6) AS share FROM p a JOIN p b ON a.user_id = b.user_id AND a.stance < b.stance JOIN u ON u.stance_x = a.stance AND u.stance_y = b.stance GROUP BY ALL""")
def categorical_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.categorical_joint(fixtures.opinions(spark, sf_dir))


@R.query()
def beta_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.beta_density(fixtures.opinions(spark, sf_dir))


BELIEFS = SNAPSHOTS + ", b AS (SELECT snapshot, user_id, stance, 0.5 * (coalesce(mean, 0.0) + 1) AS b FROM snapshots)"


@R.query(f"""WITH {BELIEFS}, m AS (SELECT *, avg(b) OVER (PARTITION BY snapshot, stance) AS m FROM b) SELECT snapshot, round(sum(abs(b - m)) / (2 * count(DISTINCT user_id)), 6) AS polarization FROM m GROUP BY snapshot""")
def polarization_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polarization.symmetric(polarization.beliefs(fixtures.snapshots(spark, sf_dir)))


@R.query(f"""WITH {BELIEFS}, masks AS (SELECT unnest(range(1, 16)) AS mask), p AS (SELECT snapshot, mask, user_id, round(avg(b), 9) AS v FROM b, masks
    WHERE (mask & (1 << (list_position({TYPES!r}, stance) - 1)::INT)) <> 0 GROUP BY ALL),
r AS (SELECT snapshot, mask, v, row_number() OVER w AS i, sum(v) OVER w AS low, sum(v) OVER (PARTITION BY snapshot, mask) AS s, count(*) OVER (PARTITION BY snapshot, mask) AS n FROM p WINDOW w AS (PARTITION BY snapshot, mask ORDER BY v, user_id))
SELECT snapshot, cast(mask AS INT) AS mask, round(max((i * (s - low) - (n - i) * low) / (4.0 * n * n)), 6) AS polarization FROM r GROUP BY ALL""")
def polarization_asymmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polarization.asymmetric(polarization.beliefs(fixtures.snapshots(spark, sf_dir)), TYPES)


@R.query(f"""WITH {BELIEFS}, n AS (SELECT snapshot, stance, least(cast(floor(round(b * 10, 9)) AS BIGINT), 9) AS bin, count(*) AS c FROM b GROUP BY ALL),
p AS (SELECT snapshot, stance, (bin + 0.5::DOUBLE) / 10 AS x, c / sum(c) OVER (PARTITION BY snapshot, stance) AS p FROM n)
SELECT a.snapshot, a.stance, round(sum(pow(a.p, 2.6) * b.p * abs(a.x - b.x)), 6) AS polarization FROM p a JOIN p b USING (snapshot, stance) GROUP BY ALL""")
def polarization_esteban_ray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polarization.esteban_ray(polarization.beliefs(fixtures.snapshots(spark, sf_dir)))


@R.query(f"""WITH {OPINIONS}, {PROFILES}, s AS (SELECT stance, predicted, classifier_id, count(*) AS n FROM opinions GROUP BY ALL), h AS (SELECT *, n / sum(n) OVER (PARTITION BY stance, predicted) AS share FROM s)
SELECT h.stance, h.predicted, p.predicted AS said, round(sum(share * prob), 6) AS prob FROM h JOIN profiles p ON h.classifier_id = p.classifier_id AND h.predicted = p.actual GROUP BY ALL""")
def classifier_shares_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opinions.emission(opinions.classifier_shares(fixtures.opinions(spark, sf_dir)), fixtures.profiles(spark))


STEPS = OPINIONS + """, st AS (SELECT stance, community, predicted, lead(predicted) OVER (PARTITION BY user_id, stance ORDER BY ts, event_id) AS next FROM opinions)"""


@R.query(f"WITH {STEPS} SELECT stance, predicted, next, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY stance, predicted), 6) AS share FROM st WHERE next IS NOT NULL GROUP BY stance, predicted, next")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opinions.transitions(fixtures.opinions(spark, sf_dir), "stance").withColumn("share", F.round("share", 6))


@R.query(f"""WITH {STEPS}, p AS (SELECT stance, community, predicted, next, count(*) / sum(count(*)) OVER (PARTITION BY stance, community, predicted) AS share FROM st WHERE next IS NOT NULL GROUP BY stance, community, predicted, next),
f AS (SELECT k.stance, k.community, i.v AS a, j.v AS b FROM (SELECT DISTINCT stance, community FROM p) k, (VALUES (-1), (0), (1)) i(v), (VALUES (-1), (0), (1)) j(v))
SELECT f.stance, f.community, round(sqrt(sum(pow(coalesce(share, 0) - CASE WHEN a = b THEN 1 ELSE 0 END, 2))), 6) AS movement FROM f LEFT JOIN p ON p.stance = f.stance AND p.community = f.community AND p.predicted = a AND p.next = b GROUP BY ALL""")
def frobenius_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opinions.frobenius(opinions.transitions(fixtures.opinions(spark, sf_dir), "stance", "community"), "stance", "community")


@R.query(f"""WITH {SNAPSHOTS}, w AS (SELECT user_id, snapshot, max(mean) FILTER (stance = 'click') AS x, max(mean) FILTER (stance = 'view') AS y FROM snapshots GROUP BY ALL),
s AS (SELECT *, lead(x) OVER (PARTITION BY user_id ORDER BY snapshot) - x AS dx, lead(y) OVER (PARTITION BY user_id ORDER BY snapshot) - y AS dy FROM w)
SELECT least(cast(floor(round((x + 1) / 2 * 10, 9)) AS BIGINT), 9) AS cx, least(cast(floor(round((y + 1) / 2 * 10, 9)) AS BIGINT), 9) AS cy, count(*) AS n, round(avg(dx), 6) AS dx, round(avg(dy), 6) AS dy FROM s WHERE dx IS NOT NULL AND dy IS NOT NULL GROUP BY 1, 2""")
def flow_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.flow_field(fixtures.snapshots(spark, sf_dir), "click", "view")


@R.query(f"""WITH {OPINIONS}, {PROFILES}, g AS (SELECT i, i * 0.05::DOUBLE - 1 AS t FROM range(41) r(i)),
l AS (SELECT classifier_id, predicted, i, ln(sum(prob * CASE actual WHEN 0 THEN 1 - abs(t) WHEN 1 THEN greatest(t, 0.0) ELSE greatest(-t, 0.0) END)) AS ll FROM profiles, g GROUP BY ALL),
c AS (SELECT user_id, stance, classifier_id, predicted, count(*) AS c FROM opinions GROUP BY ALL), s AS (SELECT user_id, stance, i, sum(c * ll) AS ll FROM c JOIN l USING (classifier_id, predicted) GROUP BY ALL),
w AS (SELECT user_id, stance, i * 0.05::DOUBLE - 1 AS t, exp(ll - max(ll) OVER (PARTITION BY user_id, stance)) AS w FROM s)
SELECT user_id, stance, round(sum(w * t) / sum(w), 6) AS mean, round(sum(w * t * t) / sum(w) - pow(sum(w * t) / sum(w), 2), 6) AS variance FROM w GROUP BY ALL""")
def stance_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.posterior(fixtures.opinions(spark, sf_dir), fixtures.profiles(spark))


@R.query(f"""WITH {OPINIONS}, {PROFILES}, t AS (SELECT classifier_id, predicted, sum(prob) AS total, max(prob) FILTER (actual = predicted) AS hit FROM profiles GROUP BY ALL)
SELECT user_id, stance, round(sum(predicted * (hit / total)) / sum(hit / total), 6) AS mean, round(sum(predicted * predicted * (hit / total)) / sum(hit / total) - pow(sum(predicted * (hit / total)) / sum(hit / total), 2), 6) AS variance FROM opinions JOIN t USING (classifier_id, predicted) GROUP BY ALL""")
def precision_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opinions.precision_mean(fixtures.opinions(spark, sf_dir), fixtures.profiles(spark), "user_id", "stance")


@R.query()
def hmm_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.hmm(fixtures.opinions(spark, sf_dir), fixtures.profiles(spark))


@R.query()
def spline_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.splines(fixtures.opinions(spark, sf_dir))


@R.query()
def predict_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.predict(fixtures.comments(spark, sf_dir).select("id", "body"), models.lexicon, "body").select("id", "predicted")


@R.query(f"""WITH {GRAPH}, c AS (SELECT DISTINCT src AS user, dst AS node, 1 AS ring FROM graph WHERE type = 'A') SELECT * FROM c""")
def first_ring_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.graph(spark, sf_dir).where("type = 'A'")
    return graph.rings(e, e.select(F.col("src").alias("user")).distinct(), 1)
