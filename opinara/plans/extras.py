"""Queries over interactions, windows of months and steps, references of movement, checks and small helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinara.functions import scores, text
from opinara.operators import chains, cohort, graph, landscape, models, movement, polarization, scans, vectors
from opinara.plans.analytics import BELIEFS, DOUBLES, PAIRS, TYPES
from opinara.plans.register import COMMENTS, CONTENTS, OPINIONS, SNAPSHOTS, Registry
from opinara.sources import fixtures
from opinara.sources.fixtures import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

INTERACTIONS = """videos AS (SELECT doc_id AS video_id, doc_id % 50 AS author_id, CASE WHEN doc_id % 3 = 0 THEN [doc_id % 7, doc_id % 13] ELSE [] END AS mentions, CASE WHEN doc_id % 4 = 0 THEN doc_id % 11 END AS share_video_user_id, 1700000000 + doc_id AS t FROM documents),
comments AS (SELECT conv_id * 100 + turn AS comment_id, (conv_id + turn) % 60 AS author_id, conv_id AS video_id, CASE WHEN turn > 1 THEN conv_id * 100 + turn - 1 END AS reply_comment_id, CASE WHEN turn % 2 = 0 THEN [conv_id % 5] ELSE [] END AS mentions, 1710000000 + conv_id * 100 + turn AS t FROM conversations)"""


def _interactions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    none = F.array().cast("array<bigint>")
    d, c = F.col("doc_id"), F.col("conv_id")
    videos = table(spark, sf_dir, "documents").select(d.alias("video_id"), (d % 50).alias("author_id"), F.when(d % 3 == 0, F.array(d % 7, d % 13)).otherwise(none).alias("mentions"), F.when(d % 4 == 0, d % 11).alias("share_video_user_id"), F.timestamp_seconds(d + 1_700_000_000).alias("createtime"))
    at = c * 100 + F.col("turn")
    comments = table(spark, sf_dir, "conversations").select(at.alias("comment_id"), ((c + F.col("turn")) % 60).alias("author_id"), c.alias("video_id"), F.when(F.col("turn") > 1, at - 1).alias("reply_comment_id"), F.when(F.col("turn") % 2 == 0, F.array(c % 5)).otherwise(none).alias("mentions"), F.timestamp_seconds(at + 1_710_000_000).alias("createtime"))
    return videos, comments


@R.query(f"""WITH {INTERACTIONS}, e AS (
    SELECT c.author_id AS src, v.author_id AS dst, 'video_comment' AS type, c.t AS unix_time FROM comments c JOIN videos v USING (video_id)
    UNION ALL SELECT * FROM (SELECT DISTINCT author_id, unnest(mentions), 'comment_mention', t FROM comments)
    UNION ALL SELECT author_id, share_video_user_id, 'video_share', t FROM videos WHERE share_video_user_id IS NOT NULL
    UNION ALL SELECT author_id, unnest(mentions), 'video_mention', t FROM videos
    UNION ALL SELECT a.author_id, b.author_id, 'comment_reply', a.t FROM comments a JOIN comments b ON a.reply_comment_id = b.comment_id)
SELECT src, dst, type, unix_time FROM e""")
def interaction_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.interaction_edges(*_interactions(spark, sf_dir))


@R.query("""WITH o AS (SELECT o_custkey, date_trunc('month', o_orderdate)::TIMESTAMP AS month, o_totalprice FROM orders),
c AS (SELECT o_custkey, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::TIMESTAMP AS month FROM o GROUP BY o_custkey)
SELECT c.o_custkey, c.month, count(o.month) AS n, round(avg(o_totalprice), 4) AS mean FROM c LEFT JOIN o ON o.o_custkey = c.o_custkey AND o.month = c.month GROUP BY ALL""")
def month_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of every customer in every calendar month from the first to the last, empty months too."""
    out = movement.monthly(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_totalprice")
    return out.withColumn("month", F.col("month").cast("timestamp_ntz")).withColumn("mean", F.round("mean", 4))


@R.query(f"WITH {OPINIONS}, n AS (SELECT stance, predicted, row_number() OVER (PARTITION BY stance ORDER BY event_id) AS i, count(*) OVER (PARTITION BY stance) AS n FROM opinions) SELECT stance, cast(floor((i - 1) / greatest(n // 4, 1)) AS BIGINT) AS step, count(*) AS n, round(avg(predicted), 6) AS mean FROM n GROUP BY 1, 2")
def step_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = scans.running(fixtures.opinions(spark, sf_dir), "event_id", {"n": F.lit(1).cast("long")}, "stance")
    step = F.floor((F.col("run_n") - 1) / F.greatest(F.floor(F.col("total_n") / 4), F.lit(1)))
    return o.groupBy("stance", step.alias("step")).agg(F.count("*").alias("n"), F.round(F.avg("predicted"), 6).alias("mean"))


@R.query(f"""WITH {BELIEFS}, masks AS (SELECT unnest(range(1, 16)) AS mask), p AS (SELECT snapshot, mask, user_id, round(avg(b), 9) AS v FROM b, masks
    WHERE (mask & (1 << (list_position({TYPES!r}, stance) - 1)::INT)) <> 0 GROUP BY ALL),
r AS (SELECT snapshot, mask, v, row_number() OVER w AS i, sum(v) OVER w AS low, sum(v) OVER (PARTITION BY snapshot, mask) AS s, count(*) OVER (PARTITION BY snapshot, mask) AS n FROM p WINDOW w AS (PARTITION BY snapshot, mask ORDER BY v, user_id)),
z AS (SELECT snapshot, cast(mask AS INT) AS mask, round(max((i * (s - low) - (n - i) * low) / (4.0 * n * n)), 6) AS polarization FROM r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY polarization DESC, mask) AS top, row_number() OVER (PARTITION BY snapshot ORDER BY polarization, mask) AS bottom FROM z)
SELECT snapshot, mask, polarization, cast(top AS INT) AS top, cast(bottom AS INT) AS bottom FROM k WHERE top <= 5 OR bottom <= 5""")
def partition_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = polarization.asymmetric(polarization.beliefs(fixtures.snapshots(spark, sf_dir)), TYPES)
    w = Window.partitionBy("snapshot")  # 15 rows each
    k = z.withColumn("top", F.row_number().over(w.orderBy(F.desc("polarization"), "mask"))).withColumn("bottom", F.row_number().over(w.orderBy("polarization", "mask")))
    return k.where("top <= 5 OR bottom <= 5")


REFERENCES = f"""p AS (SELECT *, lag(embedding) OVER (PARTITION BY author ORDER BY t) AS prev FROM contents),
v AS (SELECT p.*, b.embedding AS viewed FROM p JOIN contents b ON p.viewed_id = b.content_id WHERE p.prev IS NOT NULL)"""


def _sql_distances() -> str:
    out = []
    for n, base in (("user", "embedding"), ("prev", "prev")):
        out += [f"round(list_distance({DOUBLES.format(base)}, {DOUBLES.format('viewed')}), 4) AS dist_{n}_viewed", f"round(list_cosine_similarity({DOUBLES.format(base)}, {DOUBLES.format('viewed')}), 4) AS cos_{n}_viewed"]
    return ", ".join(out)


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors.with_previous(fixtures.contents(spark, sf_dir), "author", "t", "embedding").where("prev_embedding IS NOT NULL")
    seen = fixtures.contents(spark, sf_dir).select(F.col("content_id").alias("viewed_id"), F.col("embedding").alias("viewed"))
    return vectors.reference_distances(c.join(seen, "viewed_id"), "embedding", "prev_embedding", "viewed")


@R.query(f"WITH {CONTENTS}, {REFERENCES} SELECT content_id, {_sql_distances()} FROM v")
def reference_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(spark, sf_dir).select("content_id", *(f"{m}_{n}_viewed" for n in ("user", "prev") for m in ("dist", "cos")))


@R.query(f"""WITH {CONTENTS}, {REFERENCES}, d AS (SELECT content_id, {_sql_distances()} FROM v), c AS (SELECT content_id, cast(floor(dist_user_viewed * 2) AS BIGINT) AS cx, cast(floor(dist_prev_viewed * 2) AS BIGINT) AS cy FROM d)
SELECT cx, cy, content_id FROM c QUALIFY row_number() OVER (PARTITION BY cx, cy ORDER BY content_id) <= 3""")
def examples_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _references(spark, sf_dir).select(F.floor(F.col("dist_user_viewed") * 2).alias("cx"), F.floor(F.col("dist_prev_viewed") * 2).alias("cy"), "content_id")
    w = Window.partitionBy("cx", "cy").orderBy("content_id")  # a window group limit cuts each partition before the shuffle
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 3").drop("rank")


@R.query(f"WITH {CONTENTS} SELECT a.content_id, b.topic FROM contents a JOIN contents b ON a.viewed_id = b.content_id")
def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixtures.contents(spark, sf_dir)
    known = c.select(F.col("content_id").alias("viewed_id"), "topic")
    return cohort.lookup_one(c.select("content_id", "viewed_id"), known, "viewed_id").select("content_id", "topic")


@R.query("""WITH a AS (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 60), n AS (SELECT event_type, count(*) AS n_events, sum(CASE WHEN user_id IN (SELECT user_id FROM a) THEN 1 ELSE 0 END) AS n_active, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type)
SELECT event_type, n_events, cast(n_active AS BIGINT) AS n_active, n_active = n_events AS covered, n_users = (SELECT count(DISTINCT user_id) FROM events) AS all_users FROM n""")
def activity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether active users account for all events of a type, and whether every user has some."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id")
    known = cohort.active(e, 60, "user_id").groupBy("event_type").agg(F.count("*").alias("n_active"))
    each = e.groupBy("event_type", "user_id").agg(F.count("*").alias("n")).groupBy("event_type").agg(F.sum("n").alias("n_events"), F.count("*").alias("n_users"))
    users = e.select("user_id").distinct().agg(F.count("*").alias("n_all"))
    out = each.join(known, "event_type", "left").crossJoin(F.broadcast(users)).withColumn("n_active", F.coalesce("n_active", F.lit(0)))
    return out.select("event_type", "n_events", "n_active", (F.col("n_active") == F.col("n_events")).alias("covered"), (F.col("n_users") == F.col("n_all")).alias("all_users"))


@R.query("SELECT event_id, row_number() OVER (ORDER BY ((event_id + 7) * 2654435761) % 1000003, event_id % 1048576) AS rn FROM events")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.shuffled(table(spark, sf_dir, "events").select("event_id"), "event_id", 7)


SETS = {
    "labelled documents": ("SELECT doc_id FROM labels", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"),
    "all documents": ("SELECT doc_id FROM labels", "SELECT doc_id FROM documents"),
    "toxic and the rest": ("SELECT doc_id FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id FROM labels WHERE toxic = 0", "SELECT doc_id FROM labels"),
    "sources of twice": ("SELECT source FROM documents UNION ALL SELECT source FROM documents", "SELECT source FROM documents"),
}


@R.query(" UNION ALL ".join(f"SELECT '{name}' AS pair, NOT EXISTS (({a}) EXCEPT ALL ({b})) AND NOT EXISTS (({b}) EXCEPT ALL ({a})) AS same" for name, (a, b) in SETS.items()))
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tables that hold the same rows equally often, and pairs that do not."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ids, source = labels.select("doc_id"), docs.select("source")
    sides = (ids, docs.join(ids, "doc_id", "left_semi").select("doc_id")), (ids, docs.select("doc_id")), (labels.where("toxic = 1").select("doc_id").unionByName(labels.where("toxic = 0").select("doc_id")), ids), (source.unionByName(source), source)
    out = [cohort.same_rows(a, b).select(F.lit(name).alias("pair"), "same") for name, (a, b) in zip(SETS, sides, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@R.query("SELECT doc_id, 'quality' AS target, quality AS label FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def dataset_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda t: table(spark, sf_dir, "labels").select("doc_id", F.lit(t).alias("target"), F.col(t).alias("label"))
    return part("quality").unionByName(part("toxic"))


@R.query(f"""WITH {COMMENTS}, p AS (SELECT a.id, a.body, b.body AS prev, c.body AS viewed FROM comments a LEFT JOIN comments b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 LEFT JOIN comments c ON a.conv_id = c.conv_id AND c.turn = 0 AND a.turn > 0)
SELECT id, NOT ((length(body) < 10 AND length(coalesce(prev, '')) < 10 AND length(coalesce(viewed, '')) < 10) OR coalesce(body = prev, false)) AS good FROM p""")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a comment, the one before it and the post it answers are not all short, and the first two differ."""
    c = fixtures.comments(spark, sf_dir)
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("body").alias("prev"))
    posts = c.where("turn = 0").select("conv_id", F.col("body").alias("post"))
    texts = c.join(before, ["conv_id", "turn"], "left").join(posts, "conv_id", "left").withColumn("viewed", F.when(F.col("turn") > 0, F.col("post")))
    return texts.select("id", scores.text_quality("body", "prev", "viewed").alias("good"))


@R.query(f"WITH {COMMENTS} SELECT author, count(*) AS n FROM (SELECT CASE WHEN turn % 5 = 3 THEN '[deleted]' ELSE author END AS author FROM comments) WHERE author <> '[deleted]' GROUP BY author")
def author_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixtures.comments(spark, sf_dir).select(F.when(F.col("turn") % 5 == 3, "[deleted]").otherwise(F.col("author")).alias("author"))
    return cohort.without_tombstones(c).groupBy("author").agg(F.count("*").alias("n"))


@R.query("SELECT l.doc_id, d.source, row_number() OVER (ORDER BY l.doc_id) AS rn FROM labels l JOIN documents d USING (doc_id)")
def ordered_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = cohort.numbered(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return placed.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


@R.query(f"""WITH {COMMENTS}, a AS (SELECT id, turn, CASE WHEN conv_id % 3 = 0 THEN 'yes' ELSE 'no' END AS f, CASE WHEN turn % 2 = 0 THEN 'yes' ELSE 'no' END AS g, ['favor', 'neutral', 'against'][turn % 3 + 1] AS c FROM comments)
SELECT id, CASE WHEN f = 'yes' AND g = 'no' THEN 'favor' WHEN f = 'no' AND g = 'yes' THEN 'against' ELSE 'neutral' END AS resolved, c AS choice, 'on ' || turn AS stance FROM a""")
def answer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two questions, a choice at the end of an answer, and a field of a completion."""
    yes = lambda x: F.when(x, "yes").otherwise("no")
    choice = F.element_at(F.array(F.lit("favor"), F.lit("neutral"), F.lit("against")), (F.col("turn") % 3 + 1).cast("int"))
    answer = F.concat(F.lit("The answer is "), choice)
    completion = F.concat(F.lit("Reasoning: because\nStance: on "), F.col("turn").cast("string"), F.lit("\nEnd: x"))
    c = fixtures.comments(spark, sf_dir)
    return c.select("id", text.resolve_two(yes(F.col("conv_id") % 3 == 0), yes(F.col("turn") % 2 == 0)).alias("resolved"), text.choice_suffix(answer, "favor", "neutral", "against").alias("choice"), *text.fields(completion, "Stance"))


@R.query("SELECT user_id, round(1704067200 + (user_id % 12) * ((1735689600 - 1704067200) / 11), 3) AS at FROM (SELECT DISTINCT user_id FROM events)")
def time_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    return u.select("user_id", F.round(cohort.rescale(F.col("user_id") % 12, 12, 1_704_067_200, 1_735_689_600), 3).alias("at"))


@R.query(f"""WITH {CONTENTS}, {REFERENCES}, d AS (SELECT list_distance({DOUBLES.format('viewed')}, {DOUBLES.format('prev')}) AS d FROM v),
n AS (SELECT cast(round(d * 4) AS BIGINT) AS d4, count(*) AS n FROM d WHERE d > 0 GROUP BY 1), g AS (SELECT i, j FROM range(1, 21) a(i), range(1, 21) b(j))
SELECT cast(i AS INT) AS i, cast(j AS INT) AS j, sum(n)::BIGINT AS n, round(sum(n / (1 + exp((i - j) * 0.1::DOUBLE * d4 / 4))) / sum(n), 6) AS between_, round(1 / (1 + exp(-least((i + j) * 0.1::DOUBLE - 1, 100.0))), 6) AS away FROM g, n GROUP BY i, j""")
def movement_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both metrics over a grid of distances to the viewed and to the previous item, in tenths of the distance between the
    two, as a mean over all interactions; these are first counted by that distance, in quarters."""
    v = _references(spark, sf_dir).select(scores.euclidean(F.col("viewed"), F.col("prev_embedding")).alias("d")).where("d > 0")
    n = v.groupBy(F.round(F.col("d") * 4).cast("long").alias("d4")).agg(F.count("*").alias("n"))
    axis = lambda c: F.explode(F.sequence(F.lit(1), F.lit(20))).alias(c)
    g = n.select("*", axis("i")).select("*", axis("j")).withColumn("ou", F.col("i") * 0.1 * F.col("d4") / 4).withColumn("up", F.col("j") * 0.1 * F.col("d4") / 4)
    far = scores.away(F.col("i") * 0.1, F.lit(1.0), F.col("j") * 0.1)
    return g.groupBy("i", "j").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * scores.between(F.col("ou"), F.col("up"))) / F.sum("n"), 6).alias("between_"), F.round(F.first(far), 6).alias("away"))


@R.query(f"WITH {OPINIONS}, m AS (SELECT user_id, stance, max(CASE WHEN predicted > 0 THEN 1 ELSE 0 END) AS open FROM opinions GROUP BY ALL) SELECT user_id, stance, round(CASE WHEN open = 1 THEN 1.0::DOUBLE / sum(open) OVER (PARTITION BY user_id) ELSE 0 END, 6) AS share FROM m")
def normalised_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixtures.opinions(spark, sf_dir).groupBy("user_id", "stance").agg(F.max((F.col("predicted") > 0).cast("int")).alias("open"))
    whole = F.sum("open").over(Window.partitionBy("user_id"))  # a row a target
    return m.select("user_id", "stance", F.round(F.when(F.col("open") == 1, F.try_divide(F.lit(1.0), whole)).otherwise(0.0), 6).alias("share"))


@R.query(f"""WITH {PAIRS}, w AS (SELECT *, exp(-vx) AS wx, exp(-vy) AS wy FROM pairs),
m AS (SELECT snapshot, stance_x, stance_y, sum(wx * x) / sum(wx) AS mx, sum(wy * y) / sum(wy) AS my FROM w GROUP BY ALL),
s AS (SELECT snapshot, stance_x, stance_y, count(*) AS n, sum(wx * wy) AS ww, sum(wx * wy * (x - mx) * (y - my)) / sum(wx * wy) AS cov, sum(wx * pow(x - mx, 2)) / sum(wx) AS a, sum(wy * pow(y - my, 2)) / sum(wy) AS b FROM w JOIN m USING (snapshot, stance_x, stance_y) GROUP BY ALL)
SELECT snapshot, stance_x, stance_y, n, round(cov / sqrt(a * b), 6) AS r, round(CASE WHEN ww > 2 THEN cov / sqrt(a * b) * sqrt((ww - 2) / (1 - cov * cov / (a * b))) END, 4) AS t FROM s""")
def weighted_pearson_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = landscape.pearson_xy(landscape.stance_pairs(fixtures.snapshots(spark, sf_dir)), "snapshot", "stance_x", "stance_y")
    return r.select("snapshot", "stance_x", "stance_y", "n", F.round("r", 6).alias("r"), F.round("t", 4).alias("t"))


@R.query("SELECT u.user_id, s.j AS step, round(CASE WHEN u.user_id % 2 = 0 THEN 0.5 ELSE -0.5 END + 0.2::DOUBLE * (((u.user_id * 31 + s.j * 17) % 101) / 50.0::DOUBLE - 1), 6) AS opinion FROM (SELECT DISTINCT user_id FROM events) u, range(24) s(j)")
def synthetic_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timelines of the table's users with a fixed stance and noise that follows from user and step."""
    rows = table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("step"))
    noise = F.pmod(F.col("user_id") * 31 + F.col("step") * 17, F.lit(101)) / 50.0 - 1
    return rows.select("user_id", "step", F.round(F.when(F.col("user_id") % 2 == 0, 0.5).otherwise(-0.5) + 0.2 * noise, 6).alias("opinion"))


@R.query(f"""WITH {CONTENTS}, ring AS (SELECT DISTINCT author, (author + d) % 25 AS neighbour FROM contents, (VALUES (1), (3)) v(d)),
j AS (SELECT i.content_id, unnest(c.embedding)::DOUBLE AS x, unnest(range(len(c.embedding))) AS pos FROM contents i JOIN ring r USING (author) JOIN contents c ON c.author = r.neighbour AND c.t >= i.t - 50 AND c.t < i.t)
SELECT content_id, cast(pos AS INT) AS pos, round(avg(x), 6) AS value FROM j GROUP BY ALL""")
def neighbour_window_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean embedding of what two neighbours wrote before each item, an interval for each item."""
    c = fixtures.contents(spark, sf_dir)
    ring = c.select("author", F.explode(F.array(F.pmod(F.col("author") + 1, F.lit(25)), F.pmod(F.col("author") + 3, F.lit(25)))).alias("neighbour")).distinct()
    near = movement.neighbour_window(c.select("content_id", "author", "t"), c.select("author", "t", "embedding"), ring, 50)
    return vectors.centroids(near, "content_id")


@R.query(f"""WITH {PAIRS}, w AS (SELECT *, exp(-(vx + vy) / 2) AS w FROM pairs),
s AS (SELECT snapshot, stance_x, stance_y, count(*) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * x) / sum(w) AS qx, sum(w * y * y) / sum(w) AS qy FROM w GROUP BY ALL),
d AS (SELECT *, sqrt(greatest(qx - mx * mx, 0.0)) AS dx, sqrt(greatest(qy - my * my, 0.0)) AS dy FROM s)
SELECT snapshot, stance_x, stance_y, n, round(mx, 6) AS mean_x, round(my, 6) AS mean_y, round(CASE WHEN n > 1 AND dx > 1e-9 THEN mx / dx * sqrt(n - 1) END, 4) AS t_x, round(CASE WHEN n > 1 AND dy > 1e-9 THEN my / dy * sqrt(n - 1) END, 4) AS t_y FROM d""")
def weighted_mean_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = landscape.mean_test(landscape.stance_pairs(fixtures.snapshots(spark, sf_dir)), "snapshot", "stance_x", "stance_y")
    return r.select("snapshot", "stance_x", "stance_y", "n", *(F.round(c, d).alias(c) for c, d in (("mean_x", 6), ("mean_y", 6), ("t_x", 4), ("t_y", 4))))


def _bca_sql(replicates: int = 100) -> str:
    steps, last = "", "p"
    for i, (name, value) in enumerate(landscape.bca_steps(0.95, replicates)):
        steps += f", b{i} AS (SELECT *, {value} AS {name} FROM {last})"
        last = f"b{i}"
    bound = lambda at: f"round(max(CASE WHEN floor({at}) = i THEN v + ({at} - i) * (coalesce(next, v) - v) END), 6)"
    return f"""WITH {SNAPSHOTS}, w AS (SELECT *, exp(-variance) AS w FROM snapshots WHERE mean IS NOT NULL),
t AS (SELECT snapshot, stance, sum(w) AS sw, sum(w * mean) AS sm, count(*) AS n FROM w GROUP BY ALL),
o AS (SELECT snapshot, stance, sm / sw AS estimate, t.n, CASE WHEN sw - w > 1e-12 THEN (sm - w * mean) / (sw - w) - sm / sw ELSE 0 END AS off FROM w JOIN t USING (snapshot, stance)),
s AS (SELECT snapshot, stance, any_value(estimate) AS estimate, any_value(n)::DOUBLE AS n, sum(off) AS s1, sum(off * off) AS s2, sum(off * off * off) AS s3 FROM o GROUP BY ALL),
d AS (SELECT snapshot, stance, r, sum(w * k * mean) / nullif(sum(w * k), 0) AS v FROM (SELECT *, {landscape.poisson('user_id', 'r')} AS k FROM w, range(1, {replicates + 1}) x(r)) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY snapshot, stance ORDER BY v, r) - 1 AS i, lead(v) OVER (PARTITION BY snapshot, stance ORDER BY v, r) AS next, count(*) OVER (PARTITION BY snapshot, stance) AS m,
    avg(CASE WHEN v < estimate - 1e-12 THEN 1.0 WHEN abs(v - estimate) <= 1e-12 THEN 0.5 ELSE 0 END) OVER (PARTITION BY snapshot, stance) AS share FROM d JOIN s USING (snapshot, stance) WHERE v IS NOT NULL){steps}
SELECT snapshot, stance, round(any_value(estimate), 6) AS mean, {bound('at_lo')} AS lo, {bound('at_hi')} AS hi FROM {last} GROUP BY snapshot, stance"""


@R.query(_bca_sql())
def weighted_mean_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean opinions with their bias-corrected accelerated bootstrap intervals."""
    return landscape.bootstrap_mean(fixtures.snapshots(spark, sf_dir), 100, "snapshot", "stance")


@R.query()
def slope_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.regression_test(landscape.stance_pairs(fixtures.snapshots(spark, sf_dir)), "snapshot", "stance_x", "stance_y")


@R.query()
def beta_density_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.beta_density_2d(fixtures.opinions(spark, sf_dir))


@R.query()
def hmm_by_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transition matrices of hidden opinions for each target within each community."""
    o = fixtures.opinions(spark, sf_dir)
    return chains.hmm(o.withColumn("stance", F.concat_ws("/", "stance", F.col("community").cast("string"))), fixtures.profiles(spark))
