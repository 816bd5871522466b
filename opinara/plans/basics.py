"""Queries over filters, text, joins, aggregates, samples, evaluation and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import text
from opinara.operators import cohort, evaluation, graph, opinions, threads
from opinara.plans.register import ANNOTATIONS, COMMENTS, GRAPH, OPINIONS, SNAPSHOTS, Registry
from opinara.sources import fixtures
from opinara.sources.fixtures import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
TYPES = ["click", "error", "purchase", "signup", "view"]


@R.query(f"""WITH {OPINIONS}, m AS (SELECT user_id, stance, cast(sum(predicted) AS DOUBLE) / count(*) AS mean,
    greatest(cast(sum(predicted * predicted) AS DOUBLE) / count(*) - (cast(sum(predicted) AS DOUBLE) / count(*)) * (cast(sum(predicted) AS DOUBLE) / count(*)), 0.0) AS variance FROM opinions GROUP BY ALL)
SELECT stance, count(*) AS n_users, round(avg(mean), 6) AS mean_opinion, round(sum(mean * exp(-variance)) / sum(exp(-variance)), 6) AS weighted_mean FROM m GROUP BY stance""")
def stance_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opinions.certainty_mean(opinions.moments(fixtures.opinions(spark, sf_dir), "user_id", "stance"), "stance")


@R.query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2', 'src3') AND text NOT IN ('[removed]', '[deleted]')")
def source_membership_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src2", "src3") & text.is_alive(F.col("text"))).select("doc_id", "source")


@R.query(r"SELECT doc_id, n_chars FROM documents WHERE text IS NOT NULL AND text NOT IN ('', 'Nan', 'Null') AND NOT regexp_full_match(text, '[\s\x{FE0E}]+')")
def text_sentinel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(text.is_text(F.col("text"))).select("doc_id", "n_chars")


def _normal_sql() -> str:
    token = "CASE WHEN starts_with(t, '@') THEN '@USER' WHEN starts_with(lower(t), 'http') OR starts_with(lower(t), 'www') THEN 'HTTPURL' ELSE t END"
    quoted = text.TOKEN.replace("'", "''")
    out = "array_to_string(list_transform(regexp_extract_all(replace(replace(text, '’', ''''), '…', '...'), '(" + quoted + ")'), lambda t: " + token + "), ' ')"
    for old, new in text.REPLACEMENTS:
        out = "replace({}, '{}', '{}')".format(out, old.replace("'", "''"), new.replace("'", "''"))
    return f"SELECT doc_id, trim(regexp_replace({out}, '[ \\n\\t]+', ' ', 'g')) AS normal FROM documents"


@R.query(_normal_sql())
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all languages as tokens; the SQL names no emoji, as the table has none (tests do)."""
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("normal"))


@R.query("SELECT doc_id, length(text) AS n FROM documents ORDER BY n DESC, doc_id LIMIT 20")
def text_length_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").cast("long").alias("n")).orderBy(F.desc("n"), "doc_id").limit(20)


@R.query(r"""SELECT doc_id, md5(regexp_replace(replace(text, chr(10), chr(10) || '&gt;'), '&gt;(.*)\n', '"\1"' || chr(10), 'g')) AS unescaped FROM documents""")
def quote_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with all lines but the first quoted, and then unescaped."""
    quoted = F.replace(F.col("text"), F.lit("\n"), F.lit("\n&gt;"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.unescape_quotes(quoted).cast("binary")).alias("unescaped"))


@R.query(r"""WITH v AS (SELECT conv_id, turn, text AS t FROM conversations UNION ALL SELECT conv_id, turn + 100, CASE turn % 4 WHEN 0 THEN 'I disagree: ' WHEN 1 THEN 'Favor, ' WHEN 2 THEN 'yes ' ELSE 'They support it ' END || text FROM conversations),
w AS (SELECT conv_id, turn, t, list_filter(list_transform(regexp_extract_all(lower(split_part(t, chr(10), 1)), '\w+'), lambda x:
    CASE WHEN contains(x, 'disagree') OR (contains(x, 'against') AND NOT contains(x, 'favor') AND NOT contains(x, 'agree') AND NOT contains(x, 'support')) THEN 'against'
         WHEN contains(x, 'favor') OR contains(x, 'agree') OR contains(x, 'support') THEN 'favor' WHEN contains(x, 'neutral') THEN 'neutral' END), lambda s: s IS NOT NULL) AS s FROM v)
SELECT conv_id, turn, coalesce(s[1], 'neutral') AS stance, CASE WHEN contains(l, 'yes') AND NOT contains(l, 'no') THEN 'yes' WHEN contains(l, 'no') AND NOT contains(l, 'yes') THEN 'no' WHEN regexp_matches(l, 'favor|agree|support') THEN 'yes' ELSE 'no' END AS yes_no FROM (SELECT *, lower(split_part(t, chr(10), 1)) AS l FROM w)""")
def stance_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stance and yes or no of every turn, and of every turn after an opening that takes a side."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    opening = F.element_at(F.array(*map(F.lit, ("I disagree: ", "Favor, ", "yes ", "They support it "))), (F.col("turn") % 4 + 1).cast("int"))
    rows = c.unionByName(c.select("conv_id", (F.col("turn") + 100).alias("turn"), F.concat(opening, "text").alias("text")))
    return rows.select("conv_id", "turn", text.parse_stance(F.col("text")).alias("stance"), text.parse_yes_no(F.col("text")).alias("yes_no"))


@R.query(f"""WITH {COMMENTS}, c AS (SELECT *, nullif(regexp_extract(permalink, '^(/r/[^/]+/comments/[^/]+/[^/]+/)', 1), '') AS post_permalink,
    CASE WHEN starts_with(parent_id, 't1_') THEN nullif(regexp_extract(parent_id, '^t[0-9]_([a-z0-9]+)', 1), '') END AS parent_specific_id FROM comments)
SELECT c.id, c.post_permalink, coalesce(contains(c.parent_id, 't3_'), false) AS is_base_comment, c.parent_specific_id, s.title, length(s.selftext) AS n_selftext, length(p.body) AS n_parent, p.author AS author_parent
FROM c LEFT JOIN submissions s ON c.post_permalink = s.permalink LEFT JOIN comments p ON c.parent_specific_id = p.id""")
def thread_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = threads.with_context(fixtures.comments(spark, sf_dir), fixtures.submissions(spark, sf_dir))
    return full.select("id", "post_permalink", "is_base_comment", "parent_specific_id", "title", F.char_length("selftext").cast("long").alias("n_selftext"), F.char_length("body_parent").cast("long").alias("n_parent"), "author_parent")


@R.query(f"""WITH {COMMENTS} SELECT a.id, a.author, b.author AS author_reply, b.id AS id_reply FROM (SELECT * FROM comments WHERE turn > 0) a LEFT JOIN (SELECT * FROM comments WHERE turn = 0) b USING (conv_id)""")
def reply_root_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixtures.comments(spark, sf_dir)
    return threads.with_root(c.where("turn > 0").select("conv_id", "id", "author"), c.where("turn = 0").select("conv_id", "author", "id"), "conv_id").select("id", "author", "author_reply", "id_reply")


@R.query(f"""WITH {COMMENTS}, p AS (SELECT c.id, c.body, d.body AS parent FROM comments c LEFT JOIN comments d ON c.conv_id = d.conv_id AND c.turn = d.turn + 1)
SELECT id, md5(parent || ' ' || body) AS joined, md5(nullif(concat_ws(' ', parent, body), '')) AS some FROM p""")
def post_text_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixtures.comments(spark, sf_dir)
    parent = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("body").alias("parent"))
    both = c.join(parent, ["conv_id", "turn"], "left")
    return both.select("id", F.md5(F.concat("parent", F.lit(" "), "body")).alias("joined"), F.md5(F.nullif(F.concat_ws(" ", "parent", "body"), F.lit(""))).alias("some"))


@R.query(f"""WITH {COMMENTS}, p AS (SELECT c.id, c.body, d.body AS parent, s.selftext AS post FROM comments c LEFT JOIN comments d ON c.conv_id = d.conv_id AND c.turn = d.turn + 1 LEFT JOIN submissions s ON s.id = cast(c.conv_id AS VARCHAR))
SELECT id, 'Post: ' || replace(coalesce(post, ''), chr(10), ' ') || chr(10) || CASE WHEN parent IS NOT NULL THEN 'Parent comment: ' || replace(parent, chr(10), ' ') || chr(10) ELSE '' END
    || 'Comment: ' || replace(body, chr(10), ' ') || chr(10) || 'Stance on x:' AS prompt FROM p""")
def prompt_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = fixtures.comments(spark, sf_dir), fixtures.submissions(spark, sf_dir)
    parent = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("body").alias("parent"))
    posts = s.select(F.col("id").cast("long").alias("conv_id"), F.col("selftext").alias("post"))
    return c.join(parent, ["conv_id", "turn"], "left").join(posts, "conv_id", "left").select("id", text.prompt(F.lit("x"), F.col("post"), F.col("parent"), F.col("body")).alias("prompt"))


@R.query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic")


@R.query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS n_lines FROM lineitem GROUP BY 1)
SELECT k, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0) AS n_lines FROM a FULL JOIN b USING (k)""")
def outer_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n_lines"))
    return a.join(b, "k", "full").fillna(0, ["n_orders", "n_lines"])


@R.query("SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000, 6) AS duration_days FROM events GROUP BY user_id")
def author_activity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.activity(table(spark, sf_dir, "events"))


@R.query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS \"{t}\"" for t in TYPES) + " , count(*) FILTER (event_type IN (" + ", ".join(f"'{t}'" for t in TYPES) + ")) AS n_all, count(DISTINCT event_type) FILTER (event_type IN (" + ", ".join(f"'{t}'" for t in TYPES) + ")) AS n_topics FROM events GROUP BY user_id")
def topic_pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.topic_counts(table(spark, sf_dir, "events"), "user_id", "event_type", TYPES)


@R.query(f"WITH {OPINIONS} SELECT event_id, user_id, stance FROM opinions WHERE (user_id, stance) IN (SELECT (user_id, stance) FROM opinions GROUP BY user_id, stance HAVING count(*) > 5)")
def active_user_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.active(fixtures.opinions(spark, sf_dir), 5, "user_id", "stance").select("event_id", "user_id", "stance")


@R.query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 60 AND epoch_us(max(ts)) - epoch_us(min(ts)) >= 10 * 86400000000")
def active_user_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.activity(table(spark, sf_dir, "events")).where("n >= 60 AND duration_days >= 10").select("user_id", "n")


@R.query("SELECT md5(text) AS h, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text")
def dedup_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("h"), "doc_id", "lang")
    return cohort.dedup_keyed(d, ["h"], ["doc_id"])


@R.query("SELECT DISTINCT event_type, user_id FROM events")
def dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", "user_id").distinct()


@R.query("SELECT doc_id AS id, lang, NULL AS url, 'document' AS kind FROM documents UNION ALL SELECT page_id, NULL, url, 'page' FROM pages")
def schema_evolving_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.lit("document").alias("kind"))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.lit("page").alias("kind"))
    return d.unionByName(p, allowMissingColumns=True)


@R.query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def context_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@R.query("SELECT doc_id FROM documents WHERE (doc_id * 2654435761) % 1000 < 250")
def hash_fraction_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.fraction(table(spark, sf_dir, "documents"), "doc_id", 0.25).select("doc_id")


@R.query("SELECT doc_id FROM documents ORDER BY (doc_id * 2654435761) % 1000003, doc_id LIMIT 100")
def fixed_size_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.fixed_size(table(spark, sf_dir, "documents"), "doc_id", 100).select("doc_id")


@R.query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 2654435761) % 1000003, doc_id) AS r FROM documents) WHERE r <= 10")
def capped_group_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.capped(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 10)


@R.query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE (rn - 1) % greatest(n // 90, 1) = 0")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.systematic(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 90)


@R.query(f"WITH {ANNOTATIONS} SELECT doc_id, gold, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 10 THEN 'train' WHEN row_number() OVER (ORDER BY doc_id) <= 20 THEN 'dev' ELSE 'test' END AS split FROM predictions")
def ordered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.ordered_split(fixtures.predictions(spark, sf_dir).select("doc_id", "gold"), "doc_id", 10, 10)


@R.query(f"""WITH {ANNOTATIONS}, n AS (SELECT doc_id, gold, row_number() OVER (PARTITION BY gold ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY gold) AS n FROM predictions)
SELECT doc_id, gold, CASE WHEN rn <= n * 6 // 10 THEN 'train' WHEN rn <= n * 6 // 10 + n * 2 // 10 THEN 'dev' ELSE 'test' END AS split FROM n""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.stratified_split(fixtures.predictions(spark, sf_dir).select("doc_id", "gold"), "gold", "doc_id")


@R.query(f"WITH {ANNOTATIONS} SELECT gold, predicted, count(*) AS n FROM predictions GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(fixtures.predictions(spark, sf_dir))


CLASS_SQL = """cls AS (SELECT {by} c.class, count(*) FILTER (gold = class AND predicted = class)::DOUBLE AS tp, count(*) FILTER (gold = class) AS support, count(*) FILTER (predicted = class) AS said
    FROM {rows} , (VALUES ('favor'), ('neutral'), ('against')) c(class) GROUP BY ALL),
scores AS (SELECT {by} class, support, CASE WHEN support > 0 AND said > 0 THEN tp / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM cls),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, CASE WHEN precision + recall > 0 THEN 1.25 * precision * recall / (0.25 * precision + recall) ELSE 0 END AS fbeta FROM scores)"""
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("precision", "recall", "f1", "fbeta"))


@R.query(f"WITH {ANNOTATIONS}, {CLASS_SQL.format(by='', rows='predictions')} SELECT class, support, {ROUNDED} FROM f")
def stance_f_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.class_scores(fixtures.predictions(spark, sf_dir))
    return s.select("class", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fbeta")))


@R.query(f"WITH {ANNOTATIONS}, {CLASS_SQL.format(by='', rows='predictions')} SELECT " + ", ".join(f"round(coalesce(avg({c}) FILTER (class <> 'neutral' AND support > 0), 0), 6) AS macro_{c}" for c in ("precision", "recall", "f1", "fbeta")) + " FROM f")
def macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluation.macro_scores(evaluation.class_scores(fixtures.predictions(spark, sf_dir)))
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    return fixtures.predictions(spark, sf_dir).join(sources, "doc_id")


@R.query(f"""WITH {ANNOTATIONS}, rows_ AS (SELECT p.*, d.source FROM predictions p JOIN documents d USING (doc_id)), {CLASS_SQL.format(by='source,', rows='rows_')},
r AS (SELECT class, source, f1, row_number() OVER (PARTITION BY class ORDER BY round(f1, 4) DESC, source) AS k FROM f WHERE support > 0)
SELECT class, source, round(f1, 6) AS f1 FROM r WHERE k = 1""")
def best_run_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.class_scores(_by_source(spark, sf_dir), "source").where("support > 0").select("class", "source", "f1")
    return evaluation.best(s, "f1", "source", "class").select("class", "source", F.round("f1", 6).alias("f1"))


@R.query(f"""WITH {ANNOTATIONS}, rows_ AS (SELECT p.*, d.source FROM predictions p JOIN documents d USING (doc_id)), {CLASS_SQL.format(by='source,', rows='rows_')},
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY round(f1, 4) DESC, source) AS k FROM f WHERE support > 0 AND class IN ('favor', 'against'))
SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM r WHERE k = 1""")
def best_class_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_class_macro(evaluation.class_scores(_by_source(spark, sf_dir), "source"), "source")


@R.query(f"""WITH {ANNOTATIONS}, c AS (SELECT doc_id, count(*) FILTER (label = 'favor') AS f, count(*) FILTER (label = 'neutral') AS n, count(*) FILTER (label = 'against') AS a FROM annotations GROUP BY doc_id),
s AS (SELECT count(*) AS items, avg((f * f + n * n + a * a - 3) / 6.0::DOUBLE) AS p, sum(f) / (count(*) * 3.0::DOUBLE) AS pf, sum(n) / (count(*) * 3.0::DOUBLE) AS pn, sum(a) / (count(*) * 3.0::DOUBLE) AS pa,
    avg(CASE WHEN greatest(f, n, a) = 3 THEN 1.0::DOUBLE ELSE 0 END) AS unanimous, avg(CASE WHEN greatest(f, n, a) < 3 AND n = 0 THEN 1.0::DOUBLE ELSE 0 END) AS full_disagreement FROM c)
SELECT items, round((p - (pf * pf + pn * pn + pa * pa)) / (1 - (pf * pf + pn * pn + pa * pa)), 3) AS kappa, round(unanimous, 6) AS unanimous, round(full_disagreement, 6) AS full_disagreement FROM s""")
def annotator_counts_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.agreement(evaluation.label_counts(fixtures.annotations(spark, sf_dir)))


@R.query(f"""WITH {ANNOTATIONS}, c AS (SELECT doc_id FROM annotations GROUP BY doc_id HAVING count(DISTINCT label) > 1)
SELECT a.doc_id, coalesce(b.label, a.label) AS label FROM annotations a LEFT JOIN (SELECT * FROM annotations WHERE annotator = 3 AND doc_id IN (SELECT doc_id FROM c)) b USING (doc_id) WHERE a.annotator = 1""")
def adjudicate_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fixtures.annotations(spark, sf_dir)
    counts = evaluation.label_counts(a)
    split = counts.where("greatest(favor, neutral, against) < favor + neutral + against").select("doc_id")
    return evaluation.adjudicate(a.where("annotator = 1"), a.where("annotator = 3").join(split, "doc_id", "left_semi"))


@R.query("SELECT doc_id, CASE (doc_id % 5) - 2 WHEN -2 THEN 'against' WHEN -1 THEN 'against' WHEN 0 THEN 'neutral' ELSE 'favor' END AS label FROM labels")
def label_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", evaluation.recode((F.col("doc_id") % 5 - 2).cast("string")).alias("label"))


@R.query(f"""WITH {ANNOTATIONS}, n AS (SELECT doc_id, label, count(*) AS n, min(annotator) AS first FROM annotations GROUP BY ALL)
SELECT doc_id, label, n FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.majority(fixtures.annotations(spark, sf_dir))


@R.query(f"WITH {GRAPH} SELECT type, src, dst, count(*) AS n FROM graph GROUP BY ALL")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.graph(spark, sf_dir).groupBy("type", "src", "dst").agg(F.count("*").alias("n"))


@R.query(f"""WITH {GRAPH}, e AS (SELECT type, src AS node FROM graph UNION ALL SELECT type, dst FROM graph), d AS (SELECT type, node, count(*) AS degree FROM e GROUP BY ALL UNION ALL SELECT 'all', node, count(*) FROM e GROUP BY node)
SELECT type, degree, count(*) AS n_nodes FROM d GROUP BY ALL""")
def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(fixtures.graph(spark, sf_dir))


@R.query(f"""WITH {GRAPH}, b AS (SELECT DISTINCT src AS a, dst AS b FROM graph WHERE type = 'R' UNION SELECT DISTINCT dst, src FROM graph WHERE type = 'R'),
r1 AS (SELECT DISTINCT b AS node FROM b WHERE a = 'c1'), r2 AS (SELECT DISTINCT b.b AS node FROM r1 JOIN b ON r1.node = b.a WHERE b.b <> 'c1' AND b.b NOT IN (SELECT node FROM r1)),
r3 AS (SELECT DISTINCT b.b AS node FROM r2 JOIN b ON r2.node = b.a WHERE b.b <> 'c1' AND b.b NOT IN (SELECT node FROM r1) AND b.b NOT IN (SELECT node FROM r2))
SELECT 'c1' AS user, node, 1 AS ring FROM r1 UNION ALL SELECT 'c1', node, 2 FROM r2 UNION ALL SELECT 'c1', node, 3 FROM r3""")
def neighbour_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.rings(fixtures.graph(spark, sf_dir).where("type = 'R'"), spark.createDataFrame([("c1",)], "user string"))


@R.query("SELECT doc_id FROM documents WHERE lang = 'en' AND text IS NOT NULL")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'en' AND text IS NOT NULL").select("doc_id")


@R.query(f"""WITH {SNAPSHOTS}, l AS (SELECT stance, user_id, avg(mean) AS m FROM snapshots GROUP BY ALL)
SELECT stance, arg_min(user_id, (-round(m, 9), user_id)) AS most, arg_min(user_id, (round(m, 9), user_id)) AS least, arg_min(user_id, (abs(round(m, 9)), user_id)) AS moderate FROM l GROUP BY stance""")
def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fixtures.snapshots(spark, sf_dir).groupBy("stance", "user_id").agg(F.round(F.avg("mean"), 9).alias("m"))
    pick = lambda e, n: F.min_by("user_id", F.struct(e, "user_id")).alias(n)
    return m.groupBy("stance").agg(pick(-F.col("m"), "most"), pick(F.col("m"), "least"), pick(F.abs("m"), "moderate"))
