"""Queries over latent opinions, gated choices of runs, means over targets, disagreements and scalar models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import scores
from opinara.operators import evaluation, latent
from opinara.plans.basics import CLASS_SQL
from opinara.plans.register import ANNOTATIONS, OPINIONS, PROFILES, Registry
from opinara.sources import fixtures
from opinara.sources.fixtures import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

STEPS, PSEUDO = 25, 0.5


def _em_sql() -> str:
    """Steps of EM as a recursive query: one row a user and target, with nine counts."""
    cells = [(c, p) for c in range(3) for p in (-1, 0, 1)]
    pivot = ", ".join(f"count(*) FILTER (classifier_id = {c} AND predicted = {p}) AS n{i}" for i, (c, p) in enumerate(cells))
    emit = ", ".join(f"max(prob) FILTER (classifier_id = {c} AND predicted = {p} AND actual = {a - 1}) AS e{a}_{i}" for i, (c, p) in enumerate(cells) for a in range(3))
    total = " + ".join(f"n{i}" for i in range(9))
    ratio = lambda i: f"n{i} / (q0 * e0_{i} + q1 * e1_{i} + q2 * e2_{i})"
    share = lambda a: f"({PSEUDO}::DOUBLE + q{a} * ({' + '.join(f'e{a}_{i} * {ratio(i)}' for i in range(9))})) / ({total} + {3 * PSEUDO}::DOUBLE)"
    counts = ", ".join(f"n{i}" for i in range(9))
    return f"""WITH RECURSIVE {OPINIONS}, {PROFILES}, n AS (SELECT user_id, stance, {pivot} FROM opinions GROUP BY ALL), e AS (SELECT {emit} FROM profiles),
it AS (SELECT 0 AS k, user_id, stance, {counts}, 1 / 3.0::DOUBLE AS q0, 1 / 3.0::DOUBLE AS q1, 1 / 3.0::DOUBLE AS q2 FROM n WHERE {total} > 0
    UNION ALL SELECT k + 1, user_id, stance, {counts}, {share(0)}, {share(1)}, {share(2)} FROM it, e WHERE k < {STEPS})
SELECT user_id, stance, round(q0, 5) + 0.0 AS against, round(q1, 5) + 0.0 AS neutral, round(q2, 5) + 0.0 AS favor, round(q2 - q0, 5) + 0.0 AS mean, round(q0 + q2 - (q2 - q0) * (q2 - q0), 5) + 0.0 AS variance FROM it WHERE k = {STEPS}"""


@R.query(_em_sql())
def latent_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the three hidden opinions of each user and target by EM."""
    return latent.categorical(fixtures.opinions(spark, sf_dir), fixtures.profiles(spark), STEPS, PSEUDO)


@R.query()
def latent_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of each user's hidden opinion of each target."""
    return latent.curve(fixtures.opinions(spark, sf_dir), fixtures.profiles(spark), "normal")


@R.query()
def latent_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpha and beta of each user's hidden opinion of each target."""
    return latent.curve(fixtures.opinions(spark, sf_dir), fixtures.profiles(spark), "beta")


def _scored(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", *by)
    return evaluation.class_scores(fixtures.predictions(spark, sf_dir).join(docs, "doc_id"), *by)


@R.query(f"""WITH {ANNOTATIONS}, rows_ AS (SELECT p.*, d.source FROM predictions p JOIN documents d USING (doc_id)), {CLASS_SQL.format(by='source,', rows='rows_')},
r AS (SELECT class, source, precision, f1, row_number() OVER (PARTITION BY class ORDER BY round(f1, 4) DESC, source) AS k FROM f WHERE support > 0 AND precision > 0.5)
SELECT class, source, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM r WHERE k = 1""")
def best_run_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best source of each class, of those with a precision above one half."""
    s = _scored(spark, sf_dir, "source").where("support > 0").select("class", "source", "precision", "f1")
    top = evaluation.best(s, "f1", "source", "class", gate="precision")
    return top.select("class", "source", F.round("precision", 6).alias("precision"), F.round("f1", 6).alias("f1"))


@R.query(f"""WITH {ANNOTATIONS}, rows_ AS (SELECT p.*, d.source, d.lang FROM predictions p JOIN documents d USING (doc_id)), {CLASS_SQL.format(by='source, lang,', rows='rows_')},
m AS (SELECT source, lang, coalesce(avg(precision) FILTER (class <> 'neutral' AND support > 0), 0) AS p, coalesce(avg(recall) FILTER (class <> 'neutral' AND support > 0), 0) AS r, coalesce(avg(f1) FILTER (class <> 'neutral' AND support > 0), 0) AS f FROM f GROUP BY ALL)
SELECT source, count(*) AS targets, round(avg(p), 4) AS mean_precision, round(avg(r), 4) AS mean_recall, round(avg(f), 4) AS mean_f1 FROM m GROUP BY source""")
def target_mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro scores of each source in each language, averaged over languages."""
    return evaluation.target_means(evaluation.macro_scores(_scored(spark, sf_dir, "source", "lang"), "source", "lang"), "source")


@R.query(f"""WITH {ANNOTATIONS} SELECT doc_id, max(label) FILTER (annotator = 1) AS annotator_1, max(label) FILTER (annotator = 2) AS annotator_2, max(label) FILTER (annotator = 3) AS annotator_3
FROM annotations GROUP BY doc_id HAVING count(DISTINCT label) > 1""")
def disagreement_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.disagreements(fixtures.annotations(spark, sf_dir), 3)


@R.query("""WITH x AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS d FROM embeddings)
SELECT vec_id, round((exp(b) + 2 * exp(c)) / (exp(a) + exp(b) + exp(c)) - 1, 6) + 0.0 AS expectation, round(pow(d, -2) / (pow(d, -2) + pow(0.3, -2)), 6) AS response,
    round(exp(a) / (exp(a) + exp(b)), 6) AS beta_mean, round(sqrt(exp(a) * exp(b) / (pow(exp(a) + exp(b), 2) * (exp(a) + exp(b) + 1))), 6) AS beta_std FROM x""")
def scalar_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected class of logits, response at a distance, and moments of a Beta distribution, of every embedding."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.exp(F.col("embedding")[i].cast("double"))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    mean, std = scores.beta_moments(at(0), at(1))
    logits = F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double"))
    columns = {"expectation": scores.softmax_expectation(logits), "response": scores.bounded_confidence(length, 2.0), "beta_mean": mean, "beta_std": std}
    return e.select("vec_id", *((F.round(c, 6) + 0.0).alias(n) for n, c in columns.items()))
