"""Confusion, precision, recall, F scores, agreement and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.scores import f_beta

SIDES = ("favor", "neutral", "against")


def confusion(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by, "gold", "predicted").agg(F.count("*").alias("n"))


def class_scores(df: DataFrame, *by: str, beta: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and F-beta of each class; 0 for a class without gold rows or with a zero denominator."""
    one = df.groupBy(*by).agg(
        *(F.count_if((F.col("gold") == c) & (F.col("predicted") == c)).alias(f"tp_{c}") for c in SIDES),
        *(F.count_if(F.col("gold") == c).alias(f"gold_{c}") for c in SIDES),
        *(F.count_if(F.col("predicted") == c).alias(f"pred_{c}") for c in SIDES),
    )
    rows = one.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"tp_{c}").alias("tp"), F.col(f"gold_{c}").alias("support"), F.col(f"pred_{c}").alias("said")) for c in SIDES))).alias("x")).select(*by, "x.*")
    p = F.coalesce(F.try_divide(F.when(F.col("support") > 0, F.col("tp")).otherwise(0), F.col("said")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    scored = rows.withColumn("precision", p).withColumn("recall", r)
    return scored.withColumn("f1", f_beta(F.col("precision"), F.col("recall"), 1.0)).withColumn("fbeta", f_beta(F.col("precision"), F.col("recall"), beta)).drop("tp", "said")


def macro_scores(scores: DataFrame, *by: str) -> DataFrame:
    """Means over favor and against, of those that have gold rows; 0 without any."""
    on = F.col("class").isin("favor", "against") & (F.col("support") > 0)
    return scores.groupBy(*by).agg(*(F.coalesce(F.avg(F.when(on, F.col(c))), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1", "fbeta")))


def best(df: DataFrame, score: str, name: str, *by: str, gate: str | None = None, above: float = 0.5) -> DataFrame:
    """The row with the greatest score rounded to four digits; ties go to the least name. With a gate only rows compete
    where this column is above a limit."""
    if gate:
        df = df.where(F.col(gate) > above)
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(-F.round(score, 4), name)).alias("row")).select(*by, "row.*")


def label_counts(annotations: DataFrame, item: str = "doc_id") -> DataFrame:
    """A column for each side; another label is an error."""
    valid = annotations.withColumn("label", F.when(F.col("label").isin(*SIDES), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("invalid label: "), F.coalesce("label", F.lit("null"))))))
    return valid.groupBy(item).agg(*(F.count_if(F.col("label") == c).alias(c) for c in SIDES))


def agreement(counts: DataFrame) -> DataFrame:
    """Fleiss' kappa, and shares of unanimous and of fully split items. All items must have as many labels."""
    n = sum((F.col(c) for c in SIDES), F.lit(0))
    squares = sum((F.col(c) * F.col(c) for c in SIDES), F.lit(0))
    most = F.greatest(*(F.col(c) for c in SIDES))
    sums = counts.agg(
        F.count("*").alias("items"),
        F.avg((squares - n) / (n * (n - 1))).alias("p"),
        *(F.sum(c).alias(f"s_{c}") for c in SIDES),
        F.sum(n).alias("all"),
        F.avg(F.when(most == n, 1.0).otherwise(0.0)).alias("unanimous"),
        F.avg(F.when((most < n) & (F.col("neutral") == 0), 1.0).otherwise(0.0)).alias("full_disagreement"),
    )
    pe = sum((F.pow(F.col(f"s_{c}") / F.col("all"), F.lit(2.0)) for c in SIDES), F.lit(0.0))
    return sums.select("items", F.round(F.try_divide(F.col("p") - pe, 1 - pe), 3).alias("kappa"), F.round("unanimous", 6).alias("unanimous"), F.round("full_disagreement", 6).alias("full_disagreement"))


def disagreements(annotations: DataFrame, annotators: int, item: str = "doc_id", place: str = "annotator") -> DataFrame:
    """Items whose labels are not all the same, with a column for each annotator."""
    wide = annotations.groupBy(item).agg(*(F.max(F.when(F.col(place) == i, F.col("label"))).alias(f"annotator_{i}") for i in range(1, annotators + 1)), F.min("label").alias("least"), F.max("label").alias("most"))
    return wide.where("least <> most").drop("least", "most")


def target_means(macro: DataFrame, *by: str) -> DataFrame:
    """Means of the macro scores over targets, each target counting once."""
    return macro.groupBy(*by).agg(F.count("*").alias("targets"), *(F.round(F.avg(f"macro_{c}"), 4).alias(f"mean_{c}") for c in ("precision", "recall", "f1")))


def adjudicate(first: DataFrame, decided: DataFrame, item: str = "doc_id") -> DataFrame:
    """An adjudicated label overrides the first annotator's."""
    return first.join(decided.select(item, F.col("label").alias("decided")), item, "left").select(item, F.coalesce("decided", "label").alias("label"))


def recode(label: Column) -> Column:
    """-2 and -1 are against, 0 neutral, 1 and 2 favor; canonical labels pass."""
    return F.when(label.isin(*SIDES), label).when(label.isin("-2", "-1"), "against").when(label == "0", "neutral").when(label.isin("1", "2"), "favor")


def majority(votes: DataFrame, item: str = "doc_id", place: str = "annotator") -> DataFrame:
    """The most frequent label; the one seen first wins ties."""
    n = votes.groupBy(item, "label").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    return n.groupBy(item).agg(F.min_by("label", F.struct(-F.col("n"), "first")).alias("label"), F.max("n").alias("n"))


def best_class_macro(scores: DataFrame, name: str) -> DataFrame:
    """Of favor and of against the scores of the classifier with the best F1, and their means."""
    top = best(scores.where(F.col("class").isin("favor", "against") & (F.col("support") > 0)).select("class", name, "precision", "recall", "f1"), "f1", name, "class")
    return top.agg(*(F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
