"""Every query with SQL gives the rows that DuckDB gives; the others run and keep their invariants."""

import math

import pytest

from opinara.plans import catalogue


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{x + 0.0:.5f}" if isinstance(x, float) else str(x)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(name, spark, duck, sf_dir):
    df = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal(df.collect(), df.columns) == normal(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(name, spark, sf_dir):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_hmm_rows_are_distributions(spark, sf_dir):
    sums = catalogue.QUERIES["hmm_em"](spark, sf_dir).groupBy("stance", "state").sum("prob").collect()
    assert all(abs(r[2] - 1) < 1e-4 for r in sums)


def test_partitioning_does_not_matter(spark, sf_dir):
    from opinara.operators import cohort

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    for f in (lambda d: cohort.systematic(d, "doc_id", 30), lambda d: cohort.capped(d, "source", "doc_id", 3), lambda d: cohort.fixed_size(d, "doc_id", 20)):
        assert sorted(f(docs).collect()) == sorted(f(docs.repartition(7, "source")).collect())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
