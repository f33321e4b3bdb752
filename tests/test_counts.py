import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import counts

PROBS = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.99, "f": 1.0}


def frame(spark, pdf):
    return spark.createDataFrame(pdf, "g string, value double")


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_quantiles_equal_pandas_with_a_hot_group_and_ties(spark, buckets):
    rng = np.random.default_rng(1)
    pdf = pd.concat([
        pd.DataFrame({"g": "hot", "value": np.round(rng.lognormal(3, 2, 4000), 1)}),
        pd.DataFrame({"g": "ties", "value": rng.integers(0, 3, 500).astype(float)}),
        pd.DataFrame({"g": "one", "value": [7.5]}),
        pd.DataFrame({"g": "same", "value": [2.0] * 50}),
    ])
    got = counts.quantiles(frame(spark, pdf), ["g"], PROBS, buckets=buckets).toPandas().set_index("g")
    want = pdf.groupby("g").value.quantile(list(PROBS.values())).unstack()
    want.columns = list(PROBS)
    pd.testing.assert_frame_equal(got.sort_index(), want.sort_index(), check_names=False, rtol=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("xy"), st.integers(-20, 20)), min_size=1, max_size=60))
def test_cumulative_counts_equal_brute_force(spark, rows):
    pdf = pd.DataFrame(rows, columns=["g", "value"]).astype({"value": float})
    vc = counts.value_counts(frame(spark, pdf), ["g"])
    got = {(r.g, r.value): (r.cum_n, r.total_n) for r in counts.cumulative_counts(vc, ["g"], buckets=5).collect()}
    for g, v in got:
        same = pdf[pdf.g == g]
        assert got[(g, v)] == ((same.value <= v).sum(), len(same))


def test_results_do_not_depend_on_partitioning(spark):
    df = spark.range(2000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 1013).cast("double").alias("value"))
    one = counts.quantiles(df.coalesce(1), ["g"], PROBS).collect()
    many = counts.quantiles(df.repartition(7), ["g"], PROBS).collect()
    assert one == many


def test_bucket_of_a_value_does_not_depend_on_partitioning(spark):
    vc = spark.range(30_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 30_011).cast("double").alias("value"), F.lit(1).alias("n"))
    one, many = [counts._bucketed(df, ["g"], "value", ("n",), 64)[0].orderBy("value").collect() for df in (vc.coalesce(1), vc.repartition(7))]
    assert one == many
    sizes = pd.Series([r["_bucket"] for r in one]).value_counts()
    assert len(sizes) == 64 and sizes.max() < 4 * 30_000 / 64


def test_top_values_break_ties_by_value(spark):
    df = frame(spark, pd.DataFrame({"g": ["a"] * 5, "value": [3.0, 3.0, 1.0, 1.0, 2.0]}))
    top = counts.top_values(counts.value_counts(df, ["g"]), ["g"], 2).orderBy("rank").collect()
    assert [(r.value, r.n) for r in top] == [(1.0, 2), (3.0, 2)]


def test_empty_input(spark):
    empty = spark.createDataFrame([], "g string, value double")
    assert counts.quantiles(empty, ["g"], PROBS).count() == 0
