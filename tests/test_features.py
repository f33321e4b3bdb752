"""Flat rolling metrics of every default window."""

from plumbline.operators import rolling
from plumbline.plans import catalogue


def test_flat_names_of_every_window(spark):
    query = next(q for q in catalogue.all_queries() if q.name == "rolling_flat_windows")
    got = [r.metric for r in query.run(spark, "/root/testdata/sf0.001").collect()]
    want = [f"{m}_{f}" for m in ("orders", "price") for w in rolling.WINDOWS
            for f in [*[f"rolling_{w}d_{s}" for s in ("mean", "std", "min", "max")], *[f"{s}_{w}d" for s in ("zscore", "anomaly", "trend", "diff", "ratio")]]]
    assert sorted(got) == sorted(want)
