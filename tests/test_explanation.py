"""Explanations of the days that the detection flags."""

from plumbline.plans import catalogue, detection, explanation
from plumbline.plans.features import order_days
from plumbline.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"


def test_every_flagged_day_is_explained(spark):
    t = Tables(spark, FOLDER)
    flagged = {str(r.period)[:10]: r.severity for r in detection.detect_periods(order_days(t)).where("consensus_anomaly").collect()}
    query = next(q for q in catalogue.all_queries() if q.name == "explain_raw_flagged")
    got = query.run(spark, FOLDER).collect()
    assert len(flagged) > 3 and {r.period: r.overall_severity for r in got} == flagged
    assert sorted({(r.period, r.metric) for r in got}) == sorted((p, f"{m}_deseasonalized") for p in flagged for m in ("orders", "price"))
    newest = {r.period for r in order_days(t).selectExpr("date_format(period, 'yyyy-MM-dd') as period").distinct().orderBy("period", ascending=False).limit(3).collect()}
    assert set(flagged) - newest
