"""Lineage, joins, cleaning, reading and writing."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cleaning, fusion, joins, lineage
from plumbline.operators.column_profile import profile_columns
from plumbline.sources import readers, writers
from plumbline.types import columns_by_kind


def test_schema_diff(spark):
    a = spark.createDataFrame([(1, "x", 2.0)], "id int, s string, v double")
    b = a.select(F.col("id").cast("bigint").alias("id"), "v", F.lit(1).alias("n"))
    r = lineage.schema_diff(a, b, "derive").first()
    assert (r.new_columns, r.dropped_columns) == (["n"], ["s"])
    c = lineage.schema_changes(lineage.snapshot(a, "j", 0, "in").unionByName(lineage.snapshot(b, "j", 5, "out"))).first()
    assert (c.stage_no, c.kept_columns, c.retyped_columns) == (5, ["id", "v"], ["id"])


def test_schema_changes_move_snapshots_once(spark):
    rows = spark.range(10).select(F.col("id").cast("string").alias("job"), F.lit(1).alias("stage_no"), F.lit("s").alias("stage"), F.lit("a").alias("column"), F.lit("t").alias("type"))
    plan = lineage.schema_changes(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_impact_with_a_cycle_and_a_hub(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")] + [("d", f"x{i}") for i in range(50)], "source string, target string")
    got = {(r.start, r.node): r.depth for r in lineage.impact(edges, spark.createDataFrame([("a",), ("x1",)], "start string")).collect()}
    assert got[("a", "d")] == 3 and got[("a", "x7")] == 4 and got[("a", "a")] == 0 and got[("x1", "x1")] == 0 and len(got) == 55


def test_edges_from_model_text(spark):
    ok = '{"lineage": [{"source_columns": ["a", "b"], "target_column": "c", "operation": "concat"}]}'
    df = spark.createDataFrame([("j", 1, "x " + ok), ("j", 2, "broken {"), ("k", 1, None)], "job string, stage_no int, t string")
    assert [(r.job, r.source, r.target) for r in lineage.parse_edges(df, "t").orderBy("source").collect()] == [("j", "a", "c"), ("j", "b", "c")]


def test_suffix_join(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, name string")
    b = spark.createDataFrame([(1, "z", 5)], "k int, name string, n int")
    rows = joins.left_with_suffix(a, b, ["k"], "_b").orderBy("k").collect()
    assert [r.asDict() for r in rows] == [{"k": 1, "name": "x", "name_b": "z", "n": 5}, {"k": 2, "name": "y", "name_b": None, "n": None}]


def test_null_is_a_category(spark):
    now = spark.createDataFrame([("a",), (None,)], "v string")
    assert [r.v for r in joins.new_keys(now, spark.createDataFrame([("a",)], "v string"), ["v"]).collect()] == [None]
    assert joins.new_keys(now, now, ["v"]).count() == 0


def test_nested_columns_are_reported(spark):
    k = columns_by_kind(spark.createDataFrame([(1, [1], True)], "a int, b array<int>, c boolean"))
    assert (k.numeric, k.categorical, k.skipped) == (("a",), ("c",), ("b",))


def test_scaling_round_trip(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (8.0, 5.0)], "a double, flat double")
    for how in ("standard", "minmax"):
        s = cleaning.scale(df, ["a", "flat"], how)
        assert s.agg(F.max(F.abs("flat"))).first()[0] == 0
        back = [r.a for r in cleaning.unscale(s, ["a"], df, how).orderBy("a").collect()]
        assert back == pytest.approx([1.0, 3.0, 8.0])


def test_model_matrix_bounds(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,), (2.0,)], "a double")
    assert [r.a for r in cleaning.model_matrix(df, ["a"]).collect()] == [1e10, -1e10, 0.0, 0.0, 2.0]


def test_target_features():
    names = ["a_Mean", "a_StandardDeviation", "b_Mean_zscore_7d", "c_x"]
    assert cleaning.target_feature_names(names, ["a", "b"]) == ["a_Mean", "a_StandardDeviation", "b_Mean_zscore_7d"]


def test_csv_round_trip_needs_a_schema(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    df = readers.from_rows(spark, [(1, "x"), (2, None)], "a int, s string")
    writers.write_table(df, path, "csv")
    with pytest.raises(ValueError):
        readers.read_table(spark, path)
    assert sorted(readers.read_table(spark, path, "a int, s string").collect()) == sorted(df.collect())


def test_union_of_history_and_source(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "q")], "x int, y string")
    assert {tuple(r) for r in readers.with_history(a, b).collect()} == {(1, None), (2, "q")}


def test_profile_and_definition_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "user_id int, note string").withColumn("at", F.lit("2024-05-01").cast("timestamp"))
    writers.write_profile(profile_columns(df), str(tmp_path / "p"))
    at = [r for r in spark.read.json(str(tmp_path / "p")).collect() if r.column_name == "at"][0]
    assert at.min_date == "2024-05-01T00:00:00"
    writers.write_column_definitions(df, str(tmp_path / "d"), {"note": "free text"})
    rows = {r["name"]: r for f in (tmp_path / "d").glob("*.json") for r in map(json.loads, f.read_text().splitlines())}
    assert rows["user_id"]["pii_status"] == "PII" and rows["note"]["description"] == "free text" and rows["note"]["pii_status"] == "NON_PII"


def test_report_and_summary_files(spark, tmp_path):
    table = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "d string, n int").select(F.to_timestamp("d").alias("period"), "n")
    writers.write_report({"actions": table}, str(tmp_path / "r"))
    assert {p.name for p in (tmp_path / "r" / "actions").glob("date=*")} == {"date=2024-01-01", "date=2024-01-02"}
    f = spark.createDataFrame([("g1", "a", 1), ("g1", "b", 1), ("g2", "a", 0)], "g string, column string, flag int")
    writers.write_summary(fusion.group_summary(f, "g"), str(tmp_path / "s"))
    text = "".join(p.read_text() for p in (tmp_path / "s").glob("part-*"))
    assert text.splitlines() == ["groups: 2", "groups with flags: 1", "flags: 2", "a: 1", "b: 1", "g1: 2", "g2: 0"]


def test_a_long_chain_is_followed_to_its_end(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(60)], "source string, target string")
    out = lineage.impact(edges, spark.createDataFrame([("n0",)], "start string"))
    assert out.count() == 61 and out.agg(F.max("depth")).first()[0] == 60
    with pytest.raises(RuntimeError):
        lineage.impact(edges, spark.createDataFrame([("n0",)], "start string"), max_rounds=5)


def test_reached_pairs_are_stored_by_start(spark):
    edges = spark.createDataFrame([("a", f"b{i}") for i in range(50)], "source string, target string")
    out = lineage.impact(edges, spark.createDataFrame([("a",)], "start string"))
    files = out.inputFiles()
    assert out.count() == 51 and files and all(f.endswith(".parquet") for f in files) and len(files) <= lineage.SLICES + 1


def test_null_policy_and_type_repair(spark):
    df = spark.createDataFrame([(i, None, "1,2" if i else None, str(i), "k") for i in range(12)], "i int, gone string, l string, n string, few string")
    assert cleaning.repair_types(df).dtypes == [("i", "int"), ("l", "double"), ("n", "double")]
    assert cleaning.fill_for_models(df).where("l = 'unknown'").count() == 1 and "gone" not in cleaning.fill_for_models(df).columns
