"""Registered queries of the subpackage run; those with SQL give the same rows in DuckDB. The pipeline's stages hold their promises."""

import pytest

import corpus_pipeline
from plumbline.llm import queries
from tests.compare import connect, difference, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"
NAMES = list(queries.queries())


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_all_are_there():
    assert [n.split("_")[0] for n in NAMES] == [f"op{i}" for i in range(1, 14)]
    import __spark_entry__ as entry

    assert {*NAMES, "pipeline"} <= set(entry.queries()) and set(queries.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = spark_rows(queries.queries()[name](spark, FOLDER))
    assert got[0] and got[1]
    if name in queries.oracle_sql():
        assert difference(got, duck_rows(duck, queries.oracle_sql()[name])) == ""


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER))
        rows.append(docs.collect())
        assert docs.columns[: len(before)] == before
    whole, good, lined, single, mixed, final = ([(r.doc_id, r.text) for r in x] for x in rows)
    kept = {i for i, _ in good}
    assert set(good) <= set(whole) and sum(labels.get(i) == 1 for i, _ in whole if i not in kept) <= 2
    assert [i for i, _ in sorted(lined)] == sorted(kept) and all(set(t.split("\n")) <= set(dict(good)[i].split("\n")) | {""} for i, t in lined)
    assert set(single) <= set(lined) and len(set(single)) == len(single)
    assert set(mixed) <= set(single) and all(mixed.count(x) <= 3 for x in set(mixed))
    assert sorted(final) == sorted(mixed) and all(r.round_trip and len(r.ids) == r.n_ids for r in rows[-1])


def test_pipeline_defined_cases(spark, tmp_path):
    rows = [(i, t, "en", s, n, "extra") for i, t, s, n in [
        (1, "one two three four five six seven eight", "a", 39), (1, "one two three four five six seven eight", "a", 39), (2, None, "a", None), (3, "", None, 0),
        (None, "text without an id", "b", 18), (4, "one two three four five six seven eight", "b", 39), (5, "w " * 30_000, "b", 60_000)]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, copies string"
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    single = corpus_pipeline.near_copies(spark, docs, folder).collect()
    assert sorted(str(r.doc_id) for r in single) == ["1", "2", "3", "5", "None"]
    corpus_pipeline.run(spark, folder).collect()
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"file://{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{empty}").count() == 0
