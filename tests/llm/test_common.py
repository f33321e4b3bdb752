"""Workers that Spark uses again: the caches of one operator don't stay while another runs."""

from plumbline.llm import context_net, line_index
from plumbline.llm import piece_paths as pp
from plumbline.llm.common import release_memory, worker_cache

TASKS = 16


def _held(spark):
    """Per worker: whether it holds a compiled model."""
    def look(batches):
        import os
        import time

        import pyarrow as pa

        for _ in batches:
            pass
        time.sleep(0.3)  # so that every worker gets a task
        yield pa.RecordBatch.from_pydict({"worker": pa.array([os.getpid()]), "held": pa.array([bool(pp._compiled)])})

    rows = spark.range(0, TASKS, 1, TASKS).mapInArrow(look, "worker bigint, held boolean").distinct().collect()
    return {r.worker for r in rows if r.held}


def test_a_cache_is_kept_for_its_own_operator_alone():
    mine, other = worker_cache({1: 1}), worker_cache({2: 2})
    release_memory(mine)
    assert mine == {1: 1} and other == {}


def test_compiled_models_go_when_other_operators_run(spark):
    docs = spark.range(0, 4000, 1, TASKS).selectExpr("id doc_id", "repeat(concat('words of document ', id, ' '), 200) text")
    for other in (lambda: line_index.frequent_lines(docs).count(), lambda: context_net.context_sums(docs)):
        pp.encode_documents(docs.limit(64).repartition(TASKS)).agg({"n_ids": "sum"}).collect()
        before = _held(spark)
        other()
        assert before and not before <= _held(spark)
