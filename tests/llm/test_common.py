"""What the operators share: hashing by blocks, filters of ids, batches, staged tables; and that native operators stay native."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import common, pii, urlrules


def test_word_hashes_by_blocks():
    rng = random.Random(1)
    for _ in range(200):
        data = np.frombuffer("".join(rng.choice("ab  \n") for _ in range(rng.randrange(60))).encode(), np.uint8)
        start, end = common.word_spans(data)
        want = common.span_hash(common.prefix_hash(data), start, end)
        for block in (1, 2, 3, 7, 64):
            got = common.word_hashes(data, block)
            assert got[0].tolist() == start.tolist() and got[1].tolist() == want.tolist()


def test_id_filter(spark):
    rng = np.random.default_rng(2)
    ids, others = rng.integers(-(1 << 62), 1 << 62, 3_000), rng.integers(-(1 << 62), 1 << 62, 3_000)
    bits = common.id_filter(spark.createDataFrame([(int(i),) for i in ids], "id long"), "id")
    assert common.maybe(bits, ids).all() and common.maybe(bits, others).mean() < 0.01
    assert not common.maybe(common.id_filter(spark.createDataFrame([], "id long"), "id"), ids).any()


def test_gathered():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 3))], ["x"]) for k in range(0, 30, 3)]
    got = list(common.gathered(iter(batches), 7))
    assert [b.num_rows for b in got] == [9, 9, 9, 3] and [x for b in got for x in b.column(0).to_pylist()] == list(range(30))
    assert list(common.gathered(iter([]), 7)) == []


def test_small_batches_keep_smaller_settings(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "10")
    common.small_batches(spark)
    assert spark.conf.get(name) == "10"
    spark.conf.unset(name)
    common.small_batches(spark)
    assert spark.conf.get(name) == str(common.BATCH_ROWS)


def test_a_scope_removes_its_own_tables_only(spark):
    outer = common.staged(spark.range(3), "test")
    with common.staging(spark):
        own = common.staged(spark.range(4), "test")
        with common.staging(spark) as names:
            inner = common.staged(spark.range(5), "test")
        assert len(names) == 1 and own.count() == 4
        with pytest.raises(Exception, match="(?i)not exist|FAILED_READ_FILE"):
            inner.count()
    assert outer.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|FAILED_READ_FILE"):
        own.count()


def test_fresh_names():
    assert common.fresh("key", ["a"]) == "__key" and common.fresh("key", ["__KEY", "___key"]) == "____key"


def test_native_plans_have_no_python(spark):
    """The plans of personal data and URL rules hold built-in expressions only."""
    docs = spark.createDataFrame([(1, "a@b.org token = 12345678ab")], "doc_id long, text string")
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    for out in (pii.redact(docs), pii.personal_spans(docs), urlrules.judge_urls(pages)):
        plan = out._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "MapInArrow", "MapInPandas", "ArrowEval"))
