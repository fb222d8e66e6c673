import corpus_pipeline
import pyarrow as pa
import pytest
from overstrata.llm import common, packing

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbounded(spark):
    spark.conf.unset(KEY)
    yield
    spark.conf.unset(KEY)


def _sizes(docs):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    return docs.mapInArrow(run, "n long, bytes long").collect()


def test_batches_of_a_stage_are_bounded_in_bytes(spark, unbounded, monkeypatch):
    """1,500 rows of 10 KB went to a worker as one batch of 15 MB; a row beyond the bound stays whole."""
    monkeypatch.setattr(packing, "pack", _sizes)
    docs = spark.range(1500, numPartitions=1).selectExpr("id as doc_id", f"repeat('x', if(id = 7, {3 * common.STEP_BYTES}, 10000)) as text")
    got = corpus_pipeline.packed(spark, docs, "")
    assert sum(r.n for r in got) == 1500 and sum(r.bytes for r in got) >= 1499 * 10_000 + 3 * common.STEP_BYTES
    assert sorted(r.bytes for r in got)[-2] < 1.1 * common.STEP_BYTES


def test_every_stage_is_bounded_and_a_lower_bound_stays(spark, unbounded):
    class Stop(Exception):
        pass

    class Docs:
        sparkSession = spark

        def __getattr__(self, name):
            raise Stop

    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(KEY)
        with pytest.raises(Exception):  # noqa: B017  none of them gets far without docs
            stage(spark, Docs(), "/none")
        assert spark.conf.get(KEY) == str(common.STEP_BYTES)
    spark.conf.set(KEY, "512k")
    common.bounded_bytes(spark.range(1))
    assert spark.conf.get(KEY) == "512k"


def test_packed_rows_do_not_depend_on_batches(spark, odd_docs, unbounded):
    rows = lambda df: sorted(df.collect(), key=str)
    before = rows(packing.pack(odd_docs))
    assert spark.conf.get(KEY) != str(common.STEP_BYTES)
    spark.conf.set(KEY, "1")  # batches of a row
    assert rows(corpus_pipeline.packed(spark, odd_docs, "")) == before
