"""What executors hold for Python: batches bounded by bytes, nothing kept by the last stage's workers, no object a word in mixing."""
import gc

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from obsloom.llm import byte_bpe, extendible, near_copies
from obsloom.llm.layout import batch_bytes
from obsloom.llm.mixing import tokens_of

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def batch_sizes(df):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["doc_id"])

    return df.mapInArrow(sizes, "doc_id long")


def wide_docs(spark):
    return spark.range(4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 2000).alias("text"))


def test_last_stage_gets_small_batches_when_its_result_is_read_later(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "digests", lambda docs, *args, **kw: batch_sizes(docs))
    before = spark.conf.get(KEY, None)
    out = corpus_pipeline.encoded(spark, wide_docs(spark), "")
    got = [r[0] for r in out.collect()]
    assert max(got) < 1.1 * corpus_pipeline.BATCH_BYTES and sum(got) > 4000 * 2000
    assert spark.conf.get(KEY, None) == before


@pytest.mark.parametrize("step, module, name", [("exact", extendible, "dedup"), ("near", near_copies, "near_groups")])
def test_other_stages_run_their_jobs_with_small_batches(spark, monkeypatch, step, module, name):
    sizes = []

    def decided(docs, **kw):
        sizes.extend(r[0] for r in batch_sizes(docs).collect())
        return docs.select("doc_id", F.lit(True).alias("kept"), F.col("doc_id").alias("component_id"))

    monkeypatch.setattr(module, name, decided)
    assert getattr(corpus_pipeline, step)(spark, wide_docs(spark), "").count() == 4000
    assert max(sizes) < 1.1 * corpus_pipeline.BATCH_BYTES and sum(sizes) > 4000 * 2000


def test_batch_bound_is_taken_back_after_an_error(spark):
    before = spark.conf.get(KEY, None)
    with pytest.raises(KeyError), batch_bytes(spark, 1000):
        assert spark.conf.get(KEY) == "1000"
        raise KeyError
    assert spark.conf.get(KEY, None) == before


def test_round_trip_leaves_no_codec_behind():
    docs = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words to encode"])], ["doc_id", "text"])
    held = {}

    class Docs:  # the function that a task would run, without Spark
        def mapInArrow(self, work, schema):
            held["work"] = work

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(byte_bpe, "texts", lambda docs: Docs())
        byte_bpe.round_trip(None, path, public_tokenizers.PATTERN, keep=False)
    before = sum(isinstance(o, byte_bpe.Codec) for o in gc.get_objects())
    out = list(held["work"](iter([docs])))
    assert out[0].column(3).to_pylist() == [b"some words to encode"]
    assert sum(isinstance(o, byte_bpe.Codec) for o in gc.get_objects()) == before


def test_pipeline_encodes_without_keeping(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(byte_bpe, "digests", lambda docs, *args, **kw: seen.update(kw) or docs)
    corpus_pipeline.encoded(spark, spark.range(3), "")
    assert seen == {"keep": False}


def test_tokens_are_the_pieces_between_spaces(spark):
    values = ["", " ", "   ", "a", " a  b ", "a\tb c\n", "ü ß  €", "x " * 50, "  y", None]
    df = spark.createDataFrame([(v,) for v in values], "text string")
    got = [r[0] for r in df.select(tokens_of(F.col("text"))).collect()]
    assert got == [1 if v is None else max(len(v.strip(" ").split(" ")), 1) for v in values]
    plan = df.select(tokens_of(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
