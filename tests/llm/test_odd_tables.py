"""The pipeline and chat formatting on odd and empty tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import chat
from tests.llm.test_operators import SF, odd  # noqa: F401


def _folder(spark, tmp_path, docs) -> str:
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    return f"file://{tmp_path}"


def test_pipeline_on_odd_rows(spark, odd, tmp_path):  # noqa: F811
    """Null, empty, long and repeated texts, one doc_id twice, no doc_id, clashing columns: what has fifty words and is no copy stays."""
    unnamed = odd.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("text", F.concat(F.lit("quite another beginning of words "), F.expr("array_join(transform(sequence(1, 30000), i -> concat('word', i * 17)), ' ')")))
    got = corpus_pipeline.run(spark, _folder(spark, tmp_path, odd.unionByName(unnamed))).collect()
    ids = [r["doc_id"] for r in got]
    assert ids.count(None) == 1
    assert not {1, 2, 3, 4, 7, 8, 9, 10, 11} & set(ids)  # null, empty, short, or the same words again and again
    assert ids.count(6) in (0, 2)  # rows of one doc_id go together
    long = unnamed.first()["text"]
    assert {r["doc_id"]: r for r in got}[None]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()


def test_pipeline_on_no_rows(spark, odd, tmp_path):  # noqa: F811
    assert corpus_pipeline.run(spark, _folder(spark, tmp_path, odd.limit(0))).collect() == []


def test_chat_on_odd_rows(spark):
    """Empty tables, very long texts, and columns with names of the operator's own."""
    schema = "conv_id bigint, turn int, role string, text string"
    none = chat.digest(spark.createDataFrame([], schema)).collect()
    assert [r["conv_id"] for r in none] == [-1]
    long = "<|im_end|>\n" * 60_000 + "see https://a.b/c.png now"
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (None, None, None, None)], schema)
    df = df.withColumn("n_turns", F.lit("x")).withColumn("links", F.lit(1)).withColumn("parts", F.lit(None)).withColumn("formatted", F.lit(2)).withColumn("loss_chars", F.lit(3))
    got = {r["conv_id"]: r for r in chat.digest(df).collect()}
    assert set(got) == {1, None, -1} and got[1]["n_turns"] == 2 and got[1]["loss_chars"] == len(long)
    assert got[1]["turns_sha256"] == hashlib.sha256(f"user\n{long}\nassistant\n{long}\n".encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest() and got[1]["n_attachments"] == 2 and got[None]["loss_chars"] == 0
