"""The corpus pipeline: stages over documents, each calling one operator of orrery.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import bpe, decontam, lines, quality, simhash
from orrery.llm.common import Workspace, documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the risk-controlled cutoffs reject. Null texts fail the base and go; each of several
    rows with one doc_id is judged by itself; other columns stay; an empty table stays empty."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of all documents but the first that has them. No row goes; null texts stay null; rows with
    one doc_id count as one document, rows without as the last; columns but text and n_chars stay."""
    return lines.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies, with all its rows and columns. Empty and null texts are
    copies of each other; rows without doc_id stay."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item: all rows with such a doc_id. Null texts and rows without doc_id stay, and
    so does everything if the benchmark is empty."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's whole text, the digest of their offsets and that of the bytes they decode to. Null text is
    empty; repeated rows stay."""
    return bpe.encode_ids(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]

#: Latent semantic retrieval and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each stage's documents written to the shared folder and read again. What a stage has
    read is deleted when its result is written; the last stage's documents go when the driver ends."""
    ws, docs = Workspace(spark), documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = ws.save(docs, name.replace(" ", "_"))
            ws.drop(before)
    return docs
