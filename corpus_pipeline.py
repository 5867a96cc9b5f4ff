"""A training corpus from raw documents, in five stages.

Each stage reads what the one before wrote. All but the last return the columns
of the documents table.

quality  drops documents that the quality policy rejects
dedup    keeps one document of each near-duplicate group
pii      replaces personal data in the texts that are left
mix      repeats sources up to the limit; every document is drawn at least once
pack     lays the drawn documents into token sequences
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import minhash, mixing, packing, pii, quality
from rasterloom.llm.common import documents, scratch_dir
from rasterloom.llm.queries import WORD_VOCAB, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Tokenizers and iterative joins have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the newest policy rejects."""
    rows = quality.apply_policy(quality.ledger(docs), quality.POLICIES["v2"])
    return rows.filter("kept").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate group; of repeated rows with its id, one."""
    found = minhash.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(found.filter("doc_id is not null"), "doc_id", "left_semi")
    order = F.struct(F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars"))
    one = kept.groupBy("doc_id").agg(F.min(order).alias("r")).select("doc_id", "r.*")
    return one.unionByName(docs.select(*COLUMNS).filter("doc_id is null")).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each span of personal data replaced by its kind; n_chars follows."""
    rows = pii.redacted(docs.select(*COLUMNS))
    return rows.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each draw."""
    return mixing.mix(docs).select(*COLUMNS)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a sequence."""
    return packing.packed(docs, vocabulary(WORD_VOCAB))


STAGES = [("quality", quality_stage), ("dedup", dedup_stage), ("pii", pii_stage), ("mix", mix_stage), ("pack", pack_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each result written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    base = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{base}/{k}-{name}"
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
    return out
