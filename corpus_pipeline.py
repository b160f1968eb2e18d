"""From raw documents to token ids: each stage's decisions take effect on the next.

Stages take (spark, docs, sf_dir) and give a DataFrame; all but the last give the columns of documents.
``run`` writes each stage's result as Parquet in the shared folder and rereads it as the next one's docs; the
result before it goes then.

Each stage works on documents with null ids and texts, empty and very long texts, ties, repeated rows, no rows and
columns of any names besides its own, as the operator that it calls defines: a text that is null, empty or without
letters goes at the first stage; of repeated rows one stays, as later lines go and with them what has no lines left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm import bpe, decontaminate, langid, line_dedup, near_dedup
from veldspar.llm.common import discard, durable, load, prepare


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents and let those go that have no letters or resemble no language."""
    prepare(spark)
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    return langid.of_known_language(docs, langid.train(docs.where(learn)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Earlier lines win, equal or within one edit (see line_dedup); a document of which nothing visible is left goes."""
    prepare(spark)
    return line_dedup.dedup_lines(docs).where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, likeness 0.8 and more."""
    prepare(spark)
    return near_dedup.kept_rows(docs, near_dedup.near_duplicates(docs, n=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words a twentieth or more lies in benchmark windows."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests of the ids and of the bytes they decode to."""
    prepare(spark)
    return bpe.round_trip(docs, with_ids=True)


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("decontaminate", drop_contaminated), ("bpe", encode)]

#: Language prototypes are random projections and near-duplicate groups a closure; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
