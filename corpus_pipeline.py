"""The corpus pipeline: language identification, near-duplicate removal, secret redaction, mixing, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of documents. What a stage decides takes effect: rejected documents and
copies are gone, secrets are masked, the mix is what is packed.

Defined cases, for every stage: a null or blank text has no language and goes in the first stage (the later ones keep it:
it is no copy, holds no secret, and has no words to mix); rows with a null doc_id are documents of their own; rows that
repeat a doc_id and its text are copies, rows that repeat a doc_id over other texts are not; ties go to the smallest
doc_id; a text of any length is handled whole; columns beside those of documents, whatever their names, are kept up to
the packing; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.llm import langid, mixing, neardup, packing, secrets
from keystrata.llm.common import shared_folder

#: A document is rejected where its language is unknown or no language has this share of its positions' probability.
LEAST_LANGUAGE_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of no clear language; corrects nothing else, and keeps all columns.

    Learns from the text and lang of the documents that crc32(doc_id) mod 3 doesn't hold out.
    """
    net = langid.fit(docs, ~langid.held_out("doc_id", 3, 1))
    return langid.of_clear_language(net, docs, LEAST_LANGUAGE_SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the smallest doc_id, of each group of near duplicates; of rows that repeat doc_id and text, one."""
    found = neardup.near_duplicates(docs)
    kept = found.filter("kept and doc_id is not null").select(F.col("doc_id").alias("_kept_id")).distinct()
    out = docs.join(kept, docs["doc_id"] == kept["_kept_id"], "left_semi")
    same = F.xxhash64(docs["doc_id"], docs["text"])
    repeats = docs.filter("doc_id is not null").groupBy(same.alias("same")).agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    if repeats:
        first = Window.partitionBy("_same").orderBy("_row")
        out = out.withColumns({"_same": same, "_row": F.xxhash64(*(docs[c] for c in docs.columns))})
        out = out.withColumn("_place", F.row_number().over(first)).filter("_place = 1").select(*(F.col(f"`{c}`") for c in docs.columns))
    return out.unionByName(docs.filter("doc_id is null"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret in the text; keeps every document."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: none, once, twice, or cut, by the source's target weights."""
    return mixing.materialise(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents as token pieces in sequences of at most 4096."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("near_dedup", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Stages 1, 2 and 5 can't be expressed in SQL; the query is tested against a brute-force version.
ORACLE_SQL: str | None = None


def _delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of any file system that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what lies between them is written to the shared checkpoint folder.

    A stage's result goes once the next one is written; that of the last but one, which the returned rows are read from, stays.
    """
    shared_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
