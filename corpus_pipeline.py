"""Corpus pipeline: five text operators one after the other over ``documents``.

toxicity (documents predicted toxic go), n-gram Jaccard join (the document with the least id of
each group of near duplicates stays; sets of five-word shingles, linked from a similarity of 0.8), benchmark decontamination (documents that hold a benchmark
window go), secret scans (spans that look live are replaced), SentencePiece encoding (adds ids).

Defined cases, for every stage: nulls stay nulls, and a null text is judged as an empty one (not
toxic, no duplicate of another text, without benchmark words or secrets, no ids); very long texts
are read whole; an empty table gives an empty one; columns beyond those of documents are
dropped. Rows with a null or repeated doc_id: those with the same text are one document in the
second stage, which keeps one row of it; those with different texts are judged each for itself.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxalign.llm.common import NULL_ID, shared_folder, table, text_hash
from fluxalign.llm.decontamination import decontaminate
from fluxalign.llm.jaccard_join import components_of_texts
from fluxalign.llm.piece_encoding import encode_pieces
from fluxalign.llm.queries import TOKENIZERS
from fluxalign.llm.secrets_scan import redact
from fluxalign.llm.toxicity import score, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labelled rows among ``documents``; rows predicted toxic go."""
    model = train(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score(docs, model, COLUMNS).where("predicted = 0").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the least by id and hash of the text."""
    stays = components_of_texts(docs, n=5, percent=80).where("id = least.id and th = least.th").select(F.col("id").alias("_id"), F.col("th").alias("_th"))
    keyed = docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), text_hash(F.col("text").cast("string")).alias("_th"))
    return keyed.join(stays, ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark; rows are judged one by one."""
    judged = decontaminate(spark, docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return judged.where("not contaminated").select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; values that look live are replaced in their texts."""
    return redact(docs.select(COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ids, n_tokens and lossless beside the columns of documents."""
    return encode_pieces(spark, docs, os.path.join(TOKENIZERS, "piece_bpe_32k.model"), keep=COLUMNS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("piece_encoding", encode),
]
#: Learned scores, connected components and merge segmentation have no SQL form; the tests hold
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is written to the shared folder and read by the next."""
    shared = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{shared}/{number}")
            docs = spark.read.parquet(f"{shared}/{number}")
    return docs
