"""Small helpers shared by the text operators."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Place of a null doc_id: before every other document.
NULL_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: Arrow batches of fewer rows keep the Python workers small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def by_document(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, pk, th) dealt by document: pk is the id with null as NULL_ID, th a hash of the text.

    Rows with the same id, or none, and different texts are different documents. Every later join
    with facts about documents is on (pk, th), so the texts move once: Spark reuses this exchange
    wherever the frame is used again within a plan. That needs the same columns each time, so
    there is no other column, and doc_id is read back from pk.
    """
    text = F.col(text_col).cast("string")
    return docs.select(text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("pk"), text_hash(text).alias("th")).repartition(partitions(docs), "pk", "th")


def doc_ids(pk: pa.Array) -> pa.Array:
    """The ids that pk stands for."""
    at = pk.to_numpy()
    return pa.array(at, pa.int64(), mask=at == NULL_ID)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and their offsets; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def texts(column: pa.Array) -> list[bytes]:
    data, at = utf8(column)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: the one set, or the one that spark.checkpoint.dir names.

    A local session without either gets a temporary folder; on a cluster that is an error, since
    machines don't see each other's folders.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not named:
            import tempfile

            named = tempfile.mkdtemp()
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder, cut from its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: compressed, and read by column."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
