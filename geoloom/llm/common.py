"""Helpers shared by the corpus operators: the shared scratch folder, written tables, checked broadcasts."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words in every contract of this package (space and \t..\r).
WORD = r"[^\x20\x09-\x0D]+"

#: SQL setting that drops an execution's shuffle files once its written result replaces them.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a new one where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_UP, before)


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, its shuffle files go.

    A lost executor costs nothing that was written; `dropped` frees the table once it is no longer read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table that `written` made."""
    path = getattr(df, "_written_at", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def small_side(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most `most_rows` rows (counted here), df itself beyond that.

    df should be cheap to count: a written table or a source.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def told_apart(rows: DataFrame, summary) -> tuple[DataFrame, DataFrame]:
    """rows with a column tid by which equal texts, and no others, are equal; and summary(rows), written, with tid and whole.

    tid is a 64-bit hash of the text; where two texts share one (their digests `whole` differ), both get others. rows
    has the text as `text`. How many texts clash follows n * n / 2**65: none for a billion texts, hundreds at 100 TB.
    """
    rows, again = rows.withColumn("tid", text_hash()), 0
    while True:
        small = written(summary(rows))
        clash = small.groupBy("tid").agg(F.min("whole").alias("low"), F.max("whole").alias("high")).where("low != high").select("tid")
        if clash.isEmpty():
            return rows, small
        again += 1
        clash = small_side(written(clash.withColumn("clash", F.lit(True))), 100_000)
        rows = rows.join(clash, "tid", "left").withColumn("tid", F.when(F.col("clash"), F.xxhash64(F.sha2("text", 256), F.lit(again))).otherwise(F.col("tid"))).drop("clash")
        dropped(small)


def text_hash() -> F.Column:
    return F.xxhash64("text")


def hot(counts: DataFrame, n: str, rows: int) -> DataFrame:
    """The rows of counts with more than a quarter of a shuffle partition's share of all rows: at most four a partition,
    so they may be sent to every task whatever the table."""
    parts = partitions(counts.sparkSession)
    return F.broadcast(counts.where(F.col(n) > max(1, rows // (4 * parts))))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[memoryview, list[int]]:
    """UTF-8 bytes of a whole Arrow string column and its n+1 offsets (a null has no bytes)."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return memoryview(b""), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = memoryview(data)[at[0] : at[-1]] if data is not None else memoryview(b"")
    return raw, at - at[0]


#: Bytes of an Arrow batch that a task is handed at once, set unless the session has a lower one.
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Python workers small: texts may be long, and a worker holds a batch and what it makes of it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = str(spark.conf.get(key, "64m")).lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(size[-1:], 0)
    if not size[:-1].isdigit() or int(size.rstrip("kmg")) << unit > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(path: str, name: str, spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def apart(docs: DataFrame, text: str) -> DataFrame:
    """(row, text): a struct of the other columns, and the text beside it."""
    return docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row"), F.col(text).alias("text"))


def together(df: DataFrame, columns: list[str], text: str, as_text=None) -> DataFrame:
    """The columns that `apart` took apart, in their order."""
    return df.select(*((F.col("text") if as_text is None else as_text).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in columns))
