"""Tables that cut a long plan: written to the folder that driver and executors share, read back, dropped when done with."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a new one where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own: its plan is cut, and a lost executor costs nothing that was written."""
    path = f"{shared(df.sparkSession)}/scratch/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the table that `written` made; nothing for other DataFrames."""
    path = getattr(df, "_written_at", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def dealt(df: DataFrame) -> DataFrame:
    """df dealt out evenly for costly work on each row: a table of few bytes is read by few tasks, however many rows it has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def prefix_sums(rows: DataFrame, by: str, n: str) -> DataFrame:
    """rows with `upto`: the sum of n over all rows up to each one in the order of `by`, whose values are distinct.

    Rows are dealt out by range of `by`; only the sum of each part goes through one task.
    """
    dealt = written(rows.repartitionByRange(F.col(by)).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum(n).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = F.broadcast(sums.select("_part", ahead.alias("_before")))
    own = F.sum(n).over(W.partitionBy("_part").orderBy(by).rowsBetween(W.unboundedPreceding, 0))
    return dealt.withColumn("upto", own).join(before, "_part").withColumn("upto", F.col("upto") + F.col("_before")).drop("_part", "_before")
