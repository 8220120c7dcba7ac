"""What several text operators need: the shared folder, written tables and byte columns."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only where that is unset and all runs
    on one machine, as in tests, a local folder takes its place."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"tidewright-{os.getuid()}")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and a lost executor
    costs a read, not the work before it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain_read(df: DataFrame) -> bool:
    """Whether df is a table just read from files, whose rows come in the same order each time."""
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def stable(df: DataFrame, *columns: Column) -> DataFrame:
    """The columns of df, and rid, a number for each row that stays the same however often the rows are
    read: by place in a plain read's files, which the session from now on cuts alike however many
    executors there are; anything else is written first."""
    spark = df.sparkSession
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(1, spark.sparkContext.defaultParallelism)))
    rows = df.select(F.monotonically_increasing_id().alias("rid"), *columns)
    return rows if plain_read(df) else write_table(rows, "rows")


def in_written_order(df: DataFrame) -> DataFrame:
    """A table just read from Parquet files with its rows in the order in which they were written. A
    plain read deals the files out by size. What is no plain read is returned as it is."""
    if not plain_read(df):
        return df
    file = F.col("_metadata.file_name")
    return df.sort(F.regexp_extract(file, r"part-(\d+)", 1).cast("long"), file, F.col("_metadata.row_index"))


def remove_table(df: DataFrame) -> None:
    """Delete the files of a table that write_table() has written, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the executors' disks go of shuffle files that no plan refers to any more. Spark deletes them
    when the driver collects its garbage, which a driver with little to do does rarely."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def split_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds: the split between training and held-out rows."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions_for(df: DataFrame, at_least: int = 1) -> int:
    """How many shuffle partitions the session is set to; callers deal Python work out by it."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def byte_column(column):  # noqa: ANN001, ANN201
    """The bytes of an Arrow binary column without nulls, and where its rows start and end in them."""
    import numpy as np
    import pyarrow as pa

    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    ends = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return flat, ends - ends[0]


def portions(ends, most: int):  # noqa: ANN001, ANN201
    """Runs [i, j) of rows of at most so many bytes together, or of one row."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = i + 1
        while j < n and ends[j + 1] - ends[i] <= most:
            j += 1
        yield i, j
        i = j


def mixed(x, salt: int = 0):  # noqa: ANN001, ANN201
    """The finaliser of splitmix64 on an array of uint64."""
    import numpy as np

    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
