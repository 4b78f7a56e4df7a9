"""E11's sink: write batches of a bounded size, each sent once however often a run fails and is repeated.

Batches are formed by ``assign_batches`` (the same rows always give the same batches) and known by a digest of their
rows.  They are written in waves; after a wave its batches are entered in a ledger next to the data.  A rerun compares
the digests with the ledger and writes only what is missing or has changed; what a failed wave left behind is in no
ledger and is not read.  Ledger and digests are tables: nothing is gathered on the driver.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import assign_batches
from ..session import materialize

LEDGER = "bucket int, batch int, rows long, digest long, mix long, attempt int"
WAVES = 4
FILES_PER_TASK = 50


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The batches sent: of each (bucket, batch) its last attempt."""
    if not _exists(spark, f"{path}/ledger"):
        return spark.createDataFrame([], LEDGER)
    last = F.max(F.struct("attempt", "rows", "digest", "mix")).alias("last")
    entries = spark.read.schema(LEDGER).json(f"{path}/ledger")
    return entries.groupBy("bucket", "batch").agg(last).select("bucket", "batch", "last.*")


def send_batches(
    df: DataFrame, id_col: str, path: str, batch_size: int = 500, bucket_rows: int = 1_000_000,
    bucket_of: Callable[[Column], Column] | None = None, waves: int = WAVES,
    after_wave: Callable[[int], None] | None = None,
) -> int:
    """Write every batch that the ledger does not hold yet, one JSON file a batch; returns the attempt's number.

    ``after_wave(n)`` is called before wave ``n`` is entered in the ledger (what it raises ends the run there).
    """
    path, spark = path.rstrip("/"), df.sparkSession
    batched = materialize(assign_batches(df, id_col, batch_size, bucket_rows, bucket_of), "batches")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    one, two = F.xxhash64(row), F.xxhash64(F.lit(1), row)
    digests = batched.groupBy("bucket", "batch").agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(one).alias("digest"), F.bit_xor(two).alias("mix")
    )
    sent = materialize(ledger(spark, path), "ledger")
    attempt = (sent.agg(F.max("attempt")).first()[0] or 0) + 1
    while _exists(spark, f"{path}/data/attempt={attempt}"):
        attempt += 1  # a failed run's folder
    missing = materialize(
        digests.join(sent.drop("attempt"), ["bucket", "batch", "rows", "digest", "mix"], "left_anti"), "missing-batches"
    )
    # the work of a wave is its files, however few bytes they have: tasks by their number, whole buckets each
    tasks = max(spark.sparkContext.defaultParallelism, -(-missing.count() // (waves * FILES_PER_TASK)))
    for wave in range(waves):
        own = missing.filter(F.pmod("bucket", F.lit(waves)) == wave)
        rows = batched.filter(F.pmod("bucket", F.lit(waves)) == wave).join(own.select("bucket", "batch"), ["bucket", "batch"], "left_semi")
        rows = rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", "batch", id_col)
        # whole batches in order, only a bucket's last one is smaller: a file a batch
        rows.write.mode("append").options(**{
            "maxRecordsPerFile": batch_size, "ignoreNullFields": False,
            # tasks move their own files; nothing is read before its wave is in the ledger
            "mapreduce.fileoutputcommitter.algorithm.version": 2,
        }).partitionBy("bucket").json(f"{path}/data/attempt={attempt}")
        if after_wave:
            after_wave(wave)
        own.withColumn("attempt", F.lit(attempt)).write.mode("append").json(f"{path}/ledger")
    return attempt


def sent_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all sent batches (``schema``, bucket, batch), each once."""
    path = path.rstrip("/")
    full = T.StructType([*schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("batch", "attempt", "bucket"))])
    rows = spark.read.schema(full).json(f"{path}/data")
    return rows.join(ledger(spark, path).select("bucket", "batch", "attempt"), ["bucket", "batch", "attempt"], "left_semi").select(
        *schema.names, "bucket", "batch"
    )
