"""A session with the settings that the operators are written for."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "grainledger", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in ({"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share: what ``spark.checkpoint.dir`` names.

    Only where that is unset and driver and tasks are one process, as in tests, a temporary folder is made and set; on a
    cluster without the setting this is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="grainledger-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Rows that a task is given where large tables meet: what it sorts or holds doesn't grow with the tables.
PART_ROWS = 500_000


def parts_of(df: DataFrame) -> int:
    """Parts of about PART_ROWS rows; counting a table's rows reads its footers only."""
    return max(1, -(-df.count() // PART_ROWS))


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """df in so many parts by these keys, which stay as they are, also where small ones would be joined to large ones; one part: as it comes."""
    return df.repartition(parts, *keys) if parts > 1 else df


#: Bytes of rows that go to a Python worker at once; Spark's own bound is 10,000 rows, whatever their length.
BATCH_BYTES = 2 << 20
#: What a task holds of long texts: those of a vector that it reads, and of a row group that it writes.
SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.parquet.columnarReaderBatchSize": "512", "parquet.block.size": str(8 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Bounds what the JVM and a Python worker hold of a task's rows, for the session from now on; a bound that the user set stays."""
    given = spark.conf.getAll
    for key, value in SMALL.items():
        if key not in given:
            spark.conf.set(key, value)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder, so that a lost executor costs no work done before this point."""
    context = df.sparkSession.sparkContext
    where = shared_folder(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return df.checkpoint(eager=True)
