"""Places of rows inside their groups, where one group may hold any share of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainledger.llm.common import cut


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with ``pos``, a row's place in its group from 0, by ``order`` ascending, nulls first; written to the shared folder.

    Rows are range-partitioned by group and order, so a group that holds a third of all rows lies in many partitions. A
    task counts places inside its own part of a group; what comes before that part is added from counts by group and
    partition, of which at most one a partition isn't 0. A null group is a group. Rows equal in all of ``order`` follow
    each other in any sequence.
    """
    by = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    salted = df.withColumn("tie", F.monotonically_increasing_id())  # equal rows can be dealt out, too
    laid = salted.repartitionByRange(*by, F.col("tie")).sortWithinPartitions(*by, "tie").drop("tie").withColumn("part", F.spark_partition_id())
    at = laid.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen = object(), 0
        for batch in batches:
            keys = batch.column(at).to_pylist()
            first = np.fromiter((a != b for a, b in zip(keys, [before, *keys])), bool, len(keys))
            place = np.arange(len(keys))
            starts = np.where(first, place, 0)
            inside = place - np.maximum.accumulate(starts) + np.where(np.cumsum(first) == 0, seen, 0)
            if len(keys):
                before, seen = keys[-1], int(inside[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside, pa.int64())], names=[*batch.schema.names, "pos"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in laid.schema)
    got = cut(laid.mapInArrow(run, f"{kinds}, pos long"))
    counts = got.groupBy(group, "part").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.col(group).alias("of"), F.col("part").alias("in_part"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("shift")).where("shift > 0")
    joined = got.join(F.broadcast(shift), F.col(group).eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")), "left")
    return joined.select(*df.columns, (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"))
