"""Tables that grow by committed pieces: stages written whole or not at all, schemas in steps, and merges that cost what a batch costs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMMITS = "_commits"


def _folder(spark: SparkSession, path: str):
    """(file system, path) as Hadoop names them; any store that Spark writes to."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _folder(spark, path)
    return fs.exists(where)


# stages


def commit_stage(root: str, run: str, tables: dict[str, DataFrame]) -> None:
    """Writes all tables of a stage's run, then one marker that makes them visible together.

    A stage that fails on the way leaves no marker, so readers see what they saw before; the run can be written again. A run that was
    committed is replaced: its marker goes first.
    """
    spark = next(iter(tables.values())).sparkSession
    fs, marker = _folder(spark, f"{root}/{_COMMITS}/run={run}")
    fs.delete(marker, True)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/run={run}")
    spark.createDataFrame([(name,) for name in tables], "name string").coalesce(1).write.mode("overwrite").parquet(f"{root}/{_COMMITS}/run={run}")


def committed(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Rows of a table with ``run`` (string), of committed runs alone; none where nothing is committed."""
    whole = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("run", T.StringType())])
    if not _exists(spark, f"{root}/{_COMMITS}") or not _exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], whole)
    runs = spark.read.schema("name string, run string").parquet(f"{root}/{_COMMITS}").where(F.col("name") == name).select("run")
    return spark.read.schema(whole).parquet(f"{root}/{name}").join(runs, "run", "left_semi").select(*whole.names)


# schemas


@dataclass(frozen=True)
class Step:
    """One version of a table's schema: what changes from the one before. Each change may be applied again without effect."""

    version: int
    rename: dict[str, str] = field(default_factory=dict)
    add: dict[str, tuple[str, str]] = field(default_factory=dict)  # column: (type, SQL of its value)
    recode: dict[str, dict[str, str]] = field(default_factory=dict)  # column: old value to new value
    retire: str | None = None  # rows that go, as SQL
    unique: tuple[tuple[str, ...], tuple[str, ...]] | None = None  # (key, order): the last row of each key stays
    drop: tuple[str, ...] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        for old, new in self.rename.items():
            if old in df.columns:
                df = df.withColumn(new, F.coalesce(new, old)).drop(old) if new in df.columns else df.withColumnRenamed(old, new)
        for name, (kind, value) in self.add.items():
            if name not in df.columns:
                df = df.withColumn(name, F.expr(value).cast(kind))
        for name, values in self.recode.items():
            said = reduce(lambda e, x: e.when(F.col(name) == x[0], x[1]), list(values.items())[1:], F.when(F.col(name) == next(iter(values)), next(iter(values.values()))))
            df = df.withColumn(name, said.otherwise(F.col(name)))
        if self.retire:
            df = df.where(f"not coalesce({self.retire}, false)")
        if self.unique:
            key, order = self.unique
            df = df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")
        return df.drop(*self.drop)


def migrated(spark: SparkSession, path: str, steps: list[Step]) -> DataFrame:
    """All rows under ``path``, whose parts lie in schema_version=<n>, as the newest version has them.

    A part goes through the steps after its own version; uniqueness of the newest version holds over all parts together.
    """
    versions = [0, *(s.version for s in steps)]
    parts = []
    for v in versions:
        if _exists(spark, f"{path}/schema_version={v}"):
            parts.append(reduce(lambda df, s: s.apply(df), [s for s in steps if s.version > v], spark.read.parquet(f"{path}/schema_version={v}")))
    if not parts:
        raise ValueError(f"no version of the table under {path}")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    last = next((s for s in reversed(steps) if s.unique), None)
    return Step(last.version, unique=last.unique).apply(rows) if last and len(parts) > 1 else rows


def migrate(spark: SparkSession, path: str, steps: list[Step]) -> list[int]:
    """Rewrites older parts as the newest version; versions that were rewritten, none when all is new already.

    The newest part is written beside the old ones under another name and takes its place at the end.
    """
    newest = steps[-1].version
    old = [v for v in (0, *(s.version for s in steps[:-1])) if _exists(spark, f"{path}/schema_version={v}")]
    if not old:
        return []
    migrated(spark, path, steps).write.mode("overwrite").parquet(f"{path}/_staged")
    fs, staged = _folder(spark, f"{path}/_staged")
    for v in (*old, newest):
        fs.delete(_folder(spark, f"{path}/schema_version={v}")[1], True)
    fs.rename(staged, _folder(spark, f"{path}/schema_version={newest}")[1])
    return old


# merges

#: Runs of a level that become one of the next.
FAN = 8


def cover(epochs: int) -> list[tuple[int, int]]:
    """Ranges (first, last) of whole runs that make up the epochs 0 to ``epochs`` - 1: at most FAN - 1 of each level."""
    out, at, width = [], 0, 1
    while width * FAN <= epochs:
        width *= FAN
    while width:
        while epochs - at >= width:
            out.append((at, at + width - 1))
            at += width
        width //= FAN
    return out


def _latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, then by epoch; partial maxima first, so a frequent key is no large group."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order, "_epoch")).alias("_row")).select("_row.*")


def merge_batch(batch: DataFrame, epoch: int, path: str, keys: list[str], order: list[str]) -> None:
    """Adds a batch's latest rows as a run of its own, and joins FAN runs of a level into one of the next where a level is full.

    A row is written again once a level, so what a batch costs follows its rows and the logarithm of all batches. Names follow from the epoch: a
    batch that is run again after a failure writes the same runs. What no reader of this or the last epoch needs is deleted.
    """
    spark = batch.sparkSession
    _latest(batch.withColumn("_epoch", F.lit(epoch).cast("long")), keys, order).write.mode("overwrite").parquet(f"{path}/{epoch}-{epoch}")
    width = FAN
    while (epoch + 1) % width == 0:
        low = epoch + 1 - width
        parts = [f"{path}/{a}-{a + width // FAN - 1}" for a in range(low, epoch + 1, width // FAN)]
        runs = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in parts])
        _latest(runs, keys, order).write.mode("overwrite").parquet(f"{path}/{low}-{epoch}")
        width *= FAN
    spark.createDataFrame([(epoch,)], "epoch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/_epoch={epoch}")
    # parts that were joined stay for one more epoch: a reader may still be on them, or this batch be run again
    for a, b in set(cover(epoch - 1)) - set(cover(epoch)) if epoch else ():
        fs, where = _folder(spark, f"{path}/{a}-{b}")
        fs.delete(where, True)
    if epoch > 1:
        fs, where = _folder(spark, f"{path}/_epoch={epoch - 2}")
        fs.delete(where, True)


def merged(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The table that the batches under ``path`` add up to: the latest row of each key. At least one batch must be there."""
    fs, where = _folder(spark, path)
    done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(where) if s.getPath().getName().startswith("_epoch=") and _exists(spark, f"{path}/{s.getPath().getName()}/_SUCCESS")]
    runs = [spark.read.parquet(f"{path}/{a}-{b}") for a, b in cover(max(done) + 1)]
    return _latest(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs), keys, order).drop("_epoch")


def merging(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """``merge_batch`` for ``foreachBatch``."""
    return lambda batch, epoch: merge_batch(batch, epoch, path, keys, order)
