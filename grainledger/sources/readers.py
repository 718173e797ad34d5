"""Readers with checks. All take explicit schemas and work on any path that Spark reads."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainledger.functions.keys import canonical_ticker, company_key, ticker

#: What a filing document needs: content and at least so many bytes.
LEAST_BYTES = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_json(spark: SparkSession, path: str, schema: str | T.StructType, not_before: datetime | None = None) -> DataFrame:
    """JSON documents, a file each; with ``not_before`` only files written since."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows if not_before is None else rows.where(F.col("_metadata.file_modification_time") >= F.lit(not_before))


def verified_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(name, content) of files whose SHA-256 is the expected one (columns name, content_hash) and that are long enough."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", "length")
    return files.join(expected, "name").where((F.sha2("content", 256) == F.col("content_hash")) & (F.col("length") >= LEAST_BYTES)).select("name", "content")


def strict_records(
    spark: SparkSession, path: str, required: list[str], optional: list[str], numbers: list[str], closed: dict[str, tuple[str, ...]] | None = None, dates: tuple[str, ...] = (), checks: dict[str, Callable[[Column], Column]] | None = None, key: str = "ticker"
) -> tuple[DataFrame, DataFrame]:
    """(records, issues) of JSON lines with a closed set of keys, a required one of which may be null.

    Issues: value, ticker and code, one of unparsable, unknown_key, missing_key, not_finite, unmapped_ticker, unknown_value (a field of ``closed``
    has another value than those named), invalid_date (a field of ``dates`` isn't a day as YYYY-MM-DD), invalid_value (a field fails its check), duplicate.
    Records are the lines without one; their ``key`` is canonical, and by this spelling they are duplicates.
    """
    lines = spark.read.text(path).where("trim(value) != ''")
    fields = [T.StructField(k, T.DoubleType() if k in numbers else T.StringType()) for k in required + optional]
    parsed = lines.withColumn("keys", F.json_object_keys("value")).withColumn("r", F.from_json("value", T.StructType(fields)))
    known, read = F.array(*[F.lit(k) for k in required + optional]), F.col("keys").isNotNull()
    there = lambda k: F.col(f"r.{k}").isNotNull()
    finite = [F.when(there(k) & (F.isnan(f"r.{k}") | (F.abs(f"r.{k}") == float("inf"))), F.lit("not_finite")) for k in numbers]
    sets = [F.when(there(k) & ~F.col(f"r.{k}").isin(*values), "unknown_value") for k, values in (closed or {}).items()]
    day = lambda k: F.col(f"r.{k}").rlike(r"^\d{4}-\d{2}-\d{2}\z") & F.try_to_date(F.col(f"r.{k}"), "yyyy-MM-dd").isNotNull()
    days = [F.when(read & ~F.coalesce(day(k), F.lit(False)), "invalid_date") for k in dates]
    own = [F.when(there(k) & ~F.coalesce(good(F.col(f"r.{k}")), F.lit(False)), "invalid_value") for k, good in (checks or {}).items()]
    name = canonical_ticker(F.col(f"r.{key}"))
    codes = F.array_compact(F.array(
        F.when(~read, "unparsable"), F.when(F.size(F.array_except("keys", known)) > 0, "unknown_key"),
        *[F.when(read & ~F.array_contains("keys", k), "missing_key") for k in required], F.when(read & F.array_contains("keys", key) & name.isNull(), "unmapped_ticker"), *finite, *sets, *days, *own,
    ))
    shown = F.coalesce(name, F.col(f"r.{key}"), F.lit(""))
    twice = parsed.groupBy(name.alias("ticker")).count().where("count > 1 and ticker is not null").select("ticker", F.lit(True).alias("twice"))
    met = parsed.withColumn("ticker", shown).withColumn("codes", F.array_distinct(codes)).join(twice, "ticker", "left")
    met = met.withColumn("codes", F.when(F.col("twice"), F.array_union("codes", F.array(F.lit("duplicate")))).otherwise(F.col("codes")))
    issues = met.select("value", "ticker", F.explode("codes").alias("code"))
    return met.where("size(codes) = 0").select(*[(F.col("ticker") if k == key else F.col(f"r.{k}")).alias(k) for k in required + optional]), issues


def clean_prices(rows: DataFrame) -> DataFrame:
    """Prices without a close go, and a volume that isn't a number is unknown."""
    return rows.where("close is not null and not isnan(close)").withColumn("volume", F.when(~F.isnan(F.col("volume").cast("double")), F.col("volume")))


def index_members(spark: SparkSession, path: str, name: str) -> DataFrame:
    """ticker, name, sector, industry, universe, cik out of the first table of saved pages; columns go by their headings.

    A row needs a ticker. The key may be surrounded by other signs.
    """
    pages = spark.read.text(path, wholetext=True)
    first = F.regexp_extract("value", r"(?is)<table[^>]*>(.*?)</table>", 1)
    rows = pages.select(first.alias("t")).select(F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)).alias("rows"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", ""), "&amp;", "&"))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), plain)
    listed = rows.where("size(rows) > 1").select(cells(F.get("rows", 0)).alias("head"), F.explode(F.slice("rows", F.lit(2), F.size("rows"))).alias("row")).select("head", cells(F.col("row")).alias("c"))
    at = lambda heading: F.when(F.array_position("head", heading) > 0, F.get("c", (F.array_position("head", heading) - 1).cast("int")))
    some = lambda c: F.when(c != "", c)
    got = listed.select(ticker(at("Symbol")).alias("ticker"), at("Security").alias("name"), some(at("GICS Sector")).alias("sector"), some(at("GICS Sub-Industry")).alias("industry"), F.lit(name).alias("universe"), company_key(at("CIK")).alias("cik"))
    return got.where("ticker != ''")


def index_rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    """ticker, name, sector, industry, universe, cik (null) out of a saved JSON reply, rows under data.data.rows."""
    kind = "data struct<data: struct<rows: array<struct<symbol: string, companyName: string, sector: string>>>>"
    rows = fresh_json(spark, path, kind).select(F.explode("data.data.rows").alias("r"))
    sector = F.trim("r.sector")
    return rows.select(
        ticker(F.col("r.symbol")).alias("ticker"), F.trim(F.regexp_replace("r.companyName", r"\s+Common Stock.*$", "")).alias("name"),
        F.when(sector != "", sector).alias("sector"), F.lit(None).cast("string").alias("industry"), F.lit(name).alias("universe"), F.lit(None).cast("string").alias("cik"),
    )


def company_keys(spark: SparkSession, path: str) -> DataFrame:
    """ticker, cik of the bulk list, a JSON object of entries; of two entries of one ticker the last in order stays."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<cik_str: string, ticker: string>>")).alias("k", "e"))
    named = entries.select(F.col("k").cast("long").alias("k"), F.upper("e.ticker").alias("ticker"), company_key(F.col("e.cik_str")).alias("cik"))
    return named.groupBy("ticker").agg(F.max_by("cik", "k").alias("cik"))


def feed_keys(spark: SparkSession, path: str) -> DataFrame:
    """ticker, cik out of saved feeds, a file each, named by its ticker; those without a key are left out."""
    feeds = spark.read.text(path, wholetext=True)
    named = feeds.select(F.upper(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)).alias("ticker"), F.regexp_extract("value", r"<cik>(\d+)</cik>", 1).alias("cik"))
    return named.where("cik != ''").withColumn("cik", company_key(F.col("cik")))


def with_keys(companies: DataFrame, bulk: DataFrame, feeds: DataFrame) -> DataFrame:
    """Companies with the bulk list's key, else the feed's; null without either. Tickers are compared in capitals."""
    at = lambda df, c: df.select(F.upper("ticker").alias("_ticker"), F.col("cik").alias(c))
    plain = companies.drop("cik").withColumn("_ticker", F.upper("ticker"))
    return plain.join(at(bulk, "_a"), "_ticker", "left").join(at(feeds, "_b"), "_ticker", "left").withColumn("cik", F.coalesce("_a", "_b")).drop("_ticker", "_a", "_b")


def frozen(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """A snapshot's rows, once its Parquet files are exactly those of the manifest (name, content_hash); else an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    wrong = expected.join(files, "name", "full_outer").where(~F.col("found").eqNullSafe(F.col("content_hash"))).select("name").limit(5).collect()
    if wrong:
        raise ValueError(f"snapshot isn't the recorded one: {', '.join(r['name'] for r in wrong)}")
    return spark.read.parquet(path)
