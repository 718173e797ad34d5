"""Queries of merges, schema versions and batches over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainledger.operators import lifecycle, upsert
from grainledger.session import shared_folder
from grainledger.sources import versions
from grainledger.sources.readers import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ONE = "SELECT accession, m.t AS ticker, m.p AS price, m.a AS at_ FROM (SELECT accession, max({{'a': at_, 'p': price, 't': ticker}}) AS m FROM lines WHERE n = {n} GROUP BY 1)"
_FILED = f"lines AS (SELECT l_partkey AS accession, l_linenumber AS n, l_suppkey AS ticker, l_extendedprice AS price, l_orderkey AS at_ FROM lineitem), old AS ({_ONE.format(n=1)}), new AS ({_ONE.format(n=2)})"


def _filed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("accession"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("ticker"), F.col("l_extendedprice").alias("price"), F.col("l_orderkey").alias("at_"))
    one = lambda n: lines.where(F.col("n") == n).groupBy("accession").agg(F.max(F.struct("at_", "price", "ticker")).alias("m")).select("accession", "m.ticker", "m.price", "m.at_")
    return one(1), one(2)


@query(f"WITH {_FILED} SELECT coalesce(o.accession, n.accession) AS accession, CASE WHEN o.accession IS NOT NULL THEN o.ticker ELSE n.ticker END AS ticker, CASE WHEN n.accession IS NOT NULL THEN n.price ELSE o.price END AS price, CASE WHEN n.accession IS NOT NULL THEN n.at_ ELSE o.at_ END AS at_ FROM old o FULL JOIN new n ON o.accession = n.accession")
def filings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as filings: second lines replace first ones, but a filing keeps the company under which it was first stored."""
    old, new = _filed(spark, sf_dir)
    return upsert.retaining_upsert(old, new, ["accession"], ["ticker"], "at_")


@query(f"WITH {_FILED} SELECT o.accession, o.ticker, CASE WHEN n.accession IS NOT NULL THEN n.price ELSE o.price END AS price, o.at_ FROM old o LEFT JOIN new n ON o.accession = n.accession")
def fetched_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of stored filings only what was fetched changes; others aren't added."""
    old, new = _filed(spark, sf_dir)
    return upsert.partial_upsert(old, new, ["accession"], ["price"], "at_")


_OUTCOME = "CASE WHEN o_orderstatus = 'O' AND o_custkey % 3 = 0 THEN 'pending' WHEN o_custkey % 10 = 1 THEN 'refusal' WHEN o_custkey % 10 = 2 THEN 'api_error' WHEN o_orderkey % 7 IN (1, 3) THEN 'validation_failed' ELSE 'persisted' END"


@query(f"""WITH a AS (SELECT o_orderpriority AS batch_id, o_orderkey, {_OUTCOME} AS outcome, CASE o_orderkey % 7 WHEN 1 THEN 'truncated,uncited' WHEN 3 THEN 'uncited' END AS codes, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT batch_id, outcome, CASE WHEN outcome = 'validation_failed' THEN codes END AS failure, count(*) AS n, round(sum(CASE WHEN outcome IN ('validation_failed', 'persisted') THEN o_totalprice ELSE 0 END), 2) AS cost FROM a GROUP BY ALL
UNION ALL SELECT '5-LOW', 'pending', NULL, count(*), 0.0 FROM orders WHERE o_orderpriority = '5-LOW' HAVING count(*) > 0""")
def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests, in a batch for each priority; one batch isn't retrieved, the others are at once, and one of them again."""
    o = table(spark, sf_dir, "orders")
    requests = o.select(F.lit("r").alias("run_id"), F.col("o_orderkey").cast("string").alias("ticker"), F.col("o_orderpriority").alias("batch_id"), F.lit("m").alias("model_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("prompt_sha256"))
    attempts = lifecycle.submitted(requests, spark.createDataFrame([], lifecycle.ATTEMPT))
    k = F.col("o_custkey")
    ends = o.where(~((F.col("o_orderstatus") == "O") & (k % 3 == 0))).select(F.col("o_orderkey").cast("string").alias("ticker"), F.when(k % 10 == 1, "refusal").when(k % 10 == 2, "api_error").otherwise("end_turn").alias("stop_reason"), F.col("o_totalprice").cast("double").alias("cost"))
    codes = F.when(F.col("o_orderkey") % 7 == 1, F.array(F.lit("uncited"), F.lit("truncated"))).when(F.col("o_orderkey") % 7 == 3, F.array(F.lit("uncited"), F.lit("uncited")))
    named = attempts.select("ticker", "custom_id")
    results = ends.join(named, "ticker").select("custom_id", "stop_reason", "cost")
    issues = o.select(F.col("o_orderkey").cast("string").alias("ticker"), F.explode(codes).alias("code")).join(named, "ticker").select("custom_id", "code")
    for batch in (("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"), "1-URGENT"):
        attempts = lifecycle.retrieved(attempts, batch, results, issues)
    return attempts.groupBy("batch_id", "outcome", "failure").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 2).alias("cost"))


_STEPS = [
    versions.Step(1, rename={"c_acctbal": "balance"}, add={"currency": ("string", "'USD'")}),
    versions.Step(2, recode={"c_mktsegment": {"BUILDING": "CONSTRUCTION", "MACHINERY": "CAPITAL GOODS"}}, add={"rich": ("boolean", "balance > 5000")}),
    versions.Step(3, retire="c_mktsegment = 'HOUSEHOLD'", unique=(("c_nationkey", "c_mktsegment"), ("balance", "c_custkey")), drop=("c_name",)),
]


@query("""WITH v AS (SELECT c_custkey, c_nationkey, c_acctbal AS balance, c_custkey % 3 AS part, CASE WHEN c_custkey % 3 = 1 AND c_custkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'CONSTRUCTION' WHEN 'MACHINERY' THEN 'CAPITAL GOODS' ELSE c_mktsegment END AS c_mktsegment FROM customer)
SELECT c_custkey, c_nationkey, balance, currency, c_mktsegment, balance > 5000 AS rich FROM v WHERE c_mktsegment <> 'HOUSEHOLD' QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY balance DESC, c_custkey DESC) = 1""")
def schema_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stored under three versions of a schema, read as the newest."""
    root = f"{shared_folder(spark).rstrip('/')}/versions-{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    parts = {0: c.where(k % 3 == 0), 1: c.where(k % 3 == 1).withColumnRenamed("c_acctbal", "balance").withColumn("currency", F.when(k % 2 == 0, "EUR").otherwise("USD")), 2: _STEPS[1].apply(_STEPS[0].apply(c.where(k % 3 == 2)))}
    for v, df in parts.items():
        df.write.parquet(f"{root}/schema_version={v}")
    versions.migrate(spark, root, _STEPS)
    return versions.migrated(spark, root, _STEPS).select("c_custkey", "c_nationkey", "balance", "currency", "c_mktsegment", "rich")
