"""From nested filing facts to annual rows.

``facts`` is long: cik, tag, unit, ord, start, end, val, accn, form, filed. ``registry`` says which tags feed a metric:
metric, priority, tag, unit, kind (duration or instant).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainledger.functions.measures import SPLIT_STEP, basis_change
from grainledger.operators.series import top_row

ENTRY = "array<struct<start:string,end:string,val:double,accn:string,form:string,filed:string,fy:int,fp:string>>"
COMPANY_FACTS = f"cik string, facts struct<`us-gaap`: map<string, struct<units: map<string, {ENTRY}>>>>"
#: Days that a period of a year spans at least and at most.
YEAR_DAYS = (350, 380)

# The tags that feed a metric, the preferred first, with its unit and kind. Lease income is added to revenue, not ranked with it.
TAGS = {
    "revenue": ("USD", "duration", ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "RevenuesNetOfInterestExpense", "SalesRevenueNet", "SalesRevenueGoodsNet", "SalesRevenueServicesNet")),
    "lease_income": ("USD", "duration", ("OperatingLeaseLeaseIncome", "OperatingLeasesIncomeStatementLeaseRevenue")),
    "cost_of_revenue": ("USD", "duration", ("CostOfRevenue", "CostOfGoodsAndServicesSold")),
    "gross_profit": ("USD", "duration", ("GrossProfit",)),
    "operating_income": ("USD", "duration", ("OperatingIncomeLoss",)),
    "net_income": ("USD", "duration", ("NetIncomeLoss", "ProfitLoss")),
    "eps_diluted": ("USD/shares", "duration", ("EarningsPerShareDiluted",)),
    "shares_diluted": ("shares", "duration", ("WeightedAverageNumberOfDilutedSharesOutstanding",)),
    "operating_cash_flow": ("USD", "duration", ("NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations")),
    "capex": ("USD", "duration", ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsForCapitalImprovements", "PaymentsToAcquireProductiveAssets")),
    "cash_and_equiv": ("USD", "instant", ("CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents")),
    "stockholders_equity": ("USD", "instant", ("StockholdersEquity",)),
}


def tag_registry(spark: SparkSession) -> DataFrame:
    """TAGS as a registry, a row a tag, priorities from 0."""
    rows = [(metric, i, tag, unit, kind) for metric, (unit, kind, tags) in TAGS.items() for i, tag in enumerate(tags)]
    return spark.createDataFrame(rows, "metric string, priority int, tag string, unit string, kind string")


def long_facts(documents: DataFrame) -> DataFrame:
    """One row for each entry; ``ord`` is its place in its array, which decides ties."""
    tags = documents.select("cik", F.explode("facts.us-gaap").alias("tag", "body"))
    units = tags.select("cik", "tag", F.explode("body.units").alias("unit", "entries"))
    rows = units.select("cik", "tag", "unit", F.posexplode("entries").alias("ord", "e"))
    date = lambda c: F.expr(f"try_cast(e.{c} as date)")
    return rows.select("cik", "tag", "unit", "ord", (F.col("e.start").isNotNull()).alias("has_start"), date("start").alias("start"), date("end").alias("end"), "e.val", "e.accn", "e.form", date("filed").alias("filed"))


def annual_entries(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """(cik, metric, tag, priority, end, val, accn, filed): annual-report figures, the latest filed for each period."""
    met = facts.join(F.broadcast(registry), ["tag", "unit"])
    year = F.datediff("end", "start").between(*YEAR_DAYS)
    instant = F.col("end").isNotNull() & ~F.col("has_start")
    met = met.where((F.col("form") == "10-K") & F.when(F.col("kind") == "duration", year).otherwise(instant))
    latest = top_row(met, ["cik", "metric", "tag", "unit", "end"], F.desc_nulls_last("filed"), F.asc("ord"))
    return latest.select("cik", "metric", "tag", "priority", "end", "val", "accn", "filed")


def by_priority(entries: DataFrame) -> DataFrame:
    """For each period the figure of the first tag that has one."""
    return top_row(entries, ["cik", "metric", "end"], F.asc("priority"))


def annual_rows(series: DataFrame) -> DataFrame:
    """One row for each period with revenue and with net or operating income; the fiscal year is that of its end.

    Accession and filing date come together from the revenue figure, else from net income. Of two periods that end in
    one calendar year the later stays.
    """
    source = F.struct("accn", "filed")
    wide = series.groupBy("cik", "end").pivot("metric", ["revenue", "net_income", "operating_income", "equity", "operating_cash_flow", "capex"]).agg(F.first("val").alias("v"), F.first(source).alias("s"))
    wide = wide.where("revenue_v is not null and (net_income_v is not null or operating_income_v is not null)")
    from_ = F.coalesce("revenue_s", "net_income_s")
    rows = wide.select("cik", F.year("end").alias("fiscal_year"), F.col("end").alias("period_end_date"), *[F.col(f"{m}_v").alias(m) for m in ("revenue", "net_income", "operating_income", "equity", "operating_cash_flow", "capex")], from_["accn"].alias("accession_number"), from_["filed"].alias("filed"))
    return top_row(rows, ["cik", "fiscal_year"], F.desc("period_end_date"))


def restatements(entries: DataFrame, keys: list[str], end: str, value: str, filed: str, ord_: str) -> DataFrame:
    """keys, end, original, restated, ratio, change_type: first and last filed figure where they differ by 1.4 or more.

    Of figures filed on one day the last in order counts; figures without a filing date don't.
    """
    daily = top_row(entries.where(F.col(filed).isNotNull()), [*keys, end, filed], F.desc(ord_))
    ends = daily.groupBy(*keys, end).agg(F.min_by(value, filed).alias("original"), F.max_by(value, filed).alias("restated"))
    kept = ends.where("original > 0 and restated != 0").withColumn("ratio", F.col("restated") / F.col("original"))
    kept = kept.where((F.col("ratio") >= SPLIT_STEP) | (F.col("ratio") <= 1 / SPLIT_STEP))
    return kept.withColumn("change_type", basis_change("original", "restated"))


def filings(facts: DataFrame) -> DataFrame:
    """One row for each annual report anywhere in the facts, with the latest period that it reports."""
    return facts.where("form = '10-K' and end is not null").groupBy("cik", "accn").agg(F.max("end").alias("period_of_report"), F.max_by("filed", "end").alias("filed"))


def latest_annual_report(submissions: DataFrame) -> DataFrame:
    """The choice of a report from parallel arrays: newest period; its newest amendment, else its newest original.

    ``fallback`` is the newest original of that period where an amendment was chosen.
    """
    r = F.col("filings.recent")
    rows = submissions.select("cik", F.posexplode(F.arrays_zip(r["accessionNumber"].alias("accn"), r["form"].alias("form"), r["reportDate"].alias("period"), r["filingDate"].alias("filed"))).alias("ord", "f")).select("cik", "ord", "f.*")
    rows = rows.where(F.col("form").isin("10-K", "10-K/A") & (F.coalesce("period", F.lit("")) != ""))
    newest = rows.groupBy("cik").agg(F.max("period").alias("period"))
    rows = rows.join(newest, ["cik", "period"]).withColumn("amended", F.col("form") == "10-K/A")
    chosen = top_row(rows, ["cik"], F.desc("amended"), F.desc("filed"), F.asc("ord"))
    original = top_row(rows.where("not amended"), ["cik"], F.desc("filed"), F.asc("ord")).select("cik", F.col("accn").alias("fallback"))
    return chosen.join(original, "cik", "left").select("cik", "period", "accn", "form", "filed", F.when(F.col("amended"), F.col("fallback")).alias("fallback"))
