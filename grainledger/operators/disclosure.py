"""Disclosure of counts: small cells, all that would give them away, and what of each section of a report is public."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainledger.session import cut

# The least public count, the marks of hidden ones; by section of a report what its counts are linked over beside
# the section itself (over both runs and all views in any case), the section that one follows, and which counts of a share hide it.
LEAST = 5
SMALL, WITHHELD = "suppressed_lt_5", "withheld_secondary_suppression"
LINKED_OVER = {"screen": (), "fundamentals": (), "valuation": ("cohort",), "committee_support": (), "direct_star": (), "persona": ()}
FOLLOWS = {"status_transitions": "committee_support"}
SHARES_THAT_HIDE = {"fundamentals": ("numerator", "denominator"), "valuation": ("numerator", "denominator"), "committee_support": ("numerator", "denominator", "complement")}
ASSOCIATIONS_THAT_HIDE = ("direct_star", "persona")


def linked_families(members: DataFrame) -> DataFrame:
    """family, component: families that share a total, directly or over others; component is the least family reached.

    ``members`` has family and total, a row for each total that a family's cells add up to; a null total links with nothing. Labels go from
    families to totals and back, and every family also jumps to its label's label, so rounds grow with the logarithm of a chain.
    """
    edges = cut(members.where("family is not null").select("family", "total").distinct())
    labels = edges.select("family", F.col("family").alias("component")).distinct()
    while True:
        by_total = edges.where("total is not null").join(labels, "family").groupBy("total").agg(F.min("component").alias("near"))
        near = edges.join(by_total, "total").groupBy("family").agg(F.min("near").alias("near"))
        moved = labels.join(near, "family", "left").select("family", F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = moved.select(F.col("family").alias("component"), F.col("component").alias("further"))
        new = cut(moved.join(jump, "component").select("family", F.col("further").alias("component")))
        changed = new.join(labels.select("family", F.col("component").alias("was")), "family").where("component <> was").isEmpty()
        labels = new
        if changed:
            return labels


def _mark(n: Column, hidden: Column) -> Column:
    return F.when(n < LEAST, SMALL).when(hidden, WITHHELD)


def disclosed(counts: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells: family, cell, n, shown, mark, component; totals: total, n, shown, mark).

    ``counts`` has family, cell, n. As soon as one cell of a component is below LEAST, all its families' cells and totals are hidden: with
    any of them shown, others could be had by subtraction. Families that part the same rows in two ways must both name those rows as a
    total. Marks say whether a count is small itself or only withheld.
    """
    labels = linked_families(members)
    small = counts.join(labels, "family").groupBy("component").agg((F.min("n") < LEAST).alias("hidden"))
    known = cut(labels.join(small, "component", "left").select("family", "component", F.coalesce("hidden", F.lit(False)).alias("hidden")))
    cells = counts.join(known, "family").select("family", "cell", "n", F.when(~F.col("hidden"), F.col("n")).alias("shown"), _mark(F.col("n"), F.col("hidden")).alias("mark"), "component")
    sums = counts.groupBy("family").agg(F.sum("n").alias("n"))
    totals = members.where("total is not null").join(known, "family").join(sums, "family", "left").groupBy("total").agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("hidden").alias("hidden"))
    return cells, totals.select("total", "n", F.when(~F.col("hidden"), F.col("n")).alias("shown"), _mark(F.col("n"), F.col("hidden")).alias("mark"))


def public_share(numerator: Column, denominator: Column, value: Column, hidden: Column) -> dict[str, Column]:
    """Numerator and denominator as text or mark, and value: null where a count or the complement of both is small, or all is hidden."""
    shown = lambda n, mark: F.coalesce(mark, n.cast("string"))
    few, rest = denominator < LEAST, (numerator < LEAST) | (denominator - numerator < LEAST)
    return {
        "numerator": shown(numerator, F.when(hidden, _mark(numerator, hidden)).when(few | rest, SMALL)),
        "denominator": shown(denominator, F.when(hidden, _mark(denominator, hidden)).when(few, SMALL)),
        "value": F.when(~(hidden | few | rest), value),
    }


def public_association(denominator: Column, cohort: Column, value: Column, hidden: Column) -> dict[str, Column]:
    """Denominator as text or mark, and value: null where the rows it rests on, or those left out, are few."""
    few = (denominator < LEAST) | F.coalesce(cohort - denominator < LEAST, F.lit(False))
    hide = hidden | few
    return {"denominator": F.coalesce(F.when(hide, _mark(denominator, hide)), denominator.cast("string")), "value": F.when(~hide, value)}


def public_sections(cells: DataFrame, shares: DataFrame, associations: DataFrame) -> DataFrame:
    """section, run, view, cohort, item, cell, numerator, denominator, value: what of a report may be published, as text or mark.

    All three tables have section, run, view, cohort and item; cells also cell, n and open (counts that reveal nothing of the companies
    outside: they are never hidden); shares numerator, denominator, value; associations denominator, cohort_n and value.
    A section's counts hang together over runs and views, those of valuation within a cohort; if one of them, or a share or association
    that hides its section, is small, all of the group are withheld. A count's number is in ``numerator``.
    """
    keys = ["section", "run", "view", "cohort", "item"]
    group = F.concat_ws("/", F.coalesce(*[F.when(F.col("section") == s, t) for s, t in FOLLOWS.items()], F.col("section")), F.when(F.col("section").isin(*[s for s, over in LINKED_OVER.items() if "cohort" in over]), F.col("cohort")))
    few = lambda n: F.coalesce(n < LEAST, F.lit(False))
    parts = {"numerator": few(F.col("numerator")), "denominator": few(F.col("denominator")), "complement": few(F.col("denominator") - F.col("numerator"))}
    hides = reduce(lambda a, b: a | b, [(F.col("section") == s) & reduce(lambda a, b: a | b, [parts[w] for w in which]) for s, which in SHARES_THAT_HIDE.items()])
    apart = F.col("section").isin(*ASSOCIATIONS_THAT_HIDE) & (few(F.col("denominator")) | few(F.col("cohort_n") - F.col("denominator")))
    own = [cells.select(group.alias("_g"), (~F.col("open") & few(F.col("n"))).alias("small")), shares.select(group.alias("_g"), hides.alias("small")), associations.select(group.alias("_g"), apart.alias("small"))]
    hidden = reduce(DataFrame.unionByName, own).groupBy("_g").agg(F.max("small").alias("hidden"))
    met = lambda df: df.withColumn("_g", group).join(hidden, "_g", "left").withColumn("hidden", F.coalesce("hidden", F.lit(False)))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    n, h = F.col("n"), F.col("hidden")
    a = met(cells).select(*keys, F.col("cell").alias("cell"), F.coalesce(F.when(~F.col("open"), _mark(n, h)), n.cast("string")).alias("numerator"), text.alias("denominator"), number.alias("value"))
    b = met(shares).select(*keys, text.alias("cell"), *[c.alias(k) for k, c in public_share(F.col("numerator"), F.col("denominator"), F.col("value"), h).items()])
    c = met(associations).select(*keys, text.alias("cell"), text.alias("numerator"), *[c.alias(k) for k, c in public_association(F.col("denominator"), F.col("cohort_n"), F.col("value"), h).items()])
    return a.unionByName(b).unionByName(c)
