"""Coverage, spending and financial tables by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from purseflow import schemas as S
from purseflow.functions.dates import month_key
from purseflow.functions.money import minor_units
from purseflow.operators.ranking import ranks_within


def month_coverage(months: DataFrame, statement_dates: DataFrame) -> DataFrame:
    """A month is complete if there is a statement of day 10 of it and of the next month."""
    first = F.to_date(F.concat("month", F.lit("-01")))
    day = S.STATEMENT_DAY - 1
    seen = statement_dates.select("statement_date").distinct()
    rows = months.select("month").distinct().withColumn("_a", F.date_add(first, day)).withColumn("_b", F.date_add(F.add_months(first, 1), day))
    rows = rows.join(seen.select(F.col("statement_date").alias("_a"), F.lit(True).alias("_in_a")), "_a", "left").join(seen.select(F.col("statement_date").alias("_b"), F.lit(True).alias("_in_b")), "_b", "left")
    whole = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    return rows.select("month", whole.alias("is_complete"), whole.alias("show"))


def spending_facts(net: DataFrame, transactions: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Net spending with its purchase month, category and merchant."""
    t = transactions.select("transaction_id", month_key("transaction_date").alias("month"))
    e = enrichments.select("transaction_id", "category", "merchant_name", "display_name", "is_unclassified")
    return net.join(t, "transaction_id").join(e, "transaction_id")


def spending_statistics(facts: DataFrame) -> DataFrame:
    """All grains in one table: ``grain`` is all, month, category or merchant; ``rank`` orders
    categories and merchants in their month. The facts are summed once, at the finest
    grain, and the grouping sets read those sums. ``is_unclassified`` here says that the
    merchant is null."""
    fine = facts.groupBy("month", "category", "merchant_name", "display_name").agg(F.sum("spending").alias("spending"), F.count("*").alias("n"))
    rolled = fine.sparkSession.sql(
        """SELECT month, category, merchant_name, display_name, grouping_id() AS g, sum(spending) AS spending, sum(n) AS transaction_count
        FROM {fine} GROUP BY GROUPING SETS ((), (month), (month, category), (month, merchant_name, display_name))""",
        fine=fine,
    )
    grain = F.when(F.col("g") == 15, "all").when(F.col("g") == 7, "month").when(F.col("g") == 3, "category").otherwise("merchant")
    rows = rolled.select(grain.alias("grain"), "month", "category", "merchant_name", "display_name", minor_units("spending").alias("spending_minor"), "transaction_count")
    name = F.when(F.col("grain") == "merchant", F.col("display_name")).otherwise(F.coalesce("category", F.lit("")))
    order = Window.partitionBy("grain", "month").orderBy(F.desc("spending_minor"), name, F.coalesce("merchant_name", F.lit("")))
    unclassified = F.when(F.col("grain") == "merchant", F.col("merchant_name").isNull())
    return rows.select("*", unclassified.alias("is_unclassified"), F.row_number().over(order).alias("rank"))


def ranked_merchants(stats: DataFrame) -> DataFrame:
    """The merchants of each month with their rank, for months of many merchants: ``rank`` of the
    statistics is a window over the month, this one is worked out in ranges."""
    rows = stats.where("grain = 'merchant'").drop("rank").withColumn("_merchant", F.coalesce("merchant_name", F.lit("")))
    return ranks_within(rows, ["month"], F.desc("spending_minor"), "display_name", "_merchant").drop("_merchant")


def income_by_month(transactions: DataFrame) -> DataFrame:
    rows = transactions.where("transaction_type = 'income'").groupBy(month_key("transaction_date").alias("month"))
    return rows.agg(minor_units(F.sum("amount")).alias("income_minor"), F.count("*").alias("income_count"))


def financial_months(income: DataFrame, spending: DataFrame, coverage: DataFrame) -> DataFrame:
    """Months of income or spending with both sums, their difference and the coverage flags.
    ``spending`` has month, spending_minor and spending_count."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = income.join(spending, "month", "full_outer").join(coverage, "month", "left")
    return rows.select(
        "month", F.coalesce("is_complete", F.lit(False)).alias("spending_data_complete"), F.coalesce("show", F.lit(False)).alias("show"),
        zero("income_minor").alias("income_minor"), zero("income_count").alias("income_count"), zero("spending_minor").alias("spending_minor"), zero("spending_count").alias("spending_count"), (zero("income_minor") - zero("spending_minor")).alias("net_minor"),
    )


def financial_summary(months: DataFrame, *by: str) -> DataFrame:
    """Two rows, over all and over shown months; with ``by``, two for each of its values."""
    both = months.withColumn("scope", F.explode(F.when(F.col("show"), F.array(F.lit("all_data"), F.lit("shown_data"))).otherwise(F.array(F.lit("all_data")))))
    sums = [F.sum(c).alias(c) for c in ("income_minor", "spending_minor", "net_minor", "income_count", "spending_count")]
    return both.groupBy("scope", *by).agg(*sums, F.count("*").alias("month_count"))


def spending_summary(outcome_summary: DataFrame, facts: DataFrame, coverage: DataFrame) -> DataFrame:
    """The netting counters with the number of unclassified net rows and of shown months."""
    unclassified = facts.agg(F.count_if("is_unclassified").alias("unclassified_net_transactions"))
    return outcome_summary.crossJoin(unclassified).crossJoin(coverage.agg(F.count_if("show").alias("shown_months")))


def _spending_months(stats: DataFrame, coverage: DataFrame) -> DataFrame:
    """Each month with its categories and merchants in order."""
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x["v"])
    category = F.struct("category", "spending_minor", "transaction_count").alias("v")
    merchant = F.struct("merchant_name", "display_name", "is_unclassified", "spending_minor", "transaction_count").alias("v")
    categories = stats.where("grain = 'category'").groupBy("month").agg(order(category).alias("categories"))
    merchants = stats.where("grain = 'merchant'").groupBy("month").agg(order(merchant).alias("merchants"))
    months = stats.where("grain = 'month'").select("month", F.col("spending_minor").alias("total_spending_minor"), "transaction_count")
    rows = months.join(coverage, "month").join(categories, "month").join(merchants, "month")
    return rows.select("month", "is_complete", "show", "total_spending_minor", "transaction_count", "categories", "merchants")


def spending_json(stats: DataFrame, coverage: DataFrame) -> DataFrame:
    """One JSON object for each month, of schema version 2, with its categories and merchants in order."""
    rows = _spending_months(stats, coverage)
    return rows.select("month", F.to_json(F.struct(F.lit(2).alias("schema_version"), *rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def _scopes(months: DataFrame, *columns: str):
    """One row: all_data and shown_data, each with sums of the columns and the number of months."""
    part = lambda test: F.struct(*[F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).cast("long").alias(c) for c in columns], F.count_if(test).alias("month_count"))
    return months.agg(F.struct(part(F.lit(True)).alias("all_data"), part(F.col("show")).alias("shown_data")).alias("summary"))


def spending_scopes(stats: DataFrame, coverage: DataFrame) -> DataFrame:
    """(scope, total_spending_minor, transaction_count, month_count) over all and over shown months."""
    months = stats.where("grain = 'month'").select("month", F.col("spending_minor").alias("total_spending_minor"), "transaction_count").join(coverage, "month")
    both = _scopes(months, "total_spending_minor", "transaction_count")
    return both.select(F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), f"summary.{s}.*") for s in ("all_data", "shown_data")])).alias("s")).select("s.*")


def _document(version: int, summary: DataFrame, months: DataFrame) -> DataFrame:
    """One row, the whole as one JSON document: months are as many as the calendar has, but what is in them is
    all there at once, so a large ledger is better published by month."""
    rows = months.agg(F.transform(F.array_sort(F.collect_list(F.struct("month", F.struct(*months.columns).alias("v")))), lambda x: x["v"]).alias("months"))
    return summary.crossJoin(rows).select(F.to_json(F.struct(F.lit(version).alias("schema_version"), "summary", "months"), {"ignoreNullFields": "false"}).alias("json"))


def spending_document(stats: DataFrame, coverage: DataFrame) -> DataFrame:
    """The spending payload of schema version 2 with the summaries of all and of shown months."""
    months = _spending_months(stats, coverage)
    return _document(2, _scopes(months, "total_spending_minor", "transaction_count"), months)


def financial_document(months: DataFrame) -> DataFrame:
    """The financial payload of schema version 1 with both summaries."""
    rows = months.withColumnsRenamed(_FINANCIAL_NAMES)
    columns = ["total_income_minor", "total_spending_minor", "net_cash_flow_minor", "income_transaction_count", "spending_transaction_count"]
    return _document(1, _scopes(rows, *columns), rows)


_FINANCIAL_NAMES = {"income_minor": "total_income_minor", "income_count": "income_transaction_count", "spending_minor": "total_spending_minor", "spending_count": "spending_transaction_count", "net_minor": "net_cash_flow_minor"}


def financial_json(months: DataFrame) -> DataFrame:
    rows = months.withColumnsRenamed(_FINANCIAL_NAMES)
    return rows.select("month", F.to_json(F.struct(F.lit(1).alias("schema_version"), *rows.columns), {"ignoreNullFields": "false"}).alias("json"))
