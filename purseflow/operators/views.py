"""Read views over published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from purseflow import schemas as S
from purseflow.functions.dates import month_key
from purseflow.functions.money import share_percent


def transaction_view(transactions: DataFrame, enrichments: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Transactions with their enrichment and all review signals, raw and net."""
    rows = transactions.join(enrichments.drop("transaction_type"), "transaction_id")
    if signals is None:
        return rows
    more = signals.select("transaction_id", F.col("review_signals").alias("_more"))
    return rows.join(more, "transaction_id", "left").withColumn("review_signals", F.array_union("review_signals", F.coalesce("_more", F.array().cast("array<string>")))).drop("_more")


def manual_input_view(records: DataFrame, links: DataFrame, view: DataFrame) -> DataFrame:
    """Manual records with the transaction they belong to, newest first. A record without a link, or
    whose transaction isn't there, is an error."""
    own = records.where("source_type = 'manual'").select("source_record_id", F.col("record_ord").alias("input_ord"), F.col("description").alias("input_description"))
    there = view.drop("source_record_id").withColumn("_there", F.lit(True))
    rows = own.join(links.select("source_record_id", "transaction_id", "role"), "source_record_id", "left").join(there, "transaction_id", "left")
    lost = F.raise_error(F.concat(F.lit("manual record without a transaction: "), "source_record_id"))
    return rows.withColumn("transaction_id", F.when(F.col("_there"), F.col("transaction_id")).otherwise(lost)).drop("_there").orderBy(F.desc("input_ord"))


def manual_descriptions(records: DataFrame) -> DataFrame:
    rows = records.where("source_type = 'manual' and description is not null").groupBy("description").agg(F.max("record_ord").alias("last_ord"))
    return rows.orderBy(F.desc("last_ord"))


def transactions_page(view: DataFrame, month: str | None = None, kind: str | None = None) -> DataFrame:
    rows = view if month is None else view.where(month_key("transaction_date") == month)
    rows = rows if kind is None else rows.where(F.col("transaction_type") == kind)
    return rows.orderBy(F.desc("transaction_date"), F.desc("txn_ord"))


def transactions_by_label(view: DataFrame) -> DataFrame:
    """Date descending, then the display name in Chinese collation, then id."""
    return view.orderBy(F.desc("transaction_date"), F.collate("display_name", "zh"), "transaction_id")


def day_groups(view: DataFrame) -> DataFrame:
    """Each day's transactions in order, with their number."""
    items = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("txn_ord", "transaction_id")))), lambda x: x["transaction_id"])
    return view.groupBy("transaction_date").agg(F.count("*").alias("n"), items.alias("transaction_ids"))


def month_options(view: DataFrame) -> DataFrame:
    return view.select(month_key("transaction_date").alias("month")).distinct().orderBy(F.desc("month"))


def recent_transactions(view: DataFrame, n: int = 5) -> DataFrame:
    return view.orderBy(F.desc("transaction_date"), F.desc("txn_ord")).limit(n)


def latest_visible_month(months: DataFrame) -> DataFrame:
    return months.where("show").agg(F.max_by(F.struct(*months.columns), "month").alias("m")).select("m.*")


def selected_month(months: DataFrame, month: str | None = None) -> DataFrame:
    """The asked month if it is there, else the newest."""
    return months.orderBy(F.desc(F.coalesce(F.col("month") == F.lit(month), F.lit(False))), F.desc("month")).limit(1)


def home_summary(months: DataFrame, view: DataFrame, review: DataFrame) -> DataFrame:
    """One row: the latest visible month, the recent transactions and the number of reviews."""
    order = F.struct("transaction_date", "txn_ord", "transaction_id")
    recent = recent_transactions(view).agg(F.transform(F.reverse(F.array_sort(F.collect_list(order))), lambda x: x["transaction_id"]).alias("recent_ids"))
    return latest_visible_month(months).crossJoin(recent).crossJoin(review.agg(F.count("*").alias("review_count")))


def index_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Number of transactions, first and last order by key: the reader filters, so lists are not built."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("txn_ord").alias("first_ord"), F.max("txn_ord").alias("last_ord"))


def top_merchants(stats: DataFrame, k: int = S.TOP_MERCHANTS) -> DataFrame:
    """The first ``k`` merchants of each month with rank and share."""
    rows = stats.where("grain = 'merchant'")
    total = rows.groupBy("month").agg(F.sum("spending_minor").alias("total"))
    return rows.where(F.col("rank") <= k).join(total, "month").select("month", "rank", "merchant_name", "display_name", "spending_minor", share_percent(F.col("spending_minor"), F.col("total")).alias("share_percent"))


def spending_analytics(stats: DataFrame, month: str | None = None, k: int = S.TOP_MERCHANTS) -> DataFrame:
    """Top merchants and categories with shares, of the selected month."""
    chosen = selected_month(stats.where("grain = 'month'").select("month"), month)
    total = stats.where("grain = 'month'").select("month", F.col("spending_minor").alias("total"))
    rows = stats.where(f"grain = 'category' or grain = 'merchant' and rank <= {int(k)}").join(chosen, "month").join(total, "month")
    name = F.when(F.col("grain") == "category", F.col("category")).otherwise(F.col("display_name"))
    return rows.select("month", "grain", "rank", name.alias("name"), "spending_minor", share_percent(F.col("spending_minor"), F.col("total")).alias("share_percent"))


def last_months(months: DataFrame, n: int = S.TREND_MONTHS) -> DataFrame:
    return months.where("show").orderBy(F.desc("month")).limit(n)


def financial_trend(months: DataFrame, n: int = S.TREND_MONTHS) -> DataFrame:
    """The last ``n`` visible months, with the axis maximum over them, 1 at least."""
    rows = last_months(months, n)
    top = rows.agg(F.greatest(F.lit(1), F.max(F.greatest("income_minor", "spending_minor"))).cast("long").alias("axis_maximum"))
    return rows.select("month", "income_minor", "spending_minor", "net_minor").crossJoin(top)


def category_trend(stats: DataFrame, coverage: DataFrame, n: int = S.TREND_MONTHS) -> DataFrame:
    """A dense grid of the last ``n`` visible months and their categories, with zeros, and each category's total."""
    months = last_months(stats.where("grain = 'month'").join(coverage, "month"), n).select("month")
    cells = stats.where("grain = 'category'").join(months, "month").select("month", "category", "spending_minor")
    totals = cells.groupBy("category").agg(F.sum("spending_minor").alias("category_total"))
    grid = months.crossJoin(totals).join(cells, ["month", "category"], "left")
    return grid.select("month", "category", F.coalesce("spending_minor", F.lit(0)).cast("long").alias("spending_minor"), "category_total")


def row_json(rows: DataFrame, amounts: tuple[str, ...] = ("amount",)) -> DataFrame:
    """Rows as JSON objects with amounts as plain decimal strings and nulls kept."""
    from purseflow.functions.money import plain

    columns = [plain(c).alias(c) if c in amounts else F.col(c) for c in rows.columns]
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))
