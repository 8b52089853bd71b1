"""Merchant, category and review signals of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purseflow import schemas as S
from purseflow.functions.text import display_name


def resolve_enrichment(transactions: DataFrame, description_map: DataFrame, merchant_map: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row for each transaction (with its authoritative record's description and id):
    an override beats the mapping, a category override beats the merchant's default.
    Income has neither merchant nor default. The join strategies are Catalyst's."""
    expense = F.col("transaction_type") == "expense"
    rows = transactions.select("transaction_id", "transaction_type", "description", "source_record_id").join(decisions, "transaction_id", "left").join(description_map.withColumnRenamed("merchant", "_mapped"), "description", "left")
    merchant = F.when(expense, F.coalesce("merchant_override", "_mapped"))
    rows = rows.withColumn("merchant_name", merchant).join(merchant_map.select(F.col("merchant").alias("merchant_name"), F.col("category").alias("default_category")), "merchant_name", "left")
    source = F.when(~expense, "income_default").when(F.col("category_override").isNotNull(), "transaction_override").when(F.col("default_category").isNotNull(), "merchant_default").otherwise("unclassified")
    category = F.when(~expense, F.lit(S.OTHER_INCOME)).otherwise(F.coalesce("category_override", "default_category", F.lit(S.UNCLASSIFIED)))
    signals = F.when((source == "merchant_default") & (F.col("default_category") == S.OTHER_EXPENSE), F.array(F.lit(S.OTHER_EXPENSE_REVIEW))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "transaction_id", "transaction_type", "merchant_name", display_name("merchant_name", "description", "source_record_id").alias("display_name"), "default_category",
        category.alias("category"), source.alias("category_source"), (source == "unclassified").alias("is_unclassified"), signals.alias("review_signals"), "note",
    )


def net_signals(enrichments: DataFrame, net: DataFrame) -> DataFrame:
    """(transaction_id, review_signals): with net spending, the rule on that amount, which a
    category override silences; without, the signals as resolved."""
    rows = enrichments.join(net.select("transaction_id", "spending"), "transaction_id", "left")
    high = F.when((F.col("category") == S.GENERAL_SHOPPING) & (F.col("spending") >= S.HIGH_VALUE), F.array(F.lit(S.HIGH_VALUE_REVIEW))).otherwise(F.array().cast("array<string>"))
    ruled = F.when(F.col("category_source") == "transaction_override", F.array().cast("array<string>")).otherwise(F.concat("review_signals", high))
    return rows.select("transaction_id", F.when(F.col("spending").isNull(), F.col("review_signals")).otherwise(ruled).alias("review_signals"))
