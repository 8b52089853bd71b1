"""Data-quality checks: each gives a table of violations (check_id, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purseflow import schemas as S
from purseflow.functions.money import has_minor_units


def violations(rows: DataFrame, check_id: str, key: Column | str, detail: Column | str = "") -> DataFrame:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return rows.select(F.lit(check_id).alias("check_id"), (F.col(key) if isinstance(key, str) else key).cast("string").alias("key"), text.cast("string").alias("detail"))


def union(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


class ViolationError(ValueError):
    pass


def enforce(found: DataFrame, strict: bool = True) -> DataFrame:
    """Strict: fail with the first few violations. Lenient: hand them on, to be set aside."""
    if strict and (first := found.limit(5).collect()):
        raise ViolationError("; ".join(f"{r.check_id} {r.key}: {r.detail}" for r in first))
    return found


def _bad_text(c: str) -> Column:
    x = F.col(c)
    return x.isNull() | (F.length(F.trim(x)) == 0) | (x != F.trim(x)) | x.contains("\0")


def identity_parts(records: DataFrame) -> DataFrame:
    parts = ("source_type", "evidence_identity", "record_locator")
    return violations(records.where(reduce(Column.__or__, map(_bad_text, parts))), "V1", "source_record_id", "identity part empty, untrimmed or with NUL")


def _facts(rows: DataFrame, check_id: str, key: str) -> DataFrame:
    bad = F.coalesce(~F.col("transaction_type").isin(*S.TYPES), F.lit(True)) | F.col("amount").isNull() | F.coalesce(F.col("currency") != F.upper("currency"), F.lit(True)) | (F.trim("currency") == "")
    return violations(rows.where(bad), check_id, key, "type, amount or currency")


def record_facts(records: DataFrame) -> DataFrame:
    return _facts(records, "V2", "source_record_id")


def transaction_facts(transactions: DataFrame) -> DataFrame:
    return _facts(transactions, "V3", "transaction_id")


def link_structure(links: DataFrame) -> DataFrame:
    twice = links.groupBy("source_record_id").count().where("count > 1")
    chiefs = links.groupBy("transaction_id").agg(F.count_if(F.col("role") == "authoritative").alias("n")).where("n <> 1")
    return union(violations(twice, "V4", "source_record_id", "linked more than once"), violations(chiefs, "V4", "transaction_id", F.concat(F.col("n"), F.lit(" authorities"))))


def link_targets(links: DataFrame, records: DataFrame) -> DataFrame:
    return violations(links.join(records, "source_record_id", "left_anti"), "V5", "source_record_id", "link without record")


def mapping_catalogue(description_map: DataFrame, merchant_map: DataFrame) -> DataFrame:
    used = description_map.select("merchant").distinct()
    return union(
        violations(used.join(merchant_map, "merchant", "left_anti"), "V6", "merchant", "mapped merchant without category"), violations(merchant_map.join(used, "merchant", "left_anti"), "V6", "merchant", "categorised merchant without description"),
        violations(merchant_map.where(F.col("category") == S.UNCLASSIFIED), "V6", "merchant", "reserved category"), unique(description_map, "description", "V6"), unique(merchant_map, "merchant", "V6"),
    )


def decision_rows(decisions: DataFrame, transactions: DataFrame) -> DataFrame:
    empty = decisions.where("coalesce(merchant_override, category_override, note) is null")
    loose = decisions.where("merchant_override <> trim(merchant_override) or category_override <> trim(category_override) or note <> trim(note) or merchant_override = '' or category_override = '' or note = ''")
    orphan = decisions.join(transactions.select("transaction_id"), "transaction_id", "left_anti")
    return union(violations(empty, "V7", "transaction_id", "no value"), violations(loose, "V7", "transaction_id", "untrimmed or empty value"), violations(orphan, "V7", "transaction_id", "no such transaction"), unique(decisions, "transaction_id", "V7"))


def mirrored_facts(transactions: DataFrame, records: DataFrame, links: DataFrame) -> DataFrame:
    facts = ("transaction_type", "transaction_date", "amount", "currency")
    chief = links.where("role = 'authoritative'").select("transaction_id", "source_record_id").join(records.select("source_record_id", F.struct(*facts).alias("theirs")), "source_record_id")
    rows = transactions.select("transaction_id", F.struct(*facts).alias("mine")).join(chief, "transaction_id")
    return violations(rows.where(~F.col("mine").eqNullSafe(F.col("theirs"))), "V8", "transaction_id", "facts differ from the authority's")


def unique(rows: DataFrame, key: str, check_id: str = "V9") -> DataFrame:
    return violations(rows.groupBy(key).count().where("count > 1"), check_id, key, F.concat(F.col("count"), F.lit(" rows")))


def known_categories(decisions: DataFrame, merchant_map: DataFrame) -> DataFrame:
    rows = decisions.where("category_override is not null").join(merchant_map.select(F.col("category").alias("category_override")).distinct(), "category_override", "left_anti")
    return violations(rows, "V10", "transaction_id", F.col("category_override"))


def income_decisions(decisions: DataFrame, transactions: DataFrame) -> DataFrame:
    rows = decisions.where("merchant_override is not null or category_override is not null").join(transactions.where("transaction_type = 'income'").select("transaction_id"), "transaction_id", "left_semi")
    return violations(rows, "V11", "transaction_id", "income takes notes only")


def positive_income(transactions: DataFrame) -> DataFrame:
    return violations(transactions.where("transaction_type = 'income' and amount <= 0"), "V12", "transaction_id", F.col("amount"))


def positive_spending(net: DataFrame) -> DataFrame:
    return violations(net.where("spending <= 0"), "V13", "transaction_id", F.col("spending"))


def two_decimals(rows: DataFrame, key: str = "transaction_id", amount: str = "amount") -> DataFrame:
    return violations(rows.where(~has_minor_units(amount)), "V14", key, F.col(amount))


def month_sums(stats: DataFrame) -> DataFrame:
    """Month totals against the sums of categories and of merchants."""
    part = lambda g, c: F.sum(F.when(F.col("grain") == g, F.col(c)).otherwise(0)).alias(f"{g}_{c}")
    sums = stats.where("month is not null").groupBy("month").agg(*[part(g, c) for g in ("month", "category", "merchant") for c in ("spending_minor", "transaction_count")])
    bad = reduce(Column.__or__, [F.col(f"month_{c}") != F.col(f"{g}_{c}") for g in ("category", "merchant") for c in ("spending_minor", "transaction_count")])
    return violations(sums.where(bad), "V15", "month", "parts don't make the total")


def financial_totals(summary: DataFrame, transactions: DataFrame, net: DataFrame, by: str | None = None) -> DataFrame:
    """The all-data summary against sums of the raw rows; with ``by``, a column of all three, one summary for each of its values."""
    keys = [] if by is None else [by]
    sums = lambda rows, c, name: rows.groupBy(*keys).agg(F.coalesce(F.sum(F.col(c) * 100), F.lit(0)).cast("long").alias(name))
    income, spent = sums(transactions.where("transaction_type = 'income'"), "amount", "i"), sums(net, "spending", "s")
    raw = income.crossJoin(spent) if by is None else income.join(spent, by, "full_outer")
    rows = summary.where("scope = 'all_data'")
    rows = (rows.crossJoin(raw) if by is None else rows.join(raw, by, "full_outer")).na.fill(0, ["i", "s", "income_minor", "spending_minor", "net_minor"])
    return violations(rows.where("income_minor <> i or spending_minor <> s or net_minor <> i - s"), "V16", by or "scope", "summary differs from raw sums")


def verify_payload(stats: DataFrame, months: DataFrame, coverage: DataFrame) -> DataFrame:
    """Published tables as a reader checks them: unique keys, sums, net, null merchant if unclassified, months covered."""
    merchants = stats.where("grain = 'merchant'")
    uncovered = stats.where("grain = 'month'").join(coverage, "month", "left_anti")
    return union(
        month_sums(stats), violations(months.where("net_minor <> income_minor - spending_minor"), "V17", "month", "net"), violations(months.where("income_count = 0 and spending_count = 0"), "V17", "month", "empty month"),
        violations(merchants.where("is_unclassified <> (merchant_name is null)"), "V17", "month", "unclassified flag"), unique(months, "month", "V17"), unique(coverage, "month", "V17"), violations(uncovered, "V17", "month", "month without coverage"),
        violations(merchants.groupBy("month", "merchant_name", "display_name").count().where("count > 1"), "V17", "month", "merchant twice"),
    )


def schedule_rules(rules: DataFrame, execution: DataFrame) -> DataFrame:
    """Rules as read (first_occurrence_date a date, amount decimal) and their execution rows."""
    bad = rules.where("amount is null or first_occurrence_date is null or day(first_occurrence_date) > 28 or id <> trim(id) or description is null or description <> trim(description) or description = '' or type not in ('income', 'expense') or (type = 'income' and amount <= 0)")
    meta = ["last_processed_occurrence_date", "last_source_record_id", "last_transaction_id", "last_action"]
    given = reduce(Column.__add__, [F.col(c).isNotNull().cast("int") for c in meta])
    return union(violations(bad, "V18", "id", "rule"), violations(execution.where((given > 0) & (given < len(meta))), "V18", "rule_id", "metadata given in part"), violations(execution.join(rules.select(F.col("id").alias("rule_id")), "rule_id", "left_anti"), "V19", "rule_id", "no such rule"), unique(rules, "id", "V9"))


def feedback_rows(feedback: DataFrame) -> DataFrame:
    """created_at is text here, as it must carry a zone."""
    bad = ~F.col("status").isin(*S.FEEDBACK_STATUS) | ~F.col("context.runtime").isin(*S.FEEDBACK_RUNTIMES) | ~F.col("created_at").rlike(r"(Z|[+-]\d\d:\d\d)$") | (F.col("context.entity_type").isNull() != F.col("context.entity_id").isNull()) | (F.trim("content") == "")
    return union(violations(feedback.where(F.coalesce(bad, F.lit(True))), "V20", "id", "feedback"), unique(feedback, "id", "V9"))


def json_keys(rows: DataFrame, column: str, required: list[str], optional: list[str] = ()) -> DataFrame:
    """JSON objects with unknown or missing keys."""
    keys = F.json_object_keys(column)
    unknown = F.array_except(keys, F.array(*map(F.lit, [*required, *optional])))
    missing = F.array_except(F.array(*map(F.lit, required)), keys)
    bad = keys.isNull() | (F.size(unknown) > 0) | (F.size(missing) > 0)
    return violations(rows.where(bad), "V21", F.sha2(column, 256), F.concat(F.lit("unknown "), F.array_join(unknown, ","), F.lit("; missing "), F.array_join(missing, ",")))


def own_type(records: DataFrame, source_type: str) -> DataFrame:
    return violations(records.where(F.col("source_type") != source_type), "V22", "source_record_id", F.col("source_type"))


def matched_sides(transactions: DataFrame, enrichments: DataFrame, net: DataFrame) -> DataFrame:
    t, e = transactions.select("transaction_id", F.lit(1).alias("t")), enrichments.select("transaction_id", F.lit(1).alias("e"))
    both = t.join(e, "transaction_id", "full_outer").where("t is null or e is null")
    return union(violations(both, "V23", "transaction_id", "transaction or enrichment is missing"), violations(net.join(t, "transaction_id", "left_anti"), "V23", "transaction_id", "net of no transaction"))


def one_currency(rows: DataFrame) -> DataFrame:
    """Descriptions under review with more than one currency."""
    several = rows.groupBy("description").agg(F.min("currency").alias("a"), F.max("currency").alias("b")).where("a <> b")
    return violations(several, "V25", "description", "several currencies")


def pending_records(records: DataFrame, links: DataFrame) -> DataFrame:
    """Reported, no error: records without a link."""
    return violations(records.join(links, "source_record_id", "left_anti"), "V26", "source_record_id", "pending")


def reconciled_evidence(records: DataFrame, links: DataFrame) -> DataFrame:
    """Evidence all of whose records are linked."""
    linked = links.select("source_record_id").distinct().withColumn("_linked", F.lit(True))
    rows = records.select("evidence_identity", "source_record_id").join(linked, "source_record_id", "left")
    return rows.groupBy("evidence_identity").agg(F.bool_and(F.coalesce("_linked", F.lit(False))).alias("all_linked")).where("all_linked").select("evidence_identity")
