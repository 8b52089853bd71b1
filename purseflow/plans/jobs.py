"""Jobs over a whole ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purseflow import schemas as S
from purseflow.functions.dates import month_key
from purseflow.functions.money import minor_units
from purseflow.operators import changes as manual
from purseflow.operators import enrichment, identity, projections, refunds
from purseflow.operators.checks import pending_records, reconciled_evidence
from purseflow.operators.ranking import positions
from purseflow.sources.files import manual_records
from purseflow.storage import materialize


def full_rebuild(records: DataFrame, links: DataFrame, description_map: DataFrame, merchant_map: DataFrame, decisions: DataFrame, statement_dates: DataFrame) -> dict[str, DataFrame]:
    """Every derived table from evidence, links, maps and decisions; links stay as they are.
    Statement dates count only from evidence whose records are all linked."""
    t = materialize(identity.rebuild_transactions(records, links), "transactions")
    e = materialize(enrichment.resolve_enrichment(t, description_map, merchant_map, decisions), "enrichments")
    outcome = materialize(refunds.net_refunds(t, e), "outcome")
    net = refunds.net_consumption(outcome)
    facts = projections.spending_facts(net, t, e)
    stats = materialize(projections.spending_statistics(facts), "stats")
    dates = statement_dates.join(reconciled_evidence(records, links), "evidence_identity", "left_semi")
    coverage = projections.month_coverage(t.select(month_key("transaction_date").alias("month")), dates)
    spending = stats.where("grain = 'month'").select("month", "spending_minor", F.col("transaction_count").alias("spending_count"))
    months = projections.financial_months(projections.income_by_month(t), spending, coverage)
    return {
        "transactions": t, "enrichments": e, "outcome": outcome, "net": net, "spending": stats, "coverage": coverage, "financial": months, "signals": enrichment.net_signals(e, net),
        "refund_summary": refunds.refund_summary(outcome, t), "summary": projections.financial_summary(months), "pending": pending_records(records, links),
    }


def changed_transactions(before: dict[str, DataFrame], transactions: DataFrame, enrichments: DataFrame) -> DataFrame:
    """(transaction_id) of those that are new, gone, or not the same in what netting and projections read."""
    same = ["transaction_type", "transaction_date", "amount", "description", "source_record_id", "txn_ord", "merchant_name", "display_name", "category", "is_unclassified"]

    def marked(t, e, name):
        return t.join(e.select("transaction_id", "merchant_name", "display_name", "category", "is_unclassified"), "transaction_id").select("transaction_id", F.struct(*same).alias(name))

    both = marked(before["transactions"], before["enrichments"], "old").join(marked(transactions, enrichments, "new"), "transaction_id", "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("transaction_id")


def rebuild_touched(before: dict[str, DataFrame], records: DataFrame, links: DataFrame, description_map: DataFrame, merchant_map: DataFrame, decisions: DataFrame, statement_dates: DataFrame) -> dict[str, DataFrame]:
    """What ``full_rebuild`` gives, from its result before a change of evidence, links, maps or decisions.

    Only what the change can reach is worked out anew: the refund components of changed
    transactions, by what they were and by what they are, and the months of those and of the
    components' purchases. Netting, sums and ranks of all others are taken over."""
    t = materialize(identity.rebuild_transactions(records, links), "transactions")
    e = materialize(enrichment.resolve_enrichment(t, description_map, merchant_map, decisions), "enrichments")
    changed = materialize(changed_transactions(before, t, e), "changed")
    old_rows, new_rows = (refunds.keyed(x, y) for x, y in ((before["transactions"], before["enrichments"]), (t, e)))
    both = materialize(old_rows.union(new_rows), "rows")
    keys = materialize(refunds.reached_keys(both, both.join(changed, "transaction_id", "left_semi")), "reached")
    own = both.join(keys, "key", "left_semi").select("transaction_id", "transaction_date")
    redone = t.join(new_rows.join(keys, "key", "left_semi").select("transaction_id"), "transaction_id", "left_semi")
    outcome = before["outcome"].join(own.select("transaction_id").distinct(), "transaction_id", "left_anti")
    outcome = materialize(outcome.select(*before["outcome"].columns).union(refunds.net_refunds(redone, e).select(*before["outcome"].columns)), "outcome")
    month = month_key("transaction_date").alias("month")
    moved = before["transactions"].union(t.select(*before["transactions"].columns)).join(changed, "transaction_id", "left_semi")
    months = materialize(own.select(month).union(moved.select(month)).distinct(), "months")
    fresh = t.withColumn("month", month).join(months, "month", "left_semi").drop("month")
    net = refunds.net_consumption(outcome)
    facts = projections.spending_facts(net.join(fresh.select("transaction_id"), "transaction_id", "left_semi"), fresh, e)
    kept = before["spending"].where("grain <> 'all'").join(months, "month", "left_anti").select(*before["spending"].columns)
    stats = kept.union(projections.spending_statistics(facts).where("grain <> 'all'").select(*before["spending"].columns))
    stats = materialize(stats, "stats")
    whole = stats.where("grain = 'month'").agg(F.sum("spending_minor").alias("spending_minor"), F.sum("transaction_count").alias("transaction_count")).where("spending_minor is not null")
    empty = {c: F.lit(None).cast(d) for c, d in stats.dtypes}
    stats = stats.union(whole.select(*[F.lit("all").alias(c) if c == "grain" else F.lit(1).alias(c) if c == "rank" else F.col(c) if c in whole.columns else empty[c].alias(c) for c in stats.columns]))
    dates = statement_dates.join(reconciled_evidence(records, links), "evidence_identity", "left_semi")
    listed = before["coverage"].select("month").join(months, "month", "left_anti").union(fresh.select(month).distinct())
    coverage = projections.month_coverage(listed, dates)
    income = projections.income_by_month(fresh)
    old_income = before["financial"].where("income_count > 0").join(months, "month", "left_anti").select("month", "income_minor", "income_count")
    spending = stats.where("grain = 'month'").select("month", "spending_minor", F.col("transaction_count").alias("spending_count"))
    financial = projections.financial_months(old_income.union(income.select("month", "income_minor", "income_count")), spending, coverage)
    return {
        "transactions": t, "enrichments": e, "outcome": outcome, "net": net, "spending": stats, "coverage": coverage, "financial": financial, "signals": enrichment.net_signals(e, net),
        "refund_summary": refunds.refund_summary(outcome, t), "summary": projections.financial_summary(financial), "pending": pending_records(records, links), "months": months,
    }


def change_manual_inputs(others: DataFrame, evidence: DataFrame, changes: DataFrame, links: DataFrame, policy: DataFrame, decisions: DataFrame, description_map: DataFrame, enrichments: DataFrame, generation: int = 1) -> dict[str, DataFrame]:
    """A table of mixed changes of manual entries in one run: the entries after it, links,
    kept decisions, and for each change its transaction and outcome. ``others`` are the records of other
    sources. Corrected entries are decided on anew; created ones, and those deleted and
    created again, as new ones."""
    mine = manual_records(evidence.withColumn("line_no", F.lit(0).cast("long"))).select("source_record_id", F.col("evidence_identity").alias("id"))
    linked = mine.join(links.select("source_record_id"), "source_record_id", "left_semi").select("id")
    after, judged = manual.apply_manual_changes(evidence, changes, linked)
    after, judged = materialize(after, "evidence"), materialize(judged, "changes")
    lines = positions(after, "id", name="line_no")  # an order of the entries that doesn't depend on how the table is stored
    columns = [c.split()[0] for c in S.SOURCE_RECORDS.split(", ")]
    records = materialize(others.select(*columns).unionByName(manual_records(lines).select(*columns)), "records")
    kept = links.join(manual.renewed_records(judged, links), "source_record_id", "left_anti")
    hints, transaction_hints = identity.merchant_hints(records, description_map, enrichments)
    result, decided, counts = identity.sync(records, kept, policy, decisions, hints, transaction_hints, manual.corrected_records(judged, kept), generation)
    outcome = manual.manual_outcome(judged, links, identity.links_of(result), identity.decisions_of(result))
    return {"evidence": after, "records": records, "links": identity.links_of(result), "conflicts": identity.conflicts_of(result), "decisions": decided, "counts": counts, "outcome": outcome}


def diagnose(transactions: DataFrame, enrichments: DataFrame, links: DataFrame, records: DataFrame) -> DataFrame:
    """One row of counts."""
    t = transactions.agg(F.count("*").alias("transactions"), F.count_if(F.col("transaction_type") == "expense").alias("expenses"), F.count_if(F.col("transaction_type") == "income").alias("incomes"), minor_units(F.sum("amount")).alias("amount_minor"))
    e = enrichments.agg(F.count_if("is_unclassified").alias("unclassified"))
    return t.crossJoin(e).crossJoin(links.agg(F.count("*").alias("links"))).crossJoin(pending_records(records, links).agg(F.count("*").alias("pending")))
