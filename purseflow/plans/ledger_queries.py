"""Queries over the ledger's core: transactions, enrichment, netting, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from purseflow.functions.dates import month_key
from purseflow.functions.money import minor_units, share_percent
from purseflow.operators import enrichment, identity, projections, refunds
from purseflow.plans import adapters as A
from purseflow.plans.adapters import as_net, sql
from purseflow.storage import materialize

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function of (spark, sf_dir), and its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def enriched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = A.transactions(spark, sf_dir)
    return t, enrichment.resolve_enrichment(t, A.description_map(spark, sf_dir), A.merchant_map(spark, sf_dir), A.decisions(spark, sf_dir))


def netted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t, e = enriched(spark, sf_dir)
    e = materialize(e, "enrichments")
    return t, e, materialize(refunds.net_refunds(t, e), "outcome")


def plain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The part of the ledger that no refund can reach, by description or merchant: there, net is gross."""
    t, e = enriched(spark, sf_dir)
    rows = t.where("transaction_type = 'expense'").join(e.select("transaction_id", "merchant_name"), "transaction_id")
    refund = rows.where("amount < 0")
    rows = rows.where("amount > 0").join(refund.select("description").distinct(), "description", "left_anti")
    rows = rows.join(refund.where("merchant_name is not null").select("merchant_name").distinct(), "merchant_name", "left_anti")
    return rows.select("transaction_id", F.col("amount").alias("spending")), t, e


def whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole ledger, with spending net of refunds: what all queries of spending read but those named
    spending_no_refund_*."""
    t, e, o = netted(spark, sf_dir)
    return refunds.net_consumption(o), t, e


@query(sql("records", "transactions", then="SELECT transaction_id, source_record_id, transaction_type, transaction_date, CAST(amount * 100 AS BIGINT) AS amount_minor, currency, txn_ord FROM transactions"))
def rebuild_transactions(spark, sf_dir):
    r = A.records(spark, sf_dir)
    found = identity.rebuild_transactions(r, identity.own_links(r))
    return found.select("transaction_id", "source_record_id", "transaction_type", "transaction_date", minor_units("amount").alias("amount_minor"), "currency", F.col("txn_ord").cast("long").alias("txn_ord"))


@query(sql("enrichments", then="SELECT transaction_id, merchant_name, display_name, default_category, category, category_source, category_source = 'unclassified' AS is_unclassified, note FROM enrichments"))
def enrichments(spark, sf_dir):
    return enriched(spark, sf_dir)[1].drop("transaction_type", "review_signals")


@query(sql("enrichments", then="SELECT transaction_id, 'other_expense_review' AS signal FROM enrichments WHERE category_source = 'merchant_default' AND default_category = '其他支出'"))
def review_signals_raw(spark, sf_dir):
    return enriched(spark, sf_dir)[1].select("transaction_id", F.explode("review_signals").alias("signal"))


@query(as_net(sql("plain", then="""SELECT transaction_id, unnest(CASE WHEN category_source = 'transaction_override' THEN [] ELSE
    CASE WHEN category_source = 'merchant_default' AND category = '其他支出' THEN ['other_expense_review'] ELSE [] END ||
    CASE WHEN category = '综合购物' AND amount >= 1000 THEN ['high_value_general_shopping_review'] ELSE [] END END) AS signal FROM plain""")))
def review_signals_net(spark, sf_dir):
    return _review_signals(*whole(spark, sf_dir))


def _review_signals(net, _, e) -> DataFrame:
    return enrichment.net_signals(e.join(net.select("transaction_id"), "transaction_id", "left_semi"), net).select("transaction_id", F.explode("review_signals").alias("signal"))


@query(sql("net", then="SELECT transaction_id, CAST(amount * 100 AS BIGINT) AS spending_minor FROM net"))
def net_consumption(spark, sf_dir):
    return refunds.net_consumption(netted(spark, sf_dir)[2]).select("transaction_id", minor_units("spending").alias("spending_minor"))


@query(sql("transactions", then="""SELECT CAST(sum(CASE WHEN amount > 0 THEN amount END) * 100 AS BIGINT) AS bought_minor, CAST(-sum(CASE WHEN amount < 0 THEN amount END) * 100 AS BIGINT) AS refunded_minor, TRUE AS conserved
    FROM transactions WHERE transaction_type = 'expense'"""))
def refund_conservation(spark, sf_dir):
    o = netted(spark, sf_dir)[2]
    part = lambda k, c: F.sum(F.when(F.col("kind") == k, F.col(c)))
    sums = o.agg(part("balance", "amount").alias("b"), part("balance", "remaining").alias("n"), part("refund", "amount").alias("r"), part("refund", "remaining").alias("u"))
    return sums.select(minor_units("b").alias("bought_minor"), minor_units("r").alias("refunded_minor"), (F.col("n") == F.col("b") - F.col("r") + F.col("u")).alias("conserved"))


@query(sql("transactions", then="SELECT count(*) FILTER (amount = 0) AS zero_amount_transactions, count(*) FILTER (amount < 0) AS refund_transactions, count(*) FILTER (amount > 0) AS purchases FROM transactions WHERE transaction_type = 'expense'"))
def refund_counts(spark, sf_dir):
    t, _, o = netted(spark, sf_dir)
    s = refunds.refund_summary(o, t).select("zero_amount_transactions", "refund_transactions")
    return s.crossJoin(o.agg(F.count_if(F.col("kind") == "balance").alias("purchases")))


@query(sql("net_balances", "net_refunds", then="""SELECT (SELECT count(*) FROM transactions WHERE transaction_type = 'expense' AND amount = 0) AS zero_amount_transactions, (SELECT count(*) FROM net_refunds) AS refund_transactions,
    (SELECT count(*) FROM net_refunds WHERE rule = 'merchant') AS same_merchant_refund_matches, (SELECT coalesce(sum(matched), 0) FROM net_refunds WHERE rule = 'merchant') AS same_merchant_matched_amount,
    (SELECT count(*) FROM net_balances WHERE remaining = 0) AS fully_refunded_transactions, (SELECT count(*) FROM net_balances WHERE remaining > 0 AND remaining < amount) AS partially_refunded_transactions,
    (SELECT count(*) FROM net_refunds WHERE matched < amount) AS unmatched_refund_count, (SELECT coalesce(sum(amount - matched), 0) FROM net_refunds) AS unmatched_refund_amount"""))
def refund_summary(spark, sf_dir):
    t, _, o = netted(spark, sf_dir)
    return refunds.refund_summary(o, t)


@query(sql("net_refunds", then="SELECT transaction_id, rule, CAST(amount * 100 AS BIGINT) AS asked_minor, CAST(matched * 100 AS BIGINT) AS matched_minor FROM net_refunds"))
def refund_rules(spark, sf_dir):
    """Every refund with the rule that matched it and what it consumed."""
    o = netted(spark, sf_dir)[2].where("kind = 'refund'")
    return o.select("transaction_id", "rule", minor_units("amount").alias("asked_minor"), minor_units("matched").alias("matched_minor"))


@query(sql("net", then="""SELECT month, category, CAST(sum(amount) * 100 AS BIGINT) AS spending_minor, count(*) AS transaction_count, CAST(row_number() OVER (PARTITION BY month ORDER BY sum(amount) DESC, category) AS INTEGER) AS rank
    FROM net GROUP BY month, category"""))
def spending_by_category(spark, sf_dir):
    """The flagship: spending net of refunds by month and category."""
    t, e, o = netted(spark, sf_dir)
    stats = projections.spending_statistics(projections.spending_facts(refunds.net_consumption(o), t, e))
    return stats.where("grain = 'category'").select("month", "category", "spending_minor", "transaction_count", "rank")


@query()
def spending_payload(spark, sf_dir):
    t, e, o = netted(spark, sf_dir)
    stats = materialize(projections.spending_statistics(projections.spending_facts(refunds.net_consumption(o), t, e)), "stats")
    return projections.spending_json(stats, projections.month_coverage(stats.where("grain = 'month'").select("month"), A.statement_dates(spark, sf_dir)))


def _plain_stats(spark, sf_dir, part=plain) -> DataFrame:
    return projections.spending_statistics(projections.spending_facts(*part(spark, sf_dir)))


def _rollup(stats: DataFrame) -> DataFrame:
    return stats.where("grain <> 'merchant'").select("grain", "month", "category", "spending_minor", "transaction_count")


@query(sql("plain", then="SELECT month, CAST(sum(amount) * 100 AS BIGINT) AS spending_minor, count(*) AS transaction_count FROM plain GROUP BY month"))
def spending_no_refund_month(spark, sf_dir):
    return _plain_stats(spark, sf_dir).where("grain = 'month'").select("month", "spending_minor", "transaction_count")


@query(sql("plain", then="""SELECT month, category, CAST(sum(amount) * 100 AS BIGINT) AS spending_minor, count(*) AS transaction_count,
    row_number() OVER (PARTITION BY month ORDER BY sum(amount) DESC, category) AS rank FROM plain GROUP BY month, category"""))
def spending_no_refund_category(spark, sf_dir):
    return _plain_stats(spark, sf_dir).where("grain = 'category'").select("month", "category", "spending_minor", "transaction_count", F.col("rank").cast("long").alias("rank"))


@query(sql("plain", then="SELECT month, merchant_name, display_name, merchant_name IS NULL AS is_unclassified, CAST(sum(amount) * 100 AS BIGINT) AS spending_minor, count(*) AS transaction_count FROM plain GROUP BY ALL"))
def spending_no_refund_merchant(spark, sf_dir):
    return _plain_stats(spark, sf_dir).where("grain = 'merchant'").select("month", "merchant_name", "display_name", "is_unclassified", "spending_minor", "transaction_count")


@query(as_net(SQL["spending_no_refund_month"]))
def net_spending_month(spark, sf_dir):
    return _plain_stats(spark, sf_dir, whole).where("grain = 'month'").select("month", "spending_minor", "transaction_count")


@query(as_net(SQL["spending_no_refund_merchant"]))
def net_spending_merchant(spark, sf_dir):
    return _plain_stats(spark, sf_dir, whole).where("grain = 'merchant'").select("month", "merchant_name", "display_name", "is_unclassified", "spending_minor", "transaction_count")


@query(as_net(sql("plain", then="SELECT month, merchant_name, display_name, CAST(sum(amount) * 100 AS BIGINT) AS spending_minor, row_number() OVER (PARTITION BY month ORDER BY sum(amount) DESC, display_name, coalesce(merchant_name, '')) AS rank FROM plain GROUP BY 1, 2, 3")))
def merchant_ranks(spark, sf_dir):
    """All merchants of every month with their rank."""
    return projections.ranked_merchants(_plain_stats(spark, sf_dir, whole)).select("month", "merchant_name", "display_name", "spending_minor", "rank")


@query(as_net(sql("plain", then="""SELECT CASE WHEN grouping(month) = 1 THEN 'all' WHEN grouping(category) = 1 THEN 'month' ELSE 'category' END AS grain, month, category, CAST(sum(amount) * 100 AS BIGINT) AS spending_minor, count(*) AS transaction_count
    FROM plain GROUP BY GROUPING SETS ((), (month), (month, category))""")))
def spending_rollup(spark, sf_dir):
    return _rollup(_plain_stats(spark, sf_dir, whole))


@query(as_net(sql("statement_dates", "plain", then="""SELECT month, m.a AND m.b AS is_complete, m.a AND m.b AS "show" FROM (SELECT DISTINCT month,
    CAST(month || '-10' AS DATE) IN (SELECT statement_date FROM statement_dates) AS a,
    CAST(CAST(month || '-10' AS DATE) + INTERVAL 1 MONTH AS DATE) IN (SELECT statement_date FROM statement_dates) AS b FROM plain) m""")))
def month_coverage(spark, sf_dir):
    return _coverage(spark, sf_dir, whole)


def _coverage(spark, sf_dir, part) -> DataFrame:
    net, t, _ = part(spark, sf_dir)
    months = net.join(t, "transaction_id").select(month_key("transaction_date").alias("month"))
    return projections.month_coverage(months, A.statement_dates(spark, sf_dir))


@query(sql("transactions", then="SELECT strftime(transaction_date, '%Y-%m') AS month, CAST(sum(amount) * 100 AS BIGINT) AS income_minor, count(*) AS income_count FROM transactions WHERE transaction_type = 'income' GROUP BY 1"))
def income_by_month(spark, sf_dir):
    return projections.income_by_month(A.transactions(spark, sf_dir))


_CASH = """cash AS (SELECT coalesce(i.month, s.month) AS month, coalesce(income_minor, 0) AS income_minor, coalesce(income_count, 0) AS income_count, coalesce(spending_minor, 0) AS spending_minor, coalesce(spending_count, 0) AS spending_count,
      CAST(coalesce(i.month, s.month) || '-10' AS DATE) IN (SELECT statement_date FROM statement_dates) AND CAST(CAST(coalesce(i.month, s.month) || '-10' AS DATE) + INTERVAL 1 MONTH AS DATE) IN (SELECT statement_date FROM statement_dates) AS shown
    FROM (SELECT strftime(transaction_date, '%Y-%m') AS month, CAST(sum(amount) * 100 AS BIGINT) AS income_minor, count(*) AS income_count FROM transactions WHERE transaction_type = 'income' GROUP BY 1) i
    FULL OUTER JOIN (SELECT month, CAST(sum(amount) * 100 AS BIGINT) AS spending_minor, count(*) AS spending_count FROM plain GROUP BY 1) s ON i.month = s.month)"""


def cash_sql(then: str) -> str:
    return sql("statement_dates", "plain", then="").rstrip() + ",\n" + _CASH + "\n" + then


def cash_flow(spark, sf_dir, part) -> DataFrame:
    net, t, _ = part(spark, sf_dir)
    spending = net.join(t, "transaction_id").groupBy(month_key("transaction_date").alias("month")).agg(minor_units(F.sum("spending")).alias("spending_minor"), F.count("*").alias("spending_count"))
    months = t.select(month_key("transaction_date").alias("month"))
    return projections.financial_months(projections.income_by_month(t), spending, projections.month_coverage(months, A.statement_dates(spark, sf_dir)))


@query(as_net(cash_sql("SELECT month, shown AS spending_data_complete, shown AS \"show\", income_minor, income_count, spending_minor, spending_count, income_minor - spending_minor AS net_minor FROM cash")))
def cash_flow_month(spark, sf_dir):
    return cash_flow(spark, sf_dir, whole)


@query(as_net(cash_sql("""SELECT scope, CAST(sum(income_minor) AS BIGINT) AS income_minor, CAST(sum(spending_minor) AS BIGINT) AS spending_minor, CAST(sum(income_minor - spending_minor) AS BIGINT) AS net_minor,
    CAST(sum(income_count) AS BIGINT) AS income_count, CAST(sum(spending_count) AS BIGINT) AS spending_count, count(*) AS month_count
    FROM cash, (VALUES ('all_data'), ('shown_data')) v(scope) WHERE scope = 'all_data' OR shown GROUP BY scope""")))
def financial_summary(spark, sf_dir):
    return projections.financial_summary(cash_flow(spark, sf_dir, whole))


@query()
def financial_payload(spark, sf_dir):
    return projections.financial_json(cash_flow(spark, sf_dir, whole))


@query(as_net(sql("plain", then="""SELECT month, category, spending_minor, CASE WHEN total > 0 AND spending_minor > 0 THEN floor(CAST(spending_minor AS DOUBLE) / CAST(total AS DOUBLE) * 1000 + 0.5) / 10 ELSE 0 END AS share_percent
    FROM (SELECT month, category, CAST(sum(amount) * 100 AS BIGINT) AS spending_minor, CAST(sum(sum(amount)) OVER (PARTITION BY month) * 100 AS BIGINT) AS total FROM plain GROUP BY month, category)""")))
def category_shares(spark, sf_dir):
    return _shares(_plain_stats(spark, sf_dir, whole))


def _shares(stats: DataFrame) -> DataFrame:
    rows = stats.where("grain = 'category'")
    total = rows.groupBy("month").agg(F.sum("spending_minor").alias("total"))
    return rows.join(total, "month").select("month", "category", "spending_minor", share_percent(F.col("spending_minor"), F.col("total")).alias("share_percent"))
