"""Queries over views, reviews, changes and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from purseflow.functions import ids
from purseflow.functions.dates import month_key
from purseflow.functions.money import minor_units
from purseflow.operators import changes, checks, identity, review, schedule, views
from purseflow.plans import adapters as A
from purseflow.plans.adapters import as_net, sql
from purseflow.plans.ledger_queries import _plain_stats, cash_flow, cash_sql, enriched, plain, whole
from purseflow.schemas import MONEY

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def _view(spark, sf_dir):
    t, e = enriched(spark, sf_dir)
    return views.transaction_view(t.select("transaction_id", "transaction_type", "transaction_date", "amount", "txn_ord", "description"), e)


@query(as_net(sql("plain", then="""SELECT month, rank, merchant_name, spending_minor, CASE WHEN spending_minor > 0 THEN floor(CAST(spending_minor AS DOUBLE) / CAST(total AS DOUBLE) * 1000 + 0.5) / 10 ELSE 0 END AS share_percent FROM (
    SELECT month, merchant_name, CAST(sum(amount) * 100 AS BIGINT) AS spending_minor, CAST(sum(sum(amount)) OVER (PARTITION BY month) * 100 AS BIGINT) AS total,
      row_number() OVER (PARTITION BY month ORDER BY sum(amount) DESC, display_name, coalesce(merchant_name, '')) AS rank FROM plain GROUP BY month, merchant_name, display_name) WHERE rank <= 8""")))
def top_merchants(spark, sf_dir):
    return _top_merchants(_plain_stats(spark, sf_dir, whole))


def _top_merchants(stats):
    return views.top_merchants(stats).drop("display_name").withColumn("rank", F.col("rank").cast("long"))


@query(as_net(cash_sql("""SELECT month, income_minor, spending_minor, income_minor - spending_minor AS net_minor, CAST(greatest(1, max(greatest(income_minor, spending_minor)) OVER ()) AS BIGINT) AS axis_maximum
    FROM (SELECT * FROM cash WHERE shown ORDER BY month DESC LIMIT 12)""")))
def financial_trend(spark, sf_dir):
    return views.financial_trend(cash_flow(spark, sf_dir, whole))


@query(as_net(sql("statement_dates", "plain", then="""SELECT m.month, t.category, coalesce(s.spending_minor, 0) AS spending_minor, t.category_total FROM
    (SELECT DISTINCT month FROM plain WHERE CAST(month || '-10' AS DATE) IN (SELECT statement_date FROM statement_dates) AND CAST(CAST(month || '-10' AS DATE) + INTERVAL 1 MONTH AS DATE) IN (SELECT statement_date FROM statement_dates) ORDER BY month DESC LIMIT 12) m
    CROSS JOIN LATERAL (SELECT 1) one
    JOIN (SELECT category, CAST(sum(amount) * 100 AS BIGINT) AS category_total FROM plain WHERE month IN (SELECT DISTINCT month FROM plain WHERE CAST(month || '-10' AS DATE) IN (SELECT statement_date FROM statement_dates) AND CAST(CAST(month || '-10' AS DATE) + INTERVAL 1 MONTH AS DATE) IN (SELECT statement_date FROM statement_dates) ORDER BY month DESC LIMIT 12) GROUP BY category) t ON TRUE
    LEFT JOIN (SELECT month, category, CAST(sum(amount) * 100 AS BIGINT) AS spending_minor FROM plain GROUP BY ALL) s ON s.month = m.month AND s.category = t.category""")))
def category_trend_grid(spark, sf_dir):
    return _trend_grid(spark, sf_dir, whole)


def _trend_grid(spark, sf_dir, part):
    from purseflow.operators.projections import month_coverage

    stats = _plain_stats(spark, sf_dir, part)
    return views.category_trend(stats, month_coverage(stats.where("grain = 'month'").select("month"), A.statement_dates(spark, sf_dir)))


@query(sql("enrichments", then="SELECT e.transaction_id, e.display_name, e.category, t.transaction_date FROM enrichments e JOIN transactions t USING (transaction_id) WHERE strftime(t.transaction_date, '%Y-%m') = '1996-03' AND t.transaction_type = 'expense'"))
def transactions_page(spark, sf_dir):
    return views.transactions_page(_view(spark, sf_dir), "1996-03", "expense").select("transaction_id", "display_name", "category", "transaction_date")


@query(sql("transactions", then="SELECT transaction_date, count(*) AS n, string_agg(transaction_id, ',' ORDER BY txn_ord DESC) AS ids FROM transactions GROUP BY 1"))
def day_groups(spark, sf_dir):
    return views.day_groups(A.transactions(spark, sf_dir)).select("transaction_date", "n", F.array_join("transaction_ids", ",").alias("ids"))


@query(sql("transactions", then="SELECT transaction_id, transaction_date FROM transactions ORDER BY transaction_date DESC, txn_ord DESC LIMIT 5"))
def recent_transactions(spark, sf_dir):
    return views.recent_transactions(A.transactions(spark, sf_dir)).select("transaction_id", "transaction_date")


@query(as_net(cash_sql("""SELECT month, income_minor, spending_minor, (SELECT string_agg(transaction_id, ',' ORDER BY transaction_date DESC, txn_ord DESC) FROM (SELECT * FROM transactions ORDER BY transaction_date DESC, txn_ord DESC LIMIT 5)) AS recent,
    (SELECT count(DISTINCT description) FROM transactions WHERE transaction_type = 'expense' AND description NOT IN (SELECT description FROM description_map)) AS review_count
    FROM (SELECT * FROM cash WHERE shown ORDER BY month DESC LIMIT 1)""")))
def home_summary(spark, sf_dir):
    return _home(spark, sf_dir, whole)


def _home(spark, sf_dir, part):
    t = A.transactions(spark, sf_dir)
    todo = review.unmapped_expenses(t, A.description_map(spark, sf_dir)).select("description").distinct()
    home = views.home_summary(cash_flow(spark, sf_dir, part), t, todo)
    return home.select("month", "income_minor", "spending_minor", F.array_join("recent_ids", ",").alias("recent"), "review_count")


@query(sql("records", then="SELECT description, max(record_ord) AS last_ord FROM records WHERE source_type = 'manual' GROUP BY description"))
def manual_descriptions(spark, sf_dir):
    return views.manual_descriptions(A.records(spark, sf_dir))


@query(sql("records", then="SELECT 'txn_' || substr(sha256('transaction' || chr(0) || source_record_id), 1, 24) AS transaction_id, source_record_id, record_ord AS input_ord FROM records WHERE source_type = 'manual'"))
def manual_inputs(spark, sf_dir):
    r = A.records(spark, sf_dir)
    return views.manual_input_view(r, identity.own_links(r), _view(spark, sf_dir)).select("transaction_id", "source_record_id", "input_ord")


@query(sql("transactions", then="SELECT DISTINCT strftime(transaction_date, '%Y-%m') AS month FROM transactions"))
def month_options(spark, sf_dir):
    return views.month_options(A.transactions(spark, sf_dir))


@query(sql("transactions", then="SELECT strftime(transaction_date, '%Y-%m') AS month, count(*) AS n, min(txn_ord) AS first_ord, max(txn_ord) AS last_ord FROM transactions GROUP BY 1"))
def query_index_month(spark, sf_dir):
    return views.index_by(A.transactions(spark, sf_dir).withColumn("month", month_key("transaction_date")), "month")


@query(sql("enrichments", then="SELECT merchant_name, count(*) AS n, min(txn_ord) AS first_ord, max(txn_ord) AS last_ord FROM enrichments JOIN transactions USING (transaction_id) WHERE merchant_name IS NOT NULL GROUP BY 1"))
def query_index_merchant(spark, sf_dir):
    return views.index_by(_view(spark, sf_dir).where("merchant_name is not null"), "merchant_name")


_UNMAPPED = "SELECT * FROM transactions WHERE transaction_type = 'expense' AND description NOT IN (SELECT description FROM description_map)"


@query(sql("transactions", "description_map", then=f"SELECT DISTINCT description FROM ({_UNMAPPED})"))
def unmapped_descriptions(spark, sf_dir):
    return review.unmapped_expenses(A.transactions(spark, sf_dir), A.description_map(spark, sf_dir)).select("description").distinct()


@query(sql("decisions", "description_map", then=f"""SELECT description, count(*) AS transaction_count, CAST(sum(amount) * 100 AS BIGINT) AS amount_minor, max(transaction_date) AS latest_date,
    count(*) FILTER (coalesce(merchant_override, category_override) IS NOT NULL) AS exception_count, string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS source_types
    FROM ({_UNMAPPED}) LEFT JOIN decisions USING (transaction_id) GROUP BY description"""))
def review_workspace(spark, sf_dir):
    t = A.transactions(spark, sf_dir)
    w = review.review_workspace(t, t.select("transaction_id", "source_type"), A.description_map(spark, sf_dir), A.decisions(spark, sf_dir))
    return w.select("description", "transaction_count", minor_units("amount").alias("amount_minor"), "latest_date", "exception_count", F.array_join("source_types", ",").alias("source_types"))


@query(sql("description_map", "merchant_map", then="SELECT merchant, category, count(d.description) AS description_count FROM merchant_map LEFT JOIN description_map d USING (merchant) GROUP BY ALL"))
def merchant_options(spark, sf_dir):
    return review.merchant_options(A.merchant_map(spark, sf_dir), A.description_map(spark, sf_dir))


@query(sql("description_map", "merchant_map", then="SELECT merchant, string_agg(description, ',' ORDER BY description) AS descriptions FROM description_map GROUP BY merchant"))
def mapping_write_back(spark, sf_dir):
    by_merchant, _ = review.invert_mappings(A.description_map(spark, sf_dir), A.merchant_map(spark, sf_dir))
    return by_merchant.select("merchant", F.array_join("descriptions", ",").alias("descriptions"))


def _changes(spark, sf_dir):
    """One proposed change for each 50th unmapped customer: to the merchant of its neighbour."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 50 = 4")
    category = F.element_at(F.array(*map(F.lit, A.CATEGORIES)), ((F.expr("c_custkey div 8") + 1) % 5 + 1).cast("int"))
    return c.select(F.concat(F.lit("change-"), F.col("c_custkey")).alias("change_id"), F.concat(F.lit("desc-"), F.col("c_custkey")).alias("description"), F.concat(F.lit("M-"), F.expr("c_custkey div 8")).alias("merchant"), category.alias("category"), F.lit(True).alias("confirmed"))


_CHANGES = "changes AS (SELECT 'change-' || c_custkey AS change_id, 'desc-' || c_custkey AS description, 'M-' || (c_custkey // 8) AS merchant, ['餐饮', '交通', '综合购物', '其他支出', '居家'][((c_custkey // 8) + 1) % 5 + 1] AS category FROM customer WHERE c_custkey % 50 = 4)"


@query(sql("enrichments", then="").rstrip() + ",\n" + _CHANGES + """,
    reach AS (SELECT c.change_id, e.*, t.description = c.description AS matching, d.merchant_override, d.category_override, c.merchant AS new_merchant, c.category AS new_category
      FROM transactions t JOIN enrichments e USING (transaction_id) LEFT JOIN decisions d USING (transaction_id) JOIN changes c ON t.description = c.description OR e.merchant_name = c.merchant WHERE t.transaction_type = 'expense'),
    after AS (SELECT r.*, coalesce(r.merchant_override, CASE WHEN matching THEN new_merchant ELSE merchant_name END) AS m2 FROM reach r),
    final AS (SELECT a.*, CASE WHEN m2 = new_merchant THEN new_category ELSE x.category END AS d2 FROM after a LEFT JOIN merchant_map x ON a.m2 = x.merchant),
    diff AS (SELECT *, CASE WHEN category_override IS NOT NULL THEN 'transaction_override' WHEN d2 IS NOT NULL THEN 'merchant_default' ELSE 'unclassified' END AS s2, coalesce(category_override, d2, '待分类') AS c2 FROM final)
    SELECT c.change_id, count(*) FILTER (x) AS affected, count(*) FILTER (x AND matching) AS by_description, count(*) FILTER (x AND NOT matching) AS by_default_category,
      count(*) FILTER (NOT x AND coalesce(merchant_override, category_override) IS NOT NULL) AS preserved_exceptions, count(*) FILTER (category_source = 'unclassified' AND s2 <> 'unclassified') AS newly_classified
    FROM changes c LEFT JOIN (SELECT *, (m2 IS DISTINCT FROM merchant_name OR c2 <> category OR s2 <> category_source) AS x FROM diff) d ON c.change_id = d.change_id GROUP BY c.change_id""")
def preview_impact(spark, sf_dir):
    return review.preview_mapping(_changes(spark, sf_dir), A.transactions(spark, sf_dir), A.description_map(spark, sf_dir), A.merchant_map(spark, sf_dir), A.decisions(spark, sf_dir))


@query(sql("transactions", "description_map", then="").rstrip() + ",\n" + _CHANGES + """
    SELECT 'description_unused' AS check_id, change_id AS key FROM changes WHERE description NOT IN (SELECT description FROM transactions WHERE transaction_type = 'expense')
    UNION ALL SELECT 'description_mapped', change_id FROM changes WHERE description IN (SELECT description FROM description_map)""")
def merchant_move_guard(spark, sf_dir):
    found = review.change_guards(_changes(spark, sf_dir), A.transactions(spark, sf_dir), A.description_map(spark, sf_dir), A.merchant_map(spark, sf_dir))
    return found.where("check_id in ('description_unused', 'description_mapped')").select("check_id", "key")


@query(sql("decisions", then="""SELECT transaction_id, merchant_override, category_override, note FROM (SELECT transaction_id, merchant_override, CASE WHEN txn_ord % 3 = 0 THEN NULL ELSE category_override END AS category_override,
    CASE WHEN txn_ord % 2 = 0 THEN 'patched ' || txn_ord ELSE d.note END AS note FROM transactions LEFT JOIN decisions d USING (transaction_id)) WHERE coalesce(merchant_override, category_override, note) IS NOT NULL"""))
def apply_decision_patches(spark, sf_dir):
    t = A.transactions(spark, sf_dir)
    none = F.lit(None).cast("string")
    clear = t.where("txn_ord % 3 = 0").select(F.lit(1).cast("long").alias("seq"), "transaction_id", F.lit(False).alias("set_merchant_override"), none.alias("merchant_override"), F.lit(True).alias("set_category_override"), none.alias("category_override"), F.lit(False).alias("set_note"), none.alias("note"))
    write = t.where("txn_ord % 2 = 0").select(F.lit(2).cast("long").alias("seq"), "transaction_id", F.lit(False).alias("set_merchant_override"), none.alias("merchant_override"), F.lit(False).alias("set_category_override"), none.alias("category_override"), F.lit(True).alias("set_note"), F.concat(F.lit(" patched "), F.col("txn_ord"), F.lit(" ")).alias("note"))
    return changes.apply_decision_patches(A.decisions(spark, sf_dir), clear.union(write))


@query("""WITH c AS (SELECT 'user-' || user_id AS id, event_id AS seq, CASE WHEN event_type IN ('purchase', 'error') THEN 'resolved' ELSE 'open' END AS status FROM events),
    s AS (SELECT id, -1 AS seq, 'open' AS status FROM c GROUP BY id UNION ALL SELECT * FROM c), l AS (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY seq) AS before FROM s)
    SELECT id, arg_max(status, seq) AS status, count(*) FILTER (before <> status) AS changes FROM l GROUP BY id""")
def feedback_latest(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    c = e.select(F.concat(F.lit("user-"), F.col("user_id")).alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("purchase", "error"), "resolved").otherwise("open").alias("status"))
    items = c.select("id").distinct().withColumn("status", F.lit("open"))
    return changes.feedback_latest(items, c).select("id", "status", "changes")


def _rules(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    first = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("c_custkey") % 28).cast("int"))
    return c.select(F.concat(F.lit("rule-"), F.col("c_custkey")).alias("id"), (F.col("c_custkey") % 4 != 0).alias("enabled"), F.lit("expense").alias("type"), F.lit(77).cast(MONEY).alias("amount"), F.lit("CNY").alias("currency"), F.col("c_name").alias("description"), F.add_months(first, (F.col("c_custkey") % 5).cast("int")).alias("first_occurrence_date"), F.when(F.col("c_custkey") % 3 == 0, "note").alias("note"))


def _execution(spark, sf_dir):
    r = _rules(spark, sf_dir).where("substr(id, -1) in ('1', '2', '3')")
    return r.select(F.col("id").alias("rule_id"), F.add_months("first_occurrence_date", 2).alias("last_processed_occurrence_date"), F.lit("src_x").alias("last_source_record_id"), F.lit("txn_x").alias("last_transaction_id"), F.lit("created").alias("last_action"))


_RULES = """rules AS (SELECT 'rule-' || c_custkey AS id, c_custkey % 4 <> 0 AS enabled, CAST(DATE '2024-01-01' + CAST(c_custkey % 28 AS INTEGER) + to_months(CAST(c_custkey % 5 AS INTEGER)) AS DATE) AS first, c_custkey FROM customer),
    execution AS (SELECT id AS rule_id, CAST(first + INTERVAL 2 MONTH AS DATE) AS cursor FROM rules WHERE id[-1] IN ('1', '2', '3')),
    occ AS (SELECT id AS rule_id, CAST(unnest(generate_series(first, DATE '2024-12-15', INTERVAL 1 MONTH)) AS DATE) AS occurrence_date FROM rules WHERE enabled)"""


@query(f"WITH {_RULES} SELECT rule_id, occurrence_date, 'schedule_occ_' || substr(sha256('scheduled-occurrence' || chr(0) || rule_id || chr(0) || strftime(occurrence_date, '%Y-%m-%d')), 1, 24) AS occurrence_id FROM occ")
def schedule_occurrences(spark, sf_dir):
    return schedule.expand_schedule(_rules(spark, sf_dir), F.lit("2024-12-15").cast("date")).select("rule_id", "occurrence_date", "occurrence_id")


def _due(spark, sf_dir):
    occ = schedule.expand_schedule(_rules(spark, sf_dir), F.lit("2024-12-15").cast("date"))
    known = schedule.with_record_id(occ.where("day(occurrence_date) % 2 = 0"))
    links = known.select("source_record_id", ids.transaction_id().alias("transaction_id"))
    return schedule.pending(occ, _execution(spark, sf_dir), known.select(F.col("occurrence_id").alias("id")), links)


@query(f"WITH {_RULES} SELECT rule_id, occurrence_date, day(occurrence_date) % 2 = 0 AS has_evidence FROM occ LEFT JOIN execution USING (rule_id) WHERE day(occurrence_date) % 2 = 1 OR cursor IS NULL OR occurrence_date > cursor")
def schedule_pending(spark, sf_dir):
    return _due(spark, sf_dir).select("rule_id", "occurrence_date", "has_evidence")


@query(f"WITH {_RULES} SELECT 'schedule_occ_' || substr(sha256('scheduled-occurrence' || chr(0) || rule_id || chr(0) || strftime(occurrence_date, '%Y-%m-%d')), 1, 24) AS id, occurrence_date FROM occ WHERE day(occurrence_date) % 2 = 1")
def schedule_new_evidence(spark, sf_dir):
    return schedule.new_evidence(_due(spark, sf_dir)).select("id", "occurrence_date")


@query(f"""WITH {_RULES} SELECT coalesce(x.rule_id, e.rule_id) AS rule_id, greatest(coalesce(last, cursor), coalesce(cursor, last)) AS last_processed_occurrence_date, CASE WHEN last IS NULL THEN 'created' WHEN day(last) % 2 = 0 THEN 'recovered' ELSE 'reused' END AS last_action
    FROM (SELECT rule_id, max(occurrence_date) AS last FROM occ LEFT JOIN execution USING (rule_id) WHERE day(occurrence_date) % 2 = 1 OR cursor IS NULL OR occurrence_date > cursor GROUP BY 1) x FULL OUTER JOIN execution e ON x.rule_id = e.rule_id""")
def schedule_cursor(spark, sf_dir):
    after = schedule.next_execution(schedule.due_actions(_due(spark, sf_dir), None), _execution(spark, sf_dir))
    return after.select("rule_id", "last_processed_occurrence_date", "last_action")


@query(f"WITH {_RULES} SELECT id, CAST(CASE WHEN cursor IS NULL THEN first ELSE first + INTERVAL 3 MONTH END AS DATE) AS next_occurrence_date FROM rules LEFT JOIN execution ON id = rule_id")
def next_occurrence(spark, sf_dir):
    return schedule.schedule_view(_rules(spark, sf_dir), _execution(spark, sf_dir)).select("id", "next_occurrence_date")


@query(f"WITH {_RULES} SELECT count(*) FILTER (enabled) AS enabled, count(*) FILTER (NOT enabled) AS paused FROM rules")
def schedule_totals(spark, sf_dir):
    return schedule.schedule_totals(_rules(spark, sf_dir))


def _some_links(spark, sf_dir):
    """Links of the records whose order isn't divisible by 11; some without authority."""
    r = A.records(spark, sf_dir).where("record_ord % 11 <> 0")
    links = identity.own_links(r)
    txn = F.when(F.col("record_ord") % 10 == 1, F.concat(F.lit("shared-"), F.expr("record_ord div 20"))).otherwise(F.col("transaction_id"))
    return links.join(r.select("source_record_id", "record_ord"), "source_record_id").select(txn.alias("transaction_id"), "source_record_id", F.when(F.col("record_ord") % 10 == 1, "supporting").otherwise("authoritative").alias("role"), "link_ord")


_LINKS = """links AS (SELECT CASE WHEN record_ord % 10 = 1 THEN 'shared-' || (record_ord // 20) ELSE 'txn_' || substr(sha256('transaction' || chr(0) || source_record_id), 1, 24) END AS transaction_id, source_record_id, source_type,
    CASE WHEN record_ord % 10 = 1 THEN 'supporting' ELSE 'authoritative' END AS role, record_ord FROM records WHERE record_ord % 11 <> 0)"""


def _link_sql(then: str) -> str:
    return sql("records", then="").rstrip() + ",\n" + _LINKS + "\n" + then


@query(_link_sql("SELECT transaction_id AS key, count(*) FILTER (role = 'authoritative') || ' authorities' AS detail FROM links GROUP BY 1 HAVING count(*) FILTER (role = 'authoritative') <> 1"))
def link_violations(spark, sf_dir):
    return checks.link_structure(_some_links(spark, sf_dir)).select("key", "detail")


@query(_link_sql("""SELECT source_record_id, transaction_id, CASE WHEN role = 'supporting' AND row_number() OVER (PARTITION BY transaction_id ORDER BY CASE source_type WHEN 'bank' THEN 100 ELSE 200 END, record_ord) = 1 THEN 'authoritative' ELSE role END AS role FROM links"""))
def authority_promotion(spark, sf_dir):
    found = identity.recover_authority(A.records(spark, sf_dir), _some_links(spark, sf_dir), identity.policies(spark))
    return found.select("source_record_id", "transaction_id", "role")


@query(sql("records", then="SELECT source_record_id FROM records WHERE record_ord % 11 = 0"))
def pending_records(spark, sf_dir):
    return checks.pending_records(A.records(spark, sf_dir), _some_links(spark, sf_dir)).select(F.col("key").alias("source_record_id"))


@query(sql("records", then="SELECT evidence_identity FROM records GROUP BY 1 HAVING bool_and(record_ord % 11 <> 0)"))
def reconciled_evidence(spark, sf_dir):
    return checks.reconciled_evidence(A.records(spark, sf_dir), _some_links(spark, sf_dir))


@query(sql("decisions", then="SELECT transaction_id AS key FROM decisions WHERE transaction_id NOT IN (SELECT transaction_id FROM transactions WHERE txn_ord % 5 <> 0)"))
def orphan_decisions(spark, sf_dir):
    found = checks.decision_rows(A.decisions(spark, sf_dir), A.transactions(spark, sf_dir).where("txn_ord % 5 <> 0"))
    return found.where("detail = 'no such transaction'").select("key")


@query(sql("records", then="""SELECT source_record_id, transaction_type || '|' || CAST(amount AS VARCHAR) || '|' || sum(fresh) OVER (PARTITION BY transaction_type, amount ORDER BY transaction_date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (
    SELECT *, CASE WHEN lag(transaction_date) OVER (PARTITION BY transaction_type, amount ORDER BY transaction_date) >= transaction_date - 3 THEN 0 ELSE 1 END AS fresh FROM records)"""))
def reconcile_islands(spark, sf_dir):
    part = F.split("island", r"\|")
    return identity.islands(A.records(spark, sf_dir)).select("source_record_id", F.concat_ws("|", part[1], part[3], part[4]).alias("island"))


_CANDIDATES = """pairs AS (SELECT r.source_record_id, t.transaction_id, abs(r.transaction_date - t.transaction_date) AS day_distance, r.description = t.description AS merchant_match
    FROM records r JOIN transactions t ON r.transaction_type = t.transaction_type AND r.amount = t.amount AND abs(r.transaction_date - t.transaction_date) <= 3
    WHERE r.source_type = 'manual' AND t.source_type = 'bank' AND (r.description = t.description OR r.record_ord % 2 = 0))"""


def _candidates(spark, sf_dir):
    r = A.records(spark, sf_dir).where("source_type = 'manual'").withColumn("record_merchant", F.when(F.col("record_ord") % 2 == 1, F.col("description")))
    t = A.transactions(spark, sf_dir).where("source_type = 'bank'").withColumn("transaction_merchant", F.col("description"))
    return identity.reconcile_candidates(r, t)


@query(sql("transactions", then="").rstrip() + ",\n" + _CANDIDATES + "\nSELECT source_record_id, transaction_id, CAST(day_distance AS INTEGER) AS day_distance FROM pairs")
def reconcile_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).drop("merchant_match")


@query(sql("transactions", then="").rstrip() + ",\n" + _CANDIDATES + "\nSELECT source_record_id, count(*) AS candidates FROM pairs GROUP BY 1 HAVING count(*) > 1")
def ambiguous_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).groupBy("source_record_id").agg(F.count("*").alias("candidates")).where("candidates > 1")


@query(sql("records", then="""SELECT source_record_id, 'txn_' || substr(sha256('transaction' || chr(0) || source_record_id), 1, 24) AS transaction_id, 'txn_' || substr(sha256('transaction-reconsideration' || chr(0) || source_record_id || chr(0) || 'txn_old'), 1, 24) AS split_id FROM records"""))
def sha_ids(spark, sf_dir):
    return A.records(spark, sf_dir).select("source_record_id", ids.transaction_id().alias("transaction_id"), ids.split_transaction_id(F.col("source_record_id"), F.lit("txn_old")).alias("split_id"))


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS minor FROM orders")
def minor_unit_amounts(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", minor_units(F.col("o_totalprice").cast("decimal(18,2)")).alias("minor"))


@query(sql("enrichments", then="SELECT count(*) AS transactions, count(*) FILTER (t.transaction_type = 'expense') AS expenses, count(*) FILTER (t.transaction_type = 'income') AS incomes, CAST(sum(amount) * 100 AS BIGINT) AS amount_minor, count(*) FILTER (category_source = 'unclassified') AS unclassified, count(*) AS links, 0 AS pending FROM enrichments e JOIN transactions t USING (transaction_id)"))
def diagnose(spark, sf_dir):
    from purseflow.plans.jobs import diagnose as run

    t, e = enriched(spark, sf_dir)
    r = A.records(spark, sf_dir)
    return run(t, e, identity.own_links(r), r)
