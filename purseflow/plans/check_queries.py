"""A query for each data-quality check, over tables with planted faults, and for the functions of columns.

The faults depend on the row's order, and the SQL plants the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purseflow.functions import dates, ids, money, text
from purseflow.operators import checks, projections
from purseflow.plans import adapters as A
from purseflow.plans.adapters import sql
from purseflow.plans.ledger_queries import enriched, whole
from purseflow.plans.view_queries import _RULES, _execution, _rules
from purseflow.sources import files
from purseflow.storage import materialize

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def _faulty(rows: DataFrame, ord_: str) -> DataFrame:
    hit = lambda n, k: F.col(ord_) % n == k
    rows = rows.withColumn("evidence_identity", F.when(hit(103, 1), F.concat(F.lit(" "), "evidence_identity")).otherwise(F.col("evidence_identity")))
    rows = rows.withColumn("record_locator", F.when(hit(107, 2), "").otherwise(F.col("record_locator"))).withColumn("transaction_type", F.when(hit(109, 3), "gift").otherwise(F.col("transaction_type")))
    rows = rows.withColumn("currency", F.when(hit(113, 4), "cny").otherwise(F.col("currency")))
    return rows.withColumn("amount", F.when(hit(127, 5), F.lit(None)).when(hit(131, 6), F.col("amount") + F.lit("0.005").cast(A.MONEY)).otherwise(F.col("amount")).cast(A.MONEY))


def _faulty_sql(table: str, ord_: str, then: str) -> str:
    return sql(table, then="").rstrip() + f""",
    faulty AS (SELECT * REPLACE (CASE WHEN {ord_} % 103 = 1 THEN ' ' || evidence_identity ELSE evidence_identity END AS evidence_identity, CASE WHEN {ord_} % 107 = 2 THEN '' ELSE record_locator END AS record_locator,
      CASE WHEN {ord_} % 109 = 3 THEN 'gift' ELSE transaction_type END AS transaction_type, CASE WHEN {ord_} % 113 = 4 THEN 'cny' ELSE currency END AS currency,
      CASE WHEN {ord_} % 127 = 5 THEN NULL WHEN {ord_} % 131 = 6 THEN amount + 0.005 ELSE amount END AS amount) FROM {table})
    """ + then


def _keys(found: DataFrame) -> DataFrame:
    return found.select("check_id", "key")


@query(_faulty_sql("records", "record_ord", "SELECT 'V1' AS check_id, source_record_id AS key FROM faulty WHERE trim(evidence_identity) <> evidence_identity OR trim(record_locator) = ''"))
def check_identity_parts(spark, sf_dir):
    return _keys(checks.identity_parts(_faulty(A.records(spark, sf_dir), "record_ord")))


_FACTS = "FROM faulty WHERE transaction_type NOT IN ('income', 'expense') OR amount IS NULL OR currency <> upper(currency)"


@query(_faulty_sql("records", "record_ord", f"SELECT 'V2' AS check_id, source_record_id AS key {_FACTS}"))
def check_record_facts(spark, sf_dir):
    return _keys(checks.record_facts(_faulty(A.records(spark, sf_dir), "record_ord")))


@query(_faulty_sql("transactions", "txn_ord", f"SELECT 'V3' AS check_id, transaction_id AS key {_FACTS}"))
def check_transaction_facts(spark, sf_dir):
    return _keys(checks.transaction_facts(_faulty(A.transactions(spark, sf_dir), "txn_ord")))


@query(sql("records", then="SELECT 'V5' AS check_id, source_record_id AS key FROM records WHERE record_ord % 13 = 0"))
def check_link_targets(spark, sf_dir):
    from purseflow.operators import identity

    r = A.records(spark, sf_dir)
    return _keys(checks.link_targets(identity.own_links(r), r.where("record_ord % 13 <> 0")))


@query(sql("description_map", "merchant_map", then="""SELECT 'V6' AS check_id, merchant AS key, 'mapped merchant without category' AS detail FROM merchant_map WHERE CAST(merchant[3:] AS BIGINT) % 7 = 0 AND CAST(merchant[3:] AS BIGINT) % 11 <> 0
    UNION ALL SELECT 'V6', merchant, 'categorised merchant without description' FROM merchant_map WHERE CAST(merchant[3:] AS BIGINT) % 7 <> 0 AND CAST(merchant[3:] AS BIGINT) % 11 = 0
    UNION ALL SELECT 'V6', merchant, 'reserved category' FROM merchant_map WHERE CAST(merchant[3:] AS BIGINT) % 7 <> 0 AND CAST(merchant[3:] AS BIGINT) % 13 = 0
    UNION ALL SELECT 'V6', description, '2 rows' FROM description_map WHERE CAST(merchant[3:] AS BIGINT) % 11 <> 0 AND CAST(description[6:] AS BIGINT) % 17 = 0"""))
def check_mapping_catalogue(spark, sf_dir):
    no = F.substring("merchant", 3, 20).cast("long")
    d = A.description_map(spark, sf_dir).where(no % 11 != 0)
    d = d.union(d.where(F.substring("description", 6, 20).cast("long") % 17 == 0))
    m = A.merchant_map(spark, sf_dir).where(no % 7 != 0).withColumn("category", F.when(no % 13 == 0, "待分类").otherwise(F.col("category")))
    return checks.mapping_catalogue(d, m)


@query(sql("decisions", then="""SELECT 'no value' AS detail, transaction_id AS key FROM decisions WHERE merchant_override IS NULL AND category_override IS NULL
    UNION ALL SELECT 'untrimmed or empty value', transaction_id FROM decisions WHERE merchant_override IS NOT NULL"""))
def check_decision_values(spark, sf_dir):
    d = A.decisions(spark, sf_dir).withColumn("note", F.lit(None).cast("string")).withColumn("merchant_override", F.concat("merchant_override", F.lit(" ")))
    return checks.decision_rows(d, A.transactions(spark, sf_dir)).select("detail", "key")


@query(sql("transactions", then="SELECT 'V8' AS check_id, transaction_id AS key FROM transactions WHERE txn_ord % 127 = 5 OR txn_ord % 131 = 6 OR txn_ord % 109 = 3 OR txn_ord % 113 = 4"))
def check_mirrored_facts(spark, sf_dir):
    from purseflow.operators import identity

    r = A.records(spark, sf_dir)
    return _keys(checks.mirrored_facts(A.transactions(spark, sf_dir), _faulty(r, "record_ord"), identity.own_links(r)))


@query(sql("records", then="SELECT 'V9' AS check_id, source_record_id AS key, '2 rows' AS detail FROM records WHERE record_ord % 137 = 0"))
def check_duplicate_ids(spark, sf_dir):
    r = A.records(spark, sf_dir)
    return checks.unique(r.union(r.where("record_ord % 137 = 0")), "source_record_id")


@query(sql("decisions", "merchant_map", then="SELECT transaction_id AS key, coalesce(category_override, merchant_override) AS detail FROM decisions WHERE coalesce(category_override, merchant_override) NOT IN (SELECT category FROM merchant_map)"))
def check_known_categories(spark, sf_dir):
    d = A.decisions(spark, sf_dir).withColumn("category_override", F.coalesce("category_override", "merchant_override"))
    return checks.known_categories(d, A.merchant_map(spark, sf_dir)).select("key", "detail")


@query(sql("decisions", then="SELECT d.transaction_id AS key FROM decisions d JOIN transactions t USING (transaction_id) WHERE t.txn_ord % 2 = 0 AND (merchant_override IS NOT NULL OR category_override IS NOT NULL)"))
def check_income_decisions(spark, sf_dir):
    t = A.transactions(spark, sf_dir).withColumn("transaction_type", F.when(F.col("txn_ord") % 2 == 0, "income").otherwise("expense"))
    return checks.income_decisions(A.decisions(spark, sf_dir), t).select("key")


@query(sql("transactions", then="SELECT transaction_id AS key, CAST(amount * 100 AS BIGINT) AS minor FROM transactions WHERE amount <= 0"))
def check_positive_income(spark, sf_dir):
    t = A.transactions(spark, sf_dir).withColumn("transaction_type", F.lit("income"))
    return checks.positive_income(t).select("key", (F.col("detail").cast(A.MONEY) * 100).cast("long").alias("minor"))


@query(sql("transactions", then="SELECT transaction_id AS key, CAST(amount * 100 AS BIGINT) AS minor FROM transactions WHERE transaction_type = 'expense' AND amount <= 0"))
def check_positive_spending(spark, sf_dir):
    net = A.transactions(spark, sf_dir).where("transaction_type = 'expense'").select("transaction_id", F.col("amount").alias("spending"))
    return checks.positive_spending(net).select("key", (F.col("detail").cast(A.MONEY) * 100).cast("long").alias("minor"))


@query(_faulty_sql("transactions", "txn_ord", "SELECT 'V14' AS check_id, transaction_id AS key FROM faulty WHERE amount * 100 <> floor(amount * 100)"))
def check_two_decimals(spark, sf_dir):
    return _keys(checks.two_decimals(_faulty(A.transactions(spark, sf_dir), "txn_ord")))


def net_ledger(spark, sf_dir):
    """The whole ledger net of refunds: (net, transactions, statistics)."""
    net, t, e = whole(spark, sf_dir)
    return net, t, materialize(projections.spending_statistics(projections.spending_facts(net, t, e)), "stats")


def net_sql(then: str) -> str:
    return sql("statement_dates", "net", then=then)


@query(net_sql("SELECT DISTINCT 'V15' AS check_id, month AS key FROM net WHERE category = '交通'"))
def check_month_sums(spark, sf_dir):
    stats = net_ledger(spark, sf_dir)[2]
    wrong = F.when((F.col("grain") == "category") & (F.col("category") == "交通"), F.col("spending_minor") + 1).otherwise(F.col("spending_minor"))
    return _keys(checks.month_sums(stats.withColumn("spending_minor", wrong)))


@query(net_sql("SELECT strftime(transaction_date, '%Y') AS year, CAST(sum(amount) * 100 AS BIGINT) + 1 AS stated_minor FROM transactions WHERE transaction_type = 'income' GROUP BY 1"))
def check_financial_totals(spark, sf_dir):
    """The summary of each year against that year's rows: stated one too much, each is found; stated right, none is."""
    net, t, stats = net_ledger(spark, sf_dir)
    spending = stats.where("grain = 'month'").select("month", "spending_minor", F.col("transaction_count").alias("spending_count"))
    coverage = projections.month_coverage(t.select(dates.month_key("transaction_date").alias("month")), A.statement_dates(spark, sf_dir))
    months = projections.financial_months(projections.income_by_month(t), spending, coverage).withColumn("year", F.substring("month", 1, 4))
    summary = projections.financial_summary(months, "year")
    dated = t.withColumn("year", F.date_format("transaction_date", "yyyy"))
    mine = net.join(dated.select("transaction_id", "year"), "transaction_id")
    wrong = summary.withColumn("income_minor", F.col("income_minor") + 1)
    bad = checks.union(checks.financial_totals(summary, dated, mine, "year"), checks.financial_totals(wrong, dated, mine, "year"))
    stated = wrong.where("scope = 'all_data'").select(F.col("year").alias("key"), F.col("income_minor").alias("stated_minor"))
    return bad.join(stated, "key").select(F.col("key").alias("year"), "stated_minor")


_M = "(SELECT DISTINCT month FROM net)"


@query(net_sql(f"""SELECT month AS key, 'month without coverage' AS detail FROM {_M} WHERE month LIKE '%-03' UNION ALL SELECT month, 'net' FROM (SELECT month FROM net UNION SELECT strftime(transaction_date, '%Y-%m') FROM transactions WHERE transaction_type = 'income') WHERE month LIKE '%-05'
    UNION ALL SELECT month, 'parts don''t make the total' FROM {_M} WHERE month LIKE '%-07' UNION ALL SELECT month, 'unclassified flag' FROM (SELECT DISTINCT month, merchant_name, display_name FROM net WHERE month LIKE '%-09')
    UNION ALL SELECT 'none', 'empty month' UNION ALL SELECT month, 'merchant twice' FROM (SELECT DISTINCT month, merchant_name, display_name FROM net WHERE month LIKE '%-11') UNION ALL SELECT month, 'parts don''t make the total' FROM {_M} WHERE month LIKE '%-11'
    UNION ALL SELECT month, 'repeats' FROM (SELECT month FROM net UNION SELECT strftime(transaction_date, '%Y-%m') FROM transactions) WHERE month LIKE '%-01' UNION ALL SELECT month, 'repeats' FROM (SELECT month FROM net UNION SELECT strftime(transaction_date, '%Y-%m') FROM transactions WHERE transaction_type = 'income') WHERE month LIKE '%-02'"""))
def check_payload(spark, sf_dir):
    """Published tables with every kind of fault: a month each without coverage, with a wrong net, wrong totals, wrong flags, merchants twice,
    coverage twice, months twice, and one without anything."""
    net, t, stats = net_ledger(spark, sf_dir)
    month = dates.month_key("transaction_date").alias("month")
    spending = stats.where("grain = 'month'").select("month", "spending_minor", F.col("transaction_count").alias("spending_count"))
    coverage = projections.month_coverage(t.select(month), A.statement_dates(spark, sf_dir))
    months = projections.financial_months(projections.income_by_month(t), spending, coverage)
    at = lambda no: F.coalesce(F.col("month").like(f"%-{no}"), F.lit(False))
    empty = spark.createDataFrame([("none", False, False, 0, 0, 0, 0, 0)], months.schema)
    months = months.withColumn("net_minor", F.when(at("05"), F.col("net_minor") + 1).otherwise(F.col("net_minor"))).union(months.where(at("02"))).union(empty)
    merchant = F.col("grain") == "merchant"
    stats = stats.withColumn("transaction_count", F.when((F.col("grain") == "month") & at("07"), F.col("transaction_count") + 1).otherwise(F.col("transaction_count")))
    stats = stats.withColumn("is_unclassified", F.when(merchant & at("09"), ~F.col("is_unclassified")).otherwise(F.col("is_unclassified"))).union(stats.where(merchant & at("11")))
    coverage = coverage.where(~at("03")).union(coverage.where(at("01")))
    return checks.verify_payload(stats, months, coverage).select("key", F.when(F.col("detail").rlike(r"^\d+ rows$"), "repeats").otherwise(F.col("detail")).alias("detail"))


@query(f"""WITH {_RULES} SELECT 'V18' AS check_id, id AS key, 'rule' AS detail FROM rules WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0
    UNION ALL SELECT 'V18', rule_id, 'metadata given in part' FROM execution WHERE rule_id[-1] = '1' UNION ALL SELECT 'V19', rule_id, 'no such rule' FROM execution WHERE CAST(rule_id[6:] AS BIGINT) % 4 = 0""")
def check_schedule_rules(spark, sf_dir):
    no = F.substring("id", 6, 20).cast("long")
    r = _rules(spark, sf_dir).withColumn("amount", F.when(no % 7 == 0, None).otherwise(F.col("amount"))).withColumn("description", F.when(no % 11 == 0, F.concat("description", F.lit(" "))).otherwise(F.col("description")))
    e = _execution(spark, sf_dir).withColumn("last_action", F.when(F.col("rule_id").like("%1"), None).otherwise(F.col("last_action")))
    rules = checks.schedule_rules(r, e).where("check_id = 'V18'")
    return rules.union(checks.schedule_rules(r.where(no % 4 != 0), e).where("check_id = 'V19'"))


@query("""SELECT 'event-' || event_id AS key FROM events WHERE event_id % 4 = 0 OR event_id % 5 = 0 OR event_id % 9 = 0""")
def check_feedback_rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    stamp = F.concat(F.lit("2024-05-06T07:08:09"), F.when(F.col("event_id") % 4 == 0, "").otherwise("+08:00"))
    runtime = F.when(F.col("event_id") % 5 == 0, "watch").otherwise("weapp")
    entity = F.when(F.col("event_id") % 9 == 0, "transaction")
    context = F.struct(runtime.alias("runtime"), F.lit("p").alias("page"), F.lit("w").alias("workspace"), entity.alias("entity_type"), F.lit(None).cast("string").alias("entity_id"))
    return checks.feedback_rows(e.select(F.concat(F.lit("event-"), "event_id").alias("id"), stamp.alias("created_at"), F.lit("open").alias("status"), F.lit("text").alias("content"), context.alias("context"))).select("key")


@query("""SELECT 'V21' AS check_id, sha256(j) AS key, 'unknown ' || CASE WHEN o_orderkey % 10 = 0 THEN 'more' ELSE '' END || '; missing ' || CASE WHEN o_orderkey % 15 = 0 THEN 'day' ELSE '' END AS detail
    FROM (SELECT o_orderkey, '{"id":"' || o_orderkey || '"' || CASE WHEN o_orderkey % 15 = 0 THEN '' ELSE ',"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '"' END || CASE WHEN o_orderkey % 10 = 0 THEN ',"more":"x"' ELSE '' END || '}' AS j FROM orders) WHERE o_orderkey % 10 = 0 OR o_orderkey % 15 = 0""")
def check_json_keys(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    rows = o.select(F.to_json(F.struct(key.cast("string").alias("id"), F.when(key % 15 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), F.when(key % 10 == 0, "x").alias("more"))).alias("value"))
    return checks.json_keys(rows, "value", ["id", "day"])


@query(sql("records", then="SELECT source_record_id AS key, source_type AS detail FROM records WHERE source_type <> 'bank'"))
def check_own_type(spark, sf_dir):
    return checks.own_type(A.records(spark, sf_dir), "bank").select("key", "detail")


@query(sql("transactions", then="""SELECT transaction_id AS key, 'transaction or enrichment is missing' AS detail FROM transactions WHERE (txn_ord % 17 = 0) <> (txn_ord % 19 = 0)
    UNION ALL SELECT transaction_id, 'net of no transaction' FROM transactions WHERE txn_ord % 19 = 0 AND amount > 0"""))
def check_matched_sides(spark, sf_dir):
    t, e = enriched(spark, sf_dir)
    net = t.where("amount > 0").select("transaction_id", F.col("amount").alias("spending"))
    some = e.join(t.where("txn_ord % 17 <> 0").select("transaction_id"), "transaction_id", "left_semi")
    return checks.matched_sides(t.where("txn_ord % 19 <> 0"), some, net).select("key", "detail")


@query(sql("records", then="SELECT description AS key FROM records GROUP BY description HAVING count(*) FILTER (record_ord % 101 = 0) > 0 AND count(*) FILTER (record_ord % 101 <> 0) > 0"))
def check_one_currency(spark, sf_dir):
    r = A.records(spark, sf_dir).withColumn("currency", F.when(F.col("record_ord") % 101 == 0, "USD").otherwise(F.col("currency")))
    return checks.one_currency(r).select("key")


# --- functions of columns


@query("SELECT p_partkey, trim(regexp_replace('  ' || p_name || ' ' || chr(9) || chr(160) || p_name || chr(10), '[\\s\\x{00A0}]+', ' ', 'g')) AS spaced FROM part")
def normal_spaces(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", text.normal_space(F.concat(F.lit("  "), "p_name", F.lit(" \t "), "p_name", F.lit("\n"))).alias("spaced"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(floor(o_totalprice) * 100 + 5 AS BIGINT) * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END END AS minor FROM orders")
def statement_amounts(spark, sf_dir):
    """Statement texts such as ``-¥ 1,234.05``; every tenth is none."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    shown = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise(""), F.lit("¥ "), F.format_number(F.floor("o_totalprice"), 0), F.lit(".05"), F.when(F.col("o_orderkey") % 10 == 0, "x").otherwise(""))
    return o.select("o_orderkey", money.minor_units(money.parse_amount(shown)).alias("minor"))


@query("""SELECT o_orderkey, CASE WHEN d <= sent THEN d END AS day FROM (SELECT o_orderkey, sent, try_cast(printf('%04d', year(sent) - CAST(month(o_orderdate) > month(sent) AS INTEGER)) || '-' || strftime(o_orderdate, '%m-%d') AS DATE) AS d
    FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 - 20 AS INTEGER) AS DATE) AS sent FROM orders))""")
def statement_days(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("day", F.to_date("o_orderdate"))
    sent = F.date_add("day", (F.col("o_orderkey") % 400 - 20).cast("int"))
    return o.select("o_orderkey", dates.complete_mmdd(F.date_format("day", "MMdd"), sent).alias("day"))


@query("""SELECT o_orderkey, near, CAST(near - sent AS INTEGER) AS delta FROM (SELECT o_orderkey, sent, arg_min(d, abs(d - sent) * 2 + CAST(d > sent AS INTEGER)) AS near FROM (
    SELECT o_orderkey, sent, try_cast(printf('%04d', year(sent) + n) || '-' || strftime(o_orderdate, '%m-%d') AS DATE) AS d FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 500 AS INTEGER) AS DATE) AS sent FROM orders), (VALUES (-1), (0), (1)) v(n)) GROUP BY 1, 2)""")
def nearest_days(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("day", F.to_date("o_orderdate"))
    sent = F.date_add("day", (F.col("o_orderkey") % 500).cast("int"))
    month, day = F.month("day"), F.dayofmonth("day")
    return o.select("o_orderkey", dates.nearest_date(month, day, sent).alias("near"), dates.nearest_day_delta(month, day, sent).alias("delta"))


@query("SELECT p_partkey, sha256(p_name) AS digest, 'sha256:' || sha256(p_name) AS identity, sha256(p_name) || '.eml' AS file FROM part")
def evidence_digests(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("content", F.col("p_name").cast("binary"))
    return p.select("p_partkey", ids.evidence_digest().alias("digest"), ids.evidence_identity().alias("identity"), ids.evidence_file().alias("file"))


@query(sql("app_rows", then="SELECT row_ord, source_stem AS sheet, row_index AS place FROM app_rows"))
def row_name_parts(spark, sf_dir):
    sheet, place = files.parse_key(F.concat("row_image", F.lit(".png")))
    return A.app_rows(spark, sf_dir).select("row_ord", sheet.alias("sheet"), place.alias("place"))


@query(sql("app_rows", then="SELECT DISTINCT merchant_text, lower(regexp_replace(merchant_text, '[^A-Za-z0-9]', '', 'g')) AS match_key FROM app_rows"))
def match_keys(spark, sf_dir):
    names = A.app_rows(spark, sf_dir).select("merchant_text").distinct()
    return names.select("merchant_text", text.match_key("merchant_text").alias("match_key"))
