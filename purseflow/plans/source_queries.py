"""Queries that write evidence as files into the shared folder, read it back, and go on from there;
and queries of the smaller operators over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purseflow.functions.money import minor_units
from purseflow.operators import changes, checks, identity, matching, projections, refunds, review, schedule, views
from purseflow.operators.ranking import positions
from purseflow.plans import adapters as A
from purseflow.plans.adapters import as_net, sql
from purseflow.plans.check_queries import net_ledger, net_sql
from purseflow.plans.ledger_queries import cash_flow, cash_sql, netted, whole
from purseflow.plans.view_queries import _RULES, _execution, _rules
from purseflow.sources import files, statements
from purseflow.storage import materialize, new_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def _lines(rows: DataFrame, name: str) -> str:
    """Rows as a folder of JSON lines, in their order."""
    path = new_path(rows.sparkSession, name)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)
    return path


def _orders(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _manual(spark, sf_dir) -> DataFrame:
    """Manual evidence, newest order first; every 50th line has a field too many."""
    key = F.col("o_orderkey")
    rows = _orders(spark, sf_dir).where(key % 3 == 0).repartitionByRange(4, F.desc("o_orderkey")).sortWithinPartitions(F.desc("o_orderkey"))
    return rows.select(
        key.cast("string").alias("id"), F.when(F.col("o_orderpriority") == "1-URGENT", "income").otherwise("expense").alias("type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.floor("o_totalprice").cast("string").alias("amount"), F.lit("CNY").alias("currency"), F.concat(F.lit("desc-"), "o_custkey").alias("description"), F.when(key % 50 == 0, "x").alias("more"),
    )


_MANUAL = "(SELECT *, row_number() OVER (ORDER BY o_orderkey DESC) AS line FROM orders WHERE o_orderkey % 3 = 0)"


@query(f"""SELECT 'src_' || substr(sha256('source-record' || chr(0) || 'manual' || chr(0) || o_orderkey || chr(0) || 'entry'), 1, 24) AS source_record_id, CAST(o_orderdate AS DATE) AS transaction_date, CAST(floor(o_totalprice) * 100 AS BIGINT) AS amount_minor,
    'desc-' || o_custkey AS description, line AS record_ord FROM {_MANUAL} WHERE o_orderkey % 50 <> 0""")
def manual_evidence_records(spark, sf_dir):
    rows, _ = files.read_jsonl(spark, _lines(_manual(spark, sf_dir), "manual"), "manual_evidence")
    return files.manual_records(rows).select("source_record_id", "transaction_date", minor_units("amount").alias("amount_minor"), "description", "record_ord")


@query(f"SELECT 'V21' AS check_id, count(*) AS n, 'unknown more; missing ' AS detail FROM {_MANUAL} WHERE o_orderkey % 50 = 0")
def manual_evidence_violations(spark, sf_dir):
    _, bad = files.read_jsonl(spark, _lines(_manual(spark, sf_dir), "manual"), "manual_evidence")
    return bad.groupBy("check_id", "detail").agg(F.count("*").alias("n"))


@query(sql("records", then="""SELECT 'txn_' || substr(sha256('transaction' || chr(0) || source_record_id), 1, 24) AS transaction_id, source_record_id, 'authoritative' AS role, lpad(CAST(row_number() OVER (ORDER BY source_record_id) AS VARCHAR), 19, '0') AS link_ord FROM records"""))
def source_link_rows(spark, sf_dir):
    links = identity.own_links(A.records(spark, sf_dir)).select("transaction_id", "source_record_id", "role")
    path = _lines(links.repartitionByRange(4, "source_record_id").sortWithinPartitions("source_record_id"), "links")
    return files.read_jsonl(spark, path, "source_links")[0]


@query(sql("decisions", then="SELECT transaction_id, merchant_override, category_override, note FROM decisions"))
def decision_file_rows(spark, sf_dir):
    d = A.decisions(spark, sf_dir).select("transaction_id", "merchant_override", "category_override", "note")
    return files.read_jsonl(spark, _lines(d, "decisions"), "decisions")[0]


@query(f"WITH {_RULES} SELECT id, enabled, 7700 AS amount_minor, first AS first_occurrence_date FROM rules")
def schedule_file_rows(spark, sf_dir):
    r = _rules(spark, sf_dir).withColumn("amount", F.col("amount").cast("string"))
    rows, _ = files.read_jsonl(spark, _lines(r, "rules"), "schedule_rules")
    return files.typed_rules(rows).select("id", "enabled", minor_units("amount").cast("int").alias("amount_minor"), "first_occurrence_date")


@query("SELECT 'event-' || event_id AS id, CASE WHEN event_type IN ('purchase', 'error') THEN 'resolved' ELSE 'open' END AS status, 'user-' || user_id AS page FROM events")
def feedback_file_rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    context = F.struct(F.lit("weapp").alias("runtime"), F.concat(F.lit("user-"), "user_id").alias("page"), F.lit("w").alias("workspace"))
    rows = e.select(F.concat(F.lit("event-"), "event_id").alias("id"), F.lit("2024-05-06T07:08:09Z").alias("created_at"), F.when(F.col("event_type").isin("purchase", "error"), "resolved").otherwise("open").alias("status"), F.lit("text").alias("content"), context.alias("context"))
    return files.read_jsonl(spark, _lines(rows, "feedback"), "feedback")[0].select("id", "status", "context.page")


def _bank_csv(spark, sf_dir):
    """Bank rows as CSV; every 40th has no id, every 60th no date."""
    b = A.bank_rows(spark, sf_dir).withColumn("no", F.substring("transaction_id", 2, 12).cast("long"))
    rows = b.select(F.when(F.col("no") % 40 != 0, F.col("transaction_id")).alias("transaction_id"), F.when(F.col("no") % 60 != 0, F.col("transaction_date").cast("string")).alias("transaction_date"), F.col("amount").cast("string").alias("amount"), "description", F.lit("mail").alias("source_email"), F.lit(1).alias("source_index"))
    path = new_path(spark, "bank")
    rows.write.option("header", True).csv(path)
    return files.read_bank_csv(spark, path)


_NO = "CAST(transaction_id[2:] AS BIGINT)"


@query(sql("bank_rows", then=f"SELECT transaction_id, transaction_date, CAST(amount * 100 AS BIGINT) AS amount_minor, description FROM bank_rows WHERE {_NO} % 40 <> 0 AND {_NO} % 60 <> 0"))
def bank_csv_rows(spark, sf_dir):
    return _bank_csv(spark, sf_dir)[0].select("transaction_id", "transaction_date", minor_units("amount").alias("amount_minor"), "description")


@query(sql("bank_rows", then=f"SELECT CASE WHEN {_NO} % 40 = 0 THEN NULL ELSE transaction_id END AS key, 'unreadable row' AS detail FROM bank_rows WHERE {_NO} % 40 = 0 OR {_NO} % 60 = 0"))
def bank_csv_violations(spark, sf_dir):
    return _bank_csv(spark, sf_dir)[1].where("detail = 'unreadable row'").select("key", "detail")


@query(sql("app_rows", then="SELECT row_image, merchant_text, CAST(amount * 100 AS BIGINT) AS amount_minor, CAST(occurred_on AS VARCHAR) AS occurred_on FROM app_rows"))
def app_file_rows(spark, sf_dir):
    a = A.app_rows(spark, sf_dir).select("row_image", "merchant_text", F.lit(0.95).alias("merchant_score"), F.col("amount").cast("string").alias("amount"), F.col("occurred_on").cast("string").alias("occurred_on"))
    rows = files.read_jsonl(spark, _lines(a, "app_rows"), "app_rows")[0]
    return rows.select("row_image", "merchant_text", minor_units(F.col("amount").cast(A.MONEY)).alias("amount_minor"), "occurred_on")


@query(sql("records", then="SELECT source_type, count(*) AS records, CAST(sum(amount) * 100 AS BIGINT) AS amount_minor FROM records GROUP BY 1"))
def registered_records(spark, sf_dir):
    """The union of two registered sources."""
    r = A.records(spark, sf_dir)
    every, _ = files.registry({t: r.where(F.col("source_type") == t) for t in ("bank", "manual")})
    return every.groupBy("source_type").agg(F.count("*").alias("records"), minor_units(F.sum("amount")).alias("amount_minor"))


@query(sql("records", then="""SELECT 'V22' AS check_id, source_record_id AS key FROM records WHERE source_type = 'manual' AND record_ord % 5 = 0 UNION ALL SELECT 'V9', source_record_id FROM records WHERE source_type = 'manual' AND record_ord % 5 = 0"""))
def registry_violations(spark, sf_dir):
    """Manual records that a bank source hands on, too."""
    r = A.records(spark, sf_dir)
    foreign = r.where("source_type = 'bank' or record_ord % 5 = 0")
    return files.registry({"bank": foreign, "manual": r.where("source_type = 'manual'")})[1].select("check_id", "key")


@query("SELECT sha256(p_name) AS digest FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_name HAVING p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 3 = 0)")
def new_evidence_rows(spark, sf_dir):
    """A batch added to a store that has a third of it: what is new, each once."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.sha2("p_name", 256).alias("digest"))
    return files.new_evidence(p.where("p_partkey % 3 <> 0").select("digest"), p.where("p_partkey % 3 = 0")).select("digest")


@query(sql("merchant_map", then="SELECT merchant, category FROM merchant_map WHERE CAST(merchant[3:] AS BIGINT) % 2 = 0"))
def latest_version_rows(spark, sf_dir):
    """Two versions of a table are written; the later is read."""
    m, folder = A.merchant_map(spark, sf_dir), new_path(spark, "versions")
    files.write_version(m, folder, 1)
    files.write_version(m.where(F.substring("merchant", 3, 20).cast("long") % 2 == 0), folder, 2)
    return files.latest_version(spark, folder)


@query(sql("description_map", "merchant_map", then="SELECT merchant, string_agg(description, '; ' ORDER BY description) AS descriptions FROM description_map GROUP BY 1"))
def report_csv_rows(spark, sf_dir):
    """A report is written as CSV, its arrays as joined text, and read back."""
    by_merchant, _ = review.invert_mappings(A.description_map(spark, sf_dir), A.merchant_map(spark, sf_dir))
    path = new_path(spark, "report")
    files.write_report(by_merchant, path)
    return spark.read.option("header", True).csv(path)


@query(sql("description_map", "merchant_map", then="SELECT description, merchant, category FROM description_map JOIN merchant_map USING (merchant)"))
def mapping_file_rows(spark, sf_dir):
    """The nested lists by merchant and by category, read as flat maps."""
    d, m, _ = files.read_mappings(*review.invert_mappings(A.description_map(spark, sf_dir), A.merchant_map(spark, sf_dir)))
    return d.join(m, "merchant").select("description", "merchant", "category")


@query(sql("transactions", then="""SELECT '{"transaction_id":"' || transaction_id || '","amount":"' || CAST(CAST(amount AS BIGINT) AS VARCHAR) || '","note":null}' AS json FROM transactions"""))
def row_json_rows(spark, sf_dir):
    rows = A.transactions(spark, sf_dir).select("transaction_id", "amount", F.lit(None).cast("string").alias("note"))
    return views.row_json(rows)


# --- statement mails


def _mails(spark, sf_dir) -> DataFrame:
    """(digest, content): four mails for the bank's orders of each month, sent on the 10th of the next. Each has a table before its
    rows and a repayment after them; every fourth has a row without a date."""
    o = _orders(spark, sf_dir).where("o_orderkey % 3 <> 0").withColumn("day", F.to_date("o_orderdate"))
    td = lambda *cells: F.concat(F.lit('<table width="643" height="18"><tr>'), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr></table>"))
    none = F.lit("")
    row = td(none, F.date_format("day", "MMdd"), F.date_format(F.date_add("day", 1), "MMdd"), F.concat(F.lit("shop &amp; "), "o_custkey"), F.concat(F.lit("¥&nbsp;"), F.format_number(F.floor("o_totalprice"), 2)), none, none, none)
    mails = o.groupBy(F.trunc("day", "month").alias("month"), (F.col("o_orderkey") % 4).alias("no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    sent = F.date_format(F.date_add(F.add_months("month", 1), 9), "dd MMM yyyy")
    repayment = td(none, none, F.lit("0905"), F.lit("还款"), F.lit("-100.00"), none, none, none)
    wrong = F.when(F.col("no") == 3, td(none, none, F.lit("0905"), F.lit("no day"), F.lit("1"), none, none, none)).otherwise("")
    html = F.concat(F.lit("<html><body><table><tr><td>head</td></tr></table>"), "rows", repayment, wrong, F.lit("</body></html>"))
    text = F.concat(F.lit("Date: "), sent, F.lit(" 08:00:00 +0800\r\nSubject: statement\r\nMIME-Version: 1.0\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), html)
    content = mails.select(text.cast("binary").alias("content"))
    return materialize(content.select(F.sha2("content", 256).alias("digest"), "content"), "mails")


@query("""SELECT CAST(o_orderdate AS DATE) AS transaction_date, CAST(floor(o_totalprice) * 100 AS BIGINT) AS amount_minor, 'shop & ' || o_custkey AS description, 1 + row_number() OVER (PARTITION BY date_trunc('month', o_orderdate), o_orderkey % 4 ORDER BY o_orderkey) AS record_ord
    FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 3""")
def statement_mail_records(spark, sf_dir):
    """Records of all mails that can be read as a whole; a row's number counts all tables before it."""
    records, _, _ = statements.parse_statements(_mails(spark, sf_dir))
    return records.select("transaction_date", minor_units("amount").alias("amount_minor"), "description", "record_ord")


@query("""SELECT DISTINCT date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + INTERVAL 9 DAY AS statement_date, o_orderkey % 4 AS no FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 3""".replace("SELECT DISTINCT", "SELECT CAST(statement_date AS DATE) AS statement_date, count(*) AS mails, count(*) AS repayments FROM (SELECT DISTINCT") + ") GROUP BY 1")
def statement_mail_dates(spark, sf_dir):
    """Days of statements, with their mails and the repayments skipped in them."""
    _, dates, _ = statements.parse_statements(_mails(spark, sf_dir))
    return dates.groupBy("statement_date").agg(F.count("*").alias("mails"), F.sum("skipped_repayments").alias("repayments"))


@query("SELECT 'row without date' AS reason, count(*) AS mails FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 = 3)")
def statement_mail_rejects(spark, sf_dir):
    """Mails with a row that is neither a charge nor a repayment are rejected whole, with the reason."""
    return statements.parse_statements(_mails(spark, sf_dir))[2].groupBy("reason").agg(F.count("*").alias("mails"))


# --- smaller operators


def _some(spark, sf_dir):
    r = A.records(spark, sf_dir)
    return r, identity.own_links(r)


@query("SELECT d % 2 = 1 AS changed FROM (VALUES (0), (1)) v(d)")
def decisions_changed(spark, sf_dir):
    """The decisions against themselves in another order, and against a table with one note more."""
    d = A.decisions(spark, sf_dir)
    return changes.decisions_changed(d, d.repartition(3, "transaction_id")).union(changes.decisions_changed(d, d.union(d.where("note is not null").limit(1))))


@query(sql("transactions", then="SELECT description, min(txn_ord) AS txn_ord FROM transactions GROUP BY 1"))
def merged_descriptions(spark, sf_dir):
    """Descriptions as they first appear, each once."""
    return changes.merged_in_order(A.transactions(spark, sf_dir).select("description", "txn_ord"), "description", "txn_ord")


@query(sql("description_map", "merchant_map", then="""SELECT description, CASE WHEN CAST(description[6:] AS BIGINT) % 3 = 0 THEN 'M-new' ELSE merchant END AS merchant FROM description_map
    UNION ALL SELECT 'desc-' || c_custkey, 'M-new' FROM customer WHERE c_custkey % 5 = 4 AND c_custkey % 3 = 0"""))
def apply_mapping(spark, sf_dir):
    """Every third description moves to a new merchant; the maps' token is that of the preview."""
    d, m = A.description_map(spark, sf_dir), A.merchant_map(spark, sf_dir)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 = 0").select(F.concat(F.lit("desc-"), "c_custkey").alias("description"), F.lit("M-new").alias("merchant"), F.lit("居家").alias("category"))
    return review.apply_mapping(d, m, c, review.state_token(d, m), review.state_token(d.repartition(2), m))[0]


@query(f"""WITH {_RULES} SELECT id, CASE WHEN c_custkey % 3 = 1 THEN 'paused' ELSE 'as it was' END AS what FROM rules WHERE c_custkey % 3 <> 2 UNION ALL SELECT 'fresh-' || c_custkey, 'new' FROM rules WHERE c_custkey % 10 = 0""")
def apply_rule_changes(spark, sf_dir):
    """A third of the rules is deleted, a third gets another description, some are new; creating a known rule is rejected."""
    r = _rules(spark, sf_dir)
    no = F.substring("id", 6, 20).cast("long")
    deleted, changed = r.where(no % 3 == 2).withColumn("op", F.lit("delete")), r.where(no % 3 == 1).withColumn("op", F.lit("update")).withColumn("description", F.lit("paused"))
    new = r.where(no % 10 == 0).withColumn("id", F.concat(F.lit("fresh-"), no.cast("string"))).withColumn("op", F.lit("create")).withColumn("description", F.lit("new"))
    known = r.where(no % 30 == 0).withColumn("op", F.lit("create")).withColumn("description", F.lit("never"))
    after, _, _ = schedule.apply_rule_changes(r, _execution(spark, sf_dir), deleted.union(changed).union(new).union(known))
    what = F.when(F.col("description").isin("paused", "new", "never"), F.col("description")).otherwise("as it was")
    return after.select("id", what.alias("what"))


@query(f"""WITH {_RULES} SELECT id, row_number() OVER (ORDER BY CAST(CASE WHEN cursor IS NULL THEN first ELSE first + INTERVAL 3 MONTH END AS DATE), c_name, id) AS place FROM rules JOIN customer USING (c_custkey) LEFT JOIN execution ON id = rule_id""")
def rules_in_view_order(spark, sf_dir):
    """All rules with their place in the order in which they are shown."""
    view = schedule.in_view_order(schedule.schedule_view(_rules(spark, sf_dir), _execution(spark, sf_dir)))
    return positions(view, "next_occurrence_date", "description", "id", name="place").select("id", "place")


_SHOWN = "CAST(month || '-10' AS DATE) IN (SELECT statement_date FROM statement_dates) AND CAST(CAST(month || '-10' AS DATE) + INTERVAL 1 MONTH AS DATE) IN (SELECT statement_date FROM statement_dates)"


@query(sql("statement_dates", "net_refunds", "net", then=f"""SELECT (SELECT count(*) FROM transactions WHERE transaction_type = 'expense' AND amount = 0) AS zero_amount_transactions, (SELECT count(*) FROM net_refunds) AS refund_transactions,
    (SELECT count(*) FROM net_refunds WHERE rule = 'merchant') AS same_merchant_refund_matches, (SELECT CAST(coalesce(sum(matched), 0) * 100 AS BIGINT) FROM net_refunds WHERE rule = 'merchant') AS same_merchant_matched_minor,
    (SELECT count(*) FROM net_balances WHERE remaining = 0) AS fully_refunded_transactions, (SELECT count(*) FROM net_balances WHERE remaining > 0 AND remaining < amount) AS partially_refunded_transactions,
    (SELECT count(*) FROM net_refunds WHERE matched < amount) AS unmatched_refund_count, (SELECT CAST(coalesce(sum(amount - matched), 0) * 100 AS BIGINT) FROM net_refunds) AS unmatched_refund_minor,
    (SELECT count(*) FROM net WHERE category_source = 'unclassified') AS unclassified_net_transactions, (SELECT count(DISTINCT month) FROM net WHERE {_SHOWN}) AS shown_months"""))
def spending_summary_counters(spark, sf_dir):
    """All ten counters of the spending summary, net of refunds."""
    t, e, o = netted(spark, sf_dir)
    facts = projections.spending_facts(refunds.net_consumption(o), t, e)
    coverage = projections.month_coverage(facts.select("month"), A.statement_dates(spark, sf_dir))
    found = projections.spending_summary(refunds.refund_summary(o, t), facts, coverage)
    return found.withColumns({f"{c}_minor": minor_units(f"{c}_amount") for c in ("same_merchant_matched", "unmatched_refund")}).drop("same_merchant_matched_amount", "unmatched_refund_amount")


@query(net_sql("""SELECT month, grain, rank, name, spending_minor, floor(CAST(spending_minor AS DOUBLE) / CAST(total AS DOUBLE) * 1000 + 0.5) / 10 AS share_percent FROM (
      SELECT month, 'category' AS grain, category AS name, CAST(sum(amount) * 100 AS BIGINT) AS spending_minor, CAST(row_number() OVER (ORDER BY sum(amount) DESC, category) AS INTEGER) AS rank FROM net WHERE month = '1996-03' GROUP BY 1, 3
      UNION ALL SELECT month, 'merchant', display_name, CAST(sum(amount) * 100 AS BIGINT), CAST(row_number() OVER (ORDER BY sum(amount) DESC, display_name, coalesce(merchant_name, '')) AS INTEGER) FROM net WHERE month = '1996-03' GROUP BY month, display_name, merchant_name),
    (SELECT CAST(sum(amount) * 100 AS BIGINT) AS total FROM net WHERE month = '1996-03') WHERE grain = 'category' OR rank <= 8"""))
def spending_analytics(spark, sf_dir):
    """Categories and top merchants with rank and share of the selected month, net of refunds."""
    return views.spending_analytics(net_ledger(spark, sf_dir)[2], "1996-03")


@query(net_sql("""SELECT month, grain, rank, name, spending_minor FROM (
      SELECT month, 'category' AS grain, category AS name, CAST(sum(amount) * 100 AS BIGINT) AS spending_minor, CAST(row_number() OVER (ORDER BY sum(amount) DESC, category) AS INTEGER) AS rank FROM net WHERE month = (SELECT max(month) FROM net) GROUP BY 1, 3
      UNION ALL SELECT month, 'merchant', display_name, CAST(sum(amount) * 100 AS BIGINT), CAST(row_number() OVER (ORDER BY sum(amount) DESC, display_name, coalesce(merchant_name, '')) AS INTEGER) FROM net WHERE month = (SELECT max(month) FROM net) GROUP BY month, display_name, merchant_name)
    WHERE grain = 'category' OR rank <= 8"""))
def spending_analytics_newest(spark, sf_dir):
    """The same where no month is asked for: that of the newest."""
    return views.spending_analytics(net_ledger(spark, sf_dir)[2]).drop("share_percent")


_MONTHS_SQL = f"""cover AS (SELECT month, {_SHOWN} AS shown FROM (SELECT DISTINCT month FROM net)),
    totals AS (SELECT month, CAST(sum(amount) * 100 AS BIGINT) AS total_spending_minor, count(*) AS transaction_count FROM net GROUP BY 1),
    cats AS (SELECT month, list(struct_pack(category := category, spending_minor := s, transaction_count := n) ORDER BY s DESC, category) AS categories FROM (SELECT month, category, CAST(sum(amount) * 100 AS BIGINT) AS s, count(*) AS n FROM net GROUP BY 1, 2) GROUP BY 1),
    merchants AS (SELECT month, list(struct_pack(merchant_name := merchant_name, display_name := display_name, is_unclassified := merchant_name IS NULL, spending_minor := s, transaction_count := n) ORDER BY s DESC, display_name, coalesce(merchant_name, '')) AS merchants
      FROM (SELECT month, merchant_name, display_name, CAST(sum(amount) * 100 AS BIGINT) AS s, count(*) AS n FROM net GROUP BY 1, 2, 3) GROUP BY 1)"""


@query(net_sql("").rstrip() + ",\n" + _MONTHS_SQL + """
    SELECT scope, CAST(coalesce(sum(total_spending_minor), 0) AS BIGINT) AS total_spending_minor, CAST(coalesce(sum(transaction_count), 0) AS BIGINT) AS transaction_count, count(*) AS month_count FROM totals JOIN cover USING (month), (VALUES ('all_data'), ('shown_data')) v(scope) WHERE scope = 'all_data' OR shown GROUP BY 1""")
def spending_scopes(spark, sf_dir):
    """Spending over all and over shown months."""
    stats = net_ledger(spark, sf_dir)[2]
    return projections.spending_scopes(stats, projections.month_coverage(stats.where("grain = 'month'").select("month"), A.statement_dates(spark, sf_dir)))


@query(net_sql("").rstrip() + ",\n" + _MONTHS_SQL + """
    SELECT to_json(struct_pack(schema_version := 2, summary := struct_pack(
        all_data := struct_pack(total_spending_minor := CAST(coalesce(sum(total_spending_minor), 0) AS BIGINT), transaction_count := CAST(coalesce(sum(transaction_count), 0) AS BIGINT), month_count := count(*)),
        shown_data := struct_pack(total_spending_minor := CAST(coalesce(sum(total_spending_minor) FILTER (shown), 0) AS BIGINT), transaction_count := CAST(coalesce(sum(transaction_count) FILTER (shown), 0) AS BIGINT), month_count := count(*) FILTER (shown))),
      months := list(struct_pack(month := month, is_complete := shown, "show" := shown, total_spending_minor := total_spending_minor, transaction_count := transaction_count, categories := categories, merchants := merchants) ORDER BY month))) AS json
    FROM totals JOIN cover USING (month) JOIN cats USING (month) JOIN merchants USING (month)""")
def spending_document(spark, sf_dir):
    """The whole spending payload as one document."""
    stats = net_ledger(spark, sf_dir)[2]
    return projections.spending_document(stats, projections.month_coverage(stats.where("grain = 'month'").select("month"), A.statement_dates(spark, sf_dir)))


_PARTS = [("total_income_minor", "income_minor"), ("total_spending_minor", "spending_minor"), ("net_cash_flow_minor", "income_minor - spending_minor"), ("income_transaction_count", "income_count"), ("spending_transaction_count", "spending_count")]
_SUMS = lambda test: ", ".join(f"{n} := CAST(coalesce(sum({c}){test}, 0) AS BIGINT)" for n, c in _PARTS)


@query(as_net(cash_sql(f"""SELECT to_json(struct_pack(schema_version := 1, summary := struct_pack(all_data := struct_pack({_SUMS('')}, month_count := count(*)), shown_data := struct_pack({_SUMS(' FILTER (shown)')}, month_count := count(*) FILTER (shown))),
    months := list(struct_pack(month := month, spending_data_complete := shown, "show" := shown, total_income_minor := income_minor, income_transaction_count := income_count, total_spending_minor := spending_minor, spending_transaction_count := spending_count, net_cash_flow_minor := income_minor - spending_minor) ORDER BY month))) AS json FROM cash""")))
def financial_document(spark, sf_dir):
    """The whole financial payload as one document."""
    return projections.financial_document(cash_flow(spark, sf_dir, whole))


@query(sql("decisions", then="SELECT transaction_id, note, place FROM (SELECT t.transaction_id, d.note, row_number() OVER (PARTITION BY description ORDER BY transaction_date DESC, txn_ord DESC) AS place FROM transactions t LEFT JOIN decisions d USING (transaction_id) WHERE transaction_type = 'expense' AND description = 'desc-7') WHERE place <= 3"))
def review_detail(spark, sf_dir):
    rows = review.review_detail("desc-7", A.transactions(spark, sf_dir), A.decisions(spark, sf_dir))
    from pyspark.sql import Window

    return rows.select("transaction_id", "note", F.row_number().over(Window.orderBy(F.desc("transaction_date"), F.desc("txn_ord"))).cast("long").alias("place"))


_PAIRS = "SELECT b.transaction_id, count(a.row_image) AS n FROM bank_rows b LEFT JOIN app_rows a ON abs(a.amount) = abs(b.amount) GROUP BY 1"


def _diagnostics(spark, sf_dir):
    b = A.bank_rows(spark, sf_dir)
    return matching.pair_diagnostics(b, A.app_rows(spark, sf_dir))


@query(sql("bank_rows", "app_rows", then=f"SELECT n AS candidates, count(*) AS transactions FROM ({_PAIRS}) GROUP BY 1"))
def candidate_histogram(spark, sf_dir):
    return matching.candidate_histogram(_diagnostics(spark, sf_dir))


@query(sql("bank_rows", "app_rows", then=f"SELECT count(*) AS transactions, count(*) FILTER (n > 0) AS with_pairs, count(*) FILTER (n = 1) AS with_one, count(*) FILTER (n > 1) AS with_several, CAST(sum(n) AS BIGINT) AS n FROM ({_PAIRS})"))
def pair_summary(spark, sf_dir):
    return matching.pair_summary(_diagnostics(spark, sf_dir)).select("transactions", "with_pairs", "with_one", "with_several", "n")


@query(sql("bank_rows", "app_rows", then="""SELECT transaction_id, row_image, rank FROM (SELECT b.transaction_id, a.row_image, CAST(row_number() OVER (PARTITION BY b.transaction_id ORDER BY CASE WHEN b.amount = 0 AND a.amount = 0 THEN 'both_zero' WHEN b.amount = -a.amount THEN 'opposite' ELSE 'same' END, abs(a.occurred_on - b.transaction_date), a.source_stem, a.row_index) AS INTEGER) AS rank
    FROM bank_rows b JOIN app_rows a ON abs(a.amount) = abs(b.amount)) WHERE rank <= 3"""))
def pair_examples(spark, sf_dir):
    """The three best pairs of each transaction in their order (all similarities alike)."""
    found = matching.nearest_pairs(A.bank_rows(spark, sf_dir), A.app_rows(spark, sf_dir), 3).withColumn("similarity", F.lit(0.0))
    return matching.ordered_pairs(found, 3).select("transaction_id", "row_image", "rank")


@query(sql("app_rows", then="SELECT issue, count(*) AS count FROM (SELECT unnest(CASE WHEN row_ord % 3 = 0 THEN ['no_time', 'low_score'] WHEN row_ord % 5 = 0 THEN ['low_score'] ELSE [] END) AS issue FROM app_rows) GROUP BY 1"))
def issue_frequency(spark, sf_dir):
    issues = F.when(F.col("row_ord") % 3 == 0, F.array(F.lit("no_time"), F.lit("low_score"))).when(F.col("row_ord") % 5 == 0, F.array(F.lit("low_score"))).otherwise(F.array().cast("array<string>"))
    return matching.issue_frequency(A.app_rows(spark, sf_dir).withColumn("issues", issues))


@query()
def matching_summary(spark, sf_dir):
    b, a = A.bank_rows(spark, sf_dir), A.app_rows(spark, sf_dir)
    return matching.matching_summary(matching.match_status(b, a, materialize(matching.match_descriptions(b, a), "matched")))


@query(sql("bank_rows", then="""SELECT description, CAST(5000 - sum(n) OVER (ORDER BY n DESC, f, description ROWS UNBOUNDED PRECEDING) AS BIGINT) AS available_after FROM (SELECT description, count(*) AS n, min(transaction_date) AS f FROM bank_rows GROUP BY 1)"""))
def running_use(spark, sf_dir):
    """Rows left after each description in processing order, were every transaction assigned one of 5,000."""
    b = A.bank_rows(spark, sf_dir)
    order = matching.processing_order(b)
    rows = matching.with_running_use(b.groupBy("description").agg(F.count("*").alias("assigned")), order, 5000, 100)
    return rows.select("description", F.col("available_after").cast("long").alias("available_after"))


@query(sql("app_rows", then="SELECT row_image FROM app_rows WHERE row_ord % 4 <> 1"))
def unused_app_rows(spark, sf_dir):
    a = A.app_rows(spark, sf_dir)
    used = a.where("row_ord % 4 = 1").select(F.lit("assignment").alias("kind"), "row_image")
    return matching.unused_rows(a, used).select("row_image")


@query(sql("records", then="SELECT count(*) AS violations FROM records WHERE record_ord % 137 = 0"))
def strict_check(spark, sf_dir):
    """Violations are handed on where a check is lenient."""
    r = A.records(spark, sf_dir)
    return checks.enforce(checks.unique(r.union(r.where("record_ord % 137 = 0")), "source_record_id"), strict=False).agg(F.count("*").alias("violations"))
