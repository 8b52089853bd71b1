"""The star-schema tables as ledger tables, in Spark and in SQL.

Orders are the evidence: by priority income or expense, by status a refund at
every third merchant, by key from a bank statement or a manual entry. Customers are shops of eight to a merchant.
The SQL of each table gives the same rows in DuckDB, for comparison.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from purseflow.functions import ids
from purseflow.functions.dates import month_key
from purseflow.schemas import MONEY

CATEGORIES = ("餐饮", "交通", "综合购物", "其他支出", "居家")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "income").otherwise("expense")
    size = F.floor(F.col("o_totalprice") / 5000) * 50
    amount = F.when((kind == "expense") & (F.col("o_orderstatus") == "P") & (F.expr("o_custkey div 8") % 3 == 0), -size).otherwise(size).cast(MONEY)
    manual = F.col("o_orderkey") % 3 == 0
    rows = o.select(
        F.when(manual, "manual").otherwise("bank").alias("source_type"),
        F.when(manual, F.concat(F.lit("entry-"), F.col("o_orderkey"))).otherwise(F.concat(F.lit("statement-"), month_key("day"))).alias("evidence_identity"),
        F.col("o_orderkey").cast("string").alias("record_locator"),
        kind.alias("transaction_type"),
        F.col("day").alias("transaction_date"),
        amount.alias("amount"),
        F.lit("CNY").alias("currency"),
        F.concat(F.lit("desc-"), F.col("o_custkey")).alias("description"),
        F.col("o_orderkey").alias("record_ord"),
        "o_custkey",
    ).where("transaction_type = 'expense' or amount > 0")
    return rows.withColumn("source_record_id", ids.source_record_id())


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record is its own transaction here."""
    return records(spark, sf_dir).withColumn("transaction_id", ids.transaction_id()).withColumnRenamed("record_ord", "txn_ord")


def description_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").where("c_custkey % 5 < 4")
    return c.select(F.concat(F.lit("desc-"), F.col("c_custkey")).alias("description"), F.concat(F.lit("M-"), F.expr("c_custkey div 8")).alias("merchant"))


def merchant_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _table(spark, sf_dir, "customer").where("c_custkey % 5 < 4").select(F.expr("c_custkey div 8").alias("m")).distinct()
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("m") % 5 + 1).cast("int"))
    return m.select(F.concat(F.lit("M-"), F.col("m")).alias("merchant"), category.alias("category"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    expense = F.col("transaction_type") == "expense"
    found = t.select(
        "transaction_id",
        F.when(expense & (F.col("txn_ord") % 101 == 0), F.concat(F.lit("OV-"), F.col("o_custkey") % 40)).alias("merchant_override"),
        F.when(expense & (F.col("txn_ord") % 97 == 0), F.lit("交通")).alias("category_override"),
        F.when(F.col("txn_ord") % 89 == 0, F.concat(F.lit("note "), F.col("txn_ord"))).alias("note"),
    )
    return found.where("merchant_override is not null or category_override is not null or note is not null")


def statement_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = records(spark, sf_dir).agg(F.trunc(F.min("transaction_date"), "month").alias("a"), F.trunc(F.max("transaction_date"), "month").alias("b"))
    month = span.select(F.explode(F.sequence("a", F.add_months("b", 1), F.expr("interval 1 month"))).alias("m")).where("month(m) % 6 <> 0")
    return month.select(F.concat(F.lit("statement-"), month_key("m")).alias("evidence_identity"), F.date_add("m", 9).alias("statement_date"))


def app_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of every other customer as rows of an app, with the dates shifted a little."""
    o = _table(spark, sf_dir, "orders").where("o_custkey % 2 = 0 and o_orderkey % 7 <> 0").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    shift = F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 8).cast("int")).otherwise(0)
    size = F.floor("o_totalprice").cast(MONEY)
    return o.select(
        F.concat(F.lit("shot"), F.expr("o_orderkey div 50"), F.lit("__"), F.format_string("%02d", F.col("o_orderkey") % 50)).alias("row_image"),
        F.concat(F.lit("shot"), F.expr("o_orderkey div 50")).alias("source_stem"),
        (F.col("o_orderkey") % 50).cast("int").alias("row_index"),
        F.concat(F.when(F.col("o_orderkey") % 5 == 0, "Shop ").otherwise("shop-"), F.expr("o_custkey div 8")).alias("merchant_text"),
        F.concat(F.lit("shop"), F.expr("o_custkey div 8")).alias("merchant_key"),
        F.when(F.col("o_orderkey") % 4 == 0, size).otherwise(-size).alias("amount"),
        F.date_add("day", shift).alias("occurred_on"),
        F.col("o_orderkey").alias("row_ord"),
    )


def bank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", F.to_date("o_orderdate").alias("day"))
    size = F.floor("o_totalprice").cast(MONEY)
    return o.select(
        F.concat(F.lit("t"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("transaction_id"),
        F.col("day").alias("transaction_date"),
        F.when(F.col("o_orderstatus") == "P", -size).otherwise(size).alias("amount"),
        F.concat(F.lit("desc-"), F.col("o_custkey")).alias("description"),
    )


_SQL = {
    "records": """SELECT *, 'src_' || substr(sha256('source-record' || chr(0) || source_type || chr(0) || evidence_identity || chr(0) || record_locator), 1, 24) AS source_record_id FROM (
    SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'manual' ELSE 'bank' END AS source_type,
      CASE WHEN o_orderkey % 3 = 0 THEN 'entry-' || o_orderkey ELSE 'statement-' || strftime(o_orderdate, '%Y-%m') END AS evidence_identity,
      CAST(o_orderkey AS VARCHAR) AS record_locator,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'income' ELSE 'expense' END AS transaction_type,
      CAST(o_orderdate AS DATE) AS transaction_date,
      CAST(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderstatus = 'P' AND (o_custkey // 8) % 3 = 0 THEN -1 ELSE 1 END * floor(o_totalprice / 5000) * 50 AS DECIMAL(28,6)) AS amount,
      'CNY' AS currency, 'desc-' || o_custkey AS description, o_orderkey AS record_ord, o_custkey FROM orders)
    WHERE transaction_type = 'expense' OR amount > 0""",
    "transactions": "SELECT * RENAME (record_ord AS txn_ord), 'txn_' || substr(sha256('transaction' || chr(0) || source_record_id), 1, 24) AS transaction_id FROM records",
    "description_map": "SELECT 'desc-' || c_custkey AS description, 'M-' || (c_custkey // 8) AS merchant FROM customer WHERE c_custkey % 5 < 4",
    "merchant_map": "SELECT DISTINCT 'M-' || (c_custkey // 8) AS merchant, ['餐饮', '交通', '综合购物', '其他支出', '居家'][(c_custkey // 8) % 5 + 1] AS category FROM customer WHERE c_custkey % 5 < 4",
    "decisions": """SELECT * FROM (SELECT transaction_id,
      CASE WHEN transaction_type = 'expense' AND txn_ord % 101 = 0 THEN 'OV-' || (o_custkey % 40) END AS merchant_override,
      CASE WHEN transaction_type = 'expense' AND txn_ord % 97 = 0 THEN '交通' END AS category_override,
      CASE WHEN txn_ord % 89 = 0 THEN 'note ' || txn_ord END AS note FROM transactions)
    WHERE coalesce(merchant_override, category_override, note) IS NOT NULL""",
    "statement_dates": """SELECT 'statement-' || strftime(m, '%Y-%m') AS evidence_identity, CAST(m + INTERVAL 9 DAY AS DATE) AS statement_date
    FROM (SELECT unnest(generate_series(date_trunc('month', min(transaction_date)), date_trunc('month', max(transaction_date)) + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS m FROM records)
    WHERE month(m) % 6 <> 0""",
    "enrichments": """SELECT t.transaction_id, t.transaction_type, CASE WHEN t.transaction_type = 'expense' THEN coalesce(d.merchant_override, m.merchant) END AS merchant_name,
      CASE WHEN t.transaction_type = 'income' THEN coalesce(nullif(t.description, ''), t.source_record_id) ELSE coalesce(nullif(coalesce(d.merchant_override, m.merchant), ''), nullif(t.description, ''), t.source_record_id) END AS display_name,
      CASE WHEN t.transaction_type = 'expense' THEN c.category END AS default_category,
      CASE WHEN t.transaction_type = 'income' THEN '其他收入' ELSE coalesce(d.category_override, c.category, '待分类') END AS category,
      CASE WHEN t.transaction_type = 'income' THEN 'income_default' WHEN d.category_override IS NOT NULL THEN 'transaction_override' WHEN c.category IS NOT NULL THEN 'merchant_default' ELSE 'unclassified' END AS category_source,
      d.note AS note
    FROM transactions t LEFT JOIN decisions d USING (transaction_id) LEFT JOIN description_map m ON t.description = m.description
    LEFT JOIN merchant_map c ON coalesce(d.merchant_override, m.merchant) = c.merchant""",
    "app_rows": """SELECT 'shot' || (o_orderkey // 50) || '__' || printf('%02d', o_orderkey % 50) AS row_image, 'shot' || (o_orderkey // 50) AS source_stem, CAST(o_orderkey % 50 AS INTEGER) AS row_index,
      CASE WHEN o_orderkey % 5 = 0 THEN 'Shop ' ELSE 'shop-' END || (o_custkey // 8) AS merchant_text, 'shop' || (o_custkey // 8) AS merchant_key,
      CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE -1 END * CAST(floor(o_totalprice) AS DECIMAL(28,6)) AS amount,
      CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 8 ELSE 0 END AS INTEGER) AS occurred_on, o_orderkey AS row_ord
    FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 7 <> 0""",
    "bank_rows": """SELECT 't' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS transaction_id, CAST(o_orderdate AS DATE) AS transaction_date,
      CASE WHEN o_orderstatus = 'P' THEN -1 ELSE 1 END * CAST(floor(o_totalprice) AS DECIMAL(28,6)) AS amount, 'desc-' || o_custkey AS description FROM orders""",
    # The descriptions and merchants that no refund can reach, and their spending.
    "plain": """SELECT t.*, e.merchant_name, e.display_name, e.category, e.category_source, strftime(t.transaction_date, '%Y-%m') AS month
    FROM transactions t JOIN enrichments e USING (transaction_id)
    WHERE t.transaction_type = 'expense' AND t.amount > 0
      AND t.description NOT IN (SELECT description FROM transactions WHERE transaction_type = 'expense' AND amount < 0)
      AND coalesce(e.merchant_name, '') NOT IN (SELECT coalesce(f.merchant_name, '-') FROM transactions r JOIN enrichments f USING (transaction_id) WHERE r.transaction_type = 'expense' AND r.amount < 0)""",
}
_BALANCE = "STRUCT(id VARCHAR, k VARCHAR, m VARCHAR, d DATE, amt DECIMAL(28,6), rem DECIMAL(28,6))"
#: Netting as SQL: components of descriptions, then one step for each row of a component, with the open balances as a list.
_SQL |= {
    "net_rows": """SELECT t.transaction_id, t.description AS k, e.merchant_name AS m, t.transaction_date AS d, t.amount, t.txn_ord, CAST(floor(date_diff('day', DATE '1970-01-01', t.transaction_date) / 31) AS BIGINT) AS p
    FROM transactions t JOIN enrichments e USING (transaction_id) WHERE t.transaction_type = 'expense' AND t.amount <> 0""",
    "net_points": """SELECT DISTINCT k, m, q, refund FROM (SELECT k, m, p AS q, amount < 0 AS refund FROM net_rows WHERE m IS NOT NULL UNION ALL SELECT k, m, p - 1, TRUE FROM net_rows WHERE m IS NOT NULL AND amount < 0)""",
    "net_near": """SELECT DISTINCT a.k AS x, b.k AS y FROM net_points a JOIN net_points b USING (m, q) JOIN (SELECT m, q FROM net_points GROUP BY m, q HAVING bool_or(refund) AND bool_or(NOT refund)) USING (m, q)""",
    "net_reach": """SELECT x, y FROM net_near UNION SELECT net_reach.x, net_near.y FROM net_reach JOIN net_near ON net_reach.y = net_near.x""",
    "net_steps": """SELECT coalesce(c, k) AS c, k, m, d, amount, transaction_id, row_number() OVER (PARTITION BY coalesce(c, k) ORDER BY d, txn_ord) AS i
    FROM net_rows LEFT JOIN (SELECT x AS k, min(y) AS c FROM net_reach GROUP BY x) USING (k)""",
    "net_fold": f"""SELECT c, CAST(0 AS BIGINT) AS i, CAST([] AS {_BALANCE}[]) AS bal, CAST(NULL AS VARCHAR) AS refund_id, CAST(0 AS DECIMAL(28,6)) AS asked, CAST(0 AS DECIMAL(28,6)) AS matched, '' AS rule FROM net_steps WHERE amount < 0 GROUP BY c
    UNION ALL SELECT c, i, CASE WHEN amount > 0 THEN list_append(bal, CAST(struct_pack(id := transaction_id, k := k, m := m, d := d, amt := amount, rem := amount) AS {_BALANCE}))
        ELSE CAST(list_transform(bal, lambda b, j: struct_pack(id := b.id, k := b.k, m := b.m, d := b.d, amt := b.amt, rem := CASE WHEN chosen IS NOT NULL THEN CASE WHEN j = chosen THEN 0 ELSE b.rem END WHEN b.k <> k THEN b.rem
          ELSE b.rem - least(b.rem, greatest(0, a - coalesce(list_sum(list_transform(list_filter(bal[j + 1:], lambda z: z.k = k), lambda z: z.rem)), 0))) END)) AS {_BALANCE}[]) END,
      CASE WHEN amount < 0 THEN transaction_id END, a, CAST(CASE WHEN amount > 0 THEN 0 WHEN chosen IS NOT NULL THEN a ELSE least(a, available) END AS DECIMAL(28,6)),
      CASE WHEN amount > 0 THEN '' WHEN own IS NOT NULL THEN 'exact' WHEN chosen IS NOT NULL THEN 'merchant' WHEN available > 0 THEN 'partial' ELSE 'none' END
    FROM (SELECT *, coalesce(own, CASE WHEN d - bal[other].d <= 30 THEN other END) AS chosen FROM (
      SELECT f.c, f.i + 1 AS i, f.bal, s.k, s.m, s.d, s.amount, s.transaction_id, -s.amount AS a,
        list_max(list_filter(generate_series(1, len(f.bal)), lambda j: f.bal[j].k = s.k AND f.bal[j].rem = -s.amount)) AS own,
        list_max(list_filter(generate_series(1, len(f.bal)), lambda j: f.bal[j].m = s.m AND f.bal[j].rem = -s.amount)) AS other,
        coalesce(list_sum(list_transform(list_filter(f.bal, lambda z: z.k = s.k), lambda z: z.rem)), 0) AS available
      FROM net_fold f JOIN net_steps s ON s.c = f.c AND s.i = f.i + 1))""",
    "net_refunds": "SELECT refund_id AS transaction_id, asked AS amount, matched, rule FROM net_fold WHERE refund_id IS NOT NULL",
    "net_balances": """SELECT b.id AS transaction_id, b.amt AS amount, b.rem AS remaining FROM (SELECT unnest(bal) AS b FROM net_fold QUALIFY row_number() OVER (PARTITION BY c ORDER BY i DESC) = 1)
    UNION ALL SELECT transaction_id, amount, amount FROM net_steps WHERE amount > 0 AND c NOT IN (SELECT c FROM net_fold)""",
    "net": """SELECT t.* REPLACE (n.remaining AS amount), e.merchant_name, e.display_name, e.category, e.category_source, strftime(t.transaction_date, '%Y-%m') AS month
    FROM net_balances n JOIN transactions t USING (transaction_id) JOIN enrichments e USING (transaction_id) WHERE n.remaining > 0""",
}
_NEEDS = {"transactions": ["records"], "decisions": ["transactions"], "statement_dates": ["records"], "enrichments": ["transactions", "decisions", "description_map", "merchant_map"], "plain": ["enrichments"], "net_rows": ["enrichments"]}
_NEEDS |= {"net_points": ["net_rows"], "net_near": ["net_points"], "net_reach": ["net_near"], "net_steps": ["net_rows", "net_reach"], "net_fold": ["net_steps"], "net_refunds": ["net_fold"], "net_balances": ["net_fold"], "net": ["net_balances"]}


def sql(*tables: str, then: str) -> str:
    """A statement with the named tables, and what they need, as common table expressions."""

    def needed(name: str) -> list[str]:
        return reduce(lambda a, b: a + needed(b), _NEEDS.get(name, []), []) + [name]

    names = list(dict.fromkeys(n for t in tables for n in needed(t)))
    start = "WITH RECURSIVE " if "net_reach" in names else "WITH "
    kept = lambda n: "AS MATERIALIZED" if n.startswith("net_") and n not in ("net_reach", "net_fold") else "AS"
    return start + ",\n".join(f"{n} {kept(n)} ({_SQL[n]})" for n in names) + "\n" + then


def as_net(text: str) -> str:
    """The same statement over the whole ledger, net of refunds, in place of the part that no refund can reach."""
    rest = text.split(f"plain AS ({_SQL['plain']})", 1)[1]
    return sql("statement_dates", "net", then="").rstrip() + rest.replace("plain", "net")
