"""Queries over matching, suggestions and read app rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from purseflow.functions.dates import sheet_date
from purseflow.operators import matching, ranking, suggest
from purseflow.plans import adapters as A
from purseflow.plans.adapters import sql
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


@query(sql("bank_rows", "app_rows", then="""SELECT transaction_id, row_image, CASE WHEN b.amount = 0 AND a.amount = 0 THEN 'both_zero' WHEN b.amount = -a.amount THEN 'opposite' ELSE 'same' END AS relation, CAST(a.occurred_on - b.transaction_date AS INTEGER) AS day_delta
    FROM bank_rows b JOIN app_rows a ON abs(a.amount) = abs(b.amount)"""))
def pair_candidates(spark, sf_dir):
    return matching.pairs(A.bank_rows(spark, sf_dir), A.app_rows(spark, sf_dir)).select("transaction_id", "row_image", "relation", "day_delta")


@query(sql("bank_rows", "app_rows", then="""SELECT transaction_id, count(row_image) AS n, count(*) FILTER (x = -y AND x <> 0) AS opposite, count(*) FILTER (x = y AND x <> 0) AS same, count(*) FILTER (x = 0 AND y = 0) AS both_zero, count(*) FILTER (abs(d) <= 0) AS within_0, count(*) FILTER (abs(d) <= 1) AS within_1,
    count(*) FILTER (abs(d) <= 3) AS within_3, count(*) FILTER (abs(d) <= 7) AS within_7, 0 AS unknown_date, count(DISTINCT merchant_key) AS merchants
    FROM (SELECT b.transaction_id, a.row_image, b.amount AS x, a.amount AS y, a.occurred_on - b.transaction_date AS d, a.merchant_key FROM bank_rows b LEFT JOIN app_rows a ON abs(a.amount) = abs(b.amount)) GROUP BY 1"""))
def pair_diagnostics(spark, sf_dir):
    b = A.bank_rows(spark, sf_dir)
    return matching.pair_diagnostics(b, A.app_rows(spark, sf_dir))


@query()
def pair_similarities(spark, sf_dir):
    b, a = A.bank_rows(spark, sf_dir), A.app_rows(spark, sf_dir)
    return matching.pair_similarity(matching.pairs(matching.with_description_keys(b), matching.with_keys(a))).select("transaction_id", "row_image", "similarity")


@query(sql("bank_rows", "app_rows", then="""SELECT description, merchant_key, count(*) AS seeds FROM (SELECT transaction_id, description, min(merchant_key) AS merchant_key FROM bank_rows b JOIN app_rows a ON b.amount = -a.amount AND a.occurred_on = b.transaction_date
    WHERE b.amount > 0 GROUP BY ALL HAVING count(DISTINCT merchant_key) = 1) GROUP BY ALL"""))
def seed_merchants(spark, sf_dir):
    return matching.seed_merchants(A.bank_rows(spark, sf_dir), A.app_rows(spark, sf_dir))


@query(sql("app_rows", then="SELECT merchant_key, first(merchant_text ORDER BY n DESC, f) AS display_name FROM (SELECT merchant_key, merchant_text, count(*) AS n, min(row_ord) AS f FROM app_rows GROUP BY ALL) GROUP BY 1"))
def app_display_names(spark, sf_dir):
    return matching.display_names(A.app_rows(spark, sf_dir))


def _matched(spark, sf_dir):
    b, a = A.bank_rows(spark, sf_dir), A.app_rows(spark, sf_dir)
    return b, a, materialize(matching.match_descriptions(b, a), "matched")


@query()
def match_assignments(spark, sf_dir):
    return _matched(spark, sf_dir)[2].where("kind = 'assignment'").select("description", "transaction_id", "row_image", "stage", "day_delta")


@query()
def match_groups(spark, sf_dir):
    b, a, m = _matched(spark, sf_dir)
    return matching.group_results(b, a, m, matching.match_status(b, a, m))


@query()
def matching_totals(spark, sf_dir):
    """One row of totals over all descriptions."""
    b, a, m = _matched(spark, sf_dir)
    return matching.matching_totals(matching.group_results(b, a, m, matching.match_status(b, a, m)), a)


@query(sql("bank_rows", then="SELECT description, count(*) AS transactions, row_number() OVER (ORDER BY count(*) DESC, min(transaction_date), description) AS processing_order FROM bank_rows GROUP BY 1"))
def processing_order(spark, sf_dir):
    return matching.processing_order(A.bank_rows(spark, sf_dir)).select("description", "transactions", "processing_order")


@query()
def match_review(spark, sf_dir):
    b, a, m = _matched(spark, sf_dir)
    return matching.review_table(matching.match_status(b, a, m))


_ORDERED = """lined AS (SELECT *, row_number() OVER (PARTITION BY source_stem ORDER BY row_index) AS i, occurred_on AS v, lag(occurred_on) OVER w AS b, lead(occurred_on) OVER w AS a FROM app_rows WINDOW w AS (PARTITION BY source_stem ORDER BY row_index)),
    first AS (SELECT *, coalesce(b >= a AND NOT (b >= v AND v >= a), FALSE) AS out FROM lined),
    walk AS (SELECT source_stem, row_image, i, out, FALSE AS pair, out AS flagged FROM first WHERE i = 1
      UNION ALL SELECT f.source_stem, f.row_image, f.i, f.out, f.v > f.b AND NOT w.flagged AND NOT f.out, f.out OR (f.v > f.b AND NOT w.flagged AND NOT f.out) FROM walk w JOIN first f ON f.source_stem = w.source_stem AND f.i = w.i + 1)"""


@query(sql("app_rows", then="").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + _ORDERED + "\nSELECT row_image FROM (SELECT row_image, flagged OR coalesce(lead(pair) OVER (PARTITION BY source_stem ORDER BY i), FALSE) AS f FROM walk) WHERE f")
def order_violations(spark, sf_dir):
    """Rows out of their falling order: those between falling neighbours, then rising pairs, from the first on."""
    return matching.order_violations(A.app_rows(spark, sf_dir), "occurred_on").where("order_violation").select("row_image")


@query(sql("app_rows", then="""SELECT row_image FROM (SELECT row_image, occurred_on AS v, lag(occurred_on) OVER w AS b, lead(occurred_on) OVER w AS a FROM app_rows WINDOW w AS (PARTITION BY source_stem ORDER BY row_index)) WHERE b >= a AND NOT (b >= v AND v >= a)"""))
def order_outliers(spark, sf_dir):
    """Rows that don't lie between falling neighbours."""
    return matching.order_outliers(A.app_rows(spark, sf_dir), "occurred_on").select("row_image")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN (SELECT arg_min(d, (abs(d - first), d)) FROM (SELECT unnest([TRY_CAST((year(first) + n) || strftime(o_orderdate, '-%m-%d') AS DATE) FOR n IN [-1, 0, 1]]) AS d) WHERE d IS NOT NULL) END AS occurred_on
    FROM (SELECT *, CAST(date_trunc('month', o_orderdate + CAST(o_orderkey % 400 - 200 AS INTEGER) * INTERVAL 1 DAY) AS DATE) AS first FROM orders)""")
def sheet_dates(spark, sf_dir):
    """Full dates of rows with a month and day only, in sheets whose names begin with a month up to 200 days off; every ninth has no month."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    off = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 400 - 200).cast("int"))
    stem = F.when(F.col("o_orderkey") % 9 == 0, F.lit("screen_2024-05")).when(F.col("o_orderkey") % 2 == 0, F.date_format(off, "yyyy-MM")).otherwise(F.concat(F.date_format(off, "yyyy-MM"), F.lit("_"), F.col("o_orderkey")))
    return o.select("o_orderkey", sheet_date(stem, F.month("o_orderdate"), F.dayofmonth("o_orderdate")).alias("occurred_on"))


@query(sql("app_rows", then="SELECT row_image FROM (SELECT row_image, row_number() OVER (ORDER BY row_image) - 1 AS p, count(*) OVER () AS n FROM app_rows) WHERE p IN (SELECT round_even(i * (n - 1) / 39.0, 0) FROM range(40) t(i))"))
def even_sample(spark, sf_dir):
    return ranking.evenly_spaced(A.app_rows(spark, sf_dir).select("row_image"), 40, "row_image")


@query(sql("app_rows", then="SELECT row_image FROM (SELECT row_image, max(CAST(row_ord % 17 = 0 AS INTEGER)) OVER (PARTITION BY source_stem ORDER BY row_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM app_rows) WHERE m = 1"))
def neighbour_rows(spark, sf_dir):
    a = A.app_rows(spark, sf_dir).withColumn("selected", F.col("row_ord") % 17 == 0)
    return ranking.with_neighbours(a, "selected", "source_stem", "row_index").select("row_image")


def _names(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    names = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    return p.select(F.split("p_name", " ")[0].alias("query")).union(p.select(F.expr("substr(p_name, 1, 4)"))).distinct(), names


_SUGGEST = """WITH n AS (SELECT p_name AS name, min(p_partkey) AS ord, lower(regexp_replace(trim(p_name), '\\s+', '', 'g')) AS k FROM part GROUP BY p_name),
    q AS (SELECT DISTINCT query, lower(regexp_replace(trim(query), '\\s+', '', 'g')) AS k FROM (SELECT split_part(p_name, ' ', 1) AS query FROM part UNION ALL SELECT substr(p_name, 1, 4) FROM part)),
    s AS (SELECT query, name, ord, CASE WHEN q.k = n.k THEN 0 WHEN starts_with(n.k, q.k) OR starts_with(q.k, n.k) THEN 1 WHEN contains(n.k, q.k) OR contains(q.k, n.k) THEN 2 END AS score FROM q, n)
    SELECT query, name, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score, ord) AS INTEGER) AS rank FROM s WHERE score <= {most}) WHERE rank <= 5"""


@query(_SUGGEST.format(most=1))
def prefix_suggestions(spark, sf_dir):
    return suggest.suggest_names(*_names(spark, sf_dir))


@query(_SUGGEST.format(most=2))
def contains_suggestions(spark, sf_dir):
    return suggest.suggest_names(*_names(spark, sf_dir), allow_contains=True)


def _tokens(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    whole, cents = F.floor("o_totalprice").cast("long"), F.lpad((F.floor(F.col("o_totalprice") * 100) % 100).cast("long").cast("string"), 2, "0")
    day = F.date_format("o_orderdate", "MM-dd")
    # every fifth time repeats the day's last digit, under which it begins, as some readings do
    time = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.substring(day, 5, 1), F.lit("12:30"))).otherwise(F.lit("12:30"))
    texts = F.array(F.lit("shop"), day, time, F.concat(F.lit("-"), whole.cast("string"), F.lit(".")), cents)
    t = o.select(F.col("o_orderkey").cast("string").alias("row_image"), F.posexplode(texts).alias("pos", "text"))
    return t.withColumn("score", F.lit(0.95)).withColumn("x1", F.col("pos") * 100 - F.when(F.col("pos") == 2, 20).otherwise(0)).withColumn("x2", F.col("pos") * 100 + 90)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS row_image, CAST(-(floor(o_totalprice) * 100 + floor(o_totalprice * 100) % 100) AS BIGINT) AS amount_minor FROM orders")
def token_amounts(spark, sf_dir):
    return matching.token_amounts(_tokens(spark, sf_dir)).select("row_image", (F.col("amount") * 100).cast("long").alias("amount_minor"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS row_image, strftime(o_orderdate, '%m-%d') || ' 12:30' AS occurred_at, 'minute' AS precision, o_orderkey % 5 = 0 AS corrected FROM orders")
def token_times(spark, sf_dir):
    """The tokens of each time field; a fifth of the times repeats the day's last digit."""
    return matching.token_times(_tokens(spark, sf_dir).where("pos in (1, 2)")).select("row_image", "occurred_at", "precision", "corrected")


@query("""SELECT CAST(k AS VARCHAR) AS row_image, CASE WHEN k % 17 <> 0 THEN CAST(-(floor(p) * 100 + floor(p * 100) % 100) AS BIGINT) END AS amount_minor, CASE WHEN k % 19 <> 0 THEN d || ' 12:30' END AS occurred_at,
    list_filter([CASE WHEN k % 11 = 0 THEN 'merchant_missing' END, CASE WHEN k % 7 = 0 AND k % 11 <> 0 THEN 'merchant_truncated' END, CASE WHEN k % 17 = 0 THEN 'amount_missing' END, CASE WHEN k % 19 = 0 THEN 'occurred_at_missing' END, CASE WHEN k % 13 = 0 THEN 'merchant_low_score' END], lambda x: x IS NOT NULL) AS issues
    FROM (SELECT o_orderkey AS k, o_totalprice AS p, strftime(o_orderdate, '%m-%d') AS d FROM orders)""")
def app_token_rows(spark, sf_dir):
    """App rows read from their fields' tokens, with tags of what they lack."""
    tokens, key = _tokens(spark, sf_dir), F.col("o_orderkey")
    merchant = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.cast("string").alias("row_image"), F.when(key % 11 == 0, " ").when(key % 7 == 0, "Shop…").otherwise("Shop").alias("merchant_text"), F.when(key % 13 == 0, 0.5).otherwise(0.95).alias("merchant_score"))
    number = F.col("row_image").cast("long")
    rows = matching.parse_app_tokens(merchant, tokens.where("pos > 2").where(number % 17 != 0), tokens.where("pos in (1, 2)").where(number % 19 != 0))
    return rows.select("row_image", (F.col("amount") * 100).cast("long").alias("amount_minor"), "occurred_at", "issues")
