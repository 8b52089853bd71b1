"""Queries over reconciliation, sync and changes of manual entries, with SQL that decides record by record."""

from __future__ import annotations

from pyspark.sql import functions as F

from purseflow.operators import identity
from purseflow.operators.enrichment import resolve_enrichment
from purseflow.plans import adapters as A
from purseflow.plans import jobs
from purseflow.plans.adapters import as_net, sql
from purseflow.plans.ledger_queries import cash_sql
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


_OWN = "'txn_' || substr(sha256('transaction' || chr(0) || source_record_id), 1, 24)"
#: One step for each record without a link, in order, with the island's transactions as a list: id, the authority's record, source, day and merchant, and the transaction's own merchant.
_TXN = "STRUCT(id VARCHAR, a VARCHAR, src VARCHAR, d DATE, h VARCHAR, e VARCHAR)"
_FOLD = f"""islands AS (SELECT *, transaction_type || '|' || amount || '|' || sum(fresh) OVER (PARTITION BY transaction_type, amount ORDER BY transaction_date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM (
    SELECT *, CASE WHEN lag(transaction_date) OVER (PARTITION BY transaction_type, amount ORDER BY transaction_date) >= transaction_date - 3 THEN 0 ELSE 1 END AS fresh FROM present)),
chiefs AS (SELECT transaction_id, arg_min(source_record_id, (role <> 'authoritative', source_type, link_ord)) AS a FROM links JOIN present USING (source_record_id) GROUP BY 1),
begun AS (SELECT c, list(struct_pack(id := transaction_id, a := a, src := source_type, d := transaction_date, h := hint, e := txn_hint)) AS txns FROM chiefs JOIN islands ON a = source_record_id LEFT JOIN txn_hints USING (transaction_id) GROUP BY 1),
steps AS MATERIALIZED (SELECT c, source_record_id AS rec, source_type AS src, transaction_date AS d, hint AS h, target, act, target IN (SELECT transaction_id FROM links JOIN present USING (source_record_id)) AS used, row_number() OVER (PARTITION BY c ORDER BY source_type, record_ord) AS i FROM islands WHERE source_record_id NOT IN (SELECT source_record_id FROM links)),
fold AS (
    SELECT c, CAST(0 AS BIGINT) AS i, CAST(coalesce(txns, []) AS {_TXN}[]) AS txns, CAST(NULL AS VARCHAR) AS rec, CAST(NULL AS VARCHAR) AS txn, '' AS action, CAST(NULL AS INTEGER) AS day_distance, CAST(NULL AS BOOLEAN) AS merchant_match FROM (SELECT DISTINCT c FROM steps) LEFT JOIN begun USING (c)
    UNION ALL SELECT c, i, CASE WHEN hit IS NOT NULL AND src = 'bank' THEN CAST(list_transform(txns, lambda t: CASE WHEN t.id = hit.id THEN struct_pack(id := t.id, a := rec, src := src, d := d, h := h, e := t.e) ELSE t END) AS {_TXN}[])
        WHEN hit IS NOT NULL OR used OR len(cands) > 0 AND src = 'manual' THEN txns ELSE list_append(txns, CAST(struct_pack(id := target, a := rec, src := src, d := d, h := h, e := NULL) AS {_TXN})) END,
      rec, CASE WHEN hit IS NOT NULL THEN hit.id WHEN used OR len(cands) > 0 AND src = 'manual' THEN NULL ELSE target END, CASE WHEN hit IS NOT NULL THEN 'matched' WHEN used OR len(cands) > 0 AND src = 'manual' THEN 'conflict' ELSE act END,
      CASE WHEN hit IS NOT NULL THEN CAST(abs(date_diff('day', hit.d, d)) AS INTEGER) END, CASE WHEN hit IS NOT NULL THEN h = coalesce(hit.e, hit.h) END
    FROM (SELECT *, CASE WHEN len(cands) = 1 THEN cands[1] WHEN len(sure) = 1 THEN sure[1] END AS hit FROM (SELECT *, list_filter(cands, lambda t: coalesce(h = coalesce(t.e, t.h), FALSE)) AS sure FROM (
      SELECT f.c, f.i + 1 AS i, f.txns, s.rec, s.src, s.d, s.h, s.target, s.act, s.used, list_filter(f.txns, lambda t: abs(date_diff('day', t.d, s.d)) <= 3 AND (s.src = 'manual' OR t.src = 'manual') AND coalesce(s.h = coalesce(t.e, t.h), TRUE)) AS cands
      FROM fold f JOIN steps s ON s.c = f.c AND s.i = f.i + 1)))),
decided AS (SELECT rec AS source_record_id, txn AS transaction_id, action, action = 'reused' AS identity_match, day_distance, merchant_match FROM fold WHERE i > 0
    UNION ALL SELECT source_record_id, transaction_id, 'reused', TRUE, NULL, NULL FROM links JOIN present USING (source_record_id)),
heads AS (SELECT t.id AS transaction_id, t.a AS a FROM (SELECT unnest(txns) AS t FROM (SELECT txns FROM fold QUALIFY row_number() OVER (PARTITION BY c ORDER BY i DESC) = 1))
    UNION ALL SELECT t.id, t.a FROM (SELECT unnest(txns) AS t FROM begun WHERE c NOT IN (SELECT c FROM steps))),
linked AS (SELECT transaction_id, source_record_id, CASE WHEN a = source_record_id THEN 'authoritative' ELSE 'supporting' END AS role FROM decided JOIN heads USING (transaction_id))
"""


def _fold_sql(present: str, links: str, then: str, tables: tuple[str, ...] = ("records",), hinted: bool = False, more: str = "") -> str:
    """``present`` gives the records with hint, target and act; ``links`` their links."""
    hints = "txn_hints AS (SELECT transaction_id, merchant_name AS txn_hint FROM enrichments WHERE merchant_name IS NOT NULL)" if hinted else "txn_hints AS (SELECT '' AS transaction_id, NULL AS txn_hint WHERE FALSE)"
    body = sql(*tables, then="").rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    return f"{body},\n{more}links AS ({links}),\npresent AS ({present}),\n{hints},\n{_FOLD}{then}"


_PLAIN = f"SELECT *, NULL AS hint, {_OWN} AS target, 'created' AS act FROM records"
_PLAIN_LINKS = f"SELECT {_OWN} AS transaction_id, source_record_id, 'authoritative' AS role, record_ord AS link_ord FROM records WHERE record_ord % 11 <> 0"
_DECISIONS = "SELECT source_record_id, transaction_id, action, identity_match, day_distance, merchant_match FROM decided WHERE action <> 'conflict'"


def _reconciled(spark, sf_dir):
    """A ledger where a tenth of the records have no link yet."""
    r = A.records(spark, sf_dir)
    return identity.reconcile(r, identity.own_links(r.where("record_ord % 11 <> 0")), identity.policies(spark))


@query(_fold_sql(_PLAIN, _PLAIN_LINKS, _DECISIONS))
def reconcile_decisions(spark, sf_dir):
    """Reconciliation of a ledger where a tenth of the records have no link yet."""
    return identity.decisions_of(_reconciled(spark, sf_dir))


@query(_fold_sql(_PLAIN, _PLAIN_LINKS, "SELECT transaction_id, source_record_id, role FROM linked"))
def reconcile_links(spark, sf_dir):
    return identity.links_of(_reconciled(spark, sf_dir)).drop("link_ord")


@query(_fold_sql(_PLAIN, _PLAIN_LINKS, "SELECT source_record_id FROM decided WHERE action = 'conflict'"))
def reconcile_conflicts(spark, sf_dir):
    return identity.conflicts_of(_reconciled(spark, sf_dir)).select("source_record_id")


# --- a run over all evidence: some records are gone, some are new, some transactions have two


def _shared_links(r):
    """Every record's own link, but of records 11 to 12 the second supports the first's transaction; every eleventh has none."""
    own = identity.own_links(r)
    first = r.select((F.col("record_ord") + 1).alias("record_ord"), "source_record_id").where("record_ord % 12 = 0")
    first = first.select("record_ord", A.ids.transaction_id().alias("other"))
    rows = own.join(r.select("source_record_id", "record_ord"), "source_record_id").join(first, "record_ord", "left").where("record_ord % 11 <> 0")
    return rows.select(F.coalesce("other", "transaction_id").alias("transaction_id"), "source_record_id", F.when(F.col("other").isNotNull(), "supporting").otherwise("authoritative").alias("role"), "link_ord")


def _hinted(r, spark, sf_dir):
    return identity.merchant_hints(r, A.description_map(spark, sf_dir), resolve_enrichment(A.transactions(spark, sf_dir), A.description_map(spark, sf_dir), A.merchant_map(spark, sf_dir), A.decisions(spark, sf_dir)))


def _synced(spark, sf_dir):
    every = A.records(spark, sf_dir)
    r = every.where("record_ord % 7 <> 3")
    return identity.sync(r, _shared_links(every), identity.policies(spark), A.decisions(spark, sf_dir), *_hinted(r, spark, sf_dir))


_HINT = "CASE WHEN transaction_type = 'expense' THEN merchant END AS hint"
_PRESENT = f"SELECT records.*, {_HINT}, {_OWN} AS target, 'created' AS act FROM records LEFT JOIN description_map USING (description) WHERE record_ord % 7 <> 3"
_SHARED = f"""SELECT coalesce(other, {_OWN}) AS transaction_id, source_record_id, CASE WHEN other IS NULL THEN 'authoritative' ELSE 'supporting' END AS role, record_ord AS link_ord FROM records
    LEFT JOIN (SELECT record_ord + 1 AS record_ord, {_OWN} AS other FROM records WHERE record_ord % 12 = 11) USING (record_ord) WHERE record_ord % 11 <> 0"""
_SYNC = (("enrichments",), True)


def _sync_sql(then: str) -> str:
    return _fold_sql(_PRESENT, _SHARED, then, ("enrichments",), True)


@query(_sync_sql("SELECT transaction_id, source_record_id, role FROM linked"))
def sync_links(spark, sf_dir):
    """Links after a run over all evidence, with merchants from the maps and enrichments."""
    return identity.links_of(_synced(spark, sf_dir)[0]).drop("link_ord")


@query(_sync_sql("SELECT source_record_id, action, day_distance, merchant_match FROM decided"))
def sync_decisions(spark, sf_dir):
    result = _synced(spark, sf_dir)[0]
    return identity.decisions_of(result).select("source_record_id", "action", "day_distance", "merchant_match").union(identity.conflicts_of(result).select("source_record_id", F.lit("conflict"), F.lit(None).cast("int"), F.lit(None).cast("boolean")))


@query(_sync_sql("""SELECT (SELECT count(*) FROM present) AS records, (SELECT count(DISTINCT transaction_id) FROM linked) AS transactions,
    count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'matched') AS matched, count(*) FILTER (action = 'reused') AS reused FROM decided"""))
def sync_counts(spark, sf_dir):
    return _synced(spark, sf_dir)[2]


@query(_sync_sql("SELECT transaction_id, note FROM decisions WHERE transaction_id IN (SELECT transaction_id FROM linked)"))
def sync_kept_decisions(spark, sf_dir):
    """User decisions whose transaction still exists after the run."""
    return _synced(spark, sf_dir)[1].select("transaction_id", "note")


@query(sql("transactions", then="SELECT transaction_id FROM transactions WHERE txn_ord % 7 <> 0"))
def links_of_present_records(spark, sf_dir):
    """Links whose record is still there, as a run over all evidence keeps them."""
    r = A.records(spark, sf_dir)
    result, _, _ = identity.sync(r.where("record_ord % 7 <> 0"), identity.own_links(r), identity.policies(spark), A.decisions(spark, sf_dir))
    return identity.links_of(result).select("transaction_id")


@query(sql("decisions", then="SELECT transaction_id, note FROM decisions WHERE transaction_id IN (SELECT transaction_id FROM transactions WHERE txn_ord % 7 <> 0)"))
def decisions_kept(spark, sf_dir):
    r = A.records(spark, sf_dir)
    return identity.sync(r.where("record_ord % 7 <> 0"), identity.own_links(r), identity.policies(spark), A.decisions(spark, sf_dir))[1].select("transaction_id", "note")


# --- changes of manual entries


def _entries(spark, sf_dir):
    """The manual records as entries."""
    r = A.records(spark, sf_dir).where("source_type = 'manual'")
    return r.select(F.col("record_locator").alias("id"), F.col("transaction_type").alias("type"), F.col("transaction_date").cast("string").alias("date"), F.col("amount").cast("string").alias("amount"), "currency", "description")


def _changes(spark, sf_dir):
    """Every 15th entry is corrected twice, every 21st deleted, every 30th created though it exists, every 84th
    deleted and created again, every 45th copied under a new id, corrected, and (every 90th) deleted again."""
    e = _entries(spark, sf_dir).withColumn("k", F.col("id").cast("long"))
    change = lambda test, seq, op, **new: e.where(test).withColumns({"op": F.lit(op), "seq": F.col("k") * 10 + seq, **new}).drop("k")
    more = lambda n: (F.col("amount").cast("decimal(28,6)") + n).cast("string")
    fresh = F.concat(F.lit("new-"), "id")
    parts = [
        change("k % 15 = 0", 0, "correct", amount=more(50)), change("k % 15 = 0", 1, "correct", date=F.date_add(F.to_date("date"), 1).cast("string")), change("k % 21 = 0", 2, "delete"), change("k % 30 = 0", 3, "create"),
        change("k % 84 = 0", 4, "create", description=F.lit("again")), change("k % 45 = 0", 5, "create", id=fresh), change("k % 45 = 0", 6, "correct", id=fresh, amount=more(100)), change("k % 90 = 0", 7, "delete", id=fresh), change("k % 63 = 0", 8, "correct"),
    ]
    return A.reduce(lambda a, b: a.unionByName(b), parts)


def _changed(spark, sf_dir):
    every = A.records(spark, sf_dir)
    t, d, m = A.transactions(spark, sf_dir), A.description_map(spark, sf_dir), A.merchant_map(spark, sf_dir)
    # the entries' records have the place that entries have
    entries = _entries(spark, sf_dir)
    links = identity.own_links(jobs.manual_records(entries.withColumn("line_no", F.lit(0).cast("long"))).where("record_ord = 0 and cast(evidence_identity as long) % 11 <> 0"))
    bank = every.where("source_type = 'bank'")
    links = materialize(links.union(identity.own_links(bank)), "links")
    e = resolve_enrichment(t, d, m, A.decisions(spark, sf_dir))
    return jobs.change_manual_inputs(bank.drop("o_custkey"), entries, _changes(spark, sf_dir), links, identity.policies(spark), A.decisions(spark, sf_dir), d, e)


_ID = "'src_' || substr(sha256('source-record' || chr(0) || 'manual' || chr(0) || id || chr(0) || 'entry'), 1, 24)"
_CHANGES = f"""entries AS (SELECT record_locator AS id, record_locator AS k0, CAST(record_locator AS BIGINT) AS k, transaction_type, transaction_date, amount, currency, description FROM records WHERE source_type = 'manual'),
changes AS (SELECT k * 10 AS seq, 'correct' AS op, id, transaction_type, transaction_date, amount + 50 AS amount, description FROM entries WHERE k % 15 = 0
    UNION ALL SELECT k * 10 + 1, 'correct', id, transaction_type, transaction_date + 1, amount, description FROM entries WHERE k % 15 = 0 UNION ALL SELECT k * 10 + 2, 'delete', id, transaction_type, transaction_date, amount, description FROM entries WHERE k % 21 = 0
    UNION ALL SELECT k * 10 + 3, 'create', id, transaction_type, transaction_date, amount, description FROM entries WHERE k % 30 = 0 UNION ALL SELECT k * 10 + 4, 'create', id, transaction_type, transaction_date, amount, 'again' FROM entries WHERE k % 84 = 0
    UNION ALL SELECT k * 10 + 5, 'create', 'new-' || id, transaction_type, transaction_date, amount, description FROM entries WHERE k % 45 = 0 UNION ALL SELECT k * 10 + 6, 'correct', 'new-' || id, transaction_type, transaction_date, amount + 100, description FROM entries WHERE k % 45 = 0
    UNION ALL SELECT k * 10 + 7, 'delete', 'new-' || id, transaction_type, transaction_date, amount, description FROM entries WHERE k % 90 = 0 UNION ALL SELECT k * 10 + 8, 'correct', id, transaction_type, transaction_date, amount, description FROM entries WHERE k % 63 = 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM changes),
replay AS (SELECT id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, id NOT LIKE 'new-%' AS alive, '' AS refused FROM (SELECT DISTINCT id FROM changes)
    UNION ALL SELECT r.id, r.n + 1, c.seq, CASE WHEN why <> '' THEN r.alive ELSE c.op <> 'delete' END, why
    FROM (SELECT r.*, c.seq AS cseq, CASE WHEN c.op = 'create' AND r.alive THEN 'already exists' WHEN c.op <> 'create' AND r.alive AND waits THEN 'waits for its first sync' WHEN c.op <> 'create' AND NOT r.alive THEN 'does not exist' ELSE '' END AS why
      FROM (SELECT *, id NOT LIKE 'new-%' AND TRY_CAST(id AS BIGINT) % 11 = 0 AS waits FROM replay) r JOIN numbered c ON c.id = r.id AND c.n = r.n + 1) r JOIN changes c ON c.seq = r.cseq),
judged AS (SELECT c.*, r.refused FROM replay r JOIN changes c ON c.seq = r.seq),
final AS (SELECT id, arg_max(struct_pack(op := op, transaction_type := transaction_type, transaction_date := transaction_date, amount := amount, description := description), seq) AS f, bool_and(op = 'correct') AS corrected, bool_or(op = 'delete') AS renewed FROM judged WHERE refused = '' GROUP BY 1),
after AS (SELECT id, transaction_type, transaction_date, amount, description, FALSE AS corrected FROM entries WHERE id NOT IN (SELECT id FROM final)
    UNION ALL SELECT id, f.transaction_type, f.transaction_date, CAST(f.amount AS DECIMAL(28,6)), f.description, corrected FROM final WHERE f.op <> 'delete'),
old_links AS (SELECT {_OWN} AS transaction_id, source_record_id, record_ord AS link_ord FROM (SELECT {_ID} AS source_record_id, 0 AS record_ord FROM entries WHERE k % 11 <> 0 UNION ALL SELECT source_record_id, record_ord FROM records WHERE source_type = 'bank')),
"""
# every transaction has one record here, so a corrected entry's old transaction is gone and its id is used again
_CHANGED_LINKS = f"""SELECT transaction_id, source_record_id, 'authoritative' AS role, link_ord FROM old_links WHERE source_record_id NOT IN (SELECT {_ID} FROM final WHERE corrected OR renewed)"""
_CHANGED_PRESENT = f"""SELECT source_record_id, source_type, transaction_type, transaction_date, amount, record_ord, CASE WHEN transaction_type = 'expense' THEN merchant END AS hint, {_OWN} AS target, act FROM (
    SELECT source_record_id, source_type, transaction_type, transaction_date, amount, description, record_ord, 'created' AS act FROM records WHERE source_type = 'bank'
    UNION ALL SELECT {_ID}, 'manual', transaction_type, transaction_date, amount, description, row_number() OVER (ORDER BY id), CASE WHEN corrected AND {_ID} IN (SELECT source_record_id FROM old_links) THEN 'reused' ELSE 'created' END FROM after) LEFT JOIN description_map USING (description)"""


@query(_fold_sql(_CHANGED_PRESENT, _CHANGED_LINKS, """SELECT j.seq, j.op, CASE WHEN refused = '' THEN CASE WHEN op = 'delete' THEN o.transaction_id ELSE d.transaction_id END END AS transaction_id,
    CASE WHEN refused <> '' THEN 'refused: ' || refused WHEN op = 'delete' THEN CASE WHEN o.transaction_id IN (SELECT transaction_id FROM linked) THEN 'transaction kept' ELSE 'transaction removed' END ELSE coalesce(d.action, 'conflict') END AS outcome
    FROM (SELECT *, """ + _ID + """ AS rec FROM judged) j LEFT JOIN old_links o ON o.source_record_id = rec LEFT JOIN decided d ON d.source_record_id = rec""", ("enrichments",), True, _CHANGES))
def manual_change_outcomes(spark, sf_dir):
    """A table of creations, corrections and deletions, applied in order: what became of each."""
    return _changed(spark, sf_dir)["outcome"].drop("id")


@query(_fold_sql(_CHANGED_PRESENT, _CHANGED_LINKS, "SELECT transaction_id, source_record_id, role FROM linked", ("enrichments",), True, _CHANGES))
def manual_change_links(spark, sf_dir):
    return _changed(spark, sf_dir)["links"].drop("link_ord")


@query(sql("records", then="").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + _CHANGES.rstrip().rstrip(",") + "\nSELECT id, CAST(amount AS VARCHAR) AS amount, CAST(transaction_date AS VARCHAR) AS date, description FROM after")
def manual_change_entries(spark, sf_dir):
    """The entries after the changes."""
    return _changed(spark, sf_dir)["evidence"].select("id", F.col("amount").cast("decimal(28,6)").cast("string").alias("amount"), "date", "description")


# --- all derived tables, at once and after a change


def _ledger(spark, sf_dir, records):
    return records.drop("o_custkey"), identity.own_links(records), A.description_map(spark, sf_dir), A.merchant_map(spark, sf_dir), A.decisions(spark, sf_dir), A.statement_dates(spark, sf_dir)


_CASH = as_net(cash_sql("SELECT month, shown AS spending_data_complete, shown AS \"show\", income_minor, income_count, spending_minor, spending_count, income_minor - spending_minor AS net_minor FROM cash"))
# statement dates count only from evidence that has records, all linked
_CASH = _CASH.replace("(SELECT statement_date FROM statement_dates)", "(SELECT statement_date FROM statement_dates WHERE evidence_identity IN (SELECT evidence_identity FROM records))")


@query(_CASH)
def full_rebuild(spark, sf_dir):
    """All derived tables; the result is the monthly cash flow."""
    return jobs.full_rebuild(*_ledger(spark, sf_dir, A.records(spark, sf_dir)))["financial"]


def _rebuilt(spark, sf_dir):
    """The ledger without every 997th record is built, then those come, every 499th is corrected by a decision, and only what that touches is built anew."""
    r = A.records(spark, sf_dir)
    before = list(_ledger(spark, sf_dir, r.where("record_ord % 997 <> 0")))
    before[4] = before[4].join(A.transactions(spark, sf_dir).where("txn_ord % 499 = 0").select("transaction_id"), "transaction_id", "left_anti")
    return jobs.rebuild_touched(jobs.full_rebuild(*before), *_ledger(spark, sf_dir, r))


@query(_CASH)
def rebuild_after_change(spark, sf_dir):
    """The monthly cash flow after a rebuild of what a change touches: that of a full rebuild."""
    return _rebuilt(spark, sf_dir)["financial"]


@query(as_net(sql("plain", then="""SELECT month, merchant_name, display_name, CAST(sum(amount) * 100 AS BIGINT) AS spending_minor, count(*) AS transaction_count, CAST(row_number() OVER (PARTITION BY month ORDER BY sum(amount) DESC, display_name, coalesce(merchant_name, '')) AS INTEGER) AS rank FROM plain GROUP BY 1, 2, 3""")))
def rebuild_after_change_merchants(spark, sf_dir):
    """Merchants with their rank in each month after the same rebuild."""
    return _rebuilt(spark, sf_dir)["spending"].where("grain = 'merchant'").select("month", "merchant_name", "display_name", "spending_minor", "transaction_count", "rank")
