"""Netting and reconciliation against plain sequential models, and the fixtures of the domain."""

import datetime
import random
from decimal import Decimal

import pytest

from purseflow.functions import ids
from purseflow.operators import changes, checks, enrichment, identity, projections, refunds, review, schedule

D = datetime.date
TXN = "transaction_id string, source_record_id string, transaction_type string, transaction_date date, amount decimal(28,6), currency string, description string, txn_ord long"
REC = "source_type string, evidence_identity string, record_locator string, transaction_type string, transaction_date date, amount decimal(28,6), currency string, description string, record_ord long"


def naive_netting(rows):
    """rows: (id, date, ord, amount, key, merchant); returns remaining by purchase and outcomes by refund."""
    bought, out = [], {}
    for txn, day, _, amount, key, merchant in sorted(rows, key=lambda r: (r[1], r[2])):
        if amount > 0:
            bought.append([txn, key, merchant, amount, day])
        elif amount < 0:
            need = -amount
            same = [b for b in reversed(bought) if b[1] == key]
            hit = next((b for b in same if b[3] == need), None)
            rule = "exact"
            if hit is None and merchant is not None:
                rule = "merchant"
                hit = next((b for b in reversed(bought) if b[2] == merchant and b[3] == need and 0 <= (day - b[4]).days <= 30), None)
            if hit is not None:
                hit[3], left = Decimal(0), Decimal(0)
            else:
                left = need
                for b in same:
                    part = min(b[3], left)
                    b[3] -= part
                    left -= part
                rule = "partial" if left < need else "none"
            out[txn] = (rule, left)
    return {b[0]: b[3] for b in bought}, out


@pytest.mark.parametrize("seed", range(4))
def test_netting_equals_the_model(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        d = rng.randrange(60)
        amount = Decimal(rng.choice([0, 10, 10, 20, 30, 30, 50, -10, -20, -30, -25]))
        merchant = None if d % 7 == 0 else f"m{d // 3 if rng.random() < 0.9 else rng.randrange(20)}"
        rows.append((f"t{i:04d}", D(2026, 1, 1) + datetime.timedelta(days=rng.randrange(120)), i, amount, None if d == 5 else f"d{d}", merchant))
    t = spark.createDataFrame([(a, f"r{a}", "expense", b, x, "CNY", k, o) for a, b, o, x, k, _ in rows], TXN)
    e = spark.createDataFrame([(a, m) for a, *_, m in rows], "transaction_id string, merchant_name string")
    found = refunds.net_refunds(t, e).collect()
    balances, out = naive_netting([(a, b, o, x, k or f"source:r{a}", m) for a, b, o, x, k, m in rows])
    assert {r.transaction_id: r.remaining for r in found if r.kind == "balance"} == balances
    assert {r.transaction_id: (r.rule, r.remaining) for r in found if r.kind == "refund"} == out


def test_net_queries_cover_the_whole_ledger(spark):
    """Purchases that a refund can reach are in, net: months, merchants and shares against the model."""
    import json
    import os
    from collections import Counter

    from purseflow.plans import ledger_queries, registry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    t, e = ledger_queries.enriched(spark, sf)
    facts = {r.transaction_id: r for r in e.collect()}
    spent = [r for r in t.collect() if r.transaction_type == "expense"]
    left, _ = naive_netting([(r.transaction_id, r.transaction_date, r.txn_ord, r.amount, r.description or f"source:{r.source_record_id}", facts[r.transaction_id].merchant_name) for r in spent])
    assert any(r.amount < 0 for r in spent)
    month, category, merchant = Counter(), Counter(), Counter()
    for r in spent:
        if left.get(r.transaction_id, 0) > 0:
            m, minor = str(r.transaction_date)[:7], int(left[r.transaction_id] * 100)
            month[m] += minor
            category[m, facts[r.transaction_id].category] += minor
            merchant[m, facts[r.transaction_id].merchant_name] += minor
    rows = lambda name: registry.QUERIES[name](spark, sf).collect()
    cash = rows("cash_flow_month")
    assert {r.month: r.spending_minor for r in cash if r.spending_minor} == month
    assert all(r.net_minor == r.income_minor - r.spending_minor for r in cash)
    assert {r.scope: r.spending_minor for r in rows("financial_summary")}["all_data"] == sum(month.values())
    assert {(r.month, r.category): r.spending_minor for r in rows("category_shares")} == category
    rolled = {(r.grain, r.month, r.category): r.spending_minor for r in rows("spending_rollup")}
    assert rolled["all", None, None] == sum(month.values()) and {k[1]: v for k, v in rolled.items() if k[0] == "month"} == month
    assert all(merchant[r.month, r.merchant_name] == r.spending_minor for r in rows("top_merchants") if r.merchant_name)
    assert {r.month for r in rows("month_coverage")} == set(month)
    assert {r.month: r.spending_minor for r in rows("financial_trend")}.items() <= {r.month: r.spending_minor for r in cash}.items()
    assert all(r.spending_minor == category[r.month, r.category] for r in rows("category_trend_grid"))
    assert all(r.spending_minor == month[r.month] for r in rows("home_summary"))
    assert {r.transaction_id for r in rows("review_signals_net")} <= {k for k, v in left.items() if v > 0}
    payload = json.dumps([r.asDict(True) for r in rows("financial_payload")], default=str)
    assert all(str(v) in payload for v in month.values())


def ledger(spark, rows):
    """(description, amount, date, merchant) to transactions and enrichments."""
    t = spark.createDataFrame([(f"t{i}", f"r{i}", "income" if x > 900 and k is None else "expense", d, Decimal(x), "CNY", k, i) for i, (k, x, d, _) in enumerate(rows)], TXN)
    return t, spark.createDataFrame([(f"t{i}", m) for i, (*_, m) in enumerate(rows)], "transaction_id string, merchant_name string")


def test_refund_fixtures(spark):
    t, e = ledger(spark, [("shop", 300, D(2026, 1, 2), None), ("shop", -100, D(2026, 1, 10), None)])
    o = refunds.net_refunds(t, e)
    assert [(r.transaction_id, r.spending) for r in refunds.net_consumption(o).collect()] == [("t0", 200)]
    s = refunds.refund_summary(o, t).first()
    assert (s.partially_refunded_transactions, s.refund_transactions, s.unmatched_refund_count) == (1, 1, 0)
    t, e = ledger(spark, [("pay-shop", 50, D(2026, 1, 2), "Shop"), ("refund-shop", -50, D(2026, 1, 20), "Shop")])
    o = refunds.net_refunds(t, e)
    assert refunds.net_consumption(o).count() == 0
    s = refunds.refund_summary(o, t).first()
    assert (s.same_merchant_refund_matches, s.same_merchant_matched_amount, s.fully_refunded_transactions) == (1, 50, 1)
    t, e = ledger(spark, [(None, 1000, D(2026, 1, 2), None), ("x", 0, D(2026, 1, 2), None)])
    s = refunds.refund_summary(refunds.net_refunds(t, e), t).first()
    assert (s.zero_amount_transactions, s.refund_transactions) == (1, 0)


def test_high_value_review(spark):
    t = spark.createDataFrame([("a", "ra", "expense", D(2026, 1, 1), Decimal(1200), "CNY", "d", 0), ("b", "rb", "expense", D(2026, 1, 1), Decimal(1200), "CNY", "d", 1), ("c", "rc", "expense", D(2026, 1, 1), Decimal(5), "CNY", "none", 2)], TXN)
    dm, mm = spark.createDataFrame([("d", "M")], "description string, merchant string"), spark.createDataFrame([("M", "综合购物")], "merchant string, category string")
    dec = spark.createDataFrame([("b", None, "综合购物", None)], "transaction_id string, merchant_override string, category_override string, note string")
    e = enrichment.resolve_enrichment(t, dm, mm, dec)
    by = {r.transaction_id: r for r in e.collect()}
    assert by["c"].category == "待分类" and by["c"].is_unclassified and by["b"].category_source == "transaction_override"
    net = spark.createDataFrame([("a", Decimal(1100)), ("b", Decimal(1100))], "transaction_id string, spending decimal(28,6)")
    found = {r.transaction_id: r.review_signals for r in enrichment.net_signals(e, net).collect()}
    assert found == {"a": ["high_value_general_shopping_review"], "b": [], "c": []}


def test_coverage(spark):
    months = spark.createDataFrame([("2026-01",), ("2026-02",)], "month string")
    dates = spark.createDataFrame([("a", D(2026, 1, 10)), ("b", D(2026, 2, 10))], "evidence_identity string, statement_date date")
    assert {r.month: r.is_complete for r in projections.month_coverage(months, dates).collect()} == {"2026-01": True, "2026-02": False}


def records(spark, rows):
    """(type, key, date, amount, description)."""
    r = spark.createDataFrame([(t, k, "x", "expense", d, Decimal(a), "CNY", desc, i) for i, (t, k, d, a, desc) in enumerate(rows)], REC)
    return r.withColumn("source_record_id", ids.source_record_id()).cache()


def links_frame(spark, rows):
    return spark.createDataFrame(rows, "transaction_id string, source_record_id string, role string, link_ord string")


def id_of(r):
    return {x.evidence_identity: x.source_record_id for x in r.collect()}


def naive_reconcile(recs, links, hints):
    """Sequential model over all records. Returns (links {record: [txn, role]}, conflicts)."""
    order = {"bank": 100, "manual": 200}
    by = {r["source_record_id"]: r for r in recs}
    state = {rec: [txn, role] for txn, rec, role, _ in sorted(links, key=lambda x: x[3])}
    conflicts = set()
    for r in sorted(recs, key=lambda r: (order[r["source_type"]], r["source_type"], r["record_ord"])):
        me = r["source_record_id"]
        if me in state:
            if r["source_type"] == "bank":
                for k, v in state.items():
                    if v[0] == state[me][0]:
                        v[1] = "authoritative" if k == me else "supporting"
            continue
        found = []
        for txn in dict.fromkeys(v[0] for v in state.values()):
            a = next(by[k] for k, v in state.items() if v == [txn, "authoritative"])
            if r["source_type"] == "bank" and a["source_type"] != "manual" or a["amount"] != r["amount"]:
                continue
            x, y = hints.get(me), hints.get(a["source_record_id"])
            if abs((a["transaction_date"] - r["transaction_date"]).days) <= 3 and (x is None or y is None or x == y):
                found.append((txn, x is not None and x == y))
        sure = found if len(found) == 1 else [f for f in found if f[1]]
        if len(sure) == 1:
            state[me] = [sure[0][0], "supporting"]
            if r["source_type"] == "bank":
                for k, v in state.items():
                    if v[0] == sure[0][0]:
                        v[1] = "authoritative" if k == me else "supporting"
        elif found and r["source_type"] == "manual":
            conflicts.add(me)
        else:
            state[me] = ["new:" + me, "authoritative"]
    return state, conflicts


@pytest.mark.parametrize("seed", range(4))
def test_reconciliation_equals_the_model(spark, seed):
    rng = random.Random(seed)
    r = records(spark, [(rng.choice(["bank", "manual"]), f"e{i}", D(2026, 1, 1) + datetime.timedelta(days=rng.randrange(60)), rng.choice([10, 20, 30, 40]), f"d{i % 3}") for i in range(60)])
    recs = [x.asDict() for x in r.collect()]
    linked = rng.sample(recs, 20)
    links = []
    for k, x in enumerate(linked):
        links.append((f"txn{k // 2}" if x["amount"] == 10 and 0 else f"txn{k}", x["source_record_id"], "authoritative", f"{k:04d}"))
    hints = {x["source_record_id"]: rng.choice("ABC") for x in rng.sample(recs, 30)}
    h = spark.createDataFrame(list(hints.items()), "source_record_id string, merchant string")
    out = identity.reconcile(r, links_frame(spark, links), identity.policies(spark), h)
    state, conflicts = naive_reconcile(recs, links, hints)
    new = {x["source_record_id"]: x["transaction_id"] for x in r.withColumn("transaction_id", ids.transaction_id()).select("source_record_id", "transaction_id").collect()}
    want = {k: (new[v[0][4:]] if v[0].startswith("new:") else v[0], v[1]) for k, v in state.items()}
    got = {x.source_record_id: (x.transaction_id, x.role) for x in identity.links_of(out).collect()}
    bad = {x.source_record_id for x in identity.conflicts_of(out).collect()}
    assert got == want and bad == conflicts


def test_reconciliation_fixtures(spark):
    p = identity.policies(spark)
    none = links_frame(spark, [])
    r = records(spark, [("bank", "b", D(2026, 1, 2), 20, "x"), ("manual", "m", D(2026, 1, 2), 20, "x")])
    k = id_of(r)
    out = identity.reconcile(r, none, p)
    assert {x.source_record_id: x.role for x in identity.links_of(out).collect()} == {k["b"]: "authoritative", k["m"]: "supporting"}
    assert {x.action for x in identity.decisions_of(out).collect()} == {"created", "matched"}
    r = records(spark, [("bank", "b1", D(2026, 1, 2), 20, "x"), ("bank", "b2", D(2026, 1, 3), 20, "x"), ("manual", "m", D(2026, 1, 2), 20, "x")])
    k = id_of(r)
    assert [x.source_record_id for x in identity.conflicts_of(identity.reconcile(r, none, p)).collect()] == [k["m"]]
    h = spark.createDataFrame([(k["b1"], "A"), (k["b2"], "B"), (k["m"], "B")], "source_record_id string, merchant string")
    d = {x.source_record_id: x.transaction_id for x in identity.decisions_of(identity.reconcile(r, none, p, h)).collect()}
    assert d[k["m"]] == d[k["b2"]] != d[k["b1"]]
    r = records(spark, [("manual", "m", D(2026, 1, 2), 20, "x"), ("bank", "b", D(2026, 1, 2), 20, "x")])
    k = id_of(r)
    l = links_frame(spark, [("t", k["m"], "authoritative", "0")])  # noqa: E741
    got = {x.source_record_id: (x.transaction_id, x.role) for x in identity.links_of(identity.reconcile(r, l, p)).collect()}
    assert got == {k["m"]: ("t", "supporting"), k["b"]: ("t", "authoritative")}
    # a corrected record leaves a transaction that lives on, or takes its own back
    l = links_frame(spark, [("t", k["m"], "supporting", "1"), ("t", k["b"], "authoritative", "0")])  # noqa: E741
    r2 = records(spark, [("manual", "m", D(2026, 3, 2), 25, "x"), ("bank", "b", D(2026, 1, 2), 20, "x")])
    changed = spark.createDataFrame([(k["m"],)], "source_record_id string")
    a = {x.source_record_id: x.transaction_id for x in identity.decisions_of(identity.reconsider(r2, l, changed, p)).collect()}
    b = {x.source_record_id: x.transaction_id for x in identity.decisions_of(identity.reconsider(r2, l, changed, p)).collect()}
    assert a == b and a[k["m"]].startswith("txn_") and a[k["b"]] == "t"
    l = links_frame(spark, [("t", k["m"], "authoritative", "1")])  # noqa: E741
    only = records(spark, [("manual", "m", D(2026, 3, 2), 25, "x")])
    x = identity.decisions_of(identity.reconsider(only, l, changed, p)).first()
    assert (x.transaction_id, x.action) == ("t", "reused")
    assert checks.link_structure(links_frame(spark, [("t", "a", "authoritative", "0"), ("t", "b", "authoritative", "1"), ("u", "a", "supporting", "2")])).count() == 3


def test_sync_drops_what_is_gone(spark):
    r = records(spark, [("manual", "m", D(2026, 1, 2), 20, "x")])
    k = id_of(r)
    links = links_frame(spark, [("t", k["m"], "supporting", "1"), ("t", "gone", "authoritative", "0"), ("u", "gone2", "authoritative", "2")])
    dec = spark.createDataFrame([("t", None, None, "n"), ("u", None, None, "n")], "transaction_id string, merchant_override string, category_override string, note string")
    out, kept, counts = identity.sync(r, links, identity.policies(spark), dec)
    assert [(x.transaction_id, x.role) for x in identity.links_of(out).collect()] == [("t", "authoritative")]
    assert [x.transaction_id for x in kept.collect()] == ["t"] and [tuple(c) for c in counts.collect()] == [(1, 1, 0, 0, 1)]


def test_schedule(spark):
    rules = spark.createDataFrame([("r", True, "expense", Decimal(77), "CNY", "rent", D(2026, 1, 10), "n"), ("off", False, "expense", Decimal(1), "CNY", "x", D(2026, 1, 1), None)], "id string, enabled boolean, type string, amount decimal(28,6), currency string, description string, first_occurrence_date date, note string")
    execution = spark.createDataFrame([], "rule_id string, last_processed_occurrence_date date, last_source_record_id string, last_transaction_id string, last_action string")
    nothing = spark.createDataFrame([], "id string")
    links = spark.createDataFrame([], "source_record_id string, transaction_id string")
    from pyspark.sql import functions as F

    occ = schedule.expand_schedule(rules, F.lit("2026-03-10").cast("date"))
    due = schedule.pending(occ, execution, nothing, links)
    assert schedule.new_evidence(due).count() == 3
    linked = schedule.with_record_id(occ).select("source_record_id", ids.transaction_id().alias("transaction_id"))
    evidence = occ.select(F.col("occurrence_id").alias("id"))
    sync = linked.withColumn("action", F.lit("created"))
    after = schedule.next_execution(schedule.due_actions(due, sync), execution)
    row = after.first()
    assert (row.rule_id, row.last_processed_occurrence_date, row.last_action) == ("r", D(2026, 3, 10), "created")
    assert schedule.note_patches(schedule.due_actions(due, sync)).count() == 3
    assert schedule.pending(occ, after, evidence, linked).count() == 0  # a second run has nothing to do
    lost = schedule.due_actions(schedule.pending(occ, execution, evidence, linked), None)
    assert [x.action for x in lost.collect()] == ["recovered"] * 3 and schedule.new_evidence(lost).count() == 0
    change = spark.createDataFrame([("update", "r", True, "expense", Decimal(77), "CNY", "rent", D(2026, 2, 1), None), ("delete", "off", False, "expense", Decimal(1), "CNY", "x", D(2026, 1, 1), None), ("create", "r", True, "expense", Decimal(1), "CNY", "x", D(2026, 1, 1), None)], "op string, id string, enabled boolean, type string, amount decimal(28,6), currency string, description string, first_occurrence_date date, note string")
    new, _, rejected = schedule.apply_rule_changes(rules, after, change)
    assert sorted(x.op for x in rejected.collect()) == ["create", "update"] and [x.id for x in new.collect()] == ["r"]


def test_patches_and_feedback(spark):
    dec = spark.createDataFrame([("a", "M", None, "n"), ("b", None, None, "x")], "transaction_id string, merchant_override string, category_override string, note string")
    patch = spark.createDataFrame([(1, "a", False, None, True, "C", False, None), (2, "b", False, None, False, None, True, None), (3, "a", False, None, True, " D ", False, "ignored")], "seq int, transaction_id string, set_merchant_override boolean, merchant_override string, set_category_override boolean, category_override string, set_note boolean, note string")
    assert [tuple(r) for r in changes.apply_decision_patches(dec, patch).collect()] == [("a", "M", "D", "n")]
    items = spark.createDataFrame([("f", "open"), ("g", "open")], "id string, status string")
    c = spark.createDataFrame([(1, "f", "open"), (2, "f", "resolved"), (3, "f", "resolved")], "seq int, id string, status string")
    assert {r.id: (r.status, r.changes) for r in changes.feedback_latest(items, c).collect()} == {"f": ("resolved", 1), "g": ("open", 0)}


def test_state_token_and_apply(spark):
    dm, mm = spark.createDataFrame([("d", "M"), ("e", "M")], "description string, merchant string"), spark.createDataFrame([("M", "餐饮")], "merchant string, category string")
    token = review.state_token(dm, mm)
    assert token == review.state_token(dm.orderBy("description", ascending=False), mm) != review.state_token(dm.limit(1), mm)
    change = spark.createDataFrame([("c", "new", "N", "餐饮", True)], review.CHANGES)
    d2, m2 = review.apply_mapping(dm, mm, change, token, review.state_token(dm, mm))
    assert d2.count() == 3 and m2.count() == 2 and checks.mapping_catalogue(d2, m2).count() == 0
    with pytest.raises(ValueError):
        review.apply_mapping(dm, mm, change, token, "other")
    with pytest.raises(checks.ViolationError):
        checks.enforce(checks.mapping_catalogue(dm, mm.limit(0)))
    a, b = review.invert_mappings(dm, mm)
    x, y = review.expand_mappings(a, b)
    assert sorted(map(tuple, x.collect())) == [("d", "M"), ("e", "M")] and y.count() == 1


def test_manual_changes_are_judged_in_order(spark):
    """Random creations, corrections and deletions of few entries, some of which wait for their first sync, against one loop."""
    rng = random.Random(11)
    columns = "id string, type string, date string, amount string, currency string, description string"
    entry = lambda i, text: (i, "expense", "2026-01-02", "5", "CNY", text)
    had = {f"e{i}": entry(f"e{i}", "before") for i in range(12)}
    linked = {f"e{i}" for i in range(8)}
    ops = [(n, rng.choice(["create", "correct", "delete", "delete", "rename", None]), entry(f"e{rng.randrange(20)}", f"by {n}")) for n in range(160)]
    now, refused = dict(had), {}
    for n, op, row in ops:
        i = row[0]
        waits = i in had and i not in linked
        if op not in ("create", "correct", "delete"):
            refused[n] = "no such change"
        elif op == "create" and i in now:
            refused[n] = "already exists"
        elif op != "create" and waits:
            refused[n] = "waits for its first sync"
        elif op != "create" and i not in now:
            refused[n] = "does not exist"
        elif op == "delete":
            del now[i]
        else:
            now[i] = row
    e = spark.createDataFrame([*had.values()], columns)
    c = spark.createDataFrame([(n, op, *row) for n, op, row in ops], "seq int, op string, " + columns)
    after, judged = changes.apply_manual_changes(e, c, spark.createDataFrame([(i,) for i in linked], "id string"))
    assert {r.id: tuple(r) for r in after.collect()} == now
    assert {r.seq: r.refused for r in judged.where("refused is not null").collect()} == refused and set(refused.values()) == {"no such change", "already exists", "waits for its first sync", "does not exist"}
    same, none = changes.apply_manual_changes(e, c.limit(0))
    assert same.count() == 12 and none.count() == 0


def test_order_of_feedback_and_words_of_confidence(spark):
    from purseflow.operators import matching

    items = spark.createDataFrame([("b", "2026-01-01"), ("a", "2026-01-02"), ("c", "2026-01-02")], "id string, created_at string")
    assert [r.id for r in changes.feedback_list(items).collect()] == ["a", "c", "b"]
    stages = spark.createDataFrame([("signed_same_day",), ("absolute_same_day",), ("absolute_window",), (None,)], "stage string")
    assert [r[0] for r in stages.select(matching.confidence()).collect()] == ["high", "medium", "low", None]
