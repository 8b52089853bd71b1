"""Reconciliation, netting and matching against sequential models, with state that must stay small."""

import datetime
import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from purseflow.functions import ids
from purseflow.operators import identity, matching, refunds

D = datetime.date
REC = "source_type string, evidence_identity string, record_locator string, transaction_type string, transaction_date date, amount decimal(28,6), currency string, description string, record_ord long"
POLICIES = (("app", 50, False, "bank", "create"), ("bank", 100, True, "manual", "create"), ("manual", 200, False, "any", "fail"))


def reconcile_alone(recs, links, hints, transaction_hints, overrides, policies):
    """One loop over all records, looking at all transactions each time.
    Returns {record: (transaction, role)}, {record: (action, distance, match)} and the records in conflict."""
    order = {p[0]: p[1:] for p in policies}
    by = {r["source_record_id"]: r for r in recs}
    txns = defaultdict(dict)
    for txn, rec, role, _ in sorted(links, key=lambda x: x[3]):
        txns[txn][rec] = role
    owner = {rec: txn for txn, m in txns.items() for rec in m}
    decisions, conflicts = {}, set()

    def take(txn, rec):
        for k in txns[txn]:
            txns[txn][k] = "authoritative" if k == rec else "supporting"

    for r in sorted(recs, key=lambda r: (order[r["source_type"]][0], r["source_type"], r["record_ord"])):
        me = r["source_record_id"]
        _, takes, scope, doubt = order[r["source_type"]]
        if me in owner:
            if takes:
                take(owner[me], me)
            decisions[me] = ("reused", None, None)
            continue
        found = []
        for txn, members in txns.items():
            a = next((by[k] for k, role in members.items() if role == "authoritative"), None)
            if a is None or scope not in ("any", a["source_type"]) or any(a[c] != r[c] for c in ("transaction_type", "currency", "amount")):
                continue
            distance = abs((a["transaction_date"] - r["transaction_date"]).days)
            mine, theirs = hints.get(me), transaction_hints.get(txn) or hints.get(a["source_record_id"])
            match = None if mine is None or theirs is None else mine == theirs
            if distance <= 3 and match is not False:
                found.append((txn, distance, match))
        sure = found if len(found) == 1 else [f for f in found if f[2]]
        if len(sure) == 1:
            txn, distance, match = sure[0]
            txns[txn][me], owner[me] = "supporting", txn
            if takes:
                take(txn, me)
            decisions[me] = ("matched", distance, match)
        elif found and doubt == "fail":
            conflicts.add(me)
        else:
            txn, action = overrides.get(me, (r["new"], "created"))
            if txns.get(txn):
                conflicts.add(me)
                continue
            txns[txn][me], owner[me] = "authoritative", txn
            decisions[me] = (action, None, None)
    return {rec: (txn, txns[txn][rec]) for rec, txn in owner.items()}, decisions, conflicts


def some_records(rng, n):
    """Records of few amounts on near days, some linked (several to a transaction, over days and amounts), hints, overrides."""
    days = rng.choice([40, 90, 200])
    rows = [(rng.choice(["app", "bank", "manual"]), f"e{i}", "x", rng.choice(["expense", "expense", "income"]), D(2026, 1, 1) + datetime.timedelta(days=rng.randrange(days)), Decimal(rng.choice([10, 10, 20, 30])), rng.choice(["CNY", "CNY", "EUR"]), f"d{i % 3}", i) for i in range(n)]
    rng.shuffle(rows)
    return [(*r[:-1], i) for i, r in enumerate(rows)]


def scenario(rng, recs):
    linked = rng.sample(recs, len(recs) // 3)
    links, k = [], 0
    while linked:
        size = rng.choice([1, 1, 1, 2, 3])
        group, linked = linked[:size], linked[size:]
        chief = rng.randrange(len(group))
        for j, r in enumerate(group):
            links.append((f"txn{k}", r["source_record_id"], "authoritative" if j == chief else "supporting", f"{k:04d}{j}"))
        k += 1
    have = {x[1] for x in links}
    free = [r["source_record_id"] for r in recs if r["source_record_id"] not in have]
    hints = {r["source_record_id"]: rng.choice("AB") for r in rng.sample(recs, len(recs) // 2)}
    transaction_hints = {f"txn{j}": rng.choice("AB") for j in range(k) if rng.random() < 0.2}
    overrides = {rec: (f"old{j // 2}", "reused") if j % 3 else (f"txn{j}", "created") for j, rec in enumerate(rng.sample(free, min(8, len(free))))}
    return links, hints, transaction_hints, overrides


def fold_alone(recs, links, hints, transaction_hints, overrides):
    """All records as one component through the fold, by date."""
    order = {p[0]: p[1:] for p in POLICIES}
    link = {rec: (txn, role, o) for txn, rec, role, o in links}
    size = Counter(x[0] for x in links)
    targets = Counter(overrides.get(r["source_record_id"], (r["new"],))[0] for r in recs if r["source_record_id"] not in link)
    out: list = []
    fold = identity._Fold(3, 1, out)
    rows = []
    for r in recs:
        rec = r["source_record_id"]
        txn, role, o = link.get(rec, (None, None, None))
        number, takes, scope, doubt = order[r["source_type"]]
        target, action = overrides.get(rec, (r["new"], None))
        rows.append({"source_record_id": rec, "source_type": r["source_type"], "block": f"{r['transaction_type']}|{r['currency']}|{r['amount']}", "transaction_date": r["transaction_date"], "record_ord": r["record_ord"], "link_transaction": txn, "role": role, "link_ord": o, "processing_order": number, "takes_authority": takes,
                     "candidate_scope": scope, "on_ambiguous": doubt, "record_hint": hints.get(rec), "transaction_hint": transaction_hints.get(txn), "override_action": action, "target": target, "target_linked": target in size, "target_rows": targets[target], "txn_rows": size.get(txn)})
    most = 0
    for r in sorted(rows, key=lambda r: (r["transaction_date"], r["processing_order"], r["source_type"], r["record_ord"])):
        fold.add(r)
        most = max(most, len(fold.txns) + len(fold.waiting))
    fold.finish()
    return out, most


def of_rows(out):
    links = {r[2]: (r[1], r[3]) for r in out if r[0] == "link"}
    decisions = {r[2]: (r[5], r[6], r[7]) for r in out if r[0] == "decision"}
    return links, decisions, {r[2] for r in out if r[0] == "conflict"}


def with_ids(rows):
    return [dict(zip([c.split()[0] for c in REC.split(", ")], r)) | {"source_record_id": f"s{r[1]}", "new": f"new:{r[1]}"} for r in rows]


@pytest.mark.parametrize("held", [0, 30, 10**9])
def test_the_fold_decides_as_one_loop(monkeypatch, held):
    monkeypatch.setattr(identity, "HELD", held)
    kinds = Counter()
    for seed in range(150):
        rng = random.Random(seed)
        recs = with_ids(some_records(rng, rng.choice([15, 40, 120])))
        case = scenario(rng, recs)
        got = of_rows(fold_alone(recs, *case)[0])
        assert got == reconcile_alone(recs, *case, POLICIES), seed
        kinds.update(a for a, *_ in got[1].values())
        kinds["conflict"] += len(got[2])
    assert min(kinds.values()) > 50 and len(kinds) == 4


def test_an_amount_of_every_day_is_not_held(monkeypatch):
    """One amount paid daily for years, bank and manual, in input order: the fold holds some days."""
    monkeypatch.setattr(identity, "HELD", 40)
    rows = [(t, f"{t}{i}", "x", "expense", D(2010, 1, 1) + datetime.timedelta(days=i), Decimal(9), "CNY", "d", i) for i in range(3000) for t in ("bank", "manual")]
    recs = with_ids(rows)
    out, most = fold_alone(recs, [], {r["source_record_id"]: "AB"[r["record_ord"] % 2] for r in recs}, {}, {})
    assert most < 150 and len(of_rows(out)[0]) + len(of_rows(out)[2]) == 6000


@pytest.mark.parametrize("seed", range(3))
def test_reconcile_decides_as_one_loop(spark, monkeypatch, seed):
    rng = random.Random(100 + seed)
    rows = some_records(rng, 150)
    r = spark.createDataFrame(rows, REC).withColumn("source_record_id", ids.source_record_id()).cache()
    recs = [x.asDict() for x in r.withColumn("new", ids.transaction_id()).collect()]
    links, hints, transaction_hints, overrides = scenario(rng, recs)
    out = identity.reconcile(
        r, spark.createDataFrame(links, "transaction_id string, source_record_id string, role string, link_ord string"), identity.policies(spark, POLICIES), spark.createDataFrame([*hints.items()], "source_record_id string, merchant string"),
        spark.createDataFrame([*transaction_hints.items()], "transaction_id string, merchant string"), spark.createDataFrame([(k, *v) for k, v in overrides.items()], "source_record_id string, transaction_id string, action string"),
    )
    assert of_rows(list(map(tuple, out.collect()))) == reconcile_alone(recs, links, hints, transaction_hints, overrides, POLICIES)


def test_empty_reconcile(spark):
    r = spark.createDataFrame([], REC).withColumn("source_record_id", ids.source_record_id())
    assert identity.reconcile(r, spark.createDataFrame([], "transaction_id string, source_record_id string, role string, link_ord string"), identity.policies(spark)).collect() == []


# --- netting holds open balances only


def test_netting_forgets_what_is_used_up():
    rng, out = random.Random(2), []
    ledger = refunds.Ledger(out)
    most = entries = 0
    for i in range(30_000):
        amount = Decimal(rng.choice([10, 20, 30]))
        ledger.buy(f"t{i}", f"d{i % 5}", f"m{i % 2}", amount, D(2026, 1, 1))
        ledger.refund(f"d{rng.randrange(5)}", f"m{rng.randrange(2)}", amount if rng.random() < 0.7 else amount + 5, D(2026, 1, 2))
        most = max(most, len(ledger.balances))
        entries = max(entries, sum(map(len, [*ledger.open.values(), *ledger.same_key.values(), *ledger.same_merchant.values()])))
    ledger.finish()
    assert most < 2_000 and entries < 20_000 and sum(r[0] == "balance" for r in out) == 30_000


# --- matching


def match_alone(bank, app, window=7):
    """(id, date, amount, description) and (row, stem, index, merchant, date, amount): one loop over descriptions."""
    days = [a[4] for a in app if a[4] is not None]
    span = (min(days), max(days)) if days else None
    free = {a[0]: a for a in app if a[4] is not None and a[5] is not None}
    by = defaultdict(list)
    for b in bank:
        by[b[3]].append(b)
    groups, assigned, left, full = {}, {}, set(), []
    for description, rows in sorted(by.items(), key=lambda g: (-len(g[1]), min(r[1] for r in g[1]), g[0])):
        rows = sorted(rows, key=lambda r: (r[1], r[0]))
        covered = [r for r in rows if span and span[0] <= r[1] <= span[1]]
        evidence = [r for r in covered if r[2] > 0]

        def near(t):
            if t[2] <= 0:
                return []
            found = [(abs((a[4] - t[1]).days), a[4], a[1], a[2], a[0]) for a in free.values() if abs(a[5]) == t[2] and abs((a[4] - t[1]).days) <= window]
            return [free[x[-1]] for x in sorted(found)]

        def seeds(test):
            named = [{a[3] for a in near(t) if a[4] == t[1] and test(t, a)} for t in evidence]
            return Counter(next(iter(n)) for n in named if len(n) == 1)

        signed, absolute = seeds(lambda t, a: a[5] == -t[2]), seeds(lambda t, a: True)
        chosen, name = (signed, "signed") if signed else (absolute, "absolute")
        if chosen:
            status = f"mapped_{name}_same_day_seed" if len(chosen) == 1 else f"conflicting_{name}_same_day_seeds"
        elif any(a[4] == t[1] for t in evidence for a in near(t)):
            status = "ambiguous_without_seed"
        else:
            status = "no_same_day_candidate" if evidence else "no_eligible_purchase_evidence" if covered else "ocr_not_covered"
        merchant = next(iter(chosen)) if len(chosen) == 1 else None
        groups[description] = (status, merchant, sum(chosen.values()))
        mine = {}
        if merchant is not None:
            tests = (("signed_same_day", lambda t, a: a[4] == t[1] and a[5] == -t[2]), ("absolute_same_day", lambda t, a: a[4] == t[1]), ("absolute_window", lambda t, a: a[4] != t[1]))
            for stage, test in tests:
                holder = {}
                choices = {t[0]: [a[0] for a in near(t) if a[3] == merchant and test(t, a)] for t in evidence if t[0] not in mine}

                def assign(txn, seen):
                    for row in choices[txn]:
                        if row not in seen:
                            seen.add(row)
                            if row not in holder or assign(holder[row], seen):
                                holder[row] = txn
                                return True
                    return False

                for txn in choices:
                    assign(txn, set())
                for row, txn in holder.items():
                    mine[txn] = (row, stage)
                    del free[row]
        assigned |= mine
        rest = {t[0]: [a[0] for a in near(t) if a[4] == t[1] or merchant is not None and a[3] == merchant] for t in rows if t[0] not in mine}
        left |= {(t, a) for t, found in rest.items() for a in found}
        only = Counter("cover" if not (span and span[0] <= t[1] <= span[1]) else "refund" if t[2] < 0 else "candidate" if rest[t[0]] else "none" for t in rows if t[0] not in mine and merchant is not None)
        stages = Counter(stage for _, stage in mine.values())
        full.append((
            len(full) + 1, description, len(rows), len(covered), len(evidence), sum(chosen.values()), sorted(((m, n) for m, n in chosen.items()), key=lambda x: (-x[1], x[0])) or None, f"{name}_same_day" if merchant else None,
            {"signed": "high", "absolute": "medium"}[name] if merchant else None, merchant, status, len(mine), stages["signed_same_day"], stages["absolute_same_day"], stages["absolute_window"], len(rows) if merchant else 0, sum(only.values()),
            0 if merchant else len(rows), only["refund"], only["cover"], only["none"], only["candidate"], len(app) - len(assigned) + len(mine), len(mine), len(app) - len(assigned),
        ))
    return groups, assigned, left, full


@pytest.mark.parametrize("seed, descriptions", [(0, 4), (1, 12), (2, 40)])
def test_matching_in_waves_as_one_loop(spark, seed, descriptions):
    rng = random.Random(seed)
    day = lambda n: D(2026, 1, 1) + datetime.timedelta(days=rng.randrange(n))
    bank, app = [], [("r998", "s", 1, "m1", None, Decimal(5)), ("r999", "s", 2, "m1", D(2026, 1, 5), None)]
    for i in range(260):
        d = int(descriptions * rng.random() ** 2)
        amount = Decimal(rng.choice([10 + d // 2] * 12 + [20 + d] * 6 + [5, -5, 0]))
        bank.append((f"t{i:03d}", day(40), amount, f"d{d}"))
        if rng.random() < 0.7:
            on = bank[-1][1] + datetime.timedelta(days=rng.choice([0, 0, 1, -2, 5, -7, 9]))
            app.append((f"r{i:03d}", f"s{i % 4}", i // 4, f"m{d // 2 % 4}" if rng.random() < 0.99 else "other", on, -amount if rng.random() < 0.7 else amount))
    b = spark.createDataFrame(bank, "transaction_id string, transaction_date date, amount decimal(28,6), description string")
    a = spark.createDataFrame(app, "row_image string, source_stem string, row_index int, merchant_key string, occurred_on date, amount decimal(28,6)")
    found = matching.match_descriptions(b, a)
    found, found_schema = found.collect(), found.schema
    groups, assigned, left, full = match_alone(bank, app)
    assert {r.description: (r.status, r.merchant_key, r.seed_count) for r in found if r.kind == "group"} == groups
    assert {r.transaction_id: (r.row_image, r.stage) for r in found if r.kind == "assignment"} == assigned
    assert {(r.transaction_id, r.row_image) for r in found if r.kind == "candidate"} == left
    assert len(assigned) > 30 and len({s for _, s in assigned.values()}) == 3
    m = spark.createDataFrame(found, found_schema)
    a = a.withColumns({"merchant_text": F.col("merchant_key"), "row_ord": F.lit(0)})
    results = matching.group_results(b, a, m, matching.match_status(b, a, m))
    rows = [tuple([tuple(x) for x in v] if isinstance(v, list) else v for v in r) for r in results.orderBy("processing_order").collect()]
    assert rows == full and results.columns == [*matching.GROUP_RESULT]
    total = matching.matching_totals(results, a).first()
    assert (total.transactions, total.descriptions, total.app_rows_consumed, total.app_rows_unused) == (len(bank), len(groups), len(assigned), len(app) - len(assigned))
    assert total.suggested_mappings == sum(g[1] is not None for g in groups.values()) and total.mapping_only_transactions == sum(r[16] for r in full) and total.coverage_start == min(x[4] for x in app if x[4])


def test_stretches_are_cut(spark):
    """One description and amount on every tenth day: each purchase is matched in a stretch of its own."""
    held, rows = [], [(f"t{i:03d}", D(2026, 1, 1) + datetime.timedelta(days=20 * i)) for i in range(40)]
    real = matching.one_to_one
    try:
        matching.one_to_one = lambda t, c: held.append(len(t)) or real(t, c)
        batch = [{"description": "d", "size": 5, "transaction_id": t, "row_image": f"r{k}{t}", "occurred_on": d + datetime.timedelta(days=k), "day_delta": k, "first_row": d + datetime.timedelta(days=1)} for t, d in rows for k in (1, 2)]

        class Batch:
            def to_pylist(self):
                return batch

        out = [r for b in matching._stretches([Batch()]) for r in b.to_pylist()]
    finally:
        matching.one_to_one = real
    assert len(out) == 40 and max(held) == 1 and all(r["day_delta"] == 1 for r in out)


def test_matching_without_rows(spark):
    b = spark.createDataFrame([("t", D(2026, 1, 1), Decimal(5), "d")], "transaction_id string, transaction_date date, amount decimal(28,6), description string")
    a = spark.createDataFrame([], "row_image string, source_stem string, row_index int, merchant_key string, occurred_on date, amount decimal(28,6)")
    assert [(r.kind, r.status) for r in matching.match_descriptions(b, a).collect()] == [("group", "ocr_not_covered")]
    assert matching.match_descriptions(b.limit(0), a).collect() == []
