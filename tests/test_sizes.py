"""Plans and bounds that keep the work of a step in proportion to its input."""

import pytest
from pyspark.sql import functions as F

from purseflow.operators import schedule
from purseflow.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["schedule_pending", "schedule_new_evidence", "schedule_cursor"])
def test_occurrences_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan(registry.QUERIES[name](spark, SF))


def test_actions_of_a_sync_are_not_broadcast(spark):
    due = spark.createDataFrame([("r", "a", None), ("r", "b", "t")], "rule_id string, source_record_id string, linked_transaction string")
    got = schedule.due_actions(due, spark.createDataFrame([("a", "n", "created")], "source_record_id string, transaction_id string, action string"))
    assert "Broadcast" not in plan(got)
    assert {(r.source_record_id, r.transaction_id, r.action) for r in got.collect()} == {("a", "n", "created"), ("b", "t", None)}


@pytest.mark.parametrize("seed", [7])
def test_transactions_of_several_places_join_no_islands(spark, monkeypatch, seed):
    """Linked records of other amounts and days that take authority, also from each other: decided as one loop does, island by island."""
    import random

    from purseflow.functions import ids
    from purseflow.operators import identity
    from tests.test_folds import REC, of_rows, reconcile_alone, scenario, some_records

    policies = (("app", 50, True, "any", "create"), ("bank", 100, True, "manual", "create"), ("manual", 200, False, "any", "fail"))
    rng, edges = random.Random(seed), []
    whole = identity.connected_components
    monkeypatch.setattr(identity, "connected_components", lambda e: edges.append(e.count()) or whole(e))
    r = spark.createDataFrame(some_records(rng, 200), REC).withColumn("source_record_id", ids.source_record_id()).cache()
    recs = [x.asDict() for x in r.withColumn("new", ids.transaction_id()).collect()]
    links, hints, transaction_hints, _ = scenario(rng, recs)
    out = identity.reconcile(
        r, spark.createDataFrame(links, "transaction_id string, source_record_id string, role string, link_ord string"), identity.policies(spark, policies), spark.createDataFrame([*hints.items()], "source_record_id string, merchant string"),
        spark.createDataFrame([*transaction_hints.items()], "transaction_id string, merchant string"),
    )
    got = of_rows(list(map(tuple, out.collect())))
    assert got == reconcile_alone(recs, links, hints, transaction_hints, {}, policies)
    assert sum(role == "supporting" for _, role in got[0].values()) > 20 and edges == [0]


def test_mails_are_read_one_at_a_time(spark, monkeypatch):
    from purseflow.sources import statements

    whole = statements._read

    def alone(frame):
        assert frame["digest"].nunique() == 1
        return whole(frame)

    monkeypatch.setattr(statements, "_read", alone)
    row = '<table width="643" height="18"><tr><td></td><td>0105</td><td>0106</td><td>shop</td><td>5</td><td></td><td></td><td></td></tr></table>'
    mail = "Date: 10 Feb 2026 08:00:00 +0800\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    mails = spark.createDataFrame([(f"m{i}", (mail + row * i).encode()) for i in range(5)], "digest string, content binary").coalesce(1)
    records, dates, rejects = statements.parse_statements(mails)
    assert records.count() == 10 and dates.count() == 4
    assert [tuple(r) for r in rejects.collect()] == [("m0", "no statement table")]


def money_rows(spark, seed=3, n=60):
    """Bank transactions and app rows of few amounts and days; some have none."""
    import random
    from datetime import date, timedelta
    from decimal import Decimal

    rng = random.Random(seed)
    amount = lambda: rng.choice([None, Decimal(0), Decimal(5), Decimal(-5), Decimal(7)])
    day = lambda: rng.choice([None, *[date(2026, 1, 1) + timedelta(rng.randrange(25)) for _ in range(8)]])
    bank = [(f"t{i}", day(), amount(), f"Desc {i % 7}") for i in range(n)]
    app = [(f"r{i:03}", f"s{i % 4}", i, f"Shop {i % 9}", rng.choice([None, f"shop{i % 9}"]), amount(), day()) for i in range(n)]
    return (
        spark.createDataFrame(bank, "transaction_id string, transaction_date date, amount decimal(28,6), description string"),
        spark.createDataFrame(app, "row_image string, source_stem string, row_index int, merchant_text string, merchant_key string, amount decimal(28,6), occurred_on date"),
    )


def test_diagnostics_count_pairs_without_making_them(spark, monkeypatch):
    from purseflow.operators import matching

    bank, app = money_rows(spark)
    made = matching.pairs(bank, app).collect()
    monkeypatch.setattr(matching, "pairs", None)
    got = {r.transaction_id: r for r in matching.pair_diagnostics(bank, app).collect()}
    assert len(got) == 60 and registry.QUERIES["candidate_histogram"](spark, SF).count()
    for t, r in got.items():
        own = [p for p in made if p.transaction_id == t]
        days = [abs(p.day_delta) for p in own if p.day_delta is not None]
        kinds = [sum(p.relation == k for p in own) for k in ("opposite", "same", "both_zero")]
        near = [sum(d <= k for d in days) for k in (0, 1, 3, 7)]
        assert list(r) == [t, len(own), *kinds, *near, len(own) - len(days), len({p.merchant_key for p in own} - {None})]


@pytest.mark.parametrize("examples", [1, 3])
def test_examples_take_few_pairs_of_a_frequent_amount(spark, examples):
    from purseflow.operators import matching

    bank, app = money_rows(spark)
    alike = lambda found: {tuple(r) for r in matching.ordered_pairs(found.withColumn("similarity", F.lit(0.0)), examples).select("transaction_id", "row_image", "relation", "day_delta", "rank").collect()}
    few = matching.nearest_pairs(bank.where("transaction_date is not null"), app.where("occurred_on is not null"), examples)
    assert few.groupBy("transaction_id").count().where(f"count > {examples}").isEmpty()
    assert alike(matching.nearest_pairs(bank, app, examples)) == alike(matching.pairs(bank, app))


def test_similarities_are_measured_where_pairs_are_made(spark):
    import random

    import pandas as pd

    from purseflow.functions import text

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcab1") for _ in range(rng.choice([0, 1, 3, 8, 14, 60])))
    some = [(word(), word()) for _ in range(3000)] + [(None, "a"), ("a\0", "a"), ("店1", "店铺12")]
    got = text._similarities(*map(pd.Series, zip(*some)))
    assert list(got) == [text._one_similarity(x, y) for x, y in some]
    tree = plan(registry.QUERIES["pair_similarities"](spark, SF))
    above = tree.split("ArrowEvalPython", 1)
    assert "Exchange" not in above[0] and "Join" in above[1].split("Exchange", 1)[0]


def some_purchases(spark, seed, n=4_000):
    """Transactions and enrichments: purchases and refunds of few amounts on near days, of keys with one or more merchants."""
    import datetime
    import random
    from decimal import Decimal

    rng = random.Random(seed)
    day = lambda: datetime.date(2026, 1, 1) + datetime.timedelta(days=rng.randrange(200))
    rows = [(f"t{i:05d}", "expense", day(), i, Decimal(rng.choice([1, 1, 1, -1]) * rng.choice([10, 20, 30, 35])), rng.randrange(n // 10)) for i in range(n)]
    t = spark.createDataFrame([(*r[:5], f"d{r[5]}", r[0]) for r in rows], "transaction_id string, transaction_type string, transaction_date date, txn_ord long, amount decimal(28,6), description string, source_record_id string")
    e = spark.createDataFrame([(r[0], rng.choice([f"m{r[5] // 4}", f"m{r[5] // 4}", "all", None])) for r in rows], "transaction_id string, merchant_name string")
    return t, e


@pytest.mark.parametrize("seed", [1])
def test_netting_by_components_is_netting_of_the_whole(spark, seed):
    """Components that are dealt after a join that turns out small enough to be sent to every task, against one ledger of all."""
    from purseflow.operators import refunds

    t, e = some_purchases(spark, seed)
    rows = refunds.keyed(t, e).orderBy("transaction_date", "txn_ord").selectExpr("'c' as component", "transaction_id", "transaction_date", "amount", "key", "merchant_name")
    want = {tuple(r) for frame in refunds._fold([rows.toPandas()]) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False)}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    try:
        got = {tuple(r) for r in refunds.net_refunds(t.repartition(8), e.repartition(8)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert got == want


def test_keys_whose_amounts_cannot_meet_are_in_no_component(spark):
    import datetime
    from decimal import Decimal

    from purseflow.operators import refunds

    day = lambda n: datetime.date(2026, 1, 1) + datetime.timedelta(days=n)
    rows = [("a", day(0), 10, "m"), ("b", day(1), -20, "m"), ("c", day(1), 20, "n"), ("d", day(9), -20, "n"), ("e", day(0), 40, "o"), ("e", day(3), -5, "o"), ("f", day(5), -35, "o"), ("f", day(0), 40, "p"), ("g", day(5), -35, "p")]
    of = spark.createDataFrame([(k, d, Decimal(a), m) for k, d, a, m in rows], "key string, transaction_date date, amount decimal(28,6), merchant_name string")
    found = {r.key: r.component for r in refunds.refund_components(of).collect()}
    # a is too small for b; d takes c; what f leaves of 40 is g's, and what e leaves is f's
    assert "a" not in found and "b" not in found
    assert found["c"] == found["d"] and found["e"] == found["f"] == found["g"] != found["c"]


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(i)) for i in range(blocks.size()) if str(blocks.apply(i)).startswith("shuffle_")}


def left_of(spark, before):
    """Shuffle files that are there now and weren't before; deleting them takes a moment."""
    import time

    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    return shuffle_files(spark) - before


def test_a_written_table_leaves_no_shuffles(spark):
    from purseflow.storage import materialize

    before = shuffle_files(spark)
    one = materialize(spark.range(1000).repartition(3, "id"))
    assert not left_of(spark, before)
    assert sorted(r.id for r in one.collect()) == [*range(1000)]


def test_parts_are_written_as_one_table(spark):
    from purseflow.storage import gather

    before = shuffle_files(spark)
    several = gather(spark.range(1000).where(f"id % 3 = {i}").repartition(3, "id") for i in range(3))
    assert not left_of(spark, before)
    assert sorted(r.id for r in several.collect()) == [*range(1000)] and plan(several).count("FileScan") == 1


@pytest.mark.parametrize("changed", [False, True])
def test_a_sync_leaves_its_result_alone_on_disk(spark, changed):
    import glob

    from purseflow.operators import identity
    from purseflow.plans import adapters as A
    from purseflow.storage import shared_dir

    tables = lambda: {p.rsplit("/", 1)[1] for p in glob.glob(shared_dir(spark).removeprefix("file://") + "/purseflow/*/*") if p not in old}
    old = set(glob.glob(shared_dir(spark).removeprefix("file://") + "/purseflow/*/*"))
    r = A.records(spark, SF)
    some = r.where("record_ord % 50 = 0").select("source_record_id") if changed else None
    result, _, counts = identity.sync(r, identity.own_links(r.where("record_ord % 11 <> 0")), identity.policies(spark), A.decisions(spark, SF), changed=some)
    assert tables() - {"edges"} == {"reconciled"}
    assert counts.first().records == r.count() and identity.links_of(result).count() > 0


def test_the_waves_of_a_matching_are_read_as_one_table(spark, monkeypatch):
    from purseflow.operators import matching

    bank, app = money_rows(spark)
    waves, whole = [], matching._seeds
    monkeypatch.setattr(matching, "_seeds", lambda edges: waves.append(1) or whole(edges))
    got = matching.match_descriptions(bank.where("transaction_date is not null"), app)
    assert len(waves) > 1 and plan(got).count("FileScan") <= 5
    assert {r.kind for r in got.select("kind").distinct().collect()} == {"group", "assignment", "candidate"}
