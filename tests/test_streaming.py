"""Polling with a pending flag that survives failures, the run log, and netting in a stream against the batch."""

import datetime
import random
from decimal import Decimal

import pytest

from purseflow.streaming import netting, supervise
from tests.test_ledger import naive_netting

T = datetime.datetime


class Inbox:
    """A folder of Parquet files of (digest, content) as a stream."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path)
        path.mkdir()

    def put(self, *digests):
        self.spark.createDataFrame([(d, d.upper()) for d in digests], "digest string, content string").coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema("digest string, content string").parquet(self.path)


def test_polls_go_on_until_nothing_is_pending(spark, tmp_path):
    inbox, left, seen = Inbox(spark, tmp_path / "in"), [2, 0, 0], []

    def sync(new, store):
        seen.append((sorted(r.digest for r in new.collect()), store().count()))
        found = left.pop(0)
        if isinstance(found, Exception):
            raise found
        return found

    def supervisor(checkpoint="cp"):
        return supervise.Supervisor(spark, inbox.stream, str(tmp_path / "store"), str(tmp_path / "state"), str(tmp_path / checkpoint), sync)

    one = supervisor()
    assert one.poll_once() == {"fetched": 0, "added": 0, "synced": False, "unreconciled": None, "error": None} and one.evidence().count() == 0
    inbox.put("aa1", "bb2", "aa1")
    first = one.poll_once()
    assert (first["fetched"], first["added"], first["unreconciled"]) == (3, 2, 2) and one.pending()
    # a new program knows that something is pending, and a sync that fails leaves it so
    left.insert(0, RuntimeError("no such table"))
    two = supervisor()
    failed = two.poll_once()
    assert failed["added"] == 0 and "no such table" in failed["error"] and two.pending()
    done = two.poll_once()
    assert done["unreconciled"] == 0 and not two.pending() and two.poll_once()["synced"] is False
    # the checkpoint is lost: everything comes again, and nothing is stored twice
    inbox.put("aa3")
    again = supervisor("lost").poll_once()
    assert again["fetched"] == 4 and again["added"] == 1 and sorted(r.digest for r in two.evidence().collect()) == ["aa1", "aa3", "bb2"]
    assert seen[0] == (["aa1", "bb2"], 2) and seen[-1][1] == 3 and "aa3" in seen[-1][0]
    assert two.tick(lambda: 1) and not two.tick(lambda: 1 // 0)
    now = supervise.operational(two.log()).first()
    assert (now.polls, now.errors, now.added, now.pending) == (6, 2, 3, False) and "ZeroDivision" in now.last_tick_error and now.last_poll_error is None and now.last_sync_at is not None


def test_the_flag_stands_before_the_evidence(spark, tmp_path, monkeypatch):
    """The program ends after the evidence is stored, before anything else: the next one syncs."""
    inbox, synced = Inbox(spark, tmp_path / "in"), []
    make = lambda: supervise.Supervisor(spark, inbox.stream, str(tmp_path / "store"), str(tmp_path / "state"), str(tmp_path / "cp"), lambda new, store: synced.append(new.count()) or 0)
    inbox.put("cc1")
    one = make()
    real, taken = one._take, []

    def cut(batch, epoch, counts):
        real(batch, epoch, counts)
        taken.append(epoch)
        raise SystemError("the machine stops here")

    monkeypatch.setattr(one, "_take", cut)
    broken = one.poll_once()
    assert taken and broken["error"] and not synced
    assert make().poll_once()["added"] == 0 and synced == [1]


def test_run_needs_an_interval(spark, tmp_path):
    inbox = Inbox(spark, tmp_path / "in")
    one = supervise.Supervisor(spark, inbox.stream, str(tmp_path / "store"), str(tmp_path / "state"), str(tmp_path / "cp"), lambda new, store: 0)
    one.run(0.01, polls=2)
    assert one.polls == 2
    with pytest.raises(ValueError):
        one.run(0)


def test_netting_in_a_stream_is_the_batch(spark, tmp_path):
    """Rows come out of order within the delay, refunds before purchases."""
    rng = random.Random(7)
    rows = []
    for i in range(120):
        rows.append((f"t{i:03d}", T(2026, 1, 1) + datetime.timedelta(days=i // 4), i, rng.choice([10, 20, 30, 50, -10, -20, -30, -25]), f"d{rng.randrange(6)}", rng.choice([None, "m0", "m1"])))
    order = sorted(rows, key=lambda r: r[2] + rng.randrange(-12, 12))
    schema = "component string, transaction_id string, at timestamp, txn_ord long, amount_minor long, key string, merchant string"
    src = str(tmp_path / "in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", netting.STATE_STORE)
    put = lambda some: spark.createDataFrame([("c", *r) for r in some], schema).coalesce(1).write.mode("append").parquet(src)
    try:
        put(order[:40])
        query = netting.running_netting(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("netted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        for some in (order[40:80], order[80:], [("end", T(2026, 6, 1), 999, 1, "x", None)]):
            put(some)
            query.processAllAvailable()
        got = spark.sql("SELECT * FROM netted").collect()
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    balances, out = naive_netting([(a, b.date(), o, Decimal(x), k, m) for a, b, o, x, k, m in rows])
    assert {r.transaction_id: (r.rule, r.remaining_minor) for r in got if r.kind == "refund"} == {k: (rule, int(left)) for k, (rule, left) in out.items()}
    assert {r.transaction_id for r in got if r.kind == "balance"} == {k for k, left in balances.items() if left == 0}
