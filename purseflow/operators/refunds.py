"""Refund netting: refunds consume earlier purchases, in order.

A refund takes, of what its description still has open, a balance of exactly its
amount (the latest); else one of exactly its amount at the same merchant, bought 0 to
30 days before; else what its description has open, latest first. The rest is
unmatched. Only the second rule crosses descriptions, so descriptions that a refund
could join over a merchant are put into one component, and components are netted
independently. Most have no refund and are a plain projection.
"""

from __future__ import annotations

from collections import defaultdict
from decimal import Decimal
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purseflow.operators.components import connected_components
from purseflow.schemas import MONEY, REFUND_LOOKBACK_DAYS
from purseflow.storage import discard, materialize

OUTCOME = f"kind string, transaction_id string, amount {MONEY}, remaining {MONEY}, rule string, matched {MONEY}"


class Ledger:
    """Open balances of one component; one that is used up is given out and forgotten.

    Balances of an amount are kept in heaps, latest first, those of a description in a stack.
    Entries of what was used or changed since are passed over when they come up, and swept
    when there are more of them than of open balances."""

    def __init__(self, out: list[tuple]):
        self.out, self.count, self.stale = out, 0, 0
        self.balances: dict[int, list] = {}  # number -> id, original, remaining, day, key, merchant
        self._index()

    def _index(self):
        self.open: dict[str, list[int]] = defaultdict(list)
        self.same_key: dict[tuple, list[int]] = defaultdict(list)
        self.same_merchant: dict[tuple, list[int]] = defaultdict(list)
        self.stale = 0
        for i in self.balances:  # in the order of purchase
            self.open[self.balances[i][4]].append(i)
            self._offer(i)

    def _offer(self, i: int):
        _, _, left, _, key, merchant = self.balances[i]
        heappush(self.same_key[key, left], -i)
        if merchant is not None:
            heappush(self.same_merchant[merchant, left], -i)

    def _close(self, i: int):
        txn, amount, *_ = self.balances.pop(i)
        self.out.append(("balance", txn, amount, Decimal(0), None, amount))
        self.stale += 3
        if self.stale > 1_000 + 3 * len(self.balances):
            self._index()

    def buy(self, txn: str, key: str, merchant: str | None, amount: Decimal, day) -> None:
        i = self.count
        self.count += 1
        self.balances[i] = [txn, amount, amount, day, key, merchant]
        self.open[key].append(i)
        self._offer(i)

    def _latest(self, heap: list[int], amount: Decimal) -> int | None:
        while heap and ((b := self.balances.get(-heap[0])) is None or b[2] != amount):
            heappop(heap)
        return -heap[0] if heap else None

    def refund(self, key: str, merchant: str | None, amount: Decimal, day) -> tuple[str, Decimal]:
        i = self._latest(self.same_key.get((key, amount), []), amount)
        if i is not None:
            self._close(i)
            return "exact", amount
        if merchant is not None:
            i = self._latest(self.same_merchant.get((merchant, amount), []), amount)
            if i is not None and (day - self.balances[i][3]).days <= REFUND_LOOKBACK_DAYS:
                self._close(i)
                return "merchant", amount
        left = amount
        while left > 0 and self.open.get(key):
            i = self.open[key][-1]
            b = self.balances.get(i)
            if b is None:
                self.open[key].pop()
                continue
            part = min(b[2], left)
            b[2] -= part
            left -= part
            if b[2] > 0:
                self._offer(i)
                self.stale += 2
            else:
                self.open[key].pop()
                self._close(i)
        return ("partial" if left < amount else "none"), amount - left

    def finish(self):
        """What is open at the end."""
        self.out += [("balance", txn, amount, left, None, amount - left) for txn, amount, left, *_ in self.balances.values()]
        self.balances = {}


def _fold(frames):
    """Rows come sorted by component, date and order; a component may span frames. Only
    its open balances are held."""
    now, ledger, out = None, None, []
    names = [c.split()[0] for c in OUTCOME.split(", ")]
    for frame in frames:
        for component, txn, day, amount, key, merchant in frame.itertuples(index=False, name=None):
            if component != now:
                if ledger is not None:
                    ledger.finish()
                now, ledger = component, Ledger(out)
            merchant = None if merchant is None or merchant != merchant else merchant
            if amount > 0:
                ledger.buy(txn, key, merchant, amount, day)
            else:
                rule, matched = ledger.refund(key, merchant, -amount, day)
                out.append(("refund", txn, -amount, -amount - matched, rule, matched))
        yield pd.DataFrame(out, columns=names)
        out.clear()
    if ledger is not None:
        ledger.finish()
    yield pd.DataFrame(out, columns=names)


def keyed(transactions: DataFrame, enrichments: DataFrame) -> DataFrame:
    key = F.coalesce("description", F.concat(F.lit("source:"), F.col("source_record_id")))
    rows = transactions.where("transaction_type = 'expense' and amount <> 0").select("transaction_id", "transaction_date", "txn_ord", "amount", key.alias("key"))
    return rows.join(enrichments.select("transaction_id", "merchant_name"), "transaction_id")


def meeting_points(rows: DataFrame) -> DataFrame:
    """(key, merchant_name, period, size) where a refund of one key could meet a purchase of another.

    Refunds and purchases of a merchant meet at points (merchant, 31 days of purchase, amount):
    a refund looks at its own and the period before, for its own amount. What remains of a purchase is its
    amount, unless a refund of its own key came within those 30 days; such purchases stand at the point of size 0
    too, and so do refunds, as far as one is smaller than the other. So there is a row for each key and
    point, never one for each pair of keys. Points without a refund, a purchase, or a second key join nothing."""
    at = ["merchant_name", "period", "size"]
    period = F.expr(f"cast(floor(datediff(transaction_date, date'1970-01-01') / {REFUND_LOOKBACK_DAYS + 1}) as int)")
    known = rows.where("merchant_name is not null").select("key", "merchant_name", "transaction_date", "amount", period.alias("own"))
    zero = F.lit(0).cast(MONEY)
    asked = known.where("amount < 0").select("key", "merchant_name", (-F.col("amount")).cast(MONEY).alias("amount"), F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("period"))
    asked = asked.select("*", F.explode(F.array("amount", zero)).alias("size"))
    days = rows.where("amount < 0").groupBy("key").agg(F.collect_set("transaction_date").alias("days"))  # as many as the calendar has at most
    changes = F.exists("days", lambda d: F.datediff(d, F.col("transaction_date")).between(0, REFUND_LOOKBACK_DAYS))
    bought = known.where("amount > 0").join(days, "key", "left").select("key", "merchant_name", "amount", F.col("own").alias("period"), F.explode(F.when(changes, F.array(F.col("amount").cast(MONEY), zero)).otherwise(F.array(F.col("amount").cast(MONEY)))).alias("size"))
    asking = asked.groupBy(*at).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.min("amount").alias("least"))
    met = bought.join(asking, at).where("(low <> key or high <> key) and (size > 0 or amount > least)").select("key", *at, "amount")
    met = materialize(met, "met")
    offered = met.groupBy(*at).agg(F.max("amount").alias("most"))
    return met.select("key", *at).union(asked.join(offered, at).where("size > 0 or amount < most").select("key", *at)).distinct()


def refund_components(rows: DataFrame) -> DataFrame:
    """(key, component) of the keys that a refund could join over a merchant. A component may be
    larger than it must be, which changes no result."""
    edges = meeting_points(rows).select(F.concat(F.lit("k:"), F.col("key")).alias("src"), F.concat_ws("\0", F.lit("p:"), "merchant_name", F.col("period").cast("string"), F.col("size").cast("string")).alias("dst"))
    found = connected_components(edges)
    return found.where("node like 'k:%'").select(F.expr("substr(node, 3)").alias("key"), F.col("root").alias("component"))


def reached_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(key): the given keys and all that refunds could join with them, from one to the next. Each
    step reads the points of the newest keys only; few keys stay few."""
    points = materialize(meeting_points(rows), "points")
    known = newest = materialize(keys.select("key").distinct(), "keys")
    while True:
        met = points.join(newest, "key", "left_semi").select("merchant_name", "period", "size").distinct()
        step = points.join(met, ["merchant_name", "period", "size"], "left_semi").select("key").distinct().join(known, "key", "left_anti")
        newest = materialize(step, "keys")
        if newest.isEmpty():
            discard(points)
            return known
        known = known.union(newest)


def net_refunds(transactions: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Balances and refund outcomes, tagged by ``kind``: a row for each purchase with what
    remains, a row for each refund with its rule (exact, merchant, partial, none)."""
    rows = materialize(keyed(transactions, enrichments), "rows")
    joined = refund_components(rows)  # each of these has a refund
    alone = rows.where("amount < 0").select("key").distinct().join(joined, "key", "left_anti").select("key", F.concat(F.lit("k:"), F.col("key")).alias("component"))
    # written before they are dealt: where the join beneath is sent to every task in the end, a component could come to several of them
    dealt = materialize(rows.join(joined.union(alone), "key", "left"), "dealt")
    discard(rows)
    plain = dealt.where("component is null").select(F.lit("balance").alias("kind"), "transaction_id", "amount", F.col("amount").alias("remaining"), F.lit(None).cast("string").alias("rule"), F.lit(0).cast(MONEY).alias("matched"))
    dealt = dealt.where("component is not null").repartition("component").sortWithinPartitions("component", "transaction_date", "txn_ord")
    folded = dealt.select("component", "transaction_id", "transaction_date", "amount", "key", "merchant_name").mapInPandas(_fold, OUTCOME)
    return plain.union(folded)


def net_consumption(outcome: DataFrame) -> DataFrame:
    """(transaction_id, spending) of purchases with something left."""
    return outcome.where("kind = 'balance' and remaining > 0").select("transaction_id", F.col("remaining").alias("spending"))


def refund_summary(outcome: DataFrame, transactions: DataFrame) -> DataFrame:
    """The eight counters, in one row."""
    refund, balance = F.col("kind") == "refund", F.col("kind") == "balance"
    merchant = refund & (F.col("rule") == "merchant")
    total = lambda c, x: F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0)).cast(MONEY)
    counted = outcome.agg(
        F.count_if(refund).alias("refund_transactions"), F.count_if(merchant).alias("same_merchant_refund_matches"), total(merchant, "matched").alias("same_merchant_matched_amount"),
        F.count_if(balance & (F.col("remaining") == 0)).alias("fully_refunded_transactions"), F.count_if(balance & (F.col("remaining") > 0) & (F.col("remaining") < F.col("amount"))).alias("partially_refunded_transactions"),
        F.count_if(refund & (F.col("remaining") > 0)).alias("unmatched_refund_count"), total(refund, "remaining").alias("unmatched_refund_amount"),
    )
    zero = transactions.agg(F.count_if((F.col("transaction_type") == "expense") & (F.col("amount") == 0)).alias("zero_amount_transactions"))
    return zero.crossJoin(counted)
