"""Refund netting as rows arrive: our own extension, equal to the batch result within a delay.

Rows wait in keyed state until the watermark passes their day, and are then applied in order of day and
``txn_ord``. So rows may come in any order, a refund before its purchase included: as long as none is later than
the watermark's delay, the outcome is that of the batch. Later ones are dropped by the watermark. State holds
waiting rows and open balances; a balance that is used up is given out and forgotten. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from purseflow.operators.refunds import Ledger

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOME = "component string, kind string, transaction_id string, amount_minor long, remaining_minor long, rule string, matched_minor long"
_ROW = "transaction_id string, at long, txn_ord long, amount_minor long, key string, merchant string"
_BALANCE = "transaction_id string, amount_minor long, remaining_minor long, day int, key string, merchant string"
_DAY = 86_400_000


class _Day(int):
    """A day number whose differences have ``days``, as those of dates."""

    def __sub__(self, other):
        return pd.Timedelta(days=int(self) - int(other))


class Netting(StatefulProcessor):
    """The open balances and the waiting rows of a component."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.balances = handle.getListState("balances", _BALANCE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            at = (frame["at"].astype("datetime64[ms]").astype("int64")).tolist()
            text = lambda c: [None if pd.isna(x) else x for x in frame[c]]  # noqa: B023, E731
            for row in zip(frame["transaction_id"], at, frame["txn_ord"].tolist(), frame["amount_minor"].tolist(), text("key"), text("merchant")):
                self.waiting.appendValue(row)
            for day in {x // _DAY for x in at}:
                self.handle.registerTimer((day + 1) * _DAY - 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() // _DAY
        rows = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in rows if r[1] // _DAY <= until), key=lambda r: (r[1] // _DAY, r[2]))
        if not due:
            return
        out: list[tuple] = []
        ledger = Ledger(out)
        for r in self.balances.get():
            txn, amount, left, day, own, merchant = tuple(r)
            ledger.balances[ledger.count] = [txn, Decimal(amount), Decimal(left), _Day(day), own, merchant]
            ledger.count += 1
        ledger._index()
        for txn, at, _, amount, own, merchant in due:
            day = _Day(at // _DAY)
            if amount > 0:
                ledger.buy(txn, own, merchant, Decimal(amount), day)
            elif amount < 0:
                rule, matched = ledger.refund(own, merchant, Decimal(-amount), day)
                out.append(("refund", txn, Decimal(-amount), Decimal(-amount) - matched, rule, matched))
        self.waiting.put([r for r in rows if r[1] // _DAY > until]) if len(due) < len(rows) else self.waiting.clear()
        left = [(b[0], int(b[1]), int(b[2]), int(b[3]), b[4], b[5]) for b in ledger.balances.values()]
        self.balances.put(left) if left else self.balances.clear()
        if out:
            frame = pd.DataFrame([(key[0], kind, txn, int(a), int(r), rule, int(m)) for kind, txn, a, r, rule, m in out], columns=[c.split()[0] for c in OUTCOME.split(", ")])
            yield frame

    def close(self) -> None:
        pass


def running_netting(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Refunds' outcomes and used-up balances of (component, transaction_id, at timestamp, txn_ord, amount_minor, key,
    merchant). A day is applied when it is over by the watermark. What is left of other purchases
    is their open balance, which the batch result has."""
    rows = stream.select("component", "transaction_id", "at", "txn_ord", "amount_minor", "key", "merchant").withWatermark("at", delay)
    return rows.groupBy("component").transformWithStateInPandas(statefulProcessor=Netting(), outputStructType=OUTCOME, outputMode="Append", timeMode="EventTime")
