"""Durable identity: links between source records and transactions, and their reconciliation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from purseflow import schemas as S
from purseflow.functions import ids
from purseflow.operators.components import connected_components
from purseflow.storage import discard, gather, materialize


def policies(spark: SparkSession, rows=S.DEFAULT_POLICIES) -> DataFrame:
    """Policies are rows: a new source type needs a row, not code."""
    return spark.createDataFrame([*rows], S.POLICIES)


def order_key(generation, processing_order, source_type, record_ord):
    """A text that sorts by generation, policy, type and input order."""
    return F.concat_ws("|", F.format_string("%06d", generation), F.format_string("%06d", processing_order), source_type, F.format_string("%020d", record_ord))


def own_links(records: DataFrame) -> DataFrame:
    """Links of records that each are their own transaction."""
    return records.select(ids.transaction_id().alias("transaction_id"), "source_record_id", F.lit("authoritative").alias("role"), F.format_string("%020d", F.col("record_ord")).alias("link_ord"))


def rebuild_transactions(records: DataFrame, links: DataFrame) -> DataFrame:
    """Transactions with the facts of their authoritative record; txn_ord is the first link's order."""
    first = links.groupBy("transaction_id").agg(F.min("link_ord").alias("txn_ord"))
    facts = records.select("source_record_id", "source_type", "transaction_type", "transaction_date", "amount", "currency", "description")
    chief = links.where("role = 'authoritative'").select("transaction_id", "source_record_id")
    return chief.join(facts, "source_record_id").join(first, "transaction_id")


def recover_authority(records: DataFrame, links: DataFrame, policy: DataFrame) -> DataFrame:
    """Links in which every transaction without an authority has promoted its best record:
    by policy order, then link order."""
    ranked = links.join(records.select("source_record_id", "source_type"), "source_record_id").join(policy.select("source_type", "processing_order"), "source_type")
    best = ranked.groupBy("transaction_id").agg(F.max((F.col("role") == "authoritative").cast("int")).alias("has"), F.min(F.struct("processing_order", "link_ord", "source_record_id"))["source_record_id"].alias("best"))
    best = best.where("has = 0").select("transaction_id", "best")
    promoted = links.join(best, "transaction_id", "left")
    return promoted.select("transaction_id", "source_record_id", F.when(F.col("best") == F.col("source_record_id"), "authoritative").otherwise(F.col("role")).alias("role"), "link_ord")


def islands(records: DataFrame, days: int = S.MATCH_WINDOW_DAYS) -> DataFrame:
    """Each record with its island: records of one type, currency and amount whose dates
    follow with gaps of ``days`` at most. The window reads different dates only, so a
    frequent amount has no more rows in it than there are days."""
    block = ["transaction_type", "currency", "amount"]
    dates = records.select(*block, "transaction_date").distinct()
    order = Window.partitionBy(*block).orderBy("transaction_date")
    fresh = F.coalesce(F.datediff("transaction_date", F.lag("transaction_date").over(order)) > days, F.lit(True))
    numbered = dates.withColumn("_new", fresh.cast("int")).withColumn("_no", F.sum("_new").over(order))
    island = F.concat_ws("|", F.lit("i:"), "transaction_type", "currency", F.col("amount").cast("string"), F.col("_no").cast("string"))
    return records.join(numbered.select(*block, "transaction_date", island.alias("island")), [*block, "transaction_date"])


def reconcile_candidates(records: DataFrame, transactions: DataFrame, days: int = S.MATCH_WINDOW_DAYS) -> DataFrame:
    """Pairs of a record and a transaction with the same type, currency and amount, within
    ``days``, whose merchants don't contradict. Days are dealt into buckets, of which a
    record looks at three; merchant columns are record_merchant and transaction_merchant."""
    bucket = lambda d: F.expr(f"cast(floor(datediff({d}, date'1970-01-01') / {days + 1}) as int)")
    r = records.select("*", F.explode(F.array(*[bucket("transaction_date") + k for k in (-1, 0, 1)])).alias("_bucket"))
    t = transactions.select("transaction_id", "transaction_type", "currency", "amount", F.col("transaction_date").alias("other_date"), "transaction_merchant", bucket("transaction_date").alias("_bucket"))
    pairs = r.join(t, ["transaction_type", "currency", "amount", "_bucket"]).withColumn("day_distance", F.abs(F.datediff("transaction_date", "other_date"))).where(F.col("day_distance") <= days)
    match = F.col("record_merchant") == F.col("transaction_merchant")
    return pairs.where(F.coalesce(match, F.lit(True))).select("source_record_id", "transaction_id", "day_distance", match.alias("merchant_match"))


_FOLDED = "kind string, transaction_id string, source_record_id string, role string, link_ord string, action string, day_distance int, merchant_match boolean, identity_match boolean, detail string"
#: Transactions and undecided records that a fold holds before it looks for what is settled.
HELD = 2_000


class _Held:
    """A transaction that may still change: its links, and the facts of its authority."""

    __slots__ = ("links", "block", "day", "source_type", "record_hint", "hint", "known_as", "since", "until", "unread", "pending")

    def __init__(self, unread: int):
        self.links: dict[str, list] = {}  # record -> [role, order]
        self.block = self.day = self.source_type = self.record_hint = self.hint = self.known_as = self.since = self.until = None
        self.unread, self.pending = unread, 0


def _id(txn) -> str:
    """The transaction's id, of one with several places too."""
    return txn if isinstance(txn, str) else txn[0]


class _Fold:
    """Decides on the records of one component while they come by date.

    Decisions are made in processing order, which is not that of the dates. A decision reads
    transactions within ``days`` of its record, and another one can change those only if its
    own record is within twice as many days, or linked to one of them. So a record is decided once
    all rows up to twice ``days`` after it have come, all rows linked to what it may join, and no
    record before it in order waits so near. A transaction that no row can reach any more
    is given out and forgotten."""

    def __init__(self, days: int, generation: int, out: list[tuple]):
        self.days, self.generation, self.out = days, generation, out
        self.waiting: list[tuple] = []  # order, row
        self.txns: dict[str, _Held] = {}
        self.at: dict[tuple, dict[str | None, dict[str, None]]] = {}  # block and day -> merchant -> transactions
        self.tied = 0  # transactions of which a link has not come yet, or waits
        self.created: set[str] = set()  # of the transactions that several records could create
        self.unread: dict[str, int] = {}  # of these, how many of the records have not come
        self.most = HELD
        self.front = None

    def add(self, r: dict):
        """The next row by date."""
        day = r["transaction_date"].toordinal()
        if self.front is not None and day > self.front and len(self.waiting) + len(self.txns) > self.most:
            self._settle(day)
            self.most = max(HELD, 2 * (len(self.waiting) + len(self.txns)))
        self.front = day
        r["day"] = day
        if r.get("phase") is not None:
            self._stand(r)
            return
        txn = r["link_transaction"]
        if txn is not None:
            t = self.txns.get(txn)
            if t is None:
                t = self.txns[txn] = _Held(r["txn_rows"])
                self.tied += 1
            t.unread -= 1
            t.hint = r["transaction_hint"] if r["transaction_hint"] is not None else t.hint
            t.links[r["source_record_id"]] = [r["role"], r["link_ord"]]
            if r["role"] == "authoritative":
                self._place(txn, t, r)
            self.tied -= t.unread == 0
            if not r["takes_authority"]:
                self._decided(r, txn, "reused", None, None, True)
                return
            t.pending += 1
            self.tied += 1
        elif r["target_rows"] > 1:
            self.unread[r["target"]] = self.unread.get(r["target"], r["target_rows"]) - 1
        self.waiting.append(((r["processing_order"], r["source_type"], r["record_ord"], r["source_record_id"]), r))

    def _stand(self, r: dict):
        """A place where a linked transaction stands while decisions come from one in order to another; its links are known."""
        txn = (r["link_transaction"], r["phase"])
        t = self.txns[txn] = _Held(0)
        t.hint = r["transaction_hint"]
        t.since, t.until = (o and tuple(o.values()) for o in (r["since"], r["until"]))
        self._place(txn, t, r)

    def finish(self):
        self._settle(None)

    def _decided(self, r, txn, action, distance, match, same):
        self.out.append(("decision", txn, r["source_record_id"], None, None, action, distance, match, same, None))

    def _conflict(self, r, txn, detail):
        self.out.append(("conflict", txn, r["source_record_id"], None, None, None, None, None, None, detail))

    def _place(self, txn: str, t: _Held, r: dict):
        self._leave(txn, t)
        t.block, t.day, t.source_type, t.record_hint = r["block"], r["day"], r["source_type"], r["record_hint"]
        t.known_as = t.hint or t.record_hint
        self.at.setdefault((t.block, t.day), {}).setdefault(t.known_as, {})[txn] = None

    def _leave(self, txn: str, t: _Held):
        if t.block is None:
            return
        at = self.at[t.block, t.day]
        at[t.known_as].pop(txn, None)
        if not at[t.known_as]:
            del at[t.known_as]
        if not at:
            del self.at[t.block, t.day]

    def _near(self, r: dict):
        """Transactions within reach whose merchant doesn't contradict the record's."""
        hint = r["record_hint"]
        for day in range(r["day"] - self.days, r["day"] + self.days + 1):
            at = self.at.get((r["block"], day))
            if at is not None:
                for txns in at.values() if hint is None else [at[h] for h in (hint, None) if h in at]:
                    yield from txns

    def _take_authority(self, txn: str, t: _Held, r: dict):
        for record, link in t.links.items():
            link[0] = "authoritative" if record == r["source_record_id"] else "supporting"
        self._place(txn, t, r)

    def _decide(self, r: dict):
        record, txn = r["source_record_id"], r["link_transaction"]
        if txn is not None:
            t = self.txns[txn]
            t.pending -= 1
            self.tied -= 1
            self._take_authority(txn, t, r)
            self._decided(r, txn, "reused", None, None, True)
            return
        found, now = [], (r["processing_order"], r["source_type"], r["record_ord"], record)
        for txn in self._near(r):
            t = self.txns[txn]
            if r["candidate_scope"] != "any" and t.source_type != r["candidate_scope"]:
                continue
            if t.since is not None and now < t.since or t.until is not None and now > t.until:
                continue
            found.append((txn, abs(t.day - r["day"]), None if r["record_hint"] is None or t.known_as is None else True))
        sure = found if len(found) == 1 else [c for c in found if c[2]]
        order = f"{self.generation:06d}|{r['processing_order']:06d}|{r['source_type']}|{r['record_ord']:020d}"
        if len(sure) == 1:
            txn, distance, match = sure[0]
            t = self.txns[txn]
            t.links[record] = ["supporting", order]
            if r["takes_authority"]:
                self._take_authority(txn, t, r)
            self._decided(r, _id(txn), "matched", distance, match, False)
        elif found and r["on_ambiguous"] == "fail":
            self._conflict(r, None, "several transactions match: " + ", ".join(sorted(_id(c[0]) for c in found)))
        elif r["target_linked"] or r["target"] in self.created:
            self._conflict(r, r["target"], "the new transaction's id is in use")
        else:
            if r["target_rows"] > 1:
                self.created.add(r["target"])
            t = self.txns[r["target"]] = _Held(0)
            t.links[record] = ["authoritative", order]
            self._place(r["target"], t, r)
            self._decided(r, r["target"], r["override_action"] or "created", None, None, r["override_action"] == "reused")

    def _settle(self, front: int | None):
        """Decide what can be decided now that all rows before the day ``front`` have come, or all rows."""
        self.waiting.sort(key=lambda e: e[0])
        reach, near, stuck, left = 2 * self.days, set(), set(), []
        for event in self.waiting:
            r = event[1]
            t = self.txns.get(r["link_transaction"])
            places = [(r["block"], r["day"])] + ([(t.block, t.day)] if t is not None and t.block is not None else [])
            if t is not None:
                waits = t.unread > 0 or r["link_transaction"] in stuck
            else:
                waits = self.unread.get(r["target"], 0) > 0 or r["target"] in stuck or (self.tied or self.created) and any(self.txns[x].unread > 0 or x in stuck for x in self._near(r))
            if front is not None and (waits or any(day + reach >= front or (block, day) in near for block, day in places)):
                near.update((block, d) for block, day in places for d in range(day - reach, day + reach + 1))
                stuck.add(r["link_transaction"] or r["target"])
                left.append(event)
            else:
                self._decide(r)
        self.waiting = left
        reached = {(r["block"], d) for _, r in left if r["link_transaction"] is None for d in range(r["day"] - self.days, r["day"] + self.days + 1)}
        for txn in [*self.txns]:
            t = self.txns[txn]
            if front is None or not t.unread and not t.pending and (t.block is None or t.day + self.days < front and (t.block, t.day) not in reached):
                self.out += [("link", _id(txn), record, role, order, None, None, None, None, None) for record, (role, order) in t.links.items()]
                self._leave(txn, t)
                del self.txns[txn]


def _folded(days: int, generation: int):
    names = [c.split()[0] for c in _FOLDED.split(", ")]
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in _FOLDED.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        now, fold, out = None, None, []
        for b in batches:
            for r in b.to_pylist():
                if r["component"] != now:
                    if fold is not None:
                        fold.finish()
                    now, fold = r["component"], _Fold(days, generation, out)
                fold.add(r)
                if len(out) > 10_000:
                    yield batch(out)
                    out.clear()
        if fold is not None:
            fold.finish()
        if out:
            yield batch(out)

    return run


def meeting_islands(rows: DataFrame, days: int = S.MATCH_WINDOW_DAYS) -> DataFrame:
    """(block, transaction_date, island, meets) of the blocks that have an unlinked record.

    Two days are in one island if an unlinked record of one could look at a record of the other, by
    its policy's scope, or if such a pair spans them. ``rows`` has block, source_type, candidate_scope
    and ``open`` (unlinked). ``meets`` says that there is such a pair in the island. Everything here
    is about different days, of which a frequent amount has no more than the calendar."""
    nodes = rows.groupBy("block", "transaction_date", "source_type", "candidate_scope").agg(F.bool_or("open").alias("open"), F.count("*").alias("n"))
    nodes = nodes.join(nodes.where("open").select("block").distinct(), "block", "left_semi")
    bucket = lambda k=0: F.expr(f"cast(floor(datediff(transaction_date, date'1970-01-01') / {days + 1}) as int) + {k}")
    looks = nodes.where("open").select("block", F.col("transaction_date").alias("mine"), "candidate_scope", F.col("source_type").alias("my_type"), F.explode(F.array(*map(bucket, (-1, 0, 1)))).alias("bucket"))
    seen = nodes.select("block", F.col("transaction_date").alias("theirs"), "source_type", "n", bucket().alias("bucket"))
    pairs = looks.join(seen, ["block", "bucket"]).where(F.abs(F.datediff("mine", "theirs")) <= days).where("candidate_scope = 'any' or candidate_scope = source_type")
    pairs = pairs.where("n > 1 or mine <> theirs or my_type <> source_type")
    spans = pairs.groupBy("block", F.least("mine", "theirs").alias("transaction_date")).agg(F.max(F.greatest("mine", "theirs")).alias("far"))
    dates = nodes.select("block", "transaction_date").distinct().join(spans, ["block", "transaction_date"], "left")
    order = Window.partitionBy("block").orderBy("transaction_date")
    reached = F.max(F.coalesce("far", "transaction_date")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = dates.withColumn("no", F.sum(F.coalesce((reached < F.col("transaction_date")).cast("int"), F.lit(1))).over(order))
    meets = F.max(F.col("far").isNotNull()).over(Window.partitionBy("block", "no"))
    return numbered.select("block", "transaction_date", F.concat_ws("|", F.lit("i:"), "block", F.col("no").cast("string")).alias("island"), meets.alias("meets"))


_ORDER = ("processing_order", "source_type", "record_ord", "source_record_id")


def _places(linked: DataFrame, policy: DataFrame) -> DataFrame:
    """Where linked transactions stand: (block, transaction_date, source_type, record_hint) of the record that is the authority, with
    the part of the order (``since``, ``until``; null without an end) in which decisions meet them there.

    A linked record that takes authority does so at its place in the order, whatever was decided before. So each such record
    begins a part of its own, and no decision on one part can touch another; that keeps islands apart that
    would only share a transaction. Where the authority alone would take it back, and no record that takes authority
    may look at its kind, there is one part."""
    looked = policy.where("takes_authority").select(F.col("candidate_scope").alias("scope"))
    kinds = policy.where("takes_authority").join(F.broadcast(looked), F.expr("scope = 'any' or scope = source_type"), "left_semi").select("source_type").distinct()
    turning = linked.where("takes_authority").join(F.broadcast(kinds.withColumn("_looked", F.lit(True))), "source_type", "left").where("role <> 'authoritative' or _looked")
    parted = linked.join(turning.select("link_transaction").distinct(), "link_transaction", "left_semi")
    whole = linked.where("role = 'authoritative'").join(turning.select("link_transaction").distinct(), "link_transaction", "left_anti")
    now = F.struct(*_ORDER)
    none = F.lit(None).cast("struct<processing_order:int,source_type:string,record_ord:bigint,source_record_id:string>")
    turn = Window.partitionBy("link_transaction").orderBy(*_ORDER)
    taking = parted.where("takes_authority").withColumns({"phase": F.row_number().over(turn), "since": now, "until": F.lead(now).over(turn)})
    first = taking.where("phase = 1").select("link_transaction", F.col("since").alias("until"))
    begun = parted.where("role = 'authoritative'").join(first, "link_transaction").withColumns({"phase": F.lit(0), "since": none}).select(*taking.columns)
    return taking.union(begun).union(whole.withColumns({"phase": F.lit(0), "since": none, "until": none}).select(*taking.columns))


def reconcile(records: DataFrame, links: DataFrame, policy: DataFrame, hints: DataFrame | None = None, transaction_hints: DataFrame | None = None, overrides: DataFrame | None = None, generation: int = 1) -> DataFrame:
    """Decide for each record whether it joins a transaction or founds one.

    Returns links, decisions and conflicts in one table, tagged by ``kind``. A decision
    reads only records that it could look at, and places of transactions (``_places``), in islands of days; so
    these are decided independently, but for records that would found one transaction. Linked records pass as they are,
    and unlinked records that no other record could look at, or be seen
    by, found their transactions, both in plain projections. The others are folded
    by date, with what is out of reach forgotten (``_Fold``). The last record that took a transaction's authority has it in the end.
    ``hints`` is (source_record_id, merchant), ``transaction_hints`` (transaction_id,
    merchant), ``overrides`` (source_record_id, transaction_id, action).
    """
    spark = records.sparkSession
    hints = hints if hints is not None else spark.createDataFrame([], "source_record_id string, merchant string")
    transaction_hints = transaction_hints if transaction_hints is not None else spark.createDataFrame([], "transaction_id string, merchant string")
    overrides = overrides if overrides is not None else spark.createDataFrame([], "source_record_id string, transaction_id string, action string")
    rows = records.join(links.select("source_record_id", F.col("transaction_id").alias("link_transaction"), "role", "link_ord"), "source_record_id", "left")
    rows = rows.join(policy, "source_type").join(hints.withColumnRenamed("merchant", "record_hint"), "source_record_id", "left")
    rows = rows.join(overrides.select("source_record_id", F.col("transaction_id").alias("override_transaction"), F.col("action").alias("override_action")), "source_record_id", "left")
    rows = rows.withColumn("open", F.col("link_transaction").isNull()).withColumn("target", F.when(F.col("open"), F.coalesce("override_transaction", ids.transaction_id())))
    block = F.concat_ws("|", "transaction_type", "currency", F.col("amount").cast("string"))
    rows = rows.select("source_record_id", "source_type", block.alias("block"), "transaction_date", "record_ord", "link_transaction", "role", "link_ord", "processing_order", "takes_authority", "candidate_scope", "on_ambiguous", "record_hint", "override_action", "open", "target")
    every = materialize(rows, "records")
    linked = every.where("not open")
    blocks = materialize(every.where("open").select("block").distinct(), "blocks")
    rows = _places(linked, policy).join(blocks, "block", "left_semi").unionByName(every.where("open"), allowMissingColumns=True)
    places = materialize(rows, "places")
    rows = places.join(meeting_islands(places), ["block", "transaction_date"], "left").withColumn("meets", F.coalesce("meets", F.lit(False))).where("open or meets")
    rows = rows.withColumn("island", F.coalesce("island", F.concat_ws("|", F.lit("d:"), "block", F.col("transaction_date").cast("string"))))
    known = links.select(F.col("transaction_id").alias("target"), F.lit(True).alias("target_linked")).distinct()
    named = overrides.select(F.col("transaction_id").alias("target")).distinct()
    shared = rows.where("open").join(named, "target", "left_semi").groupBy("target").agg(F.count("*").cast("int").alias("target_rows")).where("target_rows > 1")
    opened = rows.where("open").join(known, "target", "left").join(shared, "target", "left")
    rows = rows.where("not open").withColumns({"target_linked": F.lit(None).cast("boolean"), "target_rows": F.lit(None).cast("int")}).unionByName(opened)
    rows = materialize(rows.withColumns({"target_linked": F.coalesce("target_linked", F.lit(False)), "target_rows": F.coalesce("target_rows", F.lit(1))}), "islands")
    discard(places, blocks)
    none = lambda t: F.lit(None).cast(t)
    link = lambda txn, role, order: [F.lit("link").alias("kind"), F.col(txn).alias("transaction_id"), "source_record_id", F.lit(role).alias("role") if role else F.col("role"), order.alias("link_ord"), none("string").alias("action"), none("int").alias("day_distance"), none("boolean").alias("merchant_match"), none("boolean").alias("identity_match"), none("string").alias("detail")]
    decision = lambda txn, action, same: [F.lit("decision").alias("kind"), F.col(txn).alias("transaction_id"), "source_record_id", none("string").alias("role"), none("string").alias("link_ord"), action.alias("action"), none("int").alias("day_distance"), none("boolean").alias("merchant_match"), same.alias("identity_match"), none("string").alias("detail")]
    alone = F.col("open") & ~F.col("meets") & (F.col("target_rows") == 1)
    founders = rows.where(alone & ~F.col("target_linked"))
    action = F.coalesce("override_action", F.lit("created"))
    direct = founders.select(*link("target", "authoritative", order_key(F.lit(generation), F.col("processing_order"), F.col("source_type"), F.col("record_ord")))).union(founders.select(*decision("target", action, action == "reused")))
    direct = direct.union(rows.where(alone & F.col("target_linked")).select(F.lit("conflict").alias("kind"), F.col("target").alias("transaction_id"), "source_record_id", none("string"), none("string"), none("string"), none("int"), none("boolean"), none("boolean"), F.lit("the new transaction's id is in use")))
    rest = rows.where(~alone)
    edges = rest.where("open and target_rows > 1").select("island", F.concat(F.lit("t:"), "target").alias("txn")).distinct()
    groups = connected_components(edges.select(F.col("island").alias("src"), F.col("txn").alias("dst")))
    rest = rest.join(groups.select(F.col("node").alias("island"), F.col("root").alias("component")), "island", "left").withColumn("component", F.coalesce("component", "island"))
    dealt = rest.join(transaction_hints.select(F.col("transaction_id").alias("link_transaction"), F.col("merchant").alias("transaction_hint")), "link_transaction", "left")
    dealt = dealt.drop("island", "meets", "open", "role", "link_ord").withColumn("txn_rows", F.lit(0))
    dealt = dealt.repartition("component").sortWithinPartitions("component", "transaction_date", "processing_order", "source_type", "record_ord")
    decided = materialize(dealt.mapInArrow(_folded(S.MATCH_WINDOW_DAYS, generation), _FOLDED), "decided")
    # the authority of each transaction that has moved: who took it last
    joined = decided.where("kind = 'decision' and action = 'matched'").select("source_record_id", F.col("transaction_id").alias("link_transaction")).join(rest.where("open and takes_authority").select(*_ORDER), "source_record_id")
    moved = joined.select("link_transaction").union(linked.where("takes_authority and role <> 'authoritative'").select("link_transaction")).distinct()
    took = linked.where("takes_authority").join(moved, "link_transaction", "left_semi").select("link_transaction", *_ORDER).union(joined.select("link_transaction", *_ORDER))
    chiefs = took.groupBy("link_transaction").agg(F.max_by("source_record_id", F.struct(*_ORDER)).alias("chief")).withColumnRenamed("link_transaction", "transaction_id")
    tied = linked.select(*link("link_transaction", None, F.col("link_ord"))).union(decided.where("kind = 'link'"))
    tied = tied.join(chiefs, "transaction_id", "left").withColumn("role", F.when(F.col("chief").isNull(), F.col("role")).when(F.col("chief") == F.col("source_record_id"), "authoritative").otherwise("supporting"))
    names = [c.split()[0] for c in _FOLDED.split(", ")]
    same = linked.select(*decision("link_transaction", F.lit("reused"), F.lit(True)))
    result = gather([tied.select(*names), same.union(direct).union(decided.where("kind <> 'link'"))], "reconciled")
    discard(every, rows, decided)
    return result


def links_of(result: DataFrame) -> DataFrame:
    return result.where("kind = 'link'").select("transaction_id", "source_record_id", "role", "link_ord")


def decisions_of(result: DataFrame) -> DataFrame:
    return result.where("kind = 'decision'").select("source_record_id", "transaction_id", "action", "identity_match", "day_distance", "merchant_match")


def conflicts_of(result: DataFrame) -> DataFrame:
    return result.where("kind = 'conflict'").select("source_record_id", "transaction_id", "detail")


def reconsider(records: DataFrame, links: DataFrame, changed: DataFrame, policy: DataFrame, hints: DataFrame | None = None, transaction_hints: DataFrame | None = None, generation: int = 1) -> DataFrame:
    """Drop the links of the changed records (source_record_id) and decide on them anew.
    If such a record's old transaction lives on, the record may only found its split id;
    else it gets the old id back."""
    dropped = links.join(changed.select("source_record_id"), "source_record_id")
    kept = links.join(changed.select("source_record_id"), "source_record_id", "left_anti")
    kept = materialize(recover_authority(records, kept, policy), "links")
    alive = kept.select("transaction_id").distinct().withColumn("alive", F.lit(True))
    old = dropped.select("source_record_id", "transaction_id").join(alive, "transaction_id", "left")
    overrides = old.select(
        "source_record_id", F.when(F.col("alive"), ids.split_transaction_id(F.col("source_record_id"), F.col("transaction_id"))).otherwise(F.col("transaction_id")).alias("transaction_id"), F.when(F.col("alive"), "created").otherwise("reused").alias("action"),
    )
    overrides = materialize(overrides, "overrides")
    result = reconcile(records, kept, policy, hints, transaction_hints, overrides, generation)
    discard(kept, overrides)
    return result


def merchant_hints(records: DataFrame, description_map: DataFrame, enrichments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is known of merchants: by record, from the map, for expenses only; by transaction, from its enrichment."""
    known = description_map.select("description", "merchant").where("merchant is not null").dropDuplicates(["description"])
    of_records = records.where("transaction_type = 'expense'").select("source_record_id", "description").join(known, "description").select("source_record_id", "merchant")
    return of_records, enrichments.where("merchant_name is not null").select("transaction_id", F.col("merchant_name").alias("merchant"))


def sync(records: DataFrame, links: DataFrame, policy: DataFrame, decisions: DataFrame, hints: DataFrame | None = None, transaction_hints: DataFrame | None = None, changed: DataFrame | None = None, generation: int = 1):
    """One run over all evidence: drop links whose record is gone, give transactions without
    an authority one, reconcile, drop decisions whose transaction is gone. With ``changed``
    (source_record_id), those records are decided on anew. Returns the result of ``reconcile``, the
    kept decisions, and one row of counts."""
    present = links.join(records.select("source_record_id"), "source_record_id", "left_semi")
    # what several steps read is written first, so that its shuffles aren't on disk beside theirs
    hints, transaction_hints = (None if h is None else materialize(h, "hints") for h in (hints, transaction_hints))
    if changed is None:
        authorised = materialize(recover_authority(records, present, policy), "links")
        result = reconcile(records, authorised, policy, hints, transaction_hints, generation=generation)
        discard(authorised)
    else:
        result = reconsider(records, present, changed, policy, hints, transaction_hints, generation)
    discard(hints, transaction_hints)
    kept = decisions.join(links_of(result).select("transaction_id").distinct(), "transaction_id", "left_semi")
    counts = decisions_of(result).agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("created", "matched", "reused")])
    transactions = links_of(result).agg(F.countDistinct("transaction_id").alias("transactions"))
    return result, kept, records.agg(F.count("*").alias("records")).crossJoin(transactions).crossJoin(counts)
