"""Changes to durable tables given as tables of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from purseflow.functions import ids
from purseflow.functions.text import optional

FIELDS = ("merchant_override", "category_override", "note")


def apply_decision_patches(decisions: DataFrame, patches: DataFrame) -> DataFrame:
    """Three-state patches (seq, transaction_id, set_x, x): a field that isn't set keeps its
    value, a set one takes the latest patch's, null included; a row without a value goes."""
    last = [F.max_by(F.struct(optional(f).alias("v")), F.when(F.col(f"set_{f}"), F.col("seq"))).alias(f"_{f}") for f in FIELDS]
    new = patches.groupBy("transaction_id").agg(*last, *[F.max(F.col(f"set_{f}").cast("int")).alias(f"_has_{f}") for f in FIELDS])
    rows = decisions.join(new, "transaction_id", "full_outer")
    merged = rows.select("transaction_id", *[F.when(F.col(f"_has_{f}") == 1, F.col(f"_{f}.v")).otherwise(F.col(f)).alias(f) for f in FIELDS])
    return merged.where("coalesce(" + ", ".join(FIELDS) + ") is not null")


def apply_manual_changes(evidence: DataFrame, changes: DataFrame, linked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Manual evidence after changes (seq, op create, correct or delete, and the columns of evidence), applied
    in order; and each change with ``refused``, null where it was applied.

    Creating what exists and changing what doesn't are refused, and so is changing an entry that
    is there from before and not in ``linked`` (id), as it waits for its first sync. Whether another entry
    exists before a change is what the last create or delete before it says, refused or not: after
    the one it exists in any case, after the other it doesn't. So no change needs the outcome of another."""
    columns = evidence.columns
    ops = changes.select("seq", "op", *columns)
    own = Window.partitionBy("id").orderBy("seq")
    pending = evidence.select("id") if linked is None else evidence.select("id").join(linked.select("id").distinct(), "id", "left_anti")
    pending = pending.limit(0) if linked is None else pending
    rows = ops.join(evidence.select("id", F.lit(True).alias("_was")), "id", "left").join(pending.select("id", F.lit(True).alias("_waits")), "id", "left")
    turned = F.last(F.when(F.col("op").isin("create", "delete"), F.col("op") == "create"), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    exists = F.coalesce(turned, F.col("_was"), F.lit(False))
    waits = F.coalesce("_waits", F.lit(False))
    creates = F.col("op") == "create"
    refused = (
        F.when(~F.coalesce(F.col("op").isin("create", "correct", "delete"), F.lit(False)), "no such change").when(creates & (exists | waits), "already exists")
        .when(~creates & waits, "waits for its first sync").when(~creates & ~exists, "does not exist")
    )
    judged = rows.withColumn("refused", refused).drop("_was", "_waits")
    last = judged.where("refused is null").groupBy("id").agg(F.max_by(F.struct("op", *[c for c in columns if c != "id"]), "seq").alias("_last"))
    merged = evidence.join(last, "id", "left").where("_last is null").select(*columns)
    new = last.where("_last.op <> 'delete'").select("id", *[F.col(f"_last.{c}").alias(c) for c in columns if c != "id"]).select(*columns)
    return merged.unionByName(new), judged


def decisions_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: whether two tables of decisions differ in any row, repeats counted."""
    after = after.select(*before.columns)
    return before.exceptAll(after).union(after.exceptAll(before)).agg((F.count("*") > 0).alias("changed"))


def merged_in_order(pages: DataFrame, key: str, order: str) -> DataFrame:
    """Pages of a list as one list: of repeated keys the first by ``order`` stays in its place."""
    own = Window.partitionBy(key).orderBy(order)
    return pages.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n").orderBy(order)


def manual_record_id(id_: str = "id"):
    return ids.source_record_id(F.lit("manual"), F.col(id_), F.lit("entry"))


def corrected_records(judged: DataFrame, links: DataFrame) -> DataFrame:
    """(source_record_id) of linked entries whose changes were corrections only; an entry that
    was deleted and created again is new."""
    kept = judged.where("refused is null").groupBy("id").agg(F.bool_and(F.col("op") == "correct").alias("only")).where("only")
    return kept.select(manual_record_id().alias("source_record_id")).join(links.select("source_record_id"), "source_record_id", "left_semi")


def renewed_records(judged: DataFrame, links: DataFrame) -> DataFrame:
    """(source_record_id) of linked entries that were deleted, and created again or not: their links go."""
    gone = judged.where("refused is null and op = 'delete'").select(manual_record_id().alias("source_record_id")).distinct()
    return gone.join(links.select("source_record_id"), "source_record_id", "left_semi")


def manual_outcome(judged: DataFrame, before: DataFrame, after: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per change (seq): its transaction and what became of it: the decision's action of the entry as it is in
    the end, transaction removed or kept for a deletion, conflict where no decision could be made, or why it was refused.
    ``before`` and ``after`` are links."""
    own = judged.withColumn("source_record_id", manual_record_id())
    old = before.select("source_record_id", F.col("transaction_id").alias("_old"))
    alive = after.select(F.col("transaction_id").alias("_old"), F.lit(True).alias("_alive")).distinct()
    new = decisions.select("source_record_id", F.col("transaction_id").alias("_new"), "action")
    rows = own.join(old, "source_record_id", "left").join(alive, "_old", "left").join(new, "source_record_id", "left")
    gone = F.when(F.col("_alive"), "transaction kept").otherwise("transaction removed")
    outcome = F.when(F.col("refused").isNotNull(), F.concat(F.lit("refused: "), F.col("refused"))).when(F.col("op") == "delete", gone).otherwise(F.coalesce("action", F.lit("conflict")))
    return rows.select("seq", "id", "op", F.when(F.col("refused").isNull(), F.when(F.col("op") == "delete", F.col("_old")).otherwise(F.col("_new"))).alias("transaction_id"), outcome.alias("outcome"))


def feedback_latest(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Each item with its latest status (``changes`` is seq, id, status), and how many of its
    changes did change it; repeating the status is no change."""
    first = items.select("id", F.lit(-1).cast("long").alias("seq"), "status")
    rows = first.unionByName(changes.join(items.select("id"), "id", "left_semi").select("id", F.col("seq").cast("long").alias("seq"), "status"))
    order = Window.partitionBy("id").orderBy("seq")
    rows = rows.withColumn("_new", F.col("status") != F.lag("status").over(order))
    latest = rows.groupBy("id").agg(F.max_by("status", "seq").alias("status"), F.count_if("_new").alias("changes"))
    return items.drop("status").join(latest, "id")


def feedback_list(items: DataFrame) -> DataFrame:
    return items.orderBy(F.desc("created_at"), "id")
