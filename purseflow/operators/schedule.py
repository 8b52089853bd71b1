"""Monthly scheduled entries: expansion, due runs, views and changes of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purseflow.functions import dates, ids


def expand_schedule(rules: DataFrame, as_of: Column) -> DataFrame:
    """Every monthly occurrence of the enabled rules up to ``as_of``, with its id."""
    due = rules.where("enabled").withColumn("occurrence_date", F.explode(dates.occurrences("first_occurrence_date", as_of)))
    due = due.withColumn("occurrence_id", ids.occurrence_id(F.col("id"), F.col("occurrence_date")))
    return due.select(F.col("id").alias("rule_id"), "occurrence_id", "occurrence_date", "type", "amount", "currency", "description", "note")


def with_record_id(occurrences: DataFrame) -> DataFrame:
    return occurrences.withColumn("source_record_id", ids.source_record_id(F.lit("manual"), F.col("occurrence_id"), F.lit("entry")))


def pending(occurrences: DataFrame, execution: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """Occurrences that aren't linked yet or come after the rule's cursor; whether they
    have evidence and a link.

    Evidence and links grow with the occurrences, of which a rule has many: as the planner doesn't count those
    before they are there and would broadcast them, the joins are merges."""
    rows = with_record_id(occurrences).join(execution.select("rule_id", F.col("last_processed_occurrence_date").alias("cursor")).hint("merge"), "rule_id", "left")
    rows = rows.join(evidence.select(F.col("id").alias("occurrence_id"), F.lit(True).alias("has_evidence")).hint("merge"), "occurrence_id", "left")
    rows = rows.join(links.select("source_record_id", F.col("transaction_id").alias("linked_transaction")).hint("merge"), "source_record_id", "left")
    rows = rows.withColumn("has_evidence", F.coalesce("has_evidence", F.lit(False)))
    return rows.where("linked_transaction is null or cursor is null or occurrence_date > cursor")


def new_evidence(due: DataFrame) -> DataFrame:
    return due.where("not has_evidence").select(F.col("occurrence_id").alias("id"), "type", "occurrence_date", "amount", "currency", "description")


def due_actions(due: DataFrame, sync_decisions: DataFrame | None) -> DataFrame:
    """What became of each pending occurrence: by this run's sync if one ran, else
    recovered if it was linked before, else reused. A sync runs for all if any occurrence
    is new, so ``sync_decisions`` (source_record_id, transaction_id, action) is of the run."""
    if sync_decisions is None:
        return due.withColumn("transaction_id", F.col("linked_transaction")).withColumn("action", F.when(F.col("linked_transaction").isNotNull(), "recovered").otherwise("reused"))
    return due.join(sync_decisions.select("source_record_id", "transaction_id", "action").hint("merge"), "source_record_id", "left").withColumn("transaction_id", F.coalesce("transaction_id", "linked_transaction"))


def next_execution(actions: DataFrame, execution: DataFrame) -> DataFrame:
    """Execution rows after the run: the latest occurrence with its metadata; a cursor never goes back."""
    last = actions.groupBy("rule_id").agg(F.max_by(F.struct("occurrence_date", "source_record_id", "transaction_id", "action"), "occurrence_date").alias("x"))
    rows = execution.join(last.hint("merge"), "rule_id", "full_outer")
    pick = lambda new, old: F.coalesce(F.col(f"x.{new}"), F.col(old)).alias(old)
    return rows.select(
        "rule_id", F.greatest(F.col("x.occurrence_date"), F.col("last_processed_occurrence_date")).alias("last_processed_occurrence_date"),
        pick("source_record_id", "last_source_record_id"), pick("transaction_id", "last_transaction_id"), pick("action", "last_action"),
    )


def note_patches(actions: DataFrame) -> DataFrame:
    """Notes of rules for transactions of new evidence and of occurrences unlinked before."""
    rows = actions.where("note is not null and (not has_evidence or linked_transaction is null) and transaction_id is not null")
    return rows.select("transaction_id", F.lit(True).alias("set_note"), "note")


def schedule_view(rules: DataFrame, execution: DataFrame) -> DataFrame:
    rows = rules.join(execution.withColumnRenamed("rule_id", "id"), "id", "left")
    return rows.withColumn("next_occurrence_date", dates.next_occurrence("first_occurrence_date", "last_processed_occurrence_date")).orderBy("next_occurrence_date", "description")


def in_view_order(view: DataFrame) -> DataFrame:
    """Rules as they are shown: by next date, then description."""
    return view.orderBy("next_occurrence_date", "description", "id")


def in_run_order(occurrences: DataFrame) -> DataFrame:
    """Due occurrences as they are run: by the rule's first date, its id, then by date."""
    return occurrences.orderBy("first_occurrence_date", "rule_id", "occurrence_date")


def schedule_totals(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("paused"))


def apply_rule_changes(rules: DataFrame, execution: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules, execution, rejected) after changes (op create, update or delete, and a rule's
    columns). A deleted rule takes its execution row along; an updated first date must be
    after the cursor; creating a known id or changing an unknown one is rejected."""
    known = rules.select("id", F.lit(True).alias("_known"))
    rows = changes.join(known, "id", "left").join(execution.select(F.col("rule_id").alias("id"), F.col("last_processed_occurrence_date").alias("_cursor")), "id", "left")
    rows = rows.join(rules.select("id", F.col("first_occurrence_date").alias("_first")), "id", "left")
    moved = (F.col("op") == "update") & (F.col("first_occurrence_date") != F.col("_first")) & (F.col("first_occurrence_date") <= F.col("_cursor"))
    bad = F.coalesce(moved, F.lit(False)) | ((F.col("op") == "create") & F.col("_known").isNotNull()) | ((F.col("op") != "create") & F.col("_known").isNull())
    good, rejected = rows.where(~bad), rows.where(bad).select("id", "op")
    kept = rules.join(good.select("id"), "id", "left_anti")
    after = kept.unionByName(good.where("op <> 'delete'").select(*rules.columns))
    gone = good.where("op = 'delete'").select(F.col("id").alias("rule_id"))
    return after, execution.join(gone, "rule_id", "left_anti"), rejected
