"""Reading and writing the ledger's durable tables, with bad rows kept visible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from purseflow import schemas as S
from purseflow.functions import ids
from purseflow.operators.checks import json_keys, union, unique, violations
from purseflow.operators.ranking import positions

REQUIRED = {
    "manual_evidence": (S.MANUAL_EVIDENCE, ["id", "type", "date", "amount", "currency", "description"], []),
    "source_links": (S.SOURCE_LINKS, ["transaction_id", "source_record_id", "role"], ["link_ord"]),
    "decisions": (S.DECISIONS, ["transaction_id"], ["merchant_override", "category_override", "note"]),
    "schedule_rules": (S.SCHEDULE_RULES, ["id", "enabled", "type", "amount", "currency", "description", "first_occurrence_date"], ["note"]),
    "schedule_execution": (S.SCHEDULE_EXECUTION, ["rule_id"], ["last_processed_occurrence_date", "last_source_record_id", "last_transaction_id", "last_action"]),
    "feedback": (S.FEEDBACK, ["id", "created_at", "status", "content", "context"], []),
    "app_rows": (S.APP_ROWS, ["row_image", "merchant_text", "merchant_score", "amount"], ["occurred_at", "occurred_on", "occurred_at_precision", "issues", "notes"]),
}

#: Tables whose order in the file counts.
ORDERED = ("manual_evidence", "source_links")


def read_jsonl(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of a file of JSON lines with exactly the table's fields. Blank
    lines are violations where the format has none (feedback); else they are skipped.
    Manual evidence and source links come with their place in the file (line_no, link_ord),
    as later steps go by it."""
    schema, required, optional = REQUIRED[table]
    raw = spark.read.text(path).select("value")
    if table in ORDERED:
        placed = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_at"))
        raw = positions(placed, "file_path", "file_block_start", "_at", name="_line").select("value", "_line")
    blank = raw.where("trim(value) = ''")
    lines = raw.where("trim(value) <> ''")
    bad = json_keys(lines, "value", required, optional)
    if table == "feedback":
        bad = union(bad, violations(blank, "V21", F.lit("blank"), "blank line"))
    good = lines.select(F.from_json("value", schema).alias("r"), F.json_object_keys("value").alias("k"), *[c for c in lines.columns if c != "value"])
    whole = F.size(F.array_except(F.array(*map(F.lit, required)), "k")) == 0
    known = F.size(F.array_except("k", F.array(*map(F.lit, [*required, *optional])))) == 0
    rows = good.where(whole & known)
    if table not in ORDERED:
        return rows.select("r.*"), bad
    if table == "source_links":
        return rows.select("r.*", "_line").withColumn("link_ord", F.coalesce("link_ord", F.lpad(F.col("_line").cast("string"), 19, "0"))).drop("_line"), bad
    return rows.select("r.*", F.col("_line").alias("line_no")), bad


def read_json_array(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A file that holds one JSON array of objects (rules, execution)."""
    return spark.read.schema(REQUIRED[table][0]).option("multiLine", True).option("mode", "FAILFAST").json(path)


def typed_rules(rules: DataFrame) -> DataFrame:
    return rules.withColumn("amount", F.col("amount").try_cast(S.MONEY)).withColumn("first_occurrence_date", F.try_to_date("first_occurrence_date", "yyyy-MM-dd"))


def read_bank_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of bank transactions with a header; a byte order mark does no harm."""
    rows = spark.read.schema(S.BANK_TRANSACTIONS + ", _corrupt string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    typed = rows.withColumn("transaction_date", F.try_to_date("transaction_date", "yyyy-MM-dd")).withColumn("amount", F.col("amount").try_cast(S.MONEY))
    fault = "_corrupt is not null or transaction_id is null or transaction_date is null or amount is null or description is null"
    bad = typed.where(fault)
    return typed.where(f"not ({fault})").drop("_corrupt"), union(violations(bad, "S11", "transaction_id", "unreadable row"), unique(typed, "transaction_id", "S11"))


def read_mappings(by_merchant: DataFrame, by_category: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(description_map, merchant_map, violations) of the nested lists."""
    d = by_merchant.select(F.explode("descriptions").alias("description"), "merchant")
    m = by_category.select(F.explode("merchants").alias("merchant"), "category")
    return d, m, union(unique(by_merchant, "merchant", "S7"), unique(by_category, "category", "S7"), unique(d, "description", "S7"), unique(m, "merchant", "S7"))


def manual_records(evidence: DataFrame) -> DataFrame:
    """Source records of manual evidence; record_ord is the line's place (line_no, as ``read_jsonl`` gives it)."""
    amount = F.col("amount").try_cast(S.MONEY)
    rows = evidence.select(F.lit("manual").alias("source_type"), F.col("id").alias("evidence_identity"), F.lit("entry").alias("record_locator"), F.col("type").alias("transaction_type"), F.try_to_date("date", "yyyy-MM-dd").alias("transaction_date"), amount.alias("amount"), "currency", "description", F.col("line_no").alias("record_ord"))
    return rows.withColumn("source_record_id", ids.source_record_id())


def registry(sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All records of the sources, registered by type, and the violations: foreign types, ids that repeat."""
    columns = [c.split()[0] for c in S.SOURCE_RECORDS.split(", ")]
    records = reduce(DataFrame.unionByName, [d.select(*columns) for d in sources.values()])
    foreign = [violations(d.where(F.col("source_type") != t), "V22", "source_record_id", F.col("source_type")) for t, d in sources.items()]
    return records, union(*foreign, unique(records, "source_record_id"))


def scan_mail(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(mail, violations): content-addressed mail files; a name that isn't the content's hash is a violation."""
    mail = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path).select("path", "content").withColumn("digest", ids.evidence_digest())
    named = F.regexp_extract("path", r"([^/]+)\.eml$", 1) == F.col("digest")
    return mail.where(named), violations(mail.where(~named), "S1", "path", "name is not the content's hash")


def new_evidence(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a batch (digest, ...) that aren't known yet, each once: adding twice adds nothing."""
    return batch.dropDuplicates(["digest"]).join(known.select("digest"), "digest", "left_anti")


def write_version(df: DataFrame, folder: str, version: int) -> str:
    """A whole table in a folder of its own; readers keep the version they have begun to read."""
    path = f"{folder}/version={version:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version; versions are partitions, so the others are not read."""
    every = spark.read.parquet(folder)
    newest = every.select("version").agg(F.max("version")).first()[0]
    return every.where(F.col("version") == newest).drop("version")


def write_report(df: DataFrame, path: str) -> None:
    """A report as CSV with a header; arrays become joined text."""
    flat = [F.concat_ws("; ", c).alias(c) if t.startswith("array<string") else F.to_json(c).alias(c) if t.startswith(("array", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.option("header", True).csv(path)


def parse_key(name: Column | str) -> tuple[Column, Column]:
    """Sheet and place of an app row's name (``sheet__07.png``); no number counts as 0."""
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    has = stem.contains("__")
    return F.when(has, F.regexp_replace(stem, r"__[^_]*$", "")).otherwise(stem), F.when(has, F.coalesce(F.regexp_extract(stem, r"__(\d+)$", 1).try_cast("int"), F.lit(0))).otherwise(0)
