"""Deterministic ids: a prefix and the head of a sha256 over parts joined by NUL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 24


def digest_id(prefix: str, kind: str, *parts: Column | str) -> Column:
    text = F.concat_ws("\0", F.lit(kind), *parts)
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, DIGITS))


def source_record_id(source_type="source_type", evidence="evidence_identity", locator="record_locator") -> Column:
    return digest_id("src_", "source-record", source_type, evidence, locator)


def transaction_id(record="source_record_id") -> Column:
    return digest_id("txn_", "transaction", record)


def split_transaction_id(record, previous) -> Column:
    """The id of a corrected record that leaves a transaction which lives on."""
    return digest_id("txn_", "transaction-reconsideration", record, previous)


def occurrence_id(rule, day) -> Column:
    return digest_id("schedule_occ_", "scheduled-occurrence", rule, F.date_format(day, "yyyy-MM-dd"))


def evidence_digest(content="content") -> Column:
    return F.sha2(content, 256)


def evidence_identity(content="content") -> Column:
    return F.concat(F.lit("sha256:"), evidence_digest(content))


def evidence_file(content="content") -> Column:
    return F.concat(evidence_digest(content), F.lit(".eml"))
