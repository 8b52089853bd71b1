"""Bank-statement mails to source records, as a table job."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from email import message_from_bytes, policy
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purseflow import schemas as S
from purseflow.functions import ids
from purseflow.functions.dates import complete_mmdd
from purseflow.functions.money import parse_amount
from purseflow.functions.text import normal_space

# Fixed values of the statement's layout.
WIDTH, HEIGHT, CELLS, CURRENCY = "643", "18", 8, "CNY"

_ROWS = "digest string, sent string, part string, table_no int, cells array<string>, error string"


class _Tables(HTMLParser):
    """Width, height and the cells of the first row of every table, in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            a = dict(attrs)
            t = {"width": (a.get("width") or "").strip(), "height": (a.get("height") or "").strip(), "rows": 0, "cells": [], "in": False}
            self.tables.append(t)
            self.open.append(t)
        elif self.open and tag == "tr":
            self.open[-1]["rows"] += 1
        elif self.open and tag == "td" and self.open[-1]["rows"] == 1:
            self.open[-1]["cells"].append([])
            self.open[-1]["in"] = True

    def handle_endtag(self, tag):
        if not self.open:
            return
        if tag == "table":
            self.open.pop()
        elif tag in ("td", "tr"):
            self.open[-1]["in"] = False

    def handle_data(self, data):
        for t in self.open:
            if t["in"] and data.strip():
                t["cells"][-1].append(data.strip())


def statement_rows(digest: str, content: bytes) -> list[tuple]:
    """The tables of statement rows in a mail, or one row with what is wrong with it.
    A row's number counts all tables before it, so what later versions read moves nothing."""
    fail = lambda what: [(digest, None, None, None, None, what)]
    try:
        mail = message_from_bytes(content, policy=policy.default)
        sent = parsedate_to_datetime(str(mail["Date"])).date().isoformat()
    except (TypeError, ValueError):
        return fail("mail has no date")
    seen: Counter[str] = Counter()
    parts: list[list[tuple]] = []
    for part in mail.walk():
        if part.is_multipart() or part.get_content_disposition() == "attachment" or part.get_content_type() != "text/html":
            continue
        try:
            html = (part.get_payload(decode=True) or b"").decode(part.get_content_charset() or "utf-8")
        except (LookupError, UnicodeDecodeError):
            return fail("HTML part can't be decoded")
        key = hashlib.sha256(html.encode()).hexdigest()
        seen[key] += 1
        reader = _Tables()
        reader.feed(html)
        rows = [(digest, sent, f"html:{key}:{seen[key]}", no, [re.sub(r"\s+", " ", " ".join(c)).strip() for c in t["cells"]], None) for no, t in enumerate(reader.tables, 1) if (t["width"], t["height"]) == (WIDTH, HEIGHT) and len(t["cells"]) == CELLS]
        if rows:
            parts.append(rows)
    if len(parts) != 1:
        return fail("several HTML parts hold rows" if parts else "no statement table")
    return parts[0]


def _read(frame: pd.DataFrame) -> pd.DataFrame:
    """The rows of one mail (or of its copies)."""
    names = [c.split()[0] for c in _ROWS.split(", ")]
    out = [row for digest, content in frame[["digest", "content"]].itertuples(index=False, name=None) for row in statement_rows(digest, bytes(content))]
    return pd.DataFrame(out, columns=names)


def parse_statements(mail: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, statement_dates, rejects) of mails (digest, content), each parsed once.

    A row is a charge, or a repayment, which is skipped. A mail with any other row, or
    without a charge, is rejected whole. Cache or materialise ``mail`` beforehand if it
    is costly to read; the parsed rows are three cheap branches of one table."""
    from purseflow.storage import materialize

    # by mail, as a batch of rows could be all mails of a task at once
    raw = materialize(mail.select("digest", "content").groupBy("digest").applyInPandas(_read, _ROWS), "statement_rows")
    cell = lambda i: normal_space(F.get("cells", F.lit(i)))
    mmdd = r"^\d{4}$"
    rows = raw.select("digest", F.to_date("sent").alias("sent"), "part", "table_no", "error", cell(1).alias("day"), cell(2).alias("posted"), cell(3).alias("description"), parse_amount(cell(4)).alias("amount"))
    repayment = (F.col("day") == "") & F.col("posted").rlike(mmdd) & F.col("description").contains(S.REPAYMENT_WORD)
    rows = rows.withColumn("repayment", repayment).withColumn("transaction_date", complete_mmdd("day", "sent"))
    fault = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("amount").isNull(), "amount").when(F.col("repayment"), None).when(F.col("day") == "", "row without date")
        .when(F.col("transaction_date").isNull(), "transaction date").when(~F.col("posted").rlike(mmdd), "post date").when(F.col("description") == "", "empty description")
    )
    rows = rows.withColumn("fault", fault)
    verdict = rows.groupBy("digest").agg(F.min("fault").alias("fault"), F.count_if(~F.col("repayment")).alias("charges"), F.count_if("repayment").alias("skipped_repayments"), F.min("sent").alias("sent"))
    rejects = verdict.where("fault is not null or charges = 0").select("digest", F.coalesce("fault", F.lit("no charge")).alias("reason"))
    good = rows.join(rejects, "digest", "left_anti")
    records = good.where("not repayment").select(F.lit("bank").alias("source_type"), F.concat(F.lit("sha256:"), "digest").alias("evidence_identity"), F.concat("part", F.lit("/table:"), F.col("table_no").cast("string")).alias("record_locator"), F.lit("expense").alias("transaction_type"), "transaction_date", "amount", F.lit(CURRENCY).alias("currency"), "description", F.col("table_no").cast("long").alias("record_ord"))
    records = records.withColumn("source_record_id", ids.source_record_id())
    dates = verdict.join(rejects, "digest", "left_anti").select(F.concat(F.lit("sha256:"), "digest").alias("evidence_identity"), F.col("sent").alias("statement_date"), "skipped_repayments")
    return records, dates, rejects
