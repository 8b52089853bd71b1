"""Files in and out, statement mails, streaming, matching rules."""

import datetime
import hashlib
import json
from email.message import EmailMessage
from pathlib import Path

import pytest

from purseflow import storage
from purseflow.functions import dates, money, text
from purseflow.operators import matching
from purseflow.sources import files, statements
from purseflow.streaming import ingest

D = datetime.date


def mail(rows, sent="Wed, 10 Sep 2025 08:00:00 +0800", tables_before=0):
    cell = lambda xs: "".join(f"<td>{x}</td>" for x in xs)
    html = "<table><tr><td>head</td></tr></table>" * tables_before + "".join(f'<table width="643" height="18"><tr>{cell(r)}</tr></table>' for r in rows)
    m = EmailMessage()
    m["Date"], m["Subject"] = sent, "statement"
    m.set_content("plain")
    m.add_alternative(f"<html><body>{html}</body></html>", subtype="html")
    return m.as_bytes()


CHARGE = ["", "0901", "0902", "shop &amp; co", "¥&nbsp;1,234.50", "", "", ""]
REPAYMENT = ["", "", "0905", "还款", "-100.00", "", "", ""]


def write(folder, content):
    (folder / f"{hashlib.sha256(content).hexdigest()}.eml").write_bytes(content)


def test_statements(spark, tmp_path):
    good = mail([CHARGE, REPAYMENT, ["", "1231", "0101", "old", "5", "", "", ""]], tables_before=2)
    write(tmp_path, good)
    write(tmp_path, mail([["", "", "0905", "what", "1", "", "", ""]]))
    write(tmp_path, mail([REPAYMENT]))
    write(tmp_path, mail([["", "0901", "0902", "x", "1.2.3", "", "", ""]]))
    write(tmp_path, b"no mail at all")
    (tmp_path / "wrong.eml").write_bytes(mail([CHARGE]))
    found, bad = files.scan_mail(spark, str(tmp_path))
    assert bad.count() == 1 and found.count() == 5
    records, sent, rejects = statements.parse_statements(found)
    rows = {r.description: r for r in records.collect()}
    assert set(rows) == {"shop & co", "old"}
    assert rows["shop & co"].amount == 1234.5 and rows["shop & co"].transaction_date == D(2025, 9, 1) and rows["shop & co"].record_locator.endswith("/table:3")
    assert rows["old"].transaction_date == D(2024, 12, 31)  # a later month is the year before
    assert [(r.statement_date, r.skipped_repayments) for r in sent.collect()] == [(D(2025, 9, 10), 1)]
    assert sorted(r.reason for r in rejects.collect()) == ["amount", "mail has no date", "no charge", "row without date"]


def test_streaming_adds_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    seen = []
    run = lambda: ingest.ingest(ingest.mail_stream(spark, str(inbox)), str(tmp_path / "store"), str(tmp_path / "cp"), lambda df, n: seen.append(df.count())).awaitTermination()
    write(inbox, mail([CHARGE]))
    run()
    write(inbox, mail([CHARGE, CHARGE]))
    (inbox / "again.eml").write_bytes(mail([CHARGE]).replace(b"x", b"x"))
    run()
    ingest.ingest(ingest.mail_stream(spark, str(inbox)), str(tmp_path / "store"), str(tmp_path / "lost")).awaitTermination()  # the checkpoint is lost
    digests = [r.digest for r in spark.read.parquet(str(tmp_path / "store")).collect()]
    assert len(digests) == len(set(digests)) and seen[0] == 1
    assert ingest.acquire_counts(spark.createDataFrame([("a",), ("a",), ("b",)], "digest string"), spark.createDataFrame([("b",)], "digest string")) == (3, 1)


def test_jsonl(spark, tmp_path):
    good = {"id": "a", "type": "expense", "date": "2026-01-02", "amount": "20.10", "currency": "CNY", "description": None}
    (tmp_path / "m.jsonl").write_text("\n".join([json.dumps(good), json.dumps(good | {"id": "b", "more": 1}), json.dumps({"id": "c"}), "not json", ""]))
    rows, bad = files.read_jsonl(spark, str(tmp_path / "m.jsonl"), "manual_evidence")
    assert [r.id for r in rows.collect()] == ["a"] and bad.count() == 3
    r = files.manual_records(rows).first()
    assert r.source_record_id == "src_" + hashlib.sha256("source-record\0manual\0a\0entry".encode()).hexdigest()[:24]
    (tmp_path / "rules.json").write_text(json.dumps([{"id": "r", "enabled": True, "type": "expense", "amount": "77", "currency": "CNY", "description": "rent", "first_occurrence_date": "2026-01-10"}]))
    assert files.typed_rules(files.read_json_array(spark, str(tmp_path / "rules.json"), "schedule_rules")).first().first_occurrence_date == D(2026, 1, 10)
    (tmp_path / "b.csv").write_bytes("﻿transaction_id,transaction_date,amount,description,source_email,source_index\nt1,2026-01-01,5.5,x,e,1\nt2,bad,1,x,e,2\n".encode())
    rows, bad = files.read_bank_csv(spark, str(tmp_path / "b.csv"))
    assert [r.transaction_id for r in rows.collect()] == ["t1"] and bad.count() == 1


def test_versions_and_reports(spark, tmp_path):
    for v in (1, 2):
        files.write_version(spark.createDataFrame([(v, ["a", "b"])], "x int, tags array<string>"), str(tmp_path / "t"), v)
    newest = files.latest_version(spark, str(tmp_path / "t"))
    assert [r.x for r in newest.collect()] == [2]
    files.write_report(newest, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).first().tags == "a; b"


def one(spark, column, **values):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'date' if isinstance(v, D) else 'string'}" for k, v in values.items()))
    return frame.select(column(*[F.col(k) for k in values])).first()[0]


@pytest.mark.parametrize("raw,want", [("¥1,234.50", 1234.5), ("-￥ 5", -5), ("&yen;.5", 0.5), ("1.2.3", None), ("", None), ("+7.", 7), ("1.0000000", 1), ("1.00000001", None)])
def test_amounts(spark, raw, want):
    got = one(spark, money.parse_amount, x=raw)
    assert (got is None) == (want is None) and (want is None or float(got) == want)


def test_dates_and_text(spark):
    sent = D(2026, 3, 10)
    assert one(spark, dates.complete_mmdd, a="0310", b=sent) == D(2026, 3, 10) and one(spark, dates.complete_mmdd, a="0311", b=sent) is None
    assert one(spark, dates.complete_mmdd, a="0401", b=sent) == D(2025, 4, 1) and one(spark, dates.complete_mmdd, a="0230", b=sent) is None
    assert one(spark, dates.next_occurrence, a=D(2026, 1, 28), b=D(2026, 2, 28)) == D(2026, 3, 28) and one(spark, dates.next_occurrence, a=D(2026, 1, 28), b=D(2026, 2, 27)) == D(2026, 2, 28)
    assert one(spark, dates.app_time, x="3月5日 12:30") == ("03-05 12:30", "03-05", "minute") and one(spark, dates.app_time, x="13-45") is None
    assert one(spark, text.match_key, x="Ｓｈｏｐ-Straße 1") == "shopstrasse1" and one(spark, text.similarity, a="abc", b="xabcx") == 1.0
    assert one(spark, money.app_amount, x="−1O.50") == -10.5 and one(spark, money.app_amount, x="10.5") is None
    frame = spark.createDataFrame([(["a", "1", "中", "b"],)], "t array<string>")
    assert frame.select(text.join_tokens("t")).first()[0] == "a 1中b"


def test_one_to_one_needs_a_path_of_three():
    choices = {"a": ["x", "y"], "b": ["x", "z"], "c": ["y", "x"], "d": ["x"]}
    got = matching.one_to_one(["a", "b", "c", "d"], choices)
    assert len(got) == 3 and len(set(got.values())) == 3
    assert matching.one_to_one(["a", "b", "c"], {"a": ["x"], "b": ["x", "y"], "c": ["x", "y", "z"]}) == {"a": "x", "b": "y", "c": "z"}


BANK = "transaction_id string, transaction_date date, amount decimal(28,6), description string"
APP = "row_image string, source_stem string, row_index int, merchant_text string, merchant_key string, amount decimal(28,6), occurred_on date, row_ord long"


def test_matching_rules(spark):
    from decimal import Decimal as X

    bank = spark.createDataFrame([
        ("t1", D(2026, 1, 5), X(10), "sign"), ("t2", D(2026, 1, 5), X(20), "size"), ("t3", D(2026, 1, 6), X(30), "doubt"), ("t4", D(2026, 1, 6), X(40), "doubt"),
        ("t5", D(2030, 1, 1), X(50), "late"), ("t6", D(2026, 1, 7), X(-10), "refund"), ("t7", D(2026, 1, 9), X(10), "sign"), ("t8", D(2026, 1, 8), X(77), "nothing"),
    ], BANK)
    rows = [("a", -10, 5, "m1"), ("b", 20, 5, "m2"), ("c", -30, 6, "m1"), ("d", -40, 6, "m2"), ("e", -10, 12, "m1"), ("f", 1, 1, "m9")]
    app = spark.createDataFrame([(n, "s", i, k, k, X(a), D(2026, 1, d), i) for i, (n, a, d, k) in enumerate(rows)], APP)
    m = matching.match_descriptions(bank, app)
    got = m.collect()
    assert {(r.transaction_id, r.row_image, r.stage) for r in got if r.kind == "assignment"} == {("t1", "a", "signed_same_day"), ("t7", "e", "absolute_window"), ("t2", "b", "absolute_same_day")}
    assert {r.description: r.status for r in got if r.kind == "group"} == {"sign": "mapped_signed_same_day_seed", "size": "mapped_absolute_same_day_seed", "doubt": "conflicting_signed_same_day_seeds", "late": "ocr_not_covered", "refund": "no_eligible_purchase_evidence", "nothing": "no_same_day_candidate"}
    status = {r.transaction_id: (r.state, r.reason, r.confidence) for r in matching.match_status(bank, app, m).collect()}
    assert status["t1"] == ("assigned", None, "high") and status["t5"] == ("unresolved", "ocr_not_covered", None) and status["t6"][1] == "refund_without_description_mapping" and status["t3"][1] == "remaining_same_day_candidates"
    assert {r.row_image for r in matching.unused_rows(app, m).collect()} == {"c", "d", "f"}


@pytest.mark.parametrize("values,flagged", [([9, 8, 7], []), ([9, 5, 7, 6], [1]), ([5, 6, 7, 8, 9], [1, 2, 3, 0, 4]), ([9, 8, 9], [1, 2]), ([None, 3, 4], [1, 2])])
def test_order_violations(spark, values, flagged):
    def model(v):
        out = set()
        for i in range(1, len(v) - 1):
            a, b, c = v[i - 1 : i + 2]
            if None not in (a, b, c) and a >= c and not a >= b >= c:
                out.add(i)
        for i in range(1, len(v)):
            if None not in (v[i - 1], v[i]) and v[i] > v[i - 1] and i - 1 not in out and i not in out:
                out |= {i - 1, i}
        return out

    frame = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "source_stem string, row_index int, value int")
    got = {r.row_index for r in matching.order_violations(frame).where("order_violation").collect()}
    assert got == model(values)


def test_run_log(spark, tmp_path):
    log = ingest.RunLog()
    spark.streams.addListener(log)
    try:
        inbox = tmp_path / "in"
        inbox.mkdir()
        write(inbox, mail([CHARGE]))
        ingest.ingest(ingest.mail_stream(spark, str(inbox)), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
        import time

        for _ in range(50):
            if any(r[1] == "ended" for r in log.rows):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    assert {r.event for r in log.table(spark).collect()} >= {"started", "progress", "ended"}
    held = len(log.rows)
    assert log.flush(spark, str(tmp_path / "log")) == held == spark.read.parquet(str(tmp_path / "log")).count() and log.flush(spark, "nowhere") == 0


def test_labels_sort_in_chinese(spark):
    from purseflow.operators import views

    frame = spark.createDataFrame([("a", "中"), ("b", "啊"), ("c", "波")], "transaction_id string, display_name string").withColumn("transaction_date", __import__("pyspark").sql.functions.lit("2026-01-01").cast("date"))
    assert [r.transaction_id for r in views.transactions_by_label(frame).collect()] == ["b", "c", "a"]
    assert views.row_json(spark.createDataFrame([("1.50", None)], "amount string, x string").withColumn("amount", __import__("pyspark").sql.functions.expr("cast(amount as decimal(28,6))"))).first().json == '{"amount":"1.5","x":null}'


def test_discard_deletes_what_was_written_and_nothing_else(spark):
    gone, stays = storage.materialize(spark.range(3), "gone"), storage.materialize(spark.range(4), "stays")
    folders = [Path(t.inputFiles()[0].removeprefix("file://")).parents[1] for t in (gone, stays)]
    storage.discard(gone, None, spark.range(2), stays.where("id > 1"))
    storage.discard(gone)
    assert not folders[0].exists() and folders[1].exists()
    assert stays.count() == 4


def test_ranks_within_groups_of_any_size(spark):
    from pyspark.sql import functions as F

    from purseflow.operators import ranking

    rows = [("big" if i % 3 else None if i % 2 else "small", i * 7 % 50, i) for i in range(300)]
    got = {r.i: r.rank for r in ranking.ranks_within(spark.createDataFrame(rows, "g string, v int, i int"), ["g"], F.desc("v"), "i").collect()}
    want = {}
    for g in ("big", "small", None):
        want |= {r[2]: k for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1)}
    assert got == want
    assert ranking.ranks_within(spark.createDataFrame([], "g string, v int"), ["g"], "v").collect() == []
