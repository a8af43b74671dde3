"""The manifest reads back as the sheet that was written, with one header for each month."""

import csv
import datetime as dt
import glob
import io
import json

from pyspark.sql import functions as F

from tallyloom.operators import manifest as mf

WHEN = dt.datetime(2026, 7, 2, 9, 30)


def tables(spark, n=40):
    users = spark.createDataFrame([(1, "u1", "a@x.example"), (2, "u2", "b@x.example"), (9, "boss", "c@x.example")], "user_id int, username string, email string")
    submissions = spark.createDataFrame(
        [(10, 1, dt.date(2026, 7, 1), "submitted", WHEN), (11, 2, dt.date(2026, 7, 1), "draft", None), (12, 1, dt.date(2026, 8, 1), "other", None)],
        "submission_id int, user_id int, period_month date, submission_status string, submitted_at timestamp",
    )
    rows = [
        (10 + k % 3, k, None if k % 4 else 9, 9 if k % 5 == 0 else None, k % 6 == 0, f'Name "{k}", Inc.\nline', "metered", k % 2 == 0, None if k == 3 else "12.50", "USD", "user" if k % 3 else "admin",
         "f.pdf" if k % 7 else "", k % 7 == 0 and k % 2 == 0, "" if k % 2 else "made.pdf", "o,riginal.pdf", "queued", k % 2 == 1, None if k % 4 == 0 else (f"プラン{k}", 'say "x"', None), k * 100)
        for k in range(n)
    ]
    receipts = spark.createDataFrame(
        rows, "submission_id int, receipt_id int, uploaded_by_id int, reviewed_by_id int, is_extra boolean, service_name_snapshot string, billing_type_snapshot string, p_card_snapshot boolean, amount string, currency string,"
        "upload_source string, file string, file_deleted boolean, generated_filename string, original_filename string, ai_filename_status string, ai_check_payee boolean,"
        "plan_change_details struct<previous_plan string, change string, amount double>, file_size int",
    )
    return submissions, users, receipts


def test_a_manifest_comes_back(spark, tmp_path):
    sheet = mf.manifest(*tables(spark))
    assert len(mf.NAMES) == len(set(mf.NAMES)) == 49 and sheet.columns == ["receipt_id", *mf.NAMES]
    mf.write_manifest(sheet, f"{tmp_path}/out")
    want = {}
    for r in sheet.orderBy("username", "receipt_id").collect():
        want.setdefault(r["period_month"], []).append([r[n] for n in mf.NAMES])
    assert sorted(want) == ["2026-07", "2026-08"]
    for month, rows in want.items():
        text = "".join(open(f, encoding="utf-8", newline="").read() for f in sorted(glob.glob(f"{tmp_path}/out/month={month}/part-*")))
        got = list(csv.reader(io.StringIO(text, newline="")))
        assert got[0] == list(mf.NAMES) and got[1:] == rows


def test_cells(spark):
    got = {r["receipt_id"]: r for r in mf.manifest(*tables(spark)).collect()}
    assert (got[0]["receipt_kind"], got[1]["receipt_kind"]) == ("extra", "registered_service")
    assert (got[0]["file_status"], got[1]["file_status"], got[7]["file_status"]) == ("削除済み", "保存中", "未保存")
    assert (got[0]["uploaded_by"], got[1]["uploaded_by"], got[3]["uploaded_by"]) == ("boss", "u2", "-")
    assert (got[1]["admin_reviewed_by"], got[5]["admin_reviewed_by"], got[1]["display_filename"], got[2]["display_filename"]) == ("-", "boss", "o,riginal.pdf", "made.pdf")
    assert got[1]["plan_change_details"] == json.dumps({"amount": None, "change": 'say "x"', "previous_plan": "プラン1"}, ensure_ascii=False, sort_keys=True) and got[0]["plan_change_details"] == "{}"
    assert (got[3]["amount"], got[3]["submission_status"], got[2]["submission_status"], got[3]["submitted_at"], got[1]["memo"], got[0]["file_size"]) == ("", "提出済み", "other", "2026-07-02T09:30:00+00:00", "", "")
    assert (got[1]["billing_type"], got[1]["ai_filename_status"], got[1]["ai_check_payee"], got[2]["ai_check_payee"]) == ("従量課金 / API", "AI待機中", "yes", "no")


def test_an_empty_sheet(spark, tmp_path):
    submissions, users, receipts = tables(spark, 3)
    sheet = mf.manifest(submissions, users, receipts.where(F.lit(False)))
    mf.write_manifest(sheet, f"{tmp_path}/out")
    assert sheet.count() == 0 and not glob.glob(f"{tmp_path}/out/month=*")
