"""Receipt texts as they occur, and what is read from them."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import extract as x
from tallyloom.functions import text as t
from tallyloom.functions.text import plain_number
from tallyloom.operators import extraction as ex
from tallyloom.operators import plan_sources as ps
from tallyloom.operators.leftovers import evidence_calculation
from tallyloom.plans import record_queries

UPGRADE = """Receipt
Anthropic, PBC
Invoice number ABCD-0001
Date paid June 6, 2026
Max plan - 20x
Jun 6 – Jul 6, 2026
Unused time on Claude Pro after 06 Jun 2026
Jun 6 - Jun 8, 2026
-$4.21
Subtotal $200.00
Amount paid $195.79"""
REFUND = """Refund
Dify (LangGenius, Inc.)
Invoice number 7F-22 (7F-22-CN-01)
Refunded on July 9, 2026
Refund amount $11.44
Original Transaction ID SALE-123
Payment history
June 2, 2026
Visa $42.90 2345-6789"""
TEXTS = [
    UPGRADE, REFUND, "PAID: 5\nTotal: 1,200 JPY\nDate due\n12.03.2026\nwww.sound-box.io\n", "A receipt with a refund policy\nInvoice # INV-77/2\n請求書発行日：\n2026年7月3日\n￥1,650 Google Cloud\n合計（JPY）",
    "ask support@suno.com, Suno Pro\nTotal excluding tax $1\nTotal $2.50 or EUR 3.10\nDate 2026-02-30 or Date 2026-03-01", "", None,
]


@pytest.fixture(scope="module")
def read(spark):
    docs = spark.createDataFrame([(i, text, "to: a@b.example") for i, text in enumerate(TEXTS)], "receipt_id int, text string, expected_context string")
    return {r.receipt_id: r for r in ex.text_records(docs).collect()}


def test_a_plan_change_is_read_whole(read):
    r = read[0]
    assert (r.kind, r.payee, r.service_label, r.payment_date, r.amount, r.currency) == ("charge", "Anthropic, PBC", "Claude", dt.date(2026, 6, 6), Decimal("195.79"), "USD")
    c = r.plan_change
    assert (c.previous_plan, c.new_plan, c.change_date, c.previous_plan_end, c.new_plan_end) == ("Claude Pro", "Max plan - 20x", dt.date(2026, 6, 6), dt.date(2026, 6, 8), dt.date(2026, 7, 6))
    assert (c.adjustment_amount, c.adjustment_currency, c.confidence, r.plan_name, r.confidence) == (Decimal("-4.21"), "USD", 0.99, "Max plan - 20x", 0.96)
    assert [(p.component_key, p.role, p.signed_amount) for p in r.components] == [("primary:ABCD-0001", "charge", Decimal("195.79"))]


def test_a_refund_names_its_original_charge(read):
    r = read[1]
    assert (r.kind, r.payment_date, r.amount, r.related_reference) == ("refund", dt.date(2026, 7, 9), Decimal("11.44"), "SALE-123")
    old, back = r.components
    assert (old.role, old.signed_amount, old.transaction_date, old.transaction_id) == ("charge", Decimal("42.90"), dt.date(2026, 6, 2), "2345-6789")
    assert (back.component_key, back.signed_amount, back.related_transaction_id) == ("refund:7F-22-CN-01", Decimal("-11.44"), "SALE-123")


def test_dates_on_the_next_line_and_words_in_passing(read):
    assert (read[2].kind, read[2].payment_date, read[2].amount, read[2].currency, read[2].payee) == ("charge", dt.date(2026, 3, 12), Decimal("1200.00"), "JPY", "Sound Box")
    assert (read[3].kind, read[3].payment_date, read[3].amount, read[3].reference) == ("invoice", dt.date(2026, 7, 3), Decimal("1650.00"), "INV-77/2")
    assert (read[4].kind, read[4].payee, read[4].service_label, read[4].amount, read[4].currency) == ("unknown", "Suno", "Suno", Decimal("3.10"), "EUR")
    assert read[5].confidence == read[6].confidence == 0 and read[5].components == read[6].components == []


def test_compatibility_forms_are_plain(spark):
    rows = [("ＡＢＣ　１２", "ABC 12"), ("ｶﾞｲﾄﾞ", "ガイド"), ("㈱ﬁn②", "(株)fin2"), (None, "")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r.x for r in df.select(t.narrow(F.col("a")).alias("x")).collect()] == [b for _, b in rows]


@pytest.mark.parametrize(
    ("value", "want"),
    [("Jun 6–Jul 6, 2026", ("2026-06-06", "2026-07-06")), ("December 20 - January 20, 2026", ("2026-12-20", "2027-01-20")), ("no range", (None, None))],
)
def test_english_ranges(spark, value, want):
    r = spark.createDataFrame([(value,)], "v string").select(x.date_range(F.col("v")).alias("r")).first().r
    assert tuple(str(d) if d else None for d in r) == want


def test_names_for_files(spark):
    df = spark.createDataFrame([("Open: AI, Inc. ", "  ", "Ann@x.example", "ann", Decimal("12.50"))], "payee string, last string, mail string, login string, amount decimal(14,2)")
    name = t.receipt_filename(F.lit("2026-07-03").cast("date"), t.user_part(F.col("last"), F.col("mail"), F.col("login")), F.col("payee"), F.col("amount"), F.lit("usd"), F.lit(""))
    assert df.select(name.alias("n")).first().n == "260703_Ann_Open_AI_12.5_USD.pdf"
    got = df.select(t.append_once(F.lit("a"), "b").alias("x"), t.append_once(F.lit("a b"), "b").alias("y"), t.strip_memo(F.lit("own【m】rest"), "【m】").alias("z"), t.recipient_name(F.lit("Bill to: Ann")).alias("r")).first()
    assert (got.x, got.y, got.z, got.r) == ("a\nb", "a b", "own", "Ann")


def test_japanese_labels_end_at_a_word(spark):
    """支払額合計 is not the label 支払額: the sum below counts."""
    texts = ["支払額合計 ¥900\n合計: ¥1,200", "支払額 ¥900\n合計: ¥1,200", "支払済額: ¥700", "領収金額計 ¥5\n領収金額　¥6", "支払い金額¥8"]
    got = [r["a"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", x.total_amount(F.col("text"))["amount"].alias("a")).orderBy("k").collect()]
    assert [float(a) for a in got] == [1200, 900, 700, 6, 8]


def test_numbers_of_any_scale(spark):
    rows = spark.sql("SELECT CAST(1500 AS DECIMAL(14,0)) AS a, CAST(12.50 AS DECIMAL(14,2)) AS b, CAST(0 AS DECIMAL(14,2)) AS c, CAST(100 AS DECIMAL(14,2)) AS d, CAST(NULL AS DECIMAL(14,2)) AS e, CAST(0.1250 AS DECIMAL(8,4)) AS f")
    assert rows.select(*[plain_number(F.col(n)).alias(n) for n in rows.columns]).first() == ("1500", "12.5", "0", "100", None, "0.125")
    matched = spark.createDataFrame([(1, "L", ["c", "r"])], "statement_id int, line_key string, component_keys array<string>")
    evidence = spark.sql("SELECT 1 AS statement_id, 'c' AS component_key, CAST(1500 AS DECIMAL(14,0)) AS signed_amount, 'JPY' AS currency UNION ALL SELECT 1, 'r', CAST(-100 AS DECIMAL(14,0)), 'JPY'")
    assert evidence_calculation(matched, evidence).first()["calculation"] == "1500 - 100 = 1400 JPY"


def test_patterns_run_only_where_their_letters_are(spark):
    assert x.marks(r"^total\b(?!\s+excluding)") == [["total"]] and x.marks(r"\bpaid\b|領収いたしました") == [["paid"], ["領収いたしました"]]
    assert x.marks("^支払(?:済)?額\\b") == [["支払", "額"]]
    labels = [*x.DATE_LABELS, *x.AMOUNT_LABELS, *x.REFUND_LABELS, *[p for _, p in (*x.SERVICES, *x.PLANS)]]
    assert all(words for label in labels for words in x.marks(label))
    # Java's patterns take these signs for letters when cases and Unicode classes are on
    rows = spark.createDataFrame([("Amount PAıD $5",), ("Grand total ſum\nGRAND TOTAL €7",), ("nothing $9",)], "text string")
    got = rows.select(x.total_amount(F.col("text"))["amount"].cast("int").alias("n")).collect()
    assert [r.n for r in got] == [5, 7, None]


def test_a_month_that_is_no_number_gives_no_day(spark):
    rows = spark.createDataFrame([("Date paid Sept 5, 2026",), ("Date paid 2026-02-30",), ("Date paid Sep 5, 2026",)], "text string")
    assert [str(r.d) for r in rows.select(x.payment_date(F.col("text")).alias("d")).collect()] == ["None", "None", "2026-09-05"]


def test_components_are_read_and_named_within_their_row(spark):
    part = '{"component_key": "%s", "role": "%s", "signed_amount": "%s", "currency": "$", "transaction_date": "2026-01-02"}'
    listed = "[" + ", ".join(part % p for p in (("a b", "charge", "5"), ("a_b", "other", "5"), ("a  b", "Refund ", "-6"), ("", "charge", "x"), ("a_ b", "", "7"), ("", "charge", "8"))) + ", null]"
    rows = spark.createDataFrame([(1, listed, "P", "invoice"), (2, "[]", "P", ""), (3, "no list", "P", ""), (4, None, "P", "")], "receipt_id int, components string, payee string, kind string")
    out = ex.normal_components(rows)
    got = [(r.receipt_id, r.pos, r.component_key, r.role, float(r.signed_amount), r.payee, r.document_kind) for r in out.orderBy("receipt_id", "pos").collect()]
    assert got == [(1, 0, "a_b", "charge", 5.0, "P", "invoice"), (1, 2, "a_b-3", "refund", -6.0, "P", "invoice"), (1, 4, "a_b-5", "charge", 7.0, "P", "invoice"), (1, 5, "component-6", "charge", 8.0, "P", "invoice")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("from_json(") == 1


def test_a_plan_change_is_read_once(spark):
    columns = "receipt_id int, user_id int, service_label string, payee string, merchant_key string, plan_name string, plan_change string, recipient_name string, recipient_memo string, recipient_checked boolean"
    change = '{"previous_plan": "my claude pro seat", "new_plan": "", "previous_plan_end": "2026-01-05", "confidence": "high"}'
    rows = [(1, 7, "", "V", "M", "Max", change, "a@b.co", "", True), (2, 8, "", "V", "M", "", change, "-2", "", True), (3, 9, "", "V", "M", "", '{"new_plan": "x"}', "", "", False), (4, 9, "", "V", "M", "", None, "", "", False)]
    users = spark.createDataFrame([("a@b.co", 70), ("-2", 80), (None, 90)], "address string, user_id int")
    out = ps.plan_change_documents(spark.createDataFrame(rows, columns), users)
    assert [(r.change_id, r.user_id, r.previous_plan, r.new_plan, str(r.previous_plan_end), r.confidence) for r in out.orderBy("change_id").collect()] == [
        (1, 70, "Claude Pro", "Max", "2026-01-05", 0.95), (2, 8, "Claude Pro", "", "2026-01-05", 0.95)
    ]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_queries_read_the_fields_that_they_ask(spark, monkeypatch):
    texts = spark.createDataFrame([(1, UPGRADE, ""), (2, REFUND, ""), (3, None, None)], "receipt_id long, text string, expected_context string")
    kept, staged = [], record_queries.staged
    monkeypatch.setattr(record_queries, "_texts", lambda *_: texts)
    monkeypatch.setattr(record_queries, "staged", lambda df, label: kept.append(df.columns) or staged(df, label))
    changes = record_queries.extract_plan_change(spark, "").collect()
    assert [(r.receipt_id, r.previous_plan, r.new_plan, r.change_date, r.adjustment) for r in changes] == [(1, "Claude Pro", "Max plan - 20x", "2026-06-06", -421)]
    assert {r.receipt_id for r in record_queries.extract_components(spark, "").collect()} == {1, 2}
    assert record_queries.extract_records(spark, "").count() == 3
    assert kept[:2] == [["receipt_id", "plan_change"], ["receipt_id", "components"]] and not {"plan_change", "components"} & set(kept[2])
