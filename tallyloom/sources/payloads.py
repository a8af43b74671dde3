"""Nested JSON columns to typed rows: statement payloads and receipt components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text as t

PAYLOAD = (
    "card_last4 string, statement_period string, payment_date string, summary_reason string, items array<struct<line_reference string, "
    "transaction_date string, merchant_name string, amount_jpy string, original_amount string, original_currency string, service_catalog_id string, "
    "match_status string, receipt_required boolean, confidence string, reason string>>"
)
COMPONENTS = (
    "array<struct<component_id string, role string, amount string, currency string, date string, payee string, service_label string, "
    "document_kind string, invoice_number string, transaction_id string, related_transaction_id string>>"
)
STATUSES = ("matched", "ambiguous", "unmatched", "ignored")


def statement_payloads(statements: DataFrame, catalog: DataFrame, last4: str) -> tuple[DataFrame, DataFrame]:
    """(headers, lines) of statements (statement_id, period_month, payload).

    Lines without merchant go; a line's place in the payload stands in for a missing reference; unknown
    catalog entries become null; a match needs an entry and 0.85, an ambiguous one an entry or 0.5.
    A header with an issue needs review.
    """
    parsed = statements.withColumn("p", F.from_json("payload", PAYLOAD))
    each = parsed.select("statement_id", F.posexplode("p.items").alias("at", "i")).withColumn("merchant", F.substring(t.one_line(F.col("i.merchant_name")), 1, 160))
    allowed = catalog.select(F.col("catalog_id"), F.lit(True).alias("known"))
    raw = each.where("merchant <> ''").withColumn("catalog_id", F.col("i.service_catalog_id").try_cast("long"))
    raw = raw.join(allowed, "catalog_id", "left").withColumn("catalog_id", F.when(F.col("known"), F.col("catalog_id")))
    sure = t.confidence(F.col("i.confidence"))
    said = F.when(F.col("i.match_status").isin(*STATUSES), F.col("i.match_status")).otherwise("unmatched")
    weaker = F.when((said == "matched") & (F.col("catalog_id").isNull() | (sure < 0.85)), "ambiguous").otherwise(said)
    status = F.when((weaker == "ambiguous") & F.col("catalog_id").isNull() & (sure < 0.5), "unmatched").otherwise(weaker)
    reference = F.coalesce(F.when(F.col("i.line_reference") != "", F.col("i.line_reference")), (F.col("at") + 1).cast("string"))
    place = Window.partitionBy("statement_id").orderBy("at")
    lines = raw.select(
        "statement_id", F.row_number().over(place).alias("sequence"), F.substring(reference, 1, 40).alias("reference"), cal.iso_date(F.col("i.transaction_date")).alias("line_date"),
        "merchant", t.unsigned_amount(F.col("i.amount_jpy")).alias("amount_jpy"), t.unsigned_amount(F.col("i.original_amount")).alias("original_amount"),
        t.currency_code(F.coalesce("i.original_currency", F.lit(""))).alias("original_currency"), "catalog_id", status.alias("match_status"),
        F.coalesce("i.receipt_required", F.lit(False)).alias("receipt_required"), sure.alias("confidence"),
    )
    counts = lines.groupBy("statement_id").agg(F.count(F.lit(1)).alias("lines"))
    card, period = t.card_last4(F.col("p.card_last4")), F.coalesce(cal.valid_period(F.col("p.statement_period")), F.lit(""))
    issues = F.array_compact(
        F.array(
            F.when(card != last4, "card"), F.when(period != F.date_format("period_month", "yyyy-MM"), "period"), F.when(F.col("lines").isNull(), "no lines"),
        )
    )
    headers = parsed.join(counts, "statement_id", "left").select(
        "statement_id", card.alias("card_last4"), period.alias("statement_period"), cal.iso_date(F.col("p.payment_date")).alias("payment_date"),
        F.coalesce("lines", F.lit(0)).alias("lines"), F.array_join(issues, ",").alias("issues"), F.when(F.size(issues) > 0, "needs_review").otherwise("completed").alias("status"),
    )
    return headers, lines


def receipt_components(receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components, unresolved) of receipts (receipt_id, components JSON, payee, service_label, document_kind,
    amount, currency, issued_on).

    A receipt without list gives one component from its own columns if they are there. Refunds are
    negative, charges positive; payee, label and kind default to the receipt's; a repeated key gets its
    place as suffix. Components without amount, currency, day or payee go; receipts left with none are
    unresolved.
    """
    listed = F.from_json("components", COMPONENTS)
    own = F.struct(
        F.lit("primary").alias("component_id"), F.when(F.col("document_kind") == "refund", "refund").otherwise("charge").alias("role"),
        F.col("amount").cast("string").alias("amount"), "currency", F.col("issued_on").cast("string").alias("date"), "payee", "service_label", "document_kind",
        F.lit("").alias("invoice_number"), F.lit("").alias("transaction_id"), F.lit("").alias("related_transaction_id"),
    )
    complete = F.col("amount").isNotNull() & F.col("issued_on").isNotNull() & (F.coalesce("currency", F.lit("")) != "")
    items = F.when(F.coalesce(F.size(listed), F.lit(0)) > 0, listed).when(complete, F.array(own))
    each = receipts.select("receipt_id", "payee", "service_label", "document_kind", F.posexplode(items).alias("at", "c"))
    or_own = lambda c: F.coalesce(F.nullif(F.trim(F.col(f"c.{c}")), F.lit("")), F.col(c), F.lit(""))
    role = F.lower(F.coalesce("c.role", F.lit("charge")))
    amount = t.unsigned_amount(F.col("c.amount"))
    key = F.coalesce(F.nullif(F.trim("c.component_id"), F.lit("")), F.concat(F.lit("component-"), F.col("at") + 1))
    rows = each.where(role.isin("charge", "refund")).select(
        "receipt_id", "at", key.alias("raw_key"), role.alias("role"), F.when(role == "refund", -amount).otherwise(amount).alias("signed_amount"),
        t.currency_code(F.coalesce("c.currency", F.lit(""))).alias("currency"), cal.iso_date(F.col("c.date")).alias("event_date"),
        or_own("payee").alias("payee"), or_own("service_label").alias("service_label"), F.lower(or_own("document_kind")).alias("document_kind"),
        F.coalesce("c.invoice_number", F.lit("")).alias("invoice_number"), F.coalesce("c.transaction_id", F.lit("")).alias("transaction_id"),
        F.coalesce("c.related_transaction_id", F.lit("")).alias("related_transaction_id"),
    )
    same = Window.partitionBy("receipt_id", "raw_key").orderBy("at")
    unique = F.when(F.row_number().over(same) > 1, F.concat(F.lit("-"), F.row_number().over(same).cast("string"))).otherwise("")
    keyed = rows.withColumn("component_key", F.concat(F.lit("receipt-"), "receipt_id", F.lit(":"), "raw_key", unique)).drop("raw_key", "at")
    good = keyed.where("signed_amount IS NOT NULL AND currency <> '' AND event_date IS NOT NULL AND payee <> ''")
    return good, receipts.join(good, "receipt_id", "left_anti")
