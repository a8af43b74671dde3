"""Queries of plan-change sources, inferences and decisions with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import plan_sources as ps
from .fixtures import VIEWS, view, with_clause

VIEWS |= {
    "fx_plan_receipts": """
        SELECT receipt_id, user_id, service_id, CASE WHEN receipt_id % 4 = 0 THEN 'Claude' ELSE '' END AS service_label, concat('Vendor ', catalog_id) AS payee, concat('CATALOG:', catalog_id) AS merchant_key,
               CASE WHEN receipt_id % 3 = 0 THEN 'Claude Pro' ELSE '' END AS plan_name, CASE WHEN receipt_id % 2 = 0 THEN 'subscription' ELSE 'metered' END AS billing_type,
               CASE WHEN receipt_id % 7 <> 0 THEN amount END AS amount, currency, issued_on, CASE WHEN receipt_id % 5 = 0 THEN 'invoice' ELSE 'charge' END AS document_kind, receipt_id % 9 = 0 AS reviewed,
               CASE WHEN receipt_id % 10 = 3 THEN 'x' ELSE concat('U', user_id % 50, '@example.com') END AS recipient_name, '' AS recipient_memo, receipt_id % 8 = 1 AS recipient_checked,
               CASE receipt_id % 6 WHEN 0 THEN '' WHEN 1 THEN concat(chr(123), '"new_plan": ""', chr(125))
                    WHEN 2 THEN concat(chr(123), '"previous_plan": "my claude pro seat", "new_plan": "", "previous_plan_end": "', issued_on, '", "confidence": "high"', chr(125))
                    ELSE concat(chr(123), '"previous_plan": "Team  ", "new_plan": "Max plan - 5x", "change_date": "', issued_on, 'T00:00", "previous_plan_end": "', issued_on + 2, '", "confidence": 0.8, "adjustment_amount": "-1,234.5", "adjustment_currency": "$"', chr(125)) END AS plan_change
        FROM fx_receipts""",
    "fx_old_lines": """
        SELECT *, CASE WHEN line_key % 5 = 0 THEN 'processing' ELSE 'completed' END AS status, line_key % 7 <> 0 AS receipt_required, CASE WHEN line_key % 11 = 0 THEN 'ignored' ELSE 'matched' END AS match_status FROM fx_lines""",
    "fx_decided": """
        SELECT line_key, CASE WHEN line_key % 4 = 0 THEN 'inferred' ELSE 'unmatched' END AS status, merchant_key AS user_id, CAST(0 AS DOUBLE) AS confidence, true AS receipt_required, 'm' AS memo, line_key % 9 = 0 AS is_manual,
               CASE line_key % 8 WHEN 0 THEN 'confirm' WHEN 4 THEN 'reject' WHEN 5 THEN 'ignore' WHEN 6 THEN 'required' END AS action FROM fx_lines""",
}
KEY = "CASE WHEN service_label <> '' THEN 'ANTHROPIC' ELSE merchant_key END"


def plan_change_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = view(spark, sf_dir, "fx_users").select(F.lower("email").alias("address"), "user_id")
    out = ps.plan_change_documents(view(spark, sf_dir, "fx_plan_receipts"), users)
    return out.withColumn("confidence", F.round(F.col("confidence") * 100).cast("long"))


def plan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "fx_old_lines").withColumn("merchant_key", F.concat(F.lit("CATALOG:"), "merchant_key"))
    out = ps.plan_history(view(spark, sf_dir, "fx_plan_receipts"), lines)
    money = F.regexp_replace(F.col("evidence_key"), r"\.00$", "")
    return out.select(money.alias("evidence_key"), "user_id", "merchant_key", "plan_name", "event_date", (F.col("amount") * 100).cast("long").alias("amount"), "currency", "quality", F.col("recurring").cast("int").alias("recurring"), "source")


def _inferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "fx_decided")
    state = F.when(F.col("line_key") % 3 == 0, "rejected").otherwise("pending")
    return lines.where("line_key % 2 = 0").select("line_key", F.concat(F.lit("f"), F.col("line_key") % 10).alias("fingerprint"), "user_id", F.lit(0.9).alias("confidence"), state.alias("status"))


def inference_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, stored = view(spark, sf_dir, "fx_decided"), _inferences(spark, sf_dir)
    found = lines.where("line_key % 4 = 0").select("line_key", F.lit("new").alias("fingerprint"), "user_id", F.lit(0.8).alias("confidence"))
    return ps.merge_inferences(lines, found, stored).select("line_key", "fingerprint", "status")


def inference_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of an inference for each receipt that could explain one."""
    r = view(spark, sf_dir, "fx_plan_receipts").where("amount IS NOT NULL")
    columns = {
        "change_file": F.concat(F.lit("c"), "receipt_id", F.lit(".pdf")), "old_file": F.concat(F.lit("o"), "user_id", F.lit(".pdf")), "previous_plan": F.lit("Team"), "new_plan": F.col("plan_name"),
        "change_date": F.when(F.col("receipt_id") % 2 == 0, F.col("issued_on")), "previous_plan_end": F.col("issued_on"), "event_date": F.add_months("issued_on", -1), "amount": F.col("amount").cast("long"),
        "currency": F.col("currency"), "source": F.when(F.col("receipt_id") % 5 == 0, "statement").otherwise("receipt"), "unnamed": (F.col("receipt_id") % 3 == 1).cast("int"),
    }
    return r.select("receipt_id", ps.inference_reason(columns).alias("reason"))


def apply_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "fx_decided")
    items, _ = ps.apply_decisions(lines.drop("action"), _inferences(spark, sf_dir), lines.where("action IS NOT NULL").select("line_key", "action"))
    return items.select("line_key", "status", "user_id", F.col("confidence").cast("int").alias("confidence"), F.col("receipt_required").cast("int").alias("receipt_required"), "memo")


def decided_inferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "fx_decided")
    _, told = ps.apply_decisions(lines.drop("action"), _inferences(spark, sf_dir), lines.where("action IS NOT NULL").select("line_key", "action"))
    return told.select("line_key", "status")


def inferred_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each receipt as the older document and its neighbour by user as the change's."""
    r = view(spark, sf_dir, "fx_plan_receipts")
    wanted = r.select(F.col("receipt_id").alias("line_key"), F.expr("IF(receipt_id % 3 = 0, user_id, user_id % 40 + 1)").alias("user_id"), F.expr("IF(receipt_id % 2 = 0, service_id, NULL)").alias("old_service_id"), F.col("service_id").alias("change_service_id"))
    return ps.inferred_services(wanted, view(spark, sf_dir, "fx_services"))


QUERIES = {f.__name__: f for f in (plan_change_docs, plan_history, inference_merge, inference_reasons, apply_decisions, decided_inferences, inferred_service)}

ORACLE_SQL = {
    "plan_change_docs": with_clause("fx_plan_receipts", "fx_users") + f"""
        SELECT receipt_id AS change_id, coalesce(CASE WHEN recipient_checked THEN (SELECT u.user_id FROM fx_users AS u WHERE lower(u.email) = lower(recipient_name)) END, user_id) AS user_id, {KEY} AS merchant_key,
               CASE WHEN receipt_id % 6 = 2 THEN 'Claude Pro' ELSE 'Team' END AS previous_plan, CASE WHEN receipt_id % 6 = 2 THEN plan_name ELSE 'Max plan - 5x' END AS new_plan,
               CASE WHEN receipt_id % 6 > 2 THEN issued_on END AS change_date, CASE WHEN receipt_id % 6 = 2 THEN issued_on ELSE issued_on + 2 END AS previous_plan_end, CASE WHEN receipt_id % 6 = 2 THEN 95 ELSE 80 END AS confidence
        FROM fx_plan_receipts WHERE receipt_id % 6 >= 2""",
    "plan_history": with_clause("fx_plan_receipts", "fx_old_lines") + f"""
        SELECT concat('receipt:', receipt_id) AS evidence_key, user_id, {KEY} AS merchant_key, plan_name, issued_on AS event_date, amount * 100 AS amount, currency,
               CASE WHEN document_kind = 'charge' THEN 0 ELSE 1 END + CASE WHEN reviewed THEN 0 ELSE 1 END AS quality, CASE WHEN billing_type = 'subscription' THEN 1 ELSE 0 END AS recurring, 'receipt' AS source
        FROM fx_plan_receipts WHERE amount IS NOT NULL AND (plan_name <> '' OR billing_type = 'subscription')
        UNION ALL
        SELECT concat('statement:', line_key, ':', currency, ':', amount), NULL, concat('CATALOG:', merchant_key), '', line_date, amount * 100, currency, 5, 1, 'statement'
        FROM (SELECT line_key, merchant_key, line_date, 'USD' AS currency, original_amount AS amount FROM fx_old_lines WHERE original_amount IS NOT NULL AND status = 'completed' AND receipt_required AND match_status <> 'ignored'
              UNION ALL SELECT line_key, merchant_key, line_date, 'JPY', amount_jpy FROM fx_old_lines WHERE status = 'completed' AND receipt_required AND match_status <> 'ignored') AS o""",
    "inference_merge": with_clause("fx_decided") + """
        SELECT line_key, CASE WHEN line_key % 4 = 0 THEN 'new' ELSE concat('f', line_key % 10) END AS fingerprint,
               CASE WHEN line_key % 4 = 0 THEN 'pending' WHEN line_key % 3 = 0 THEN 'rejected' ELSE 'pending' END AS status
        FROM fx_decided WHERE line_key % 4 = 0 OR (line_key % 2 = 0 AND (is_manual OR (line_key % 3 = 0 AND status = 'unmatched')))""",
    "inference_reasons": with_clause("fx_plan_receipts") + """
        SELECT receipt_id, concat('契約変更書類「c', receipt_id, '.pdf」に、旧プラン Team、新プラン ', CASE WHEN plan_name <> '' THEN plan_name ELSE '未抽出' END, '、変更日 ',
               CASE WHEN receipt_id % 2 = 0 THEN CAST(issued_on AS VARCHAR) ELSE '未抽出' END, '、旧プラン終了日 ', issued_on, ' が明記されています。',
               CASE WHEN receipt_id % 5 = 0 THEN concat('前月のカード明細「o', user_id, '.pdf」に ', before, '、', amount, ' ', currency, ' の同一請求周期があり、')
                    WHEN receipt_id % 3 <> 1 THEN concat('過去領収書「o', user_id, '.pdf」には旧プラン Team が明記され、', before, '、', amount, ' ', currency, ' の実績があり、')
                    ELSE concat('過去領収書「o', user_id, '.pdf」では旧プラン名を抽出できませんでしたが、定期契約サービスとして、', before, '、', amount, ' ', currency, ' の実績があり、') END,
               '今回の明細の請求元・金額・通貨・請求周期と一致します。') AS reason
        FROM (SELECT *, CAST(issued_on - INTERVAL 1 MONTH AS DATE) AS before FROM fx_plan_receipts WHERE amount IS NOT NULL) AS r""",
    "apply_decisions": with_clause("fx_decided") + """
        SELECT line_key, CASE line_key % 8 WHEN 0 THEN 'matched' WHEN 4 THEN 'unmatched' WHEN 5 THEN 'ignored' WHEN 6 THEN 'unmatched' ELSE status END AS status,
               CASE WHEN line_key % 8 IN (4, 5, 6) THEN NULL ELSE user_id END AS user_id, CASE WHEN line_key % 8 IN (0, 5) THEN 1 ELSE 0 END AS confidence, CASE WHEN line_key % 8 = 5 THEN 0 ELSE 1 END AS receipt_required,
               CASE line_key % 8 WHEN 0 THEN '管理者が契約変更の推定を確定しました。' WHEN 5 THEN '管理者が領収書管理対象外にしました。' ELSE memo END AS memo FROM fx_decided""",
    "decided_inferences": with_clause("fx_decided") + """
        SELECT line_key, CASE line_key % 8 WHEN 0 THEN 'confirmed' WHEN 4 THEN 'rejected' ELSE CASE WHEN line_key % 3 = 0 THEN 'rejected' ELSE 'pending' END END AS status
        FROM fx_decided WHERE line_key % 2 = 0 AND line_key % 8 <> 6""",
    "inferred_service": with_clause("fx_plan_receipts", "fx_services") + """
        , w AS (
            SELECT receipt_id AS line_key, CASE WHEN receipt_id % 3 = 0 THEN user_id ELSE user_id % 40 + 1 END AS user_id, service_id AS sid FROM fx_plan_receipts
        ), t AS (
            SELECT line_key, w.user_id, s.service_id AS own, s.user_id AS owner, s.catalog_id, s.name, s.billing_type FROM w LEFT JOIN fx_services AS s ON s.service_id = w.sid
        ), best AS (
            SELECT *, row_number() OVER (PARTITION BY user_id, catalog_id ORDER BY is_active DESC, service_id) AS k FROM fx_services
        )
        SELECT line_key, CASE WHEN owner = t.user_id THEN own ELSE b.service_id END AS service_id FROM t LEFT JOIN best AS b ON b.user_id = t.user_id AND b.catalog_id = t.catalog_id AND b.k = 1""",
}
