"""Queries of requests, arrivals, messages and repairs with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import backfills as bf
from ..operators import messages as ms
from ..operators import requests as rq
from . import compliance_queries, queue_queries  # noqa: F401  they add views
from .fixtures import VIEWS, view, with_clause

VIEWS |= {
    "fx_held": """
        SELECT service_id, user_id, catalog_id, name, billing_type, is_active, uses_p_card, CASE WHEN service_id % 3 = 0 THEN '例外申請用途: need 7' ELSE '' END AS memo, registration_source, deactivation_source, final_receipt_month FROM fx_services""",
    "fx_wishes": """
        SELECT c_custkey AS request_id, c_custkey % (SELECT count(*) / 3 FROM {customer}) + 1 AS user_id, concat(CASE WHEN c_custkey % 2 = 0 THEN 'SERVICE ' ELSE 'Brand ' END, c_custkey % 11) AS service_name,
               CASE c_custkey % 11 % 3 WHEN 0 THEN 'metered' WHEN 1 THEN 'subscription' ELSE 'one_time' END AS billing_type, c_custkey % 3 = 0 AS uses_p_card, concat('need ', c_custkey % 10) AS purpose,
               CASE WHEN c_custkey % 7 = 0 THEN 'rejected' ELSE 'pending' END AS status, CASE c_custkey % 5 WHEN 0 THEN 'reject' WHEN 1 THEN NULL ELSE 'approve' END AS action
        FROM {customer}""",
    "fx_entries": """
        SELECT s_suppkey AS catalog_id, concat('Service ', s_suppkey) AS name, CASE s_suppkey % 3 WHEN 0 THEN 'metered' WHEN 1 THEN 'subscription' ELSE 'one_time' END AS billing_type, s_suppkey % 4 <> 0 AS is_active FROM {supplier}""",
    "fx_choices": """
        SELECT c_custkey AS user_id, c_custkey % (SELECT count(*) FROM {supplier}) + 1 AS catalog_id, c_custkey % 2 = 0 AS uses_p_card, CASE WHEN c_custkey % 3 = 0 THEN ' mine ' ELSE '' END AS memo FROM {customer}""",
    "fx_returns": """
        SELECT receipt_id, user_id, CAST(receipt_month + INTERVAL 1 MONTH AS DATE) AS period_month, concat('Service ', catalog_id) AS service_name, 'metered' AS billing_type, is_extra, 'm' AS memo, receipt_id % 9 <> 0 AS has_result,
               CASE receipt_id % 4 WHEN 0 THEN concat('AIの推奨。理由: wrong card。', chr(10), 'audit') WHEN 1 THEN 'plain advice' ELSE '' END AS recommendation, CASE WHEN receipt_id % 8 = 2 THEN '日付' ELSE '' END AS unchecked,
               CASE WHEN receipt_id % 5 = 0 THEN 'by hand.' ELSE '' END AS reason FROM fx_receipts""",
    "fx_uploads": """
        SELECT receipt_id, user_id, service_id, is_extra, file, CASE WHEN receipt_id % 3 = 0 THEN 'usd' ELSE currency END AS currency, CAST(issued_on AS TIMESTAMP) AS uploaded_at FROM fx_receipts""",
    "fx_old_items": """
        SELECT line_key, statement_id, CASE WHEN line_key % 3 <> 0 THEN line_key END AS receipt_id, CASE WHEN line_key % 4 = 0 THEN merchant_key END AS service_id, merchant_key AS user_id,
               CASE line_key % 6 WHEN 0 THEN 'ignored' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'ambiguous' ELSE 'matched' END AS match_status, CASE WHEN line_key % 5 = 0 THEN 1.0 ELSE 0.5 END AS confidence,
               CASE WHEN line_key % 5 < 2 THEN '管理者 ok' ELSE 'auto' END AS memo, line_key % 7 <> 0 AS receipt_required FROM fx_lines""",
    "fx_old_statements": """
        SELECT statement_id, CAST(date_trunc('month', min(line_date) + 1) AS DATE) AS period_month, min(merchant_key) AS user_id, CASE statement_id % 5 WHEN 0 THEN 'processing' WHEN 1 THEN 'failed' ELSE 'completed' END AS status,
               CASE WHEN statement_id % 3 > 0 THEN 'unknown' WHEN statement_id % 100 = 12 THEN concat(CAST(floor(statement_id / 100) AS BIGINT) + 1, '-01') ELSE concat(CAST(floor(statement_id / 100) AS BIGINT), '-', right(concat('0', statement_id % 100 + 1), 2)) END AS statement_period, CASE WHEN statement_id % 2 = 0 THEN 'note【再】' ELSE 'note' END AS memo
        FROM fx_lines GROUP BY statement_id""",
}


def _flag(*names: str) -> list:
    return [F.col(n).cast("int").alias(n) for n in names]


def dq_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    wishes = view(spark, sf_dir, "fx_wishes")
    return rq.request_problems(wishes, view(spark, sf_dir, "fx_held"), view(spark, sf_dir, "fx_entries"), wishes)


def _approved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    wishes = view(spark, sf_dir, "fx_wishes")
    return rq.approve_requests(wishes.drop("action"), wishes.select("request_id", "action").where("action IS NOT NULL"), view(spark, sf_dir, "fx_held"), view(spark, sf_dir, "fx_entries"))


def apply_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services after approvals; new ones are named by user and entry, not by their new numbers."""
    _, services, catalog = _approved(spark, sf_dir)
    return services.select("user_id", "name", "billing_type", *_flag("is_active", "uses_p_card"), "memo", "registration_source")


def requested_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _approved(spark, sf_dir)[2].select("catalog_id", F.lower("name").alias("name"), "billing_type", *_flag("is_active"))


def judged_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _approved(spark, sf_dir)[0].select("request_id", "status")


def register_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rq.register_services(view(spark, sf_dir, "fx_choices"), view(spark, sf_dir, "fx_held"), view(spark, sf_dir, "fx_entries"))
    return out.select("service_id", "user_id", "catalog_id", "name", "billing_type", *_flag("is_active", "uses_p_card"), "memo", "registration_source")


def renamed_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = view(spark, sf_dir, "fx_entries")
    renamed = entries.where("NOT is_active").select("catalog_id", F.concat(F.lit("New "), "catalog_id").alias("new_name"), F.lit("other").alias("new_billing"))
    return rq.rename_entries(view(spark, sf_dir, "fx_held"), entries, renamed)[0].select("service_id", "name", "billing_type")


def _returned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    receipts = view(spark, sf_dir, "fx_returns")
    asked = receipts.where("NOT is_extra").select("receipt_id", "reason").where("receipt_id % 10 < 5")
    return rq.request_resubmissions(receipts.drop("reason"), asked, view(spark, sf_dir, "fx_submissions"))


def request_resubmission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _returned(spark, sf_dir)[0].select("receipt_id", "user_id", "period_month", "message")


def reopened_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions after receipts were sent back, without those that lost their last receipt."""
    _, left, submissions = _returned(spark, sf_dir)
    receipts = view(spark, sf_dir, "fx_returns")
    gone = receipts.join(left.select("receipt_id"), "receipt_id", "left_anti")
    return rq.drop_empty_submissions(submissions, receipts, gone).select("user_id", "period_month", "status")


def off_card_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    wishes = view(spark, sf_dir, "fx_wishes").withColumns({"is_extra": F.col("request_id") % 13 == 0, "status": F.when(F.col("status") == "pending", "open").otherwise("resolved")})
    return rq.resolve_off_card(wishes, view(spark, sf_dir, "fx_held").where("NOT uses_p_card")).select("request_id", "status")


def arrival_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rq.arrival_snapshots(view(spark, sf_dir, "fx_uploads"), view(spark, sf_dir, "fx_held"), 5)
    return out.select("receipt_id", "currency", "service_name", "billing_type", *_flag("p_card_snapshot"), F.to_date("expires_at").alias("expires_on"))


def removed_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that stay when the statements that failed go."""
    gone = view(spark, sf_dir, "fx_old_statements").where("status = 'failed'")
    return rq.remove_statements(gone, {"items": view(spark, sf_dir, "fx_old_items")})["items"].select("line_key")


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("service_id") % 3 == 0, "missing").when(F.col("service_id") % 3 == 1, "api_pending").otherwise("uploaded")
    return view(spark, sf_dir, "fx_services").select("user_id", F.lit("1998-02-01").cast("date").alias("receipt_month"), "name", "billing_type", state.alias("status"))


def _addressees(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = view(spark, sf_dir, "fx_users")
    return users.select("user_id", F.lit("1998-02-01").cast("date").alias("receipt_month"), F.col("username").alias("user_name"), "email", (F.col("account_status") == "stopped").alias("stopped"))


def reminder_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ms.reminder_messages(_addressees(spark, sf_dir), _status(spark, sf_dir), "urgent", "{app_name} {receipt_month} {other}", "{user_name} 様\n{missing_services}\n--\n{api_pending_services}\n{upload_url}", "App", "https://x.example/")
    return out.select("user_id", "subject", "body")


def resubmission_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = view(spark, sf_dir, "fx_returns").select(
        F.col("receipt_id").alias("request_id"), F.concat(F.lit("u"), "user_id").alias("user_name"), "period_month", "service_name", "billing_type", "is_extra", F.when(F.col("receipt_id") % 2 == 0, "a.pdf").otherwise("").alias("filename"), F.lit(" do it ").alias("message")
    )
    return ms.resubmission_messages(asked, "App", "https://x.example/")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = view(spark, sf_dir, "fx_users").where("user_id % 4 < 2")
    key = F.concat(F.lit("urgent:1998-03:user-"), "user_id", F.lit(":"), F.lower("email"))
    return users.select(key.alias("idempotency_key"), F.when(F.col("user_id") % 4 == 0, "sent").otherwise("failed").alias("status"))


def message_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.outbox(_addressees(spark, sf_dir), _log(spark, sf_dir), "urgent").select("user_id", "idempotency_key", "action", "status")


def message_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected, waiting = _addressees(spark, sf_dir), ms.outbox(_addressees(spark, sf_dir), _log(spark, sf_dir), "urgent")
    tried = waiting.withColumn("status", F.when(F.col("stopped"), "skipped").when(F.col("user_id") % 5 == 0, "failed").otherwise("sent"))
    return ms.run_counts(selected, tried)


def backfill_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bf.link_owners(view(spark, sf_dir, "fx_old_items"), view(spark, sf_dir, "fx_receipts"), view(spark, sf_dir, "fx_services"), view(spark, sf_dir, "fx_old_statements"))


def backfill_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shifted(spark, sf_dir)[0].select("statement_id", "period_month", "status")


def _shifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    receipts = view(spark, sf_dir, "fx_receipts").select("receipt_id", F.col("receipt_month").alias("period_month"))
    return bf.shift_months(view(spark, sf_dir, "fx_old_statements"), view(spark, sf_dir, "fx_old_items"), receipts)


def backfill_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shifted(spark, sf_dir)[1].select("line_key", "receipt_id", "user_id", "service_id", "match_status", "memo")


def backfill_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bf.reason_codes(view(spark, sf_dir, "fx_old_items"))


def retired_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bf.retire_ambiguous(view(spark, sf_dir, "fx_old_items"))


def marked_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bf.mark_pending(view(spark, sf_dir, "fx_old_statements"), "【再】")


def requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, k = view(spark, sf_dir, "fx_receipts"), F.col("receipt_id")
    state = F.element_at(F.array(*[F.lit(x) for x in ("generated", "needs_review", "queued", "failed")]), (k % 4 + 1).cast("int"))
    flags = {n: k % m != 0 for n, m in (("amount_ok", 5), ("date_ok", 7), ("currency_ok", 11))}
    marked = r.withColumns({"state": state, "available": F.col("file") != "", "reviewed": k % 6 == 0, "generated_filename": F.lit("x.pdf"), "recommended": k % 2 == 0, **flags})
    return bf.requeue_incomplete(marked).select("receipt_id", "state", "generated_filename", *_flag("recommended"))


def unconfirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("receipt_id")
    r = view(spark, sf_dir, "fx_receipts").withColumns({"checked": k % 5 != 0, "issued_on": F.when(k % 7 != 0, F.date_add("issued_on", (k % 3 * 10).cast("int"))), "reviewed": k % 2 == 0})
    return bf.unconfirm_mismatches(r).select("receipt_id", "period_state", *_flag("reviewed"))


def upload_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("receipt_id")
    r = view(spark, sf_dir, "fx_receipts").select("receipt_id", "user_id", F.when(k % 3 == 0, F.lit(1).cast("long")).alias("uploaded_by"), F.when(k % 3 == 0, "admin").otherwise("").alias("upload_source"))
    return bf.upload_actors(r)


def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as texts print them, from customers: parts of file names, contexts, labels."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    k = F.col("k")
    firm = F.concat(F.lit("Vendor: Shop "), k, F.element_at(F.array(*[F.lit(x) for x in (" Inc.", ", LLC", " GmbH", " / K.K.")]), (k % 4 + 1).cast("int")))
    last, mail = F.when(k % 3 == 0, F.concat(F.lit("O'N: "), k)).otherwise(""), F.when(k % 2 == 0, F.concat(F.lit("a.b-"), k, F.lit("@x.example"))).otherwise("")
    login, month = F.concat(F.lit("log_"), k), F.lit("2026-07-03").cast("date")
    return c.select(
        "k", t.party_name(firm).alias("payee"), t.company_part(t.party_name(firm)).alias("company"), t.user_part(last, mail, login).alias("user_part"), t.recipient_context(F.lit("Ann"), last, mail, login).alias("context"),
        t.context_text(firm).alias("relation_text"), t.service_name(F.lit("S"), F.when(k % 2 == 0, "metered").otherwise("odd")).alias("service"), t.display_filename(F.lit(""), F.when(k % 2 == 0, "o.pdf"), F.concat(F.lit("in/"), k)).alias("shown"),
        t.strip_memo(F.concat(F.lit("own "), k, F.lit("【m】x")), "【m】").alias("memo"), ms.month_label(month).alias("label"), ms.month_query(month).alias("query"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        dq_requests, apply_requests, requested_entries, judged_requests, register_services, renamed_services, request_resubmission, reopened_submissions, off_card_requests, arrival_snapshots, removed_statements,
        reminder_messages, resubmission_notices, message_outbox, message_runs, backfill_owners, backfill_months, backfill_items, backfill_reasons, retired_items, marked_statements, requeue, unconfirmed, upload_actors, name_parts,
    )
}

APPROVED = """
, yes AS (
    SELECT *, lower(service_name) AS low FROM fx_wishes WHERE status = 'pending' AND action = 'approve'
), known AS (
    SELECT lower(name) AS low, billing_type, min(catalog_id) AS catalog_id FROM fx_entries GROUP BY lower(name), billing_type
), asked AS (
    SELECT y.low, y.billing_type, arg_min(service_name, request_id) AS new_name, any_value(k.catalog_id) AS catalog_id FROM yes AS y LEFT JOIN known AS k ON k.low = y.low AND k.billing_type = y.billing_type GROUP BY y.low, y.billing_type
), made AS (
    SELECT low, billing_type, new_name, (SELECT max(catalog_id) FROM fx_entries) + row_number() OVER (ORDER BY low, billing_type) AS catalog_id FROM asked WHERE catalog_id IS NULL
), entries AS (
    SELECT catalog_id, name, billing_type, is_active OR catalog_id IN (SELECT catalog_id FROM asked WHERE catalog_id IS NOT NULL) AS is_active FROM fx_entries
    UNION ALL SELECT catalog_id, new_name, billing_type, true FROM made
), targets AS (
    SELECT low, billing_type, catalog_id FROM asked WHERE catalog_id IS NOT NULL UNION ALL SELECT low, billing_type, catalog_id FROM made
), wishes AS (
    SELECT y.user_id, y.low, y.billing_type, arg_max(uses_p_card, request_id) AS card, list(concat('例外申請用途: ', purpose) ORDER BY request_id) AS notes, any_value(e.name) AS entry_name
    FROM yes AS y JOIN targets AS g ON g.low = y.low AND g.billing_type = y.billing_type JOIN entries AS e ON e.catalog_id = g.catalog_id GROUP BY y.user_id, y.low, y.billing_type
), mine AS (
    SELECT user_id, lower(name) AS low, billing_type, min(service_id) AS service_id FROM fx_held GROUP BY user_id, lower(name), billing_type
), hits AS (
    SELECT w.*, m.service_id FROM wishes AS w LEFT JOIN mine AS m ON m.user_id = w.user_id AND m.low = w.low AND m.billing_type = w.billing_type
)"""
CHOSEN = """
, chosen AS (
    SELECT c.*, e.name AS entry_name, e.billing_type AS entry_billing,
           (SELECT min(service_id) FROM fx_held AS h WHERE h.user_id = c.user_id AND (h.catalog_id = c.catalog_id OR (lower(h.name) = lower(e.name) AND h.billing_type = e.billing_type))) AS service_id
    FROM fx_choices AS c JOIN fx_entries AS e ON e.catalog_id = c.catalog_id
)"""
SENT = """
, sent AS (
    SELECT * FROM fx_returns WHERE has_result AND NOT is_extra AND receipt_id % 10 < 5
)"""
MAIL = "FROM fx_users"
ORACLE_SQL = {
    "dq_requests": with_clause("fx_wishes", "fx_held", "fx_entries") + """
        SELECT request_id, concat_ws(',', CASE WHEN EXISTS (SELECT 1 FROM fx_held AS h WHERE h.is_active AND h.user_id = w.user_id AND lower(h.name) = lower(w.service_name) AND h.billing_type = w.billing_type) THEN 'already used' END,
               (SELECT CASE WHEN e.is_active THEN 'in catalog' ELSE 'in catalog, inactive' END FROM fx_entries AS e WHERE lower(e.name) = lower(w.service_name) AND e.billing_type = w.billing_type ORDER BY catalog_id LIMIT 1),
               CASE WHEN EXISTS (SELECT 1 FROM fx_wishes AS o WHERE o.status = 'pending' AND o.user_id = w.user_id AND lower(o.service_name) = lower(w.service_name) AND o.billing_type = w.billing_type AND o.request_id <> w.request_id) THEN 'already asked' END) AS problems
        FROM fx_wishes AS w""",
    "apply_requests": with_clause("fx_wishes", "fx_held", "fx_entries").rstrip() + APPROVED + """
        SELECT s.user_id, coalesce(h.entry_name, s.name) AS name, s.billing_type, CASE WHEN s.is_active OR h.user_id IS NOT NULL THEN 1 ELSE 0 END AS is_active, CASE WHEN coalesce(h.card, s.uses_p_card) THEN 1 ELSE 0 END AS uses_p_card,
               CASE WHEN h.user_id IS NULL THEN s.memo ELSE array_to_string(list_filter(list_prepend(s.memo, list_filter(h.notes, lambda n: n <> s.memo)), lambda x: x <> ''), chr(10)) END AS memo,
               CASE WHEN h.user_id IS NULL THEN s.registration_source ELSE 'exception_request' END AS registration_source
        FROM fx_held AS s LEFT JOIN hits AS h ON h.service_id = s.service_id
        UNION ALL SELECT user_id, entry_name, billing_type, 1, CASE WHEN card THEN 1 ELSE 0 END, array_to_string(notes, chr(10)), 'exception_request' FROM hits WHERE service_id IS NULL""",
    "requested_entries": with_clause("fx_wishes", "fx_held", "fx_entries").rstrip() + APPROVED + "SELECT catalog_id, lower(name) AS name, billing_type, CASE WHEN is_active THEN 1 ELSE 0 END AS is_active FROM entries",
    "judged_requests": with_clause("fx_wishes") + """
        SELECT request_id, CASE WHEN status = 'pending' AND action = 'approve' THEN 'approved' WHEN status = 'pending' AND action = 'reject' THEN 'rejected' ELSE status END AS status FROM fx_wishes""",
    "register_services": with_clause("fx_choices", "fx_held", "fx_entries").rstrip() + CHOSEN + """
        SELECT s.service_id, s.user_id, coalesce(c.catalog_id, s.catalog_id) AS catalog_id, coalesce(c.entry_name, s.name) AS name, coalesce(c.entry_billing, s.billing_type) AS billing_type,
               CASE WHEN s.is_active OR c.user_id IS NOT NULL THEN 1 ELSE 0 END AS is_active, CASE WHEN coalesce(c.uses_p_card, s.uses_p_card) THEN 1 ELSE 0 END AS uses_p_card,
               CASE WHEN trim(c.memo) <> '' THEN trim(c.memo) ELSE s.memo END AS memo, CASE WHEN c.user_id IS NULL THEN s.registration_source ELSE 'user' END AS registration_source
        FROM fx_held AS s LEFT JOIN chosen AS c ON c.service_id = s.service_id
        UNION ALL SELECT (SELECT max(service_id) FROM fx_held) + row_number() OVER (ORDER BY user_id, catalog_id), user_id, catalog_id, entry_name, entry_billing, 1, CASE WHEN uses_p_card THEN 1 ELSE 0 END, trim(memo), 'user'
        FROM chosen WHERE service_id IS NULL""",
    "renamed_services": with_clause("fx_held", "fx_entries") + """
        SELECT service_id, CASE WHEN e.is_active THEN h.name ELSE concat('New ', h.catalog_id) END AS name, CASE WHEN e.is_active THEN h.billing_type ELSE 'other' END AS billing_type
        FROM fx_held AS h JOIN fx_entries AS e ON e.catalog_id = h.catalog_id""",
    "request_resubmission": with_clause("fx_returns").rstrip() + SENT + """
        SELECT receipt_id, user_id, period_month, CASE WHEN reason <> '' THEN 'by hand' WHEN receipt_id % 4 = 0 THEN 'wrong card' WHEN receipt_id % 4 = 1 THEN 'plain advice'
               WHEN unchecked <> '' THEN '管理者確認で未確認項目が残りました: 日付' ELSE '管理者が領収書本体を確認し、再提出が必要と判断しました' END AS message FROM sent""",
    "reopened_submissions": with_clause("fx_returns", "fx_submissions").rstrip() + SENT + """
        SELECT user_id, period_month, CASE WHEN status = 'submitted' AND EXISTS (SELECT 1 FROM sent AS x WHERE x.user_id = s.user_id AND x.period_month = s.period_month) THEN 'draft' ELSE status END AS status FROM fx_submissions AS s
        WHERE NOT (EXISTS (SELECT 1 FROM sent AS x WHERE x.user_id = s.user_id AND x.period_month = s.period_month)
                   AND NOT EXISTS (SELECT 1 FROM fx_returns AS r WHERE r.user_id = s.user_id AND r.period_month = s.period_month AND r.receipt_id NOT IN (SELECT receipt_id FROM sent)))""",
    "off_card_requests": with_clause("fx_wishes", "fx_held") + """
        SELECT request_id, CASE WHEN status <> 'pending' THEN 'resolved' WHEN request_id % 13 <> 0 AND EXISTS (SELECT 1 FROM fx_held AS h WHERE NOT h.uses_p_card AND h.user_id = w.user_id AND lower(h.name) = lower(w.service_name)
               AND h.billing_type = w.billing_type) THEN 'resolved' ELSE 'open' END AS status FROM fx_wishes AS w""",
    "arrival_snapshots": with_clause("fx_uploads", "fx_held") + """
        SELECT receipt_id, upper(currency) AS currency, CASE WHEN is_extra THEN 'その他' ELSE coalesce(h.name, '') END AS service_name, CASE WHEN is_extra THEN 'other' ELSE h.billing_type END AS billing_type,
               CASE WHEN NOT is_extra AND coalesce(h.uses_p_card, false) THEN 1 ELSE 0 END AS p_card_snapshot, CASE WHEN file <> '' THEN CAST(uploaded_at + INTERVAL 3 MONTH AS DATE) END AS expires_on
        FROM fx_uploads AS a LEFT JOIN fx_held AS h ON h.service_id = a.service_id""",
    "removed_statements": with_clause("fx_old_items", "fx_old_statements") + "SELECT line_key FROM fx_old_items WHERE statement_id NOT IN (SELECT statement_id FROM fx_old_statements WHERE status = 'failed')",
    "reminder_messages": with_clause("fx_users", "fx_services") + """
        SELECT user_id, '【重要】App 1998年02月 {other}' AS subject, concat(username, ' 様', chr(10), coalesce((SELECT string_agg(line, chr(10) ORDER BY name, billing_type) FROM lines AS l WHERE l.user_id = u.user_id AND k = 0), '・なし'), chr(10), '--', chr(10),
               coalesce((SELECT string_agg(line, chr(10) ORDER BY name, billing_type) FROM lines AS l WHERE l.user_id = u.user_id AND k = 1), '・なし'), chr(10), 'https://x.example/?receipt_month=1998-02') AS body
        FROM fx_users AS u""".replace("SELECT user_id, '【重要】", """, lines AS (SELECT user_id, service_id % 3 AS k, name, billing_type, concat('・', name, '（', CASE billing_type WHEN 'metered' THEN '従量課金 / API' WHEN 'subscription' THEN 'サブスク' ELSE '一回払い' END, '）') AS line FROM fx_services)
        SELECT user_id, '【重要】""", 1),
    "resubmission_notices": with_clause("fx_returns") + """
        SELECT receipt_id AS request_id, concat('【再提出依頼】App: ', label, '分 ', shown, ' の領収書を再度アップロードしてください') AS subject,
               concat('u', user_id, ' 様', chr(10), chr(10), '対象領収書月: ', label, chr(10), '対象サービス: ', shown, chr(10), '対象ファイル: ', CASE WHEN receipt_id % 2 = 0 THEN 'a.pdf' ELSE '-' END, chr(10), chr(10), 'do it', chr(10), chr(10),
                      '以下のページから正しい領収書を再度アップロードしてください。', chr(10), 'https://x.example/?receipt_month=', strftime(m, '%Y-%m')) AS body
        FROM (SELECT *, CAST(period_month - INTERVAL 1 MONTH AS DATE) AS m, strftime(CAST(period_month - INTERVAL 1 MONTH AS DATE), '%Y年%m月') AS label, CASE WHEN is_extra THEN 'その他' ELSE concat(service_name, '（従量課金 / API）') END AS shown FROM fx_returns) AS r""",
    "message_outbox": with_clause("fx_users") + f"""
        SELECT user_id, concat('urgent:1998-03:user-', user_id, ':', lower(email)) AS idempotency_key, CASE WHEN user_id % 4 = 1 THEN 'retry' ELSE 'insert' END AS action, CASE WHEN account_status = 'stopped' THEN 'skipped' ELSE 'pending' END AS status
        {MAIL} WHERE user_id % 4 <> 0""",
    "message_runs": with_clause("fx_users") + f"""
        SELECT DATE '1998-02-01' AS receipt_month, count(*) AS selected, count(CASE WHEN user_id % 4 <> 0 AND account_status <> 'stopped' AND user_id % 5 <> 0 THEN 1 END) AS sent,
               count(CASE WHEN user_id % 4 <> 0 AND account_status = 'stopped' THEN 1 END) AS skipped, count(CASE WHEN user_id % 4 <> 0 AND account_status <> 'stopped' AND user_id % 5 = 0 THEN 1 END) AS failed,
               count(CASE WHEN user_id % 4 = 0 THEN 1 END) AS already_sent {MAIL}""",
    "backfill_owners": with_clause("fx_old_items", "fx_receipts", "fx_services", "fx_old_statements") + """
        SELECT line_key, coalesce(r.user_id, s.user_id, t.user_id) AS user_id, coalesce(e.catalog_id, s.catalog_id) AS catalog_id FROM fx_old_items AS i LEFT JOIN fx_receipts AS r ON r.receipt_id = i.receipt_id
        LEFT JOIN fx_services AS e ON e.service_id = r.service_id LEFT JOIN fx_services AS s ON s.service_id = i.service_id LEFT JOIN fx_old_statements AS t ON t.statement_id = i.statement_id""",
    "backfill_months": with_clause("fx_old_statements") + """
        SELECT statement_id, CASE WHEN statement_period = strftime(CAST(period_month + INTERVAL 1 MONTH AS DATE), '%Y-%m') THEN CAST(period_month + INTERVAL 1 MONTH AS DATE) ELSE period_month END AS period_month,
               CASE WHEN status = 'completed' THEN 'needs_review' ELSE status END AS status FROM fx_old_statements""",
    "backfill_items": with_clause("fx_old_items", "fx_old_statements", "fx_receipts") + """
        SELECT line_key, CASE WHEN NOT wrong THEN receipt_id END AS receipt_id, CASE WHEN NOT lost THEN user_id END AS user_id, CASE WHEN NOT lost THEN service_id END AS service_id,
               CASE WHEN lost AND match_status = 'matched' THEN 'ambiguous' ELSE match_status END AS match_status, CASE WHEN wrong THEN concat(memo, ' 旧月次ルールで照合された領収書を解除しました。') ELSE memo END AS memo
        FROM (SELECT *, wrong AND NOT (confidence >= 1 AND memo LIKE '管理者%') AS lost FROM (
              SELECT i.line_key, i.receipt_id, i.user_id, i.service_id, i.match_status, i.memo, i.confidence, coalesce(s.status = 'completed' AND r.receipt_month <> CASE WHEN s.statement_period = strftime(CAST(s.period_month + INTERVAL 1 MONTH AS DATE), '%Y-%m')
                     THEN CAST(s.period_month + INTERVAL 1 MONTH AS DATE) ELSE s.period_month END, false) AS wrong
              FROM fx_old_items AS i JOIN fx_old_statements AS s ON s.statement_id = i.statement_id LEFT JOIN fx_receipts AS r ON r.receipt_id = i.receipt_id) AS x) AS y""",
    "backfill_reasons": with_clause("fx_old_items") + """
        SELECT line_key, CASE WHEN match_status = 'ignored' THEN 'ignored' WHEN confidence >= 1 AND memo LIKE '管理者%' THEN 'manual_confirmed' WHEN receipt_id IS NOT NULL AND match_status = 'matched' THEN 'auto_strong'
               WHEN receipt_id IS NOT NULL AND match_status = 'ambiguous' THEN 'auto_amount_only' WHEN service_id IS NOT NULL THEN 'service_only' WHEN match_status = 'ambiguous' THEN 'insufficient_evidence' ELSE 'no_compatible_receipt' END AS reason_code
        FROM fx_old_items""",
    "retired_items": with_clause("fx_old_items") + "SELECT line_key, CASE WHEN match_status <> 'ambiguous' THEN match_status WHEN receipt_required THEN 'unmatched' ELSE 'ignored' END AS match_status FROM fx_old_items",
    "marked_statements": with_clause("fx_old_statements") + "SELECT statement_id, CASE WHEN status = 'completed' AND memo = 'note' THEN 'note 【再】' ELSE memo END AS memo FROM fx_old_statements",
    "requeue": with_clause("fx_receipts") + """
        SELECT receipt_id, CASE WHEN again THEN 'not_processed' ELSE CASE receipt_id % 4 WHEN 0 THEN 'generated' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'queued' ELSE 'failed' END END AS state, CASE WHEN again THEN '' ELSE 'x.pdf' END AS generated_filename,
               CASE WHEN receipt_id % 2 = 0 AND NOT again THEN 1 ELSE 0 END AS recommended
        FROM (SELECT receipt_id, file <> '' AND receipt_id % 6 <> 0 AND receipt_id % 4 <> 2 AND (receipt_id % 5 = 0 OR receipt_id % 7 = 0 OR receipt_id % 11 = 0) AS again FROM fx_receipts) AS r""",
    "unconfirmed": with_clause("fx_receipts") + """
        SELECT receipt_id, state AS period_state, CASE WHEN receipt_id % 2 = 0 AND state <> 'mismatched' THEN 1 ELSE 0 END AS reviewed
        FROM (SELECT receipt_id, CASE WHEN receipt_id % 5 = 0 THEN 'not_checked' WHEN receipt_id % 7 = 0 THEN 'unknown' WHEN date_trunc('month', issued_on + CAST(receipt_id % 3 * 10 AS INTEGER)) = receipt_month THEN 'matched' ELSE 'mismatched' END AS state
              FROM fx_receipts) AS r""",
    "upload_actors": with_clause("fx_receipts") + "SELECT receipt_id, CASE WHEN receipt_id % 3 = 0 THEN 1 ELSE user_id END AS uploaded_by, CASE WHEN receipt_id % 3 = 0 THEN 'admin' ELSE 'user' END AS upload_source FROM fx_receipts",
    "name_parts": """
        SELECT k, concat('Shop ', k, form) AS payee, CASE k % 4 WHEN 3 THEN concat('Shop_', k) ELSE concat('Shop_', k) END AS company, CASE WHEN k % 3 = 0 THEN concat('O''N_', k) WHEN k % 2 = 0 THEN concat('a.b-', k) ELSE concat('log_', k) END AS user_part,
               concat('登録氏名=Ann', CASE WHEN k % 3 = 0 THEN concat(' O''N: ', k) ELSE '' END, ' / アカウント=', CASE WHEN k % 2 = 0 THEN concat('a.b-', k, '@x.example') ELSE concat('log_', k) END, ' / 氏名候補=', CASE WHEN k % 2 = 0 THEN concat('a b ', k) ELSE concat('log ', k) END) AS context,
               concat('vendor shop ', k, CASE WHEN k % 4 = 3 THEN ' k k' ELSE '' END) AS relation_text, CASE WHEN k % 2 = 0 THEN 'S（従量課金 / API）' ELSE 'S（odd）' END AS service, CASE WHEN k % 2 = 0 THEN 'o.pdf' ELSE CAST(k AS VARCHAR) END AS shown,
               concat('own ', k) AS memo, '2026年07月' AS label, '2026-07' AS query
        FROM (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ', LLC' WHEN 2 THEN ' GmbH' ELSE ' / K.K.' END AS form FROM customer) AS c""",
}
