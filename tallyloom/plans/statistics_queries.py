"""Queries of month statistics, lists, audits, batches and changed statements with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text as t
from ..operators import changes as ch
from ..operators import compliance as c
from ..operators import incremental as inc
from ..operators import matching as m
from ..operators import queues as q
from ..operators import requests as rq
from ..operators import review as rv
from ..operators import statistics as st
from ..sources.stages import staged
from . import queue_queries  # noqa: F401  it adds the views of requests and statements
from .compliance_queries import ALL, AS_OF, HISTORY, _flags, _history
from .fixtures import VIEWS, view, with_clause
from .matching_queries import DEDUP, EDGES, OPTIONS

VIEWS |= {
    "fx_checked": """
        SELECT *, CASE WHEN state IN ('generated', 'needs_review', 'failed', 'skipped') THEN CASE WHEN period THEN 'matched' ELSE 'mismatched' END ELSE 'not_checked' END AS period_state,
               receipt_id % 4 = 0 AS card_checked, receipt_id % 8 = 0 AS card
        FROM fx_review""",
    "fx_files": """
        SELECT receipt_id, CASE WHEN is_extra THEN 'extra' ELSE 'receipt' END AS kind, file, file_deleted, CAST(issued_on + INTERVAL 3 MONTH AS TIMESTAMP) AS expires_at FROM fx_receipts""",
    "fx_exceptions": """
        SELECT o_orderkey AS request_id, o_custkey AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN 'NAME ' ELSE 'name ' END || CAST(o_orderkey % 5 AS VARCHAR(9)) AS service_name,
               CASE o_orderkey % 3 WHEN 0 THEN 'metered' ELSE 'subscription' END AS billing_type, CASE o_orderkey % 4 WHEN 0 THEN 'approved' ELSE 'pending' END AS status
        FROM {orders}""",
    "fx_items_used": """
        SELECT rk AS row_id, l_orderkey AS item_key, l_partkey % 40 AS receipt_id, concat('c', l_suppkey % 5) AS component_key,
               CASE WHEN l_partkey % 3 > 0 THEN concat('mail:', l_orderkey, ':', l_partkey % 4) END AS idempotency_key FROM fx_base""",
    "fx_accounts": """
        SELECT user_id, email AS address FROM fx_users UNION ALL SELECT user_id, CASE WHEN user_id % 7 = 0 THEN concat('u', user_id + 7, '@example.com') ELSE username END FROM fx_users""",
    "fx_memos": """
        SELECT statement_id, period_month, status, concat('注記 ', CASE statement_id %% 16 %s ELSE '' END, ' 以上') AS memo FROM fx_statements"""
    % " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(inc.RECONCILE_MARKERS)),
}


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.review_status(view(spark, sf_dir, "fx_checked").withColumn("amount", F.col("amount").cast("boolean")))


def month_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, services, asked = (view(spark, sf_dir, f"fx_{n}") for n in ("users", "services", "asked"))
    facts = st.month_facts(_history(spark, sf_dir), users, c.user_service_counts(users, services), _reviewed(spark, sf_dir), asked)
    return _flags(st.month_statistics(facts))


def own_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(st.own_history(_history(spark, sf_dir).where("has_submission"), view(spark, sf_dir, "fx_submissions")))


def submission_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.submission_list(view(spark, sf_dir, "fx_submissions"), view(spark, sf_dir, "fx_receipts"))


def resubmission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = view(spark, sf_dir, "fx_requests").join(view(spark, sf_dir, "fx_asked").select("request_id", "status"), "request_id")
    return st.resubmission_rows(asked, view(spark, sf_dir, "fx_users"), view(spark, sf_dir, "fx_services")).select("request_id", "receipt_month", "status", "username", "service_name", "place")


def open_resubmissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.open_resubmissions(view(spark, sf_dir, "fx_asked"), ["user_id", "receipt_month"])


def active_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(st.active_assignments(*(view(spark, sf_dir, f"fx_{n}") for n in ("catalog", "services", "users"))))


def offered_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.offered_catalogs(*(view(spark, sf_dir, f"fx_{n}") for n in ("catalog", "services", "users"))).select("catalog_id", "name")


def managed_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(st.managed_receipts(view(spark, sf_dir, "fx_receipts"), view(spark, sf_dir, "fx_users")).select("receipt_id", "user_id", "receipt_month", "user_active"))


def key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys that must be unique, counted in one aggregation."""
    at = {n: view(spark, sf_dir, f"fx_{n}") for n in ("catalog", "services", "exceptions", "submissions", "declarations", "items_used", "accounts")}
    col = F.col
    return st.repeated_keys({
        "catalog": (at["catalog"], {"catalog": (None, [F.lower(F.substring("name", 1, 16)), col("billing_type")])}),
        "services": (at["services"], {"service": (None, [col("user_id"), F.lower(F.substring("name", 1, 9)), col("billing_type")])}),
        "exceptions": (at["exceptions"], {"pending request": (col("status") == "pending", [F.lower("service_name"), col("user_id"), col("billing_type")])}),
        "submissions": (at["submissions"], {"submission": (None, [col("user_id"), F.trunc("period_month", "quarter")])}),
        "declarations": (at["declarations"], {"declaration": (None, [col("user_id"), col("service_id"), F.trunc("receipt_month", "year")])}),
        "items": (at["items_used"], {
            "inference of an item": (None, [col("item_key")]), "evidence": (None, [col("item_key"), col("receipt_id"), col("component_key")]), "message": (None, [col("idempotency_key")]),
        }),
        "accounts": (at["accounts"], {"account address": (None, [F.lower("address")])}),
    })


def reference_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules within and across tables, rows that break each."""
    receipts, services, users, submissions, declarations = (view(spark, sf_dir, f"fx_{n}") for n in ("receipts", "services", "users", "submissions", "declarations"))
    owner = services.select("service_id", F.col("user_id").alias("owner"), "uses_p_card", "billing_type")
    of_receipts = receipts.join(owner, "service_id", "left").join(users.select("user_id", F.lit(True).alias("known_user")), "user_id", "left")
    memo = F.when(F.col("bits") % 2 == 0, "memo").otherwise("")
    size = F.col("bits") * 1024 * 8
    one = rv.rule_violations(of_receipts, "receipt_id", {
        "extra without service": F.col("is_extra") != F.col("service_id").isNull(), "extra needs a memo": F.col("is_extra") & (memo == ""), "receipt month is a first day": F.dayofmonth("receipt_month") != 1,
        "service of the submitter": F.col("service_id").isNotNull() & (F.col("owner").isNull() | (F.col("owner") != F.col("user_id"))),
        "service is uploadable": F.col("owner").isNotNull() & ~F.col("uses_p_card"), "user is known": F.col("known_user").isNull(), "upload size": size > 10 * 1024 * 1024,
    })
    two = rv.rule_violations(submissions.withColumn("key", F.concat_ws("|", "user_id", "period_month")), "key", {"submission month is a first day": F.dayofmonth("period_month") != 1})
    three = rv.rule_violations(declarations.withColumnRenamed("user_id", "asker").join(owner, "service_id", "left").withColumn("key", F.concat_ws("|", "asker", "service_id", "receipt_month")), "key", {
        "declared service is known": F.col("owner").isNull(), "declared service is metered": F.col("owner").isNotNull() & (F.col("billing_type") != "metered"),
    })
    days = submissions.select(F.col("user_id"), F.dayofmonth(F.date_add("period_month", F.col("user_id").cast("int") % 31)).alias("reminder_day"), (F.col("user_id") % 30).alias("warning_day"), "period_month")
    four = rv.rule_violations(days.withColumn("key", F.concat_ws("|", "user_id", "period_month")), "key", {
        "reminder days": ~F.col("reminder_day").between(1, 28) | ~F.col("warning_day").between(1, 28) | (F.col("warning_day") <= F.col("reminder_day")),
    })
    return one.unionByName(two).unionByName(three).unionByName(four).groupBy("rule").agg(F.count(F.lit(1)).alias("broken"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def purge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.purge_batches(view(spark, sf_dir, "fx_files"), F.lit(AS_OF).cast("timestamp"), 500).select("kind", "receipt_id", "place", "batch")


def filtered_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.filtered_reviews(_reviewed(spark, sf_dir), "manual_review").select("receipt_id", "receipt_month", "place")


def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(st.review_flags(_reviewed(spark, sf_dir)).select("receipt_id", "optional_passed", "can_request", "needs_decision", "unchecked_all", "label"))


def marked_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.pending_statements(view(spark, sf_dir, "fx_memos")).select("statement_id", inc.without_markers(F.col("memo")).alias("memo_after"))


def statement_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a state in which receipts of unknown kind had not come, nor the statements since September 1998."""
    lines, evidence = view(spark, sf_dir, "fx_lines"), view(spark, sf_dir, "fx_evidence")
    before = "statement_id < 199809"
    then = inc.statement_digests(lines.where(before), evidence.where(before).where("document_kind <> 'unknown'"))
    return inc.statement_changes(staged(inc.statement_digests(lines, evidence), "digests"), staged(then, "digests-before"))


def removed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that is left after the removal of stopped users, with the user it names now."""
    users, services, submissions, declarations, receipts = (view(spark, sf_dir, f"fx_{n}") for n in ("users", "services", "submissions", "declarations", "receipts"))
    out = ch.remove_users(users.where("account_status = 'stopped'"), {"services": services, "submissions": submissions, "declarations": declarations}, {"receipts": receipts})
    keys = {"services": ["service_id"], "submissions": ["user_id", "period_month"], "declarations": ["service_id", "receipt_month"], "receipts": ["receipt_id"]}
    parts = [df.select(F.lit(name).alias("name"), F.concat_ws("|", *keys[name]).alias("key"), "user_id") for name, df in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def deleted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests without those of months in which nothing has been submitted."""
    requests = view(spark, sf_dir, "fx_requests").withColumnRenamed("receipt_month", "period_month")
    months = view(spark, sf_dir, "fx_submissions").groupBy("period_month").agg(F.count_if(F.col("status") == "submitted").alias("n")).where("n < 5").select("period_month")
    return rq.delete_requests(requests, months).select("request_id", "period_month")


def memo_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    memo = F.when(F.col("line_key") % 3 == 0, "note").when(F.col("line_key") % 3 == 1, F.concat(F.lit("memo "), "line_key"))
    return view(spark, sf_dir, "fx_lines").select("line_key", t.append_once(memo, "note", 12).alias("memo"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = view(spark, sf_dir, "fx_users")
    email = F.when(F.col("user_id") % 3 > 0, F.col("email"))
    name = F.when(F.col("user_id") % 2 == 0, F.concat("username", F.lit("@x.example"))).otherwise(F.col("username"))
    return users.select("user_id", t.contact_address(email, name).alias("address"))


def target_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = view(spark, sf_dir, "fx_base").select("d").distinct()
    return days.select("d", cal.target_month(F.col("d")).alias("this_month"), cal.target_month(F.col("d"), -1).alias("last_month"), cal.target_month(F.col("d"), F.dayofmonth("d") % 5).alias("later"))


def matched_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of no usage for services and months whose receipt a line has matched."""
    edges = m.direct_edges(m.amount_options(view(spark, sf_dir, "fx_lines")), m.unique_evidence(view(spark, sf_dir, "fx_evidence")))
    receipts = view(spark, sf_dir, "fx_receipts").select(F.col("receipt_id").alias("component_key"), "service_id", "receipt_month")
    matched = m.uncontested(staged(edges, "edges")).join(receipts, "component_key")
    return q.declaration_conflicts(matched, view(spark, sf_dir, "fx_declarations")).select("user_id", "service_id", "receipt_month")


QUERIES = {
    f.__name__: f
    for f in (
        month_statistics, own_history, submission_list, resubmission_rows, open_resubmissions, active_assignments, offered_catalogs, managed_receipts, key_audit, reference_audit,
        purge_batches, filtered_reviews, review_flags, marked_statements, statement_changes, removed_users, deleted_requests, memo_notes,
        contacts, target_months, matched_conflicts,
    )
}

PASSED = "(payee AND recipient AND related AND date AND amount AND currency AND period)"
RESULT = "state IN ('generated', 'needs_review', 'failed', 'skipped')"
STATUS_OF = f"""CASE WHEN NOT available THEN 'file_unavailable' WHEN reviewed THEN 'admin_confirmed' WHEN state IN ('queued', 'processing') THEN 'ai_processing'
    WHEN NOT {RESULT} THEN 'ai_unprocessed' WHEN recommended THEN 'resubmission_decision' WHEN state IN ('needs_review', 'skipped') THEN 'manual_review'
    WHEN {PASSED} THEN 'ai_ok' ELSE 'manual_review' END"""
COUNTED = {
    "ai_pending": "available AND state = 'none'", "ai_ready": "available AND state = 'none'", "ai_processing": "available AND state IN ('queued', 'processing')", "ai_queued": "available AND state = 'queued'",
    "ai_review": "available AND NOT reviewed AND state IN ('needs_review', 'failed')", "period_mismatch": f"available AND NOT reviewed AND {RESULT} AND NOT period",
    "manual_review": f"available AND NOT reviewed AND {RESULT} AND NOT {PASSED}", "recipient_name_review": f"available AND NOT reviewed AND {RESULT} AND NOT recipient",
    "service_payee_review": f"available AND NOT reviewed AND {RESULT} AND NOT related", "resubmission_decision": "available AND NOT reviewed AND recommended",
}
PEOPLE = {
    "total_users": "count(*)", "active_users": "count(*) FILTER (account_status = 'active')", **{s: f"count(*) FILTER (display = '{s}')" for s in ("submitted", "draft", "not_started", "not_required")},
    "incomplete_users": "count(*) FILTER (missing > 0 OR api_pending > 0)", "missing_services": "sum(missing)", "api_pending_services": "sum(api_pending)",
    "api_pending_users": "count(*) FILTER (api_pending > 0)", "receipts": "sum(receipts)", "available_files": "sum(available)", "active_services": "sum(active)",
    "active_p_card_services": "sum(active_p_card)", "active_non_p_card_services": "sum(active_non_p_card)", "user_registered": "sum(user_registered)", "user_stopped": "sum(user_stopped)",
}


def _level(keys: str, level: int) -> str:
    """One level of the statistics: its three sources grouped on their own and joined."""
    names = [k for k in keys.split(", ") if k]
    group = f"GROUP BY {keys}" if names else ""
    lead = f"{keys}, " if names else ""
    join = lambda t: f"LEFT JOIN {t} ON " + (" AND ".join(f"{t}.{k} = every.{k}" for k in names) or "true")
    every = f"SELECT DISTINCT {keys} FROM (SELECT user_id, receipt_month FROM who UNION ALL SELECT user_id, receipt_month FROM looked UNION ALL SELECT user_id, receipt_month FROM wanted) AS x" if names else "SELECT 1 AS one"
    month, user = ("every.receipt_month" if "receipt_month" in names else "CAST(NULL AS DATE)"), ("every.user_id" if "user_id" in names else "CAST(NULL AS BIGINT)")
    columns = ", ".join([*(f"CAST(coalesce(p.{n}, 0) AS BIGINT) AS {n}" for n in PEOPLE), *(f"coalesce(r.{n}, 0) AS {n}" for n in COUNTED), "coalesce(o.open_resubmissions, 0) AS open_resubmissions"])
    due = "CASE WHEN coalesce(p.missing_services, 0) > 0 OR coalesce(p.api_pending_services, 0) > 0 OR coalesce(r.manual_review, 0) > 0 THEN 1 ELSE 0 END" if level == 0 else "CAST(NULL AS INTEGER)"
    return f"""
        SELECT {month} AS receipt_month, {user} AS user_id, {level} AS level, {columns}, {due} AS needs_attention
        FROM ({every}) AS every
        {join("p").replace("JOIN p", f"JOIN (SELECT {lead}{', '.join(f'{e} AS {n}' for n, e in PEOPLE.items())} FROM who {group}) AS p")}
        {join("r").replace("JOIN r", f"JOIN (SELECT {lead}{', '.join(f'count(*) FILTER ({e}) AS {n}' for n, e in COUNTED.items())} FROM looked {group}) AS r")}
        {join("o").replace("JOIN o", f"JOIN (SELECT {lead}count(*) AS open_resubmissions FROM wanted {group}) AS o")}"""


def _repeats(rule: str, table: str, columns: list[str], where: str = "true") -> str:
    key = "concat_ws('|', " + ", ".join(columns) + ")"
    return f"SELECT '{rule}' AS rule, {key} AS key, count(*) AS n FROM {table} WHERE {where} GROUP BY {key} HAVING count(*) > 1"


STATS_ALL = with_clause("fx_services", "fx_months", "fx_receipts", "fx_declarations", "fx_submissions", "fx_users", "fx_catalog", "fx_checked", "fx_asked").rstrip()
ORACLE_SQL = {
    "month_statistics": STATS_ALL + HISTORY + """
        , own AS (
            SELECT user_id, count(CASE WHEN is_active THEN 1 END) AS active, count(CASE WHEN is_active AND uses_p_card THEN 1 END) AS active_p_card,
                   count(CASE WHEN is_active AND NOT uses_p_card THEN 1 END) AS active_non_p_card, count(CASE WHEN registration_source = 'user' THEN 1 END) AS user_registered,
                   count(CASE WHEN NOT is_active AND deactivation_source = 'user' THEN 1 END) AS user_stopped FROM fx_services GROUP BY user_id
        ), people AS (SELECT user_id, account_status FROM fx_users WHERE is_active AND NOT is_staff
        ), who AS (SELECT h.*, p.account_status, o.active, o.active_p_card, o.active_non_p_card, o.user_registered, o.user_stopped
                   FROM history AS h JOIN people AS p ON p.user_id = h.user_id LEFT JOIN own AS o ON o.user_id = h.user_id
        ), looked AS (SELECT * FROM fx_checked WHERE user_id IN (SELECT user_id FROM people)
        ), wanted AS (SELECT * FROM fx_asked WHERE status = 'pending' AND user_id IN (SELECT user_id FROM people)
        )""" + " UNION ALL ".join(_level(k, n) for k, n in (("receipt_month, user_id", 0), ("receipt_month", 1), ("", 3))),
    "own_history": ALL + HISTORY + """
        SELECT h.user_id, h.receipt_month, s.status AS submission_status, h.display, h.missing + h.api_pending AS remaining, h.receipts, CASE WHEN h.available > 0 THEN 1 ELSE 0 END AS has_files
        FROM fx_submissions AS s JOIN history AS h ON h.user_id = s.user_id AND h.receipt_month = CAST(s.period_month - INTERVAL 1 MONTH AS DATE)""",
    "submission_list": with_clause("fx_submissions", "fx_receipts") + """
        SELECT s.user_id, s.period_month, s.status, count(r.receipt_id) AS receipts, count(CASE WHEN r.file <> '' AND NOT r.file_deleted THEN 1 END) AS available_files
        FROM fx_submissions AS s LEFT JOIN fx_receipts AS r ON r.user_id = s.user_id AND CAST(r.receipt_month + INTERVAL 1 MONTH AS DATE) = s.period_month GROUP BY s.user_id, s.period_month, s.status""",
    "resubmission_rows": with_clause("fx_requests", "fx_asked", "fx_users", "fx_services") + """
        SELECT r.request_id, r.receipt_month, a.status, u.username, s.name AS service_name,
               row_number() OVER (PARTITION BY r.receipt_month ORDER BY a.status, u.username NULLS FIRST, s.name NULLS FIRST, r.created_at, r.request_id) AS place
        FROM fx_requests AS r JOIN fx_asked AS a ON a.request_id = r.request_id LEFT JOIN fx_users AS u ON u.user_id = r.user_id LEFT JOIN fx_services AS s ON s.service_id = r.service_id""",
    "open_resubmissions": with_clause("fx_asked") + "SELECT user_id, receipt_month, count(*) AS open FROM fx_asked WHERE status = 'pending' GROUP BY user_id, receipt_month",
    "active_assignments": with_clause("fx_catalog", "fx_services", "fx_users") + """
        SELECT c.catalog_id, c.name AS catalog_name, s.service_id, s.user_id, CASE WHEN s.uses_p_card THEN 1 ELSE 0 END AS uses_p_card, u.username
        FROM fx_catalog AS c JOIN fx_services AS s ON s.catalog_id = c.catalog_id AND s.is_active JOIN fx_users AS u ON u.user_id = s.user_id""",
    "offered_catalogs": with_clause("fx_catalog", "fx_services", "fx_users") + """
        SELECT catalog_id, name FROM fx_catalog WHERE catalog_id IN (SELECT s.catalog_id FROM fx_services AS s JOIN fx_users AS u ON u.user_id = s.user_id
            WHERE s.is_active AND s.uses_p_card AND u.is_active AND NOT u.is_staff)""",
    "managed_receipts": with_clause("fx_receipts", "fx_users") + """
        SELECT r.receipt_id, r.user_id, r.receipt_month, CASE WHEN u.is_active THEN 1 ELSE 0 END AS user_active
        FROM fx_receipts AS r, fx_users AS u WHERE u.user_id = r.user_id AND NOT u.is_staff""",
    "key_audit": with_clause("fx_catalog", "fx_services", "fx_exceptions", "fx_submissions", "fx_declarations", "fx_items_used", "fx_accounts") + " UNION ALL ".join((
        _repeats("catalog", "fx_catalog", ["lower(substr(name, 1, 16))", "billing_type"]), _repeats("service", "fx_services", ["user_id", "lower(substr(name, 1, 9))", "billing_type"]),
        _repeats("pending request", "fx_exceptions", ["lower(service_name)", "user_id", "billing_type"], "status = 'pending'"),
        _repeats("submission", "fx_submissions", ["user_id", "CAST(date_trunc('quarter', period_month) AS DATE)"]),
        _repeats("declaration", "fx_declarations", ["user_id", "service_id", "CAST(date_trunc('year', receipt_month) AS DATE)"]), _repeats("inference of an item", "fx_items_used", ["item_key"]),
        _repeats("evidence", "fx_items_used", ["item_key", "receipt_id", "component_key"]), _repeats("message", "fx_items_used", ["idempotency_key"], "idempotency_key IS NOT NULL"),
        _repeats("account address", "fx_accounts", ["lower(address)"]),
    )),
    "reference_audit": with_clause("fx_receipts", "fx_services", "fx_users", "fx_submissions", "fx_declarations") + """
        , broken AS (
            SELECT 'extra without service' AS rule, CAST(receipt_id AS VARCHAR) AS key FROM fx_receipts WHERE is_extra <> (service_id IS NULL)
            UNION ALL SELECT 'extra needs a memo', CAST(receipt_id AS VARCHAR) FROM fx_receipts WHERE is_extra AND bits % 2 = 1
            UNION ALL SELECT 'receipt month is a first day', CAST(receipt_id AS VARCHAR) FROM fx_receipts WHERE day(receipt_month) <> 1
            UNION ALL SELECT 'service of the submitter', CAST(receipt_id AS VARCHAR) FROM fx_receipts AS r WHERE service_id IS NOT NULL
                AND NOT EXISTS (SELECT 1 FROM fx_services AS s WHERE s.service_id = r.service_id AND s.user_id = r.user_id)
            UNION ALL SELECT 'service is uploadable', CAST(receipt_id AS VARCHAR) FROM fx_receipts WHERE service_id IN (SELECT service_id FROM fx_services WHERE NOT uses_p_card)
            UNION ALL SELECT 'user is known', CAST(receipt_id AS VARCHAR) FROM fx_receipts WHERE user_id NOT IN (SELECT user_id FROM fx_users)
            UNION ALL SELECT 'upload size', CAST(receipt_id AS VARCHAR) FROM fx_receipts WHERE bits > 1280
            UNION ALL SELECT 'submission month is a first day', concat_ws('|', user_id, period_month) FROM fx_submissions WHERE day(period_month) <> 1
            UNION ALL SELECT 'declared service is known', concat_ws('|', user_id, service_id, receipt_month) FROM fx_declarations WHERE service_id NOT IN (SELECT service_id FROM fx_services)
            UNION ALL SELECT 'declared service is metered', concat_ws('|', d.user_id, d.service_id, d.receipt_month) FROM fx_declarations AS d JOIN fx_services AS s ON s.service_id = d.service_id WHERE s.billing_type <> 'metered'
            UNION ALL SELECT 'reminder days', concat_ws('|', user_id, period_month) FROM fx_submissions
                WHERE day(period_month + CAST(user_id % 31 AS INTEGER)) > 28 OR user_id % 30 NOT BETWEEN 1 AND 28 OR user_id % 30 <= day(period_month + CAST(user_id % 31 AS INTEGER))
        )
        SELECT rule, count(*) AS broken, min(key) AS first_key, max(key) AS last_key FROM broken GROUP BY rule""",
    "purge_batches": with_clause("fx_files") + f"""
        , due AS (SELECT kind, receipt_id, row_number() OVER (PARTITION BY kind ORDER BY expires_at, receipt_id) AS place FROM fx_files WHERE file <> '' AND NOT file_deleted AND expires_at <= TIMESTAMP '{AS_OF}')
        SELECT kind, receipt_id, place, (place - 1) // 500 AS batch FROM due""",
    "filtered_reviews": with_clause("fx_checked") + f"""
        SELECT receipt_id, receipt_month, row_number() OVER (PARTITION BY receipt_month ORDER BY issued_on DESC, receipt_id DESC) AS place FROM fx_checked WHERE {STATUS_OF} = 'manual_review'""",
    "review_flags": with_clause("fx_checked") + f"""
        SELECT receipt_id, CASE WHEN card_checked THEN CASE WHEN card THEN 1 ELSE 0 END END AS optional_passed, CASE WHEN available AND {RESULT} AND NOT reviewed THEN 1 ELSE 0 END AS can_request,
               CASE WHEN available AND {RESULT} AND NOT reviewed AND recommended THEN 1 ELSE 0 END AS needs_decision,
               concat_ws(',', {", ".join(f"CASE WHEN NOT {c} THEN '{c}' END" for c in rv.CHECKS)}, CASE WHEN card_checked AND NOT card THEN 'card' END) AS unchecked_all,
               CASE WHEN reviewed THEN 'confirmed' WHEN state IN ('queued', 'processing') THEN 'processing' WHEN NOT {RESULT} THEN 'unprocessed' WHEN recommended THEN 'decision'
                    WHEN NOT {PASSED} THEN 'manual' ELSE 'ok' END AS label
        FROM fx_checked""",
    "marked_statements": with_clause("fx_statements") + "SELECT statement_id, '注記 以上' AS memo_after FROM fx_statements WHERE statement_id % 16 < 12 AND status NOT IN ('processing', 'failed')",
    "statement_changes": with_clause("fx_lines", "fx_evidence") + """
        SELECT DISTINCT statement_id, CASE WHEN statement_id >= 199809 THEN 'new' ELSE 'changed' END AS change
        FROM (SELECT statement_id FROM fx_lines WHERE statement_id >= 199809 UNION ALL SELECT statement_id FROM fx_evidence WHERE statement_id >= 199809 OR document_kind = 'unknown') AS x""",
    "removed_users": with_clause("fx_users", "fx_services", "fx_submissions", "fx_declarations", "fx_receipts") + """
        , gone AS (SELECT user_id FROM fx_users WHERE account_status = 'stopped')
        SELECT 'services' AS name, CAST(service_id AS VARCHAR) AS key, user_id FROM fx_services WHERE user_id NOT IN (SELECT user_id FROM gone)
        UNION ALL SELECT 'submissions', concat_ws('|', user_id, period_month), user_id FROM fx_submissions WHERE user_id NOT IN (SELECT user_id FROM gone)
        UNION ALL SELECT 'declarations', concat_ws('|', service_id, receipt_month), user_id FROM fx_declarations WHERE user_id NOT IN (SELECT user_id FROM gone)
        UNION ALL SELECT 'receipts', CAST(receipt_id AS VARCHAR), CASE WHEN user_id NOT IN (SELECT user_id FROM gone) THEN user_id END FROM fx_receipts""",
    "deleted_requests": with_clause("fx_requests", "fx_submissions") + """
        SELECT request_id, receipt_month AS period_month FROM fx_requests
        WHERE receipt_month NOT IN (SELECT period_month FROM fx_submissions GROUP BY period_month HAVING count(*) FILTER (status = 'submitted') < 5)""",
    "memo_notes": with_clause("fx_lines") + """
        SELECT line_key, CASE line_key % 3 WHEN 1 THEN substr(concat('memo ', line_key, chr(10), 'note'), 1, 12) ELSE 'note' END AS memo FROM fx_lines""",
    "contacts": with_clause("fx_users") + """
        SELECT user_id, CASE WHEN user_id % 3 > 0 THEN email WHEN user_id % 2 = 0 THEN concat(username, '@x.example') ELSE '' END AS address FROM fx_users""",
    "target_months": with_clause("fx_base") + """
        SELECT DISTINCT d, CAST(date_trunc('month', d) AS DATE) AS this_month, CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE) AS last_month,
               CAST(date_trunc('month', d) + to_months(CAST(day(d) % 5 AS INTEGER)) AS DATE) AS later FROM fx_base""",
    "matched_conflicts": with_clause("fx_lines", "fx_evidence", "fx_receipts", "fx_declarations") + DEDUP.lstrip() + OPTIONS + EDGES + """
        , alone AS (SELECT component_key FROM (SELECT *, count(*) OVER (PARTITION BY statement_id, line_key) AS ld, count(*) OVER (PARTITION BY statement_id, component_key) AS pd FROM edges) AS e WHERE ld = 1 AND pd = 1)
        SELECT user_id, service_id, receipt_month FROM fx_declarations AS d
        WHERE EXISTS (SELECT 1 FROM fx_receipts AS r JOIN alone AS a ON a.component_key = r.receipt_id WHERE r.service_id = d.service_id AND r.receipt_month = d.receipt_month)""",
}
