"""Months of services counted by user against the plain listing of services by month."""

import datetime as dt

from tallyloom.operators import compliance as c

MONTHS = [dt.date(2026, m, 1) for m in (1, 2, 3, 4)]
SERVICES = "service_id long, user_id long, catalog_id long, name string, billing_type string, is_active boolean, uses_p_card boolean, final_receipt_month date"


def tables(spark):
    services = [
        (1, 1, 1, "b", "metered", True, True, None), (2, 1, 1, "a", "subscription", False, True, MONTHS[1]), (3, 1, 1, "c", None, True, True, None), (4, 1, 1, None, "metered", True, True, None),
        (5, 1, 1, "d", "metered", True, False, None), (6, 2, 1, "e", "one_time", False, True, None), (7, 2, 1, "f", "metered", None, True, MONTHS[0]), (8, 3, 1, "g", "metered", True, None, None),
        (9, None, 1, "h", "metered", True, True, None), (1, 1, 1, "b", "metered", True, True, None),
    ]
    receipts = [
        (1, 1, 1, MONTHS[0], "f", False, False), (2, 1, 2, MONTHS[1], "f", False, False), (3, 1, 2, MONTHS[3], "f", False, False), (4, 1, 3, MONTHS[1], "", False, True), (5, 1, 4, MONTHS[2], "f", True, False),
        (6, 1, None, MONTHS[2], "f", False, True), (7, 2, 7, MONTHS[0], "f", False, False), (8, 2, 6, MONTHS[0], "f", False, False), (9, 1, 1, MONTHS[0], "f", False, False), (10, None, 9, MONTHS[0], "f", False, False),
    ]
    said = [(1, 1, MONTHS[0]), (1, 1, MONTHS[2]), (1, 3, MONTHS[2]), (1, 4, MONTHS[2]), (2, 7, MONTHS[3])]
    held = [(1, MONTHS[1], "submitted"), (1, MONTHS[2], None), (2, MONTHS[1], "draft"), (1, MONTHS[3], "draft"), (1, MONTHS[3], "submitted")]
    return (
        spark.createDataFrame(services, SERVICES), spark.createDataFrame([(m,) for m in MONTHS], "receipt_month date"),
        spark.createDataFrame(receipts, "receipt_id long, user_id long, service_id long, receipt_month date, file string, file_deleted boolean, is_extra boolean"),
        spark.createDataFrame(said, "user_id long, service_id long, receipt_month date"), spark.createDataFrame(held, "user_id long, period_month date, status string"),
    )


def rows(df, columns=None):
    return sorted(map(str, df.select(*sorted(columns or df.columns)).collect()))


def test_scopes_give_the_rows_of_the_listing(spark):
    services, months, receipts, said, held = tables(spark)
    status = c.service_month_status(services, months, receipts, said)
    summary = c.user_month_summary(status, c.services_in_scope(services, months))
    scopes = c.user_scopes(services, receipts, said)
    assert rows(c.scope_summary(scopes, months)) == rows(summary)
    want = c.history_rows(summary, held, receipts)
    assert rows(c.scope_history(scopes, months, held, receipts), want.columns) == rows(want)
    assert rows(c.scope_submit_check(services, months, receipts, said)) == rows(c.submit_check(status))


def test_nothing_is_shuffled_once_months_are_listed(spark):
    from tallyloom.plans import compliance_queries as q

    for query in (q.user_month_summary, q.history_rows, q.submit_check):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
        full = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        above = full[: full.index("explode(filter(months")]
        assert "explode(filter(months" in plan and "Exchange hashpartitioning" not in above
