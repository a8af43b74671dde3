"""Month keys and time limits as column expressions. Months are first-of-month dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_of(day: Column) -> Column:
    return F.trunc(day, "month")


def shift_months(day: Column, months: int | Column) -> Column:
    """A date some months on; days past the month's end become its last day."""
    return F.add_months(day, months)


def target_month(as_of: Column, offset: int | Column = 0) -> Column:
    """The first of the month that a reminder on the day as_of is about, `offset` months on."""
    return F.add_months(F.trunc(as_of, "month"), offset)


def receipt_month_of_submission(month: Column) -> Column:
    return F.add_months(month_of(month), -1)


def submission_month_of_receipt(month: Column) -> Column:
    return F.add_months(month_of(month), 1)


def receipt_month_of_statement(month: Column) -> Column:
    return month_of(month)


def expiry_of(uploaded_at: Column, months: int | Column = 3) -> Column:
    """The upload time 1 to 3 months on, time of day kept."""
    kept = F.greatest(F.lit(1), F.least(F.lit(3), months if isinstance(months, Column) else F.lit(months)))
    return uploaded_at + F.make_ym_interval(F.lit(0), kept.cast("int"))


def is_previous_month(day: Column, of: Column) -> Column:
    return month_of(day) == F.add_months(month_of(of), -1)


def valid_period(text: Column) -> Column:
    """YYYY-MM of the first seven characters, null if they are no month."""
    head = F.substring(F.trim(text), 1, 7)
    return F.when(head.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$"), head)


def iso_date(text: Column) -> Column:
    """The date of the first ten characters, null if they are none."""
    head = F.substring(F.trim(text), 1, 10)
    return F.when(head.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def reminder_kind(day: Column, reminder_day: Column, warning_day: Column) -> Column:
    return F.when(F.dayofmonth(day) == reminder_day, "initial").when(F.dayofmonth(day) == warning_day, "urgent")
