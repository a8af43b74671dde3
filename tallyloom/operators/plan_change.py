"""Inference of plan changes: a line with no receipt that continues a user's old plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import is_previous_month
from ..functions.text import plans_related
from .exclusive import greedy_choice

CORE = ["end_days", "unnamed", "billing_days", "neg_confidence", "quality"]


def plan_change_candidates(options: DataFrame, changes: DataFrame, history: DataFrame, tolerance: int = 1, least: float = 0.75) -> DataFrame:
    """Lines, change documents and older evidence that fit together, with the confidence of the inference.

    options: line_key, sequence, line_date, merchant_key, amount, currency. changes: change_id, user_id,
    merchant_key, previous_plan, change_date, previous_plan_end, confidence. history: evidence_key,
    user_id (null for statement lines), merchant_key, plan_name, event_date, amount, currency, quality,
    recurring, source. The band around the plan's end is a hash join on its days.
    """
    days = F.sequence(F.date_sub("previous_plan_end", tolerance), F.date_add("previous_plan_end", tolerance))
    ends = changes.where((F.coalesce("previous_plan", F.lit("")) != "") & F.col("previous_plan_end").isNotNull() & (F.col("confidence") >= least))
    ends = ends.select("change_id", F.col("user_id").alias("change_user"), "merchant_key", "previous_plan", "change_date", "previous_plan_end", "confidence", F.explode(days).alias("line_date"))
    old = history.select("evidence_key", F.col("user_id").alias("old_user"), "merchant_key", "plan_name", "event_date", "amount", "currency", "quality", "recurring", "source",
                         F.add_months(F.trunc("event_date", "month"), 1).alias("line_month"))
    lines = options.withColumn("line_month", F.trunc("line_date", "month"))
    pairs = lines.join(ends, ["merchant_key", "line_date"]).where("change_date IS NULL OR change_date <= line_date")
    named = F.trim(F.coalesce("plan_name", F.lit(""))) != ""
    fits = (
        (F.col("old_user").isNull() | (F.col("old_user") == F.col("change_user")))
        & F.when(named, plans_related(F.col("previous_plan"), F.col("plan_name"))).otherwise(F.col("recurring"))
        & is_previous_month(F.col("event_date"), F.col("line_date"))
        & (F.abs(F.dayofmonth("event_date") - F.dayofmonth("line_date")) <= tolerance)
        & (F.col("change_date").isNull() | (F.col("event_date") < F.col("change_date")))
    )
    met = pairs.join(old, ["merchant_key", "line_month", "currency", "amount"]).where(fits)
    end_days, billing_days = F.abs(F.datediff("line_date", "previous_plan_end")), F.abs(F.dayofmonth("event_date") - F.dayofmonth("line_date"))
    loss = F.when(F.col("source") == "statement", 0.12).when(~named, 0.08).otherwise(0.0)
    base = F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.col("confidence")) - loss)
    gain = F.when(end_days == 0, 0.005).otherwise(0.0) + F.when(billing_days == 0, 0.005).otherwise(0.0)
    return met.select(
        "statement_id", "line_key", "sequence", "merchant_key", "change_id", F.col("change_user").alias("user_id"), "evidence_key", "source", "quality", "amount", "currency",
        end_days.alias("end_days"), billing_days.alias("billing_days"), (~named).cast("int").alias("unnamed"), F.least(F.lit(0.99), base + gain).alias("confidence"),
    )


def plan_change_best(candidates: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """The best candidate of each line; none if equally good ones name different users, or if it was rejected."""
    line = Window.partitionBy("statement_id", "line_key")
    ranked = candidates.withColumn("neg_confidence", -F.round("confidence", 4)).withColumn("core", F.rank().over(line.orderBy(*CORE)))
    top = ranked.where("core = 1")
    one_user = top.groupBy("statement_id", "line_key").agg(F.countDistinct("user_id").alias("users")).where("users = 1").drop("users")
    first = F.row_number().over(line.orderBy("user_id", "change_id", "evidence_key"))
    best = top.join(one_user, ["statement_id", "line_key"], "left_semi").withColumn("n", first).where("n = 1").drop("n", "core")
    prints = F.concat_ws(";", "line_key", "change_id", "evidence_key", F.col("amount").cast("string"), "currency", "unnamed")
    best = best.withColumn("fingerprint", prints)
    return best if rejected is None else best.join(rejected, "fingerprint", "left_anti")


def plan_change_alloc(best: DataFrame) -> DataFrame:
    """In rank order, each line, change document and older evidence once; whoever comes late gets nothing."""
    order = [*CORE[:4], "sequence", "line_key", "change_id", "evidence_key"]
    name = lambda kind, key: F.concat_ws("|", F.lit(kind), *[F.col(c).cast("string") for c in ("statement_id", "merchant_key", key)])
    names = F.array(name("line", "line_key"), name("change", "change_id"), name("old", "evidence_key"))
    return greedy_choice(best, [F.col("statement_id"), F.col("merchant_key"), *[F.col(c) for c in order]], names, ["statement_id", "merchant_key"])
