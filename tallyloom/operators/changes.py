"""Batch state changes: decision tables applied by joins, each returning the changed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import one_line


def apply_services(services: DataFrame, actions: DataFrame) -> DataFrame:
    """actions (service_id, action activate/deactivate/no_card, final_month): new state of every service.

    Stopping keeps the final month only for services on the card; switching the card off clears it.
    """
    joined = services.join(actions, "service_id", "left")
    act = F.coalesce("action", F.lit(""))
    active = F.when(act == "activate", True).when(act == "deactivate", False).otherwise(F.col("is_active"))
    card = F.when(act == "no_card", False).otherwise(F.col("uses_p_card"))
    final = F.when(act == "activate", None).when(act == "deactivate", F.col("final_month")).otherwise(F.col("final_receipt_month"))
    return joined.select("service_id", active.alias("is_active"), card.alias("uses_p_card"), F.when(card, final).alias("final_receipt_month"))


def upload_effects(receipts: DataFrame, submissions: DataFrame, declarations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(submissions, declarations) after new receipts: their submitted months reopen, their declarations go."""
    touched = receipts.select("user_id", F.add_months("receipt_month", 1).alias("period_month")).distinct().withColumn("touched", F.lit(True))
    reopened = submissions.join(touched, ["user_id", "period_month"], "left").withColumn(
        "status", F.when(F.col("touched") & (F.col("status") == "submitted"), "draft").otherwise(F.col("status"))
    )
    left = declarations.join(receipts.where("service_id IS NOT NULL").select("service_id", "receipt_month").distinct(), ["service_id", "receipt_month"], "left_anti")
    return reopened.drop("touched"), left


def apply_declarations(asked: DataFrame, services: DataFrame, receipts: DataFrame) -> DataFrame:
    """Declarations of no usage that hold: metered services on the card without a receipt in that month."""
    may = services.where("billing_type = 'metered' AND uses_p_card").select("service_id")
    there = receipts.where("service_id IS NOT NULL").select("service_id", "receipt_month").distinct()
    return asked.join(may, "service_id", "left_semi").join(there, ["service_id", "receipt_month"], "left_anti")


def remove_users(gone: DataFrame, tables: dict[str, DataFrame], nulled: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables without the users' rows, and tables that keep their rows with a null user."""
    ids = gone.select("user_id").distinct()
    out = {name: df.join(ids, "user_id", "left_anti") for name, df in tables.items()}
    for name, df in nulled.items():
        flagged = df.join(ids.withColumn("is_gone", F.lit(True)), "user_id", "left")
        out[name] = flagged.withColumn("user_id", F.when(F.col("is_gone").isNull(), F.col("user_id"))).drop("is_gone")
    return out


def canonical_catalog(services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog, links): one entry per name, in any case, and billing type, the lowest id first; and each service's entry."""
    keyed = services.withColumn("low", F.lower(one_line(F.col("name"))))
    entries = keyed.groupBy("low", "billing_type").agg(F.min("service_id").alias("catalog_id"), F.min_by("name", "service_id").alias("name"), F.count(F.lit(1)).alias("services"))
    links = keyed.drop("catalog_id").join(entries.select("low", "billing_type", "catalog_id"), ["low", "billing_type"]).select("service_id", "catalog_id")
    return entries.select("catalog_id", "name", "billing_type", "services"), links


def manifest_paths(receipts: DataFrame) -> DataFrame:
    """receipt_id, path in the archive: month / user / status / id_stem.extension, for files that are there."""
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", ""), r"[^A-Za-z0-9._-]+", "_")
    ending = F.regexp_extract("file", r"(\.[A-Za-z0-9]+)$", 1)
    status = F.when(F.col("is_extra"), "extra").otherwise("service")
    return receipts.where("file <> '' AND NOT file_deleted").select(
        "receipt_id", F.concat_ws("/", F.date_format("receipt_month", "yyyy-MM"), F.concat(F.lit("u"), "user_id"), status, F.concat("receipt_id", F.lit("_"), stem, ending)).alias("path")
    )
