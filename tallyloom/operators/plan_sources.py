"""Where inferences of plan changes come from, and what becomes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import extract as x
from ..functions import text as t
from .matching import amount_options

DETAILS = (
    "previous_plan string, new_plan string, change_date string, previous_plan_unused_from string, previous_plan_end string, new_plan_start string, "
    "new_plan_end string, adjustment_amount string, adjustment_currency string, confidence string"
)
DATES = ("change_date", "previous_plan_unused_from", "previous_plan_end", "new_plan_start", "new_plan_end")


def plan_details(json: Column, only: tuple[str, ...] = ()) -> Column:
    """The typed plan change of a JSON object, or those of its fields that are named; null if it names no plan."""
    empty = lambda c: F.coalesce(c, F.lit(""))

    def typed(raw: Column) -> Column:
        plans = F.struct(*[x.normal_plan_name(empty(raw[c])).alias(c) for c in ("previous_plan", "new_plan")])
        fields = {c: cal.iso_date(raw[c]) for c in DATES}
        fields["adjustment_amount"] = t.signed_amount(F.when(raw["adjustment_amount"] != "", raw["adjustment_amount"]))
        fields |= {"adjustment_currency": t.currency_code(empty(raw["adjustment_currency"])), "confidence": t.confidence(raw["confidence"])}
        kept = [c.alias(n) for n, c in fields.items() if not only or n in only]
        named = lambda p: F.struct(p["previous_plan"].alias("previous_plan"), p["new_plan"].alias("new_plan"), *kept)
        return t.let(plans, lambda p: F.when((p["previous_plan"] != "") | (p["new_plan"] != ""), named(p)))

    # an object is read once for all its fields
    return t.let(F.from_json(json, DETAILS), typed)


def context_key(names: DataFrame) -> Column:
    """The key of a receipt's context: that of a known merchant in its label or payee, else the resolved one.
    names must have been joined with resolve.merchant_keys as (merchant_key)."""
    context = F.coalesce(F.when(F.col("service_label") != "", F.col("service_label")), F.col("payee"))
    known = t.known_merchant(context)
    return F.coalesce(F.when(known != "", known), F.col("merchant_key"))


def plan_change_documents(receipts: DataFrame, users: DataFrame) -> DataFrame:
    """change_id, user_id, merchant_key, plans, dates and confidence of receipts that end an old plan.

    receipts (receipt_id, user_id, service_label, payee, merchant_key, plan_name, plan_change JSON,
    recipient_name, recipient_memo, recipient_checked). Where the recipient was checked and its mail
    address names exactly one user (users: address, user_id), that user owns the change.
    """
    d = F.col("d")
    details = F.array(plan_details(F.col("plan_change"), ("change_date", "previous_plan_end", "confidence")))
    # what explode yields is not computed again where it is filtered or read
    read = receipts.select("*", F.explode(F.filter(details, lambda d: (d["previous_plan"] != "") & d["previous_plan_end"].isNotNull())).alias("d"))
    address = t.first_email(F.concat_ws(" ", "recipient_name", "recipient_memo"))
    named = users.where(F.contains("address", F.lit("@"))).select(F.col("address").alias("mail"), F.col("user_id").alias("mail_user"))
    # rows without an address meet no user; each has a key of its own, so that they do not go to one task
    none = F.concat(F.lit("-"), F.col("receipt_id").cast("string"))
    keyed = read.withColumn("mail", F.coalesce(F.when(F.col("recipient_checked"), F.when(address != "", address)), none)).join(named, "mail", "left").withColumn("key", context_key(read))
    return keyed.where("key IS NOT NULL").select(
        F.col("receipt_id").alias("change_id"), F.coalesce("mail_user", "user_id").alias("user_id"), F.col("key").alias("merchant_key"), d["previous_plan"].alias("previous_plan"),
        F.coalesce(F.when(d["new_plan"] != "", d["new_plan"]), F.col("plan_name"), F.lit("")).alias("new_plan"), d["change_date"].alias("change_date"),
        d["previous_plan_end"].alias("previous_plan_end"), d["confidence"].alias("confidence"),
    )


def receipt_history(receipts: DataFrame) -> DataFrame:
    """Older receipts that show a plan's price: with amount, currency and day, and a plan or a subscription."""
    recurring = F.col("billing_type") == "subscription"
    plan = F.trim(F.coalesce("plan_name", F.lit("")))
    good = receipts.where(F.col("amount").isNotNull() & (F.coalesce("currency", F.lit("")) != "") & F.col("issued_on").isNotNull() & ((plan != "") | recurring))
    quality = F.when(F.col("document_kind") == "charge", 0).otherwise(1) + F.when(F.col("reviewed"), 0).otherwise(1)
    keyed = good.withColumn("key", context_key(good)).where("key IS NOT NULL")
    return keyed.select(
        F.concat(F.lit("receipt:"), "receipt_id").alias("evidence_key"), "user_id", F.col("key").alias("merchant_key"), plan.alias("plan_name"), F.col("issued_on").alias("event_date"),
        "amount", "currency", quality.alias("quality"), recurring.alias("recurring"), F.lit("receipt").alias("source"),
    )


def statement_history(lines: DataFrame) -> DataFrame:
    """Lines of finished statements as older evidence: one row for each amount, no user, the weakest quality.

    lines also has status (of the statement), receipt_required and match_status.
    """
    usable = lines.where("status IN ('completed', 'needs_review') AND receipt_required AND line_date IS NOT NULL AND match_status <> 'ignored'")
    return amount_options(usable).select(
        F.concat_ws(":", F.lit("statement"), "line_key", "currency", F.col("amount").cast("string")).alias("evidence_key"), F.lit(None).cast("long").alias("user_id"), "merchant_key",
        F.lit("").alias("plan_name"), F.col("line_date").alias("event_date"), "amount", "currency", F.lit(5).alias("quality"), F.lit(True).alias("recurring"), F.lit("statement").alias("source"),
    )


def plan_history(receipts: DataFrame, lines: DataFrame) -> DataFrame:
    return receipt_history(receipts).unionByName(statement_history(lines))


def inference_reason(c: dict[str, Column]) -> Column:
    """Why an inference is proposed, for the person who decides. c: change_file, old_file, previous_plan,
    new_plan, change_date, previous_plan_end, event_date, amount, currency, source, unnamed."""
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    price = F.concat_ws(" ", c["amount"].cast("string"), c["currency"])
    by_statement = F.concat(F.lit("前月のカード明細「"), c["old_file"], F.lit("」に "), iso(c["event_date"]), F.lit("、"), price, F.lit(" の同一請求周期があり、"))
    by_plan = F.concat(F.lit("過去領収書「"), c["old_file"], F.lit("」には旧プラン "), c["previous_plan"], F.lit(" が明記され、"), iso(c["event_date"]), F.lit("、"), price, F.lit(" の実績があり、"))
    by_service = F.concat(F.lit("過去領収書「"), c["old_file"], F.lit("」では旧プラン名を抽出できませんでしたが、定期契約サービスとして、"), iso(c["event_date"]), F.lit("、"), price, F.lit(" の実績があり、"))
    basis = F.when(c["source"] == "statement", by_statement).when(c["unnamed"] == 0, by_plan).otherwise(by_service)
    new = F.when(F.coalesce(c["new_plan"], F.lit("")) != "", c["new_plan"]).otherwise("未抽出")
    return F.concat(
        F.lit("契約変更書類「"), c["change_file"], F.lit("」に、旧プラン "), c["previous_plan"], F.lit("、新プラン "), new, F.lit("、変更日 "), F.coalesce(iso(c["change_date"]), F.lit("未抽出")),
        F.lit("、旧プラン終了日 "), iso(c["previous_plan_end"]), F.lit(" が明記されています。"), basis, F.lit("今回の明細の請求元・金額・通貨・請求周期と一致します。"),
    )


def merge_inferences(items: DataFrame, found: DataFrame, stored: DataFrame) -> DataFrame:
    """Inferences after a run: new ones are pending and replace stored ones of their line; of the others
    those of decided lines stay, and rejected ones of lines that are still unmatched.

    items (line_key, status, is_manual), found and stored (line_key, fingerprint, user_id, confidence,
    and status in stored).
    """
    columns = ["line_key", "fingerprint", "user_id", "confidence", "status"]
    new = found.withColumn("status", F.lit("pending")).select(columns)
    rest = stored.join(found.select("line_key"), "line_key", "left_anti").join(items.select("line_key", F.col("status").alias("now"), "is_manual"), "line_key")
    kept = rest.where("is_manual OR (status = 'rejected' AND now = 'unmatched')").select(columns)
    return new.unionByName(kept)


def apply_decisions(items: DataFrame, inferences: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, inferences) after people's decisions (line_key, action): confirm takes the inference's user and
    makes the item matched by hand, reject leaves it unmatched and marks the inference, ignore and required
    set whether the line needs a receipt."""
    act = F.col("action")
    guess = inferences.select("line_key", F.col("user_id").alias("guess_user"))
    joined = items.join(decisions, "line_key", "left").join(guess, "line_key", "left")
    has = F.col("guess_user").isNotNull()
    confirm, reject = (act == "confirm") & has, (act == "reject") & has
    status = F.when(confirm, "matched").when(reject, "unmatched").when(act == "ignore", "ignored").when(act == "required", "unmatched").otherwise(F.col("status"))
    memo = F.when(confirm, "管理者が契約変更の推定を確定しました。").when(act == "ignore", "管理者が領収書管理対象外にしました。").otherwise(F.col("memo"))
    decided = joined.select(
        "line_key", status.alias("status"), F.when(confirm, F.col("guess_user")).when(reject | act.isin("ignore", "required"), None).otherwise(F.col("user_id")).alias("user_id"),
        F.when(confirm | (act == "ignore"), 1.0).when(reject | (act == "required"), 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(act == "ignore", False).when(act == "required", True).otherwise(F.col("receipt_required")).alias("receipt_required"), memo.alias("memo"),
    )
    told = inferences.join(decisions, "line_key", "left")
    state = F.when(act == "confirm", "confirmed").when(act == "reject", "rejected").otherwise(F.col("status"))
    return decided, told.where("action IS NULL OR action NOT IN ('ignore', 'required')").select("line_key", "fingerprint", "user_id", "confidence", state.alias("status"))


def inferred_services(wanted: DataFrame, services: DataFrame) -> DataFrame:
    """line_key, service_id: the service of an inference's user.

    wanted (line_key, user_id, old_service_id, change_service_id). The older receipt's service, then the
    change's, if it is the user's own; else the user's service with the entry of the first of them that has one; else with
    the name and billing of the first of them. Active services go first, then the lowest id.
    """
    info = services.select("service_id", F.col("user_id").alias("owner"), "catalog_id", F.lower(t.one_line(F.col("name"))).alias("low"), "billing_type")
    both = wanted.select("line_key", "user_id", F.posexplode(F.array("old_service_id", "change_service_id")).alias("pos", "service_id")).where("service_id IS NOT NULL").join(info, "service_id")
    own = both.where("owner = user_id").groupBy("line_key").agg(F.min_by("service_id", "pos").alias("own"))
    entry = both.where("catalog_id IS NOT NULL").groupBy("line_key", "user_id").agg(F.min_by("catalog_id", "pos").alias("catalog_id"))
    named = both.groupBy("line_key", "user_id").agg(F.min_by(F.struct("low", "billing_type"), "pos").alias("n")).select("line_key", "user_id", "n.*")
    ranked = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy("line_key").orderBy(F.desc("is_active"), "service_id"))).where("k = 1")
    pool = services.select("user_id", "catalog_id", F.lower(t.one_line(F.col("name"))).alias("low"), "billing_type", "service_id", "is_active")
    by_entry = ranked(entry.join(pool, ["user_id", "catalog_id"])).select("line_key", F.col("service_id").alias("by_entry"))
    by_name = ranked(named.join(pool, ["user_id", "low", "billing_type"])).select("line_key", F.col("service_id").alias("by_name"))
    out = wanted.select("line_key").join(own, "line_key", "left").join(by_entry, "line_key", "left").join(by_name, "line_key", "left")
    return out.select("line_key", F.coalesce("own", "by_entry", "by_name").alias("service_id"))
