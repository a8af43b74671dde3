"""Statement lines against evidence: options, deduplication, candidate edges, one-to-one assignment.

Every key starts with statement_id, so that one plan reconciles all statements of all months.
lines: statement_id, line_key, sequence, line_date, merchant_key, original_amount, original_currency,
amount_jpy. evidence: statement_id, component_key, receipt_id, receipt_order, merchant_key,
signed_amount, currency, event_date, role, document_kind, invoice_number, transaction_id,
related_transaction_id. Amounts are decimals and are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import staged
from .assignment import assign_by_counts
from .exclusive import greedy_choice, placed_rows

TOLERANCE_DAYS = 1
COMPONENT_KEYS = ["statement_id", "component_key"]
LINE_KEYS = ["statement_id", "line_key"]


def plain_reference(text: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]", "")


def quality_rank(role: Column, kind: Column) -> Column:
    """0 for paid receipts, 1 for refund documents, 2 for invoices, 3 for anything else."""
    paid = (role == "charge") & kind.isin("receipt", "charge")
    return F.when(paid, 0).when(kind == "refund", 1).when(kind == "invoice", 2).otherwise(3)


def option_list() -> Column:
    """The amounts that a line can be matched by, the foreign one first if there is one."""
    foreign = F.when(
        F.col("original_amount").isNotNull() & (F.coalesce(F.col("original_currency"), F.lit("")) != ""),
        F.struct(F.col("original_amount").alias("amount"), F.upper("original_currency").alias("currency"), F.lit("original").alias("basis")),
    )
    home = F.when(F.col("amount_jpy").isNotNull(), F.struct(F.col("amount_jpy").alias("amount"), F.lit("JPY").alias("currency"), F.lit("jpy").alias("basis")))
    same = (foreign["amount"] == home["amount"]) & (foreign["currency"] == home["currency"])
    return F.array_compact(F.array(foreign, F.when(~F.coalesce(same, F.lit(False)), home)))


def amount_options(lines: DataFrame) -> DataFrame:
    """One row per amount that a line can be matched by: pos 0 is the foreign amount if there is one."""
    return lines.select("*", F.posexplode(option_list()).alias("pos", "option")).select("*", "option.*").drop("option")


def dedup_identity() -> Column:
    """What makes two components the same evidence, null if nothing does."""
    invoice, transaction = plain_reference(F.col("invoice_number")), plain_reference(F.col("transaction_id"))
    by_invoice = F.concat_ws("|", F.lit("invoice"), "role", "merchant_key", invoice, "currency", F.col("signed_amount").cast("string"))
    by_transaction = F.concat_ws("|", F.lit("transaction"), "role", "merchant_key", transaction)
    return (
        F.when((F.col("role") == "charge") & (invoice != ""), by_invoice).when(transaction != "", by_transaction).when(invoice != "", by_invoice)
    )


def dedup_evidence(evidence: DataFrame) -> DataFrame:
    """evidence with quality, kept, kept_key (the component that stands for it)."""
    ranked = evidence.withColumn("quality", quality_rank(F.col("role"), F.col("document_kind"))).withColumn(
        "identity", F.coalesce(dedup_identity(), F.concat(F.lit("self|"), F.col("component_key").cast("string")))
    )
    best = F.min(F.struct("quality", "receipt_order", "component_key"))
    chosen = ranked.groupBy("statement_id", "identity").agg(best.alias("best"))
    return (
        ranked.join(chosen, ["statement_id", "identity"])
        .withColumn("kept_key", F.col("best.component_key"))
        .withColumn("kept", F.col("kept_key") == F.col("component_key"))
        .drop("best", "identity")
    )


def kept_evidence(evidence: DataFrame) -> DataFrame:
    """The components that stand for their identity, with quality, in no order.

    Rows that nothing makes the same as others stay without a shuffle; of the rest the best one of each identity is
    kept by an aggregation.
    """
    columns = [*evidence.columns, "quality"]
    ranked = evidence.withColumn("quality", quality_rank(F.col("role"), F.col("document_kind"))).withColumn("_identity", dedup_identity())
    best = F.min_by(F.struct(*columns), F.struct("quality", "receipt_order", "component_key"))
    doubles = ranked.where("_identity IS NOT NULL").groupBy("statement_id", "_identity").agg(best.alias("_best")).select("_best.*")
    return ranked.where("_identity IS NULL").select(columns).unionByName(doubles)


def unique_evidence(evidence: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The kept components with component_index, their place in the statement, and of others only `columns` if given. The rows
    in order are a written table, so that more than one step may read them."""
    kept = kept_evidence(evidence)
    kept = kept if columns is None else kept.select(columns)
    placed = placed_rows(kept, ["statement_id"], [F.asc_nulls_first("receipt_order"), F.col("component_key")], "component_index")
    return placed.withColumn("component_index", (F.col("component_index") - 1).cast("int"))


#: What nets need to know of evidence, but for references.
NET_COLUMNS = ["statement_id", "merchant_key", "currency", "component_key", "event_date", "signed_amount", "role", "quality", "receipt_order"]


def net_evidence(unique: DataFrame) -> DataFrame:
    """The components that nets are made of, with NET_COLUMNS and their places if they have any."""
    columns = [*NET_COLUMNS, *[c for c in unique.columns if c == "component_index"]]
    return unique.where("role IN ('charge', 'refund') AND event_date IS NOT NULL").select(columns)


def direct_edges(options: DataFrame, unique: DataFrame, tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """Pairs of a line and a charge of equal merchant, currency and amount, at most `tolerance` days apart.

    The band is a hash join: a charge stands under each day it reaches. Per pair the first option counts; both options of
    a pair have the keys of the join, so pairs are grouped where they meet.
    """
    around = F.sequence(F.date_sub("event_date", tolerance), F.date_add("event_date", tolerance))
    charges = unique.where((F.col("role") == "charge") & (F.col("signed_amount") >= 0) & F.col("event_date").isNotNull()).select(
        "statement_id", "merchant_key", "currency", F.col("signed_amount").alias("amount"), F.explode(around).alias("line_date"),
        "component_key", "event_date", "quality", "component_index", "document_kind",
    )
    pairs = options.where(F.coalesce(F.col("merchant_key").cast("string"), F.lit("")) != "").join(
        charges, ["statement_id", "merchant_key", "currency", "amount", "line_date"]
    )
    days = F.abs(F.datediff("line_date", "event_date"))
    cost = days * 1_000_000 + F.col("quality") * 10_000 + F.col("component_index")
    return (
        pairs.withColumn("cost", cost.cast("long"))
        .withColumn("days", days).groupBy("statement_id", "merchant_key", "currency", "amount", "line_date", "line_key", "component_key")
        .agg(
            F.min_by("basis", "pos").alias("basis"), F.min("cost").alias("cost"), F.min("days").alias("days"), F.min("quality").alias("quality"),
            F.min("event_date").alias("event_date"), F.min("sequence").alias("sequence"), F.min("component_index").alias("component_index"), F.min("document_kind").alias("document_kind"),
        )
        .select(
            "statement_id", "merchant_key", "line_key", "component_key", "basis", "cost", "days", "quality", "line_date", "event_date", "currency", "amount", "sequence", "component_index", "document_kind",
        )
    )


def with_degrees(edges: DataFrame) -> DataFrame:
    line, piece = Window.partitionBy(*LINE_KEYS), Window.partitionBy(*COMPONENT_KEYS)
    return edges.withColumn("line_degree", F.count(F.lit(1)).over(line)).withColumn("piece_degree", F.count(F.lit(1)).over(piece))


def uncontested(edges: DataFrame) -> DataFrame:
    return with_degrees(edges).where("line_degree = 1 AND piece_degree = 1").drop("line_degree", "piece_degree")


def direct_assign(lines: DataFrame, unique: DataFrame, tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """A one-to-one choice among the pairs of direct_edges: most pairs first; then least days, quality and places."""
    return assign_by_counts(lines, unique, option_list(), tolerance)


def match_type(document_kind: Column) -> Column:
    return F.when(document_kind == "refund", "original_charge").otherwise("direct")


def _linked(unique: DataFrame, charge: list[Column], refund: list[Column]) -> DataFrame:
    """Pairs of a charge and a refund of one statement and merchant where the refund names the charge, with columns of both."""
    keys = ["statement_id", "merchant_key", "ref"]
    names = F.array_distinct(F.filter(F.array(*[plain_reference(F.col(c)) for c in ("transaction_id", "invoice_number")]), lambda n: n != ""))
    charges = unique.where("role = 'charge'").select("statement_id", "merchant_key", F.explode(names).alias("ref"), *charge)
    refunds = unique.where("role = 'refund'").select("statement_id", "merchant_key", plain_reference(F.col("related_transaction_id")).alias("ref"), *refund).where("ref <> ''")
    return charges.join(refunds, keys).drop("ref")


def refund_links(unique: DataFrame) -> DataFrame:
    """Charges and refunds of a statement and merchant where the refund names the charge."""
    return _linked(unique, [F.col("component_key").alias("charge_key")], [F.col("component_key").alias("refund_key")]).distinct()


def refund_net_candidates(options: DataFrame, unique: DataFrame, linked: bool, tolerance: int = TOLERANCE_DAYS, most: int = 3) -> DataFrame:
    """Lines with a merchant that equal a near charge less one to three refunds of its statement, merchant and currency
    in the line's calendar month. Linked refunds name the charge; others are near the line too.

    Refunds are told by their place in the statement; evidence without component_index goes by receipt and key, as places do. Sets
    of refunds are built one refund at a time, so none is built twice. Near ones are met by
    the same keys at each step, so that rows stay where they are; linked pairs are few and met before any line.
    """
    place, base = ["statement_id", "merchant_key", "currency", "line_date"], ["statement_id", "merchant_key", "line_key", "charge_key", "pos"]
    around = lambda day: F.explode(F.sequence(F.date_sub(day, tolerance), F.date_add(day, tolerance))).alias("line_date")
    of_month = F.trunc("refund_date", "month") == F.trunc("line_date", "month")
    charge = [F.col("component_key").alias("charge_key"), F.col("event_date").alias("charge_date"), F.col("signed_amount").alias("charge_amount"), F.col("quality"), F.col("receipt_order")]
    order = ["component_index"] if "component_index" in unique.columns else ["receipt_order", "component_key"]
    refund = [F.struct(*order, F.col("component_key").alias("key")).alias("refund"), F.col("event_date").alias("refund_date"), F.col("signed_amount").alias("refund_amount")]
    slots = options.where((F.coalesce(F.col("merchant_key").cast("string"), F.lit("")) != "") & F.col("line_date").isNotNull()).select(*place, "line_key", "sequence", "pos", "basis", "amount")
    if linked:
        pairs = _linked(unique.where("event_date IS NOT NULL"), ["currency", *charge], [F.col("currency").alias("refund_currency"), *refund]).where("currency = refund_currency").drop("refund_currency")
        pool = slots.join(pairs.select("*", around("charge_date")).where(of_month), place)
        next_from, keys = pool.select(*base, "refund", "refund_amount", "refund_date"), base
    else:
        charges = unique.where("role = 'charge' AND event_date IS NOT NULL").select(*place[:3], *charge, around("event_date"))
        refunds = unique.where("role = 'refund' AND event_date IS NOT NULL").select(*place[:3], *refund, around("event_date")).where(of_month)
        pool = slots.join(charges, place).join(refunds, place)
        next_from, keys = refunds, place
    days = lambda day: F.abs(F.datediff("line_date", day))
    told = ["sequence", "basis", "quality", "receipt_order", "charge_days"]
    # refunds over zero go first, so that a set whose last one is none of them only falls from there
    last = F.struct((F.col("refund_amount") <= 0).alias("falls"), "refund")
    sets = pool.withColumn("charge_days", days("charge_date")).select(
        *place, "line_key", "charge_key", "pos", "amount", *told, (F.col("charge_amount") + F.col("refund_amount")).alias("net"), days("refund_date").alias("worst"), F.array("refund").alias("refunds"), last.alias("last"),
    )
    every, at = sets, sets
    for _ in range(most - 1):
        # a set that can only fall and is below the amount needs no more refunds, nor does one at it, but for zeros
        at = at.where("net >= amount OR NOT last.falls").join(next_from, keys).where(last > F.col("last")).select(
            *place, "line_key", "charge_key", "pos", "amount", *told, (F.col("net") + F.col("refund_amount")).alias("net"), F.greatest("worst", days("refund_date")).alias("worst"),
            F.concat("refunds", F.array("refund")).alias("refunds"), last.alias("last"),
        )
        every = every.unionByName(at)
    first = Window.partitionBy("statement_id", "line_key", "charge_key", "refund_keys").orderBy("pos")
    found = every.where("net = amount").withColumn("refund_keys", F.transform(F.array_sort("refunds"), lambda r: r["key"]))
    fitting = found.withColumn("n", F.row_number().over(first)).where("n = 1")
    return fitting.select("statement_id", "merchant_key", "line_key", "charge_key", *told, "worst", "refund_keys")


def refund_net_assign(candidates: DataFrame) -> DataFrame:
    """Lines in sequence take their first candidate whose evidence is still free."""
    order = ["statement_id", "merchant_key", "sequence", "line_key", F.size("refund_keys"), "charge_days", "worst", "quality", "receipt_order", "charge_key", "refund_keys"]
    name = lambda kind, key: F.concat_ws("|", F.lit(kind), F.col("statement_id").cast("string"), key.cast("string"))
    pieces = F.transform(F.concat(F.array("charge_key"), "refund_keys"), lambda k: name("piece", k))
    return greedy_choice(candidates, [c if isinstance(c, Column) else F.col(c) for c in order], F.concat(F.array(name("line", F.col("line_key"))), pieces), ["statement_id", "merchant_key"])


def _without(evidence: DataFrame, used: DataFrame) -> DataFrame:
    return evidence.join(used, COMPONENT_KEYS, "left_anti")


def reconcile(lines: DataFrame, evidence: DataFrame, unique: DataFrame | None = None) -> DataFrame:
    """One row per matched line: match_type, basis, component_keys (charge first).

    Direct matches go first, then refunds that name their charge, then near refunds; each step sees
    only lines and evidence that the one before has left. Tables that later steps read are written. unique is
    unique_evidence(evidence), if it is there already.
    """
    lines = staged(lines.select(*LINE_KEYS, "sequence", "line_date", "merchant_key", "original_amount", "original_currency", "amount_jpy"), "lines")
    unique = unique_evidence(evidence) if unique is None else unique
    columns = ["statement_id", "merchant_key", "line_key", "match_type", "basis", "component_keys"]
    direct = direct_assign(lines, unique)
    found = now = staged(
        direct.select("statement_id", "merchant_key", "line_key", match_type(F.col("document_kind")).alias("match_type"), "basis", F.array("component_key").alias("component_keys")),
        "direct",
    )
    slim = net_evidence(unique).columns
    left, spare = lines, unique.select(*slim, "transaction_id", "invoice_number", "related_transaction_id").where("role IN ('charge', 'refund') AND event_date IS NOT NULL")
    for linked, name in ((True, "linked_refund_net"), (False, "merchant_refund_net")):
        used = now.select("statement_id", F.explode("component_keys").alias("component_key"))
        left = staged(left.join(now.select(*LINE_KEYS), LINE_KEYS, "left_anti"), "left")
        spare = staged(_without(spare if linked else spare.select(slim), used), "spare")
        nets = refund_net_assign(refund_net_candidates(amount_options(left), spare, linked)).select(
            "statement_id", "merchant_key", "line_key", F.lit(name).alias("match_type"), "basis", F.concat(F.array("charge_key"), "refund_keys").alias("component_keys")
        )
        now = staged(nets, name)
        found = found.unionByName(now)
    return found.select(columns)


def unused_evidence(evidence: DataFrame, matched: DataFrame) -> DataFrame:
    used = matched.select("statement_id", F.explode("component_keys").alias("component_key"))
    return _without(unique_evidence(evidence), used)


def without_charge(options: DataFrame, kept: DataFrame, tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """The first options of lines that direct_edges gives no pair: one charge near an amount is enough, and no pair is listed."""
    keys = ["statement_id", "merchant_key", "currency", "amount", "line_date"]
    around = F.sequence(F.date_sub("event_date", tolerance), F.date_add("event_date", tolerance))
    charges = kept.where("role = 'charge' AND signed_amount >= 0 AND event_date IS NOT NULL").select("statement_id", "merchant_key", "currency", F.col("signed_amount").alias("amount"), F.explode(around).alias("line_date")).distinct()
    named = options.where(F.coalesce(F.col("merchant_key").cast("string"), F.lit("")) != "")
    return options.where("pos = 0").join(named.join(charges, keys, "left_semi").select(*LINE_KEYS), LINE_KEYS, "left_anti")
