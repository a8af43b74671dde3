"""Merchants, catalog entries, users and services that texts and addresses name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.stages import staged
from .containment import contained_texts


def catalog_aliases(catalog: DataFrame) -> DataFrame:
    """catalog_id, alias: the name, and each alias of the list."""
    listed = F.split(F.coalesce("merchant_aliases", F.lit("")), r"[,;\n]+")
    each = catalog.select("catalog_id", F.explode(F.concat(F.array(F.coalesce("name", F.lit(""))), listed)).alias("alias"))
    return each.withColumn("alias", F.trim("alias")).where("alias <> ''").distinct()


#: Rows of either side that meet in one place for a token.
MEETING = 2_000


def _sides(names: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = staged(names.select("text").distinct().withColumn("a", t.normal_text(F.col("text"))).where("a <> ''"), "names")
    return left, staged(aliases.select("catalog_id", "alias").withColumn("b", t.normal_text(F.col("alias"))).where("b <> ''"), "aliases")


def _by_text(left: DataFrame, right: DataFrame) -> DataFrame:
    """text, catalog_id, strength of equal texts and of those that hold each other."""
    exact = left.join(right, F.col("a") == F.col("b")).select("text", "catalog_id", F.lit(4).alias("strength"))

    def contained(long: DataFrame, key: str, short: DataFrame, other: str) -> DataFrame:
        hits = contained_texts(long.select(F.col(key).alias("value")), short.where(F.length(other) >= 5).select(F.col(other).alias("value")))
        met = hits.withColumnRenamed("text", "_long").join(long, F.col("_long") == F.col(key)).join(short, F.col("pattern") == F.col(other))
        return met.withColumn("strength", F.when(F.length(other) >= 8, 3).otherwise(2)).select("text", "catalog_id", "strength")

    inside = contained(left, "a", right, "b").unionByName(contained(right, "b", left, "a"))
    return staged(exact.unionByName(inside).groupBy("text", "catalog_id").agg(F.max("strength").alias("strength")), "strong")


def _by_token(left: DataFrame, right: DataFrame, strong: DataFrame, meeting: int = MEETING) -> DataFrame:
    """text, catalog_id, strength 2 of those that share a token, without the pairs of strong.

    A pair comes from the first token that both have and from no other one, so none is listed twice and pairs are not shuffled. A
    token of many texts and entries is cut into squares of `meeting` rows of each, which are joined where they are dealt to.
    """
    held = strong.groupBy("text").agg(F.collect_list("catalog_id").alias("held"), F.bool_or(F.col("catalog_id").isNull()).alias("held_null"))
    own = left.select("text", F.sort_array(t.identity_tokens(F.col("text")), asc=False).alias("all"))
    entries = right.groupBy("catalog_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(t.identity_tokens(F.col("alias"))))), asc=False).alias("all"))

    def each(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.select(*columns, "all", F.posexplode("all").alias("_at", "token")).withColumn("before", F.expr("slice(all, 1, _at)")).drop("all", "_at")

    x, y = staged(each(own.join(held, "text", "left"), "text", "held", "held_null"), "text-tokens"), staged(each(entries, "catalog_id"), "entry-tokens")
    blocks = lambda rows, name: rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / meeting).alias(name))
    both = staged(blocks(x, "rows_x").join(blocks(y, "rows_y"), "token"), "shared-tokens")
    x = x.join(both, "token").select("token", "text", "held", "held_null", F.col("before").alias("before_x"), F.pmod(F.xxhash64("text"), F.col("rows_x")).alias("i"), F.explode(F.expr("sequence(0L, rows_y - 1)")).alias("j"))
    y = y.join(both, "token").select("token", "catalog_id", F.col("before").alias("before_y"), F.pmod(F.xxhash64("catalog_id"), F.col("rows_y")).alias("j"), F.explode(F.expr("sequence(0L, rows_x - 1)")).alias("i"))
    known = F.when(F.col("catalog_id").isNull(), F.col("held_null")).otherwise(F.array_contains("held", F.col("catalog_id")))
    met = x.join(y, ["token", "i", "j"]).where(~F.arrays_overlap("before_x", "before_y") & ~F.coalesce(known, F.lit(False)))
    return met.select("text", "catalog_id", F.lit(2).alias("strength"))


def catalog_strength(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (text) against aliases: text, catalog_id, strength 4 equal, 3 contained, 2 related.

    Each way to match has a join of its own, so no name meets every alias: equal texts join on the text, shared
    tokens on the token, and containment is what automata over the shorter texts find. Work on distinct names: there are far fewer than lines.
    All pairs that share a token are a result, however many they are: who needs the best ones takes best_entries.
    """
    left, right = _sides(names, aliases)
    strong = _by_text(left, right)
    return strong.unionByName(_by_token(left, right, strong))


def catalog_best(strength: DataFrame) -> DataFrame:
    """The strongest entries of each text, ties kept."""
    best = strength.groupBy("text").agg(F.max("strength").alias("strength"))
    return strength.join(best, ["text", "strength"])


def best_entries(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """catalog_best of catalog_strength: only texts that no entry equals, holds or stands in by eight signs meet others by their tokens."""
    left, right = _sides(names, aliases)
    strong = _by_text(left, right)
    sure = staged(catalog_best(strong.where("strength > 2")), "sure")
    rest, weak = left.join(sure, "text", "left_anti"), strong.join(sure, "text", "left_anti")
    return sure.unionByName(weak).unionByName(_by_token(rest, right, weak))


def merchant_keys(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """text, merchant_key: a known merchant, else that of the best entries, else the entries, else the
    longest token, else the normal text; null for texts without letters or digits."""
    aliases = catalog_aliases(catalog)
    spelled = aliases.groupBy("catalog_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), " ").alias("all"))
    entries = spelled.select("catalog_id", t.known_merchant(F.col("all")).alias("known"))
    best = best_entries(names, aliases).join(entries, "catalog_id").groupBy("text").agg(
        F.array_sort(F.collect_set("catalog_id")).alias("ids"), F.collect_set(F.when(F.col("known") != "", F.col("known"))).alias("known")
    )
    own = t.known_merchant(F.col("text"))
    by_catalog = F.when(F.size("known") == 1, F.element_at("known", 1)).when(F.size("ids") > 0, F.concat(F.lit("CATALOG:"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ":")))
    longest = F.array_sort(F.transform(t.identity_tokens(F.col("text")), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    normal = t.normal_text(F.col("text"))
    by_text = F.when(F.size(longest) > 0, F.concat(F.lit("TEXT:"), longest[0]["w"])).when(normal != "", F.concat(F.lit("TEXT:"), normal))
    joined = names.select("text").distinct().join(best, "text", "left")
    return joined.select("text", F.coalesce(F.when(own != "", own), by_catalog, by_text).alias("merchant_key"))


def users_by_address(users: DataFrame) -> DataFrame:
    """address, user_id for addresses and login names that name exactly one user."""
    both = users.select(F.lower("email").alias("address"), "user_id").unionByName(users.select(F.lower("username").alias("address"), "user_id"))
    named = both.where("address <> ''").groupBy("address").agg(F.min("user_id").alias("user_id"), F.countDistinct("user_id").alias("n"))
    return named.where("n = 1").drop("n")


def bill_to_user(documents: DataFrame, users: DataFrame) -> DataFrame:
    """doc_id, address (the text's first mail address), user_id it names, if any."""
    found = documents.select("doc_id", t.first_email(F.col("text")).alias("address")).where("address <> ''")
    return found.join(users_by_address(users), "address", "left").select("doc_id", "address", "user_id")


def user_lookup(addresses: DataFrame, users: DataFrame) -> DataFrame:
    """address, user_id: the general user of lowest id whose mail or login it is, in any case."""
    wanted = addresses.select("address", F.lower("address").alias("low")).distinct()
    people = users.where("NOT is_staff")
    hits = None
    for column in ("email", "username"):
        one = wanted.join(people.select(F.lower(column).alias("low"), "user_id"), "low").select("address", "user_id")
        hits = one if hits is None else hits.unionByName(one)
    return hits.groupBy("address").agg(F.min("user_id").alias("user_id"))


def same_service(wanted: DataFrame, services: DataFrame) -> DataFrame:
    """wanted (request_id, user_id, catalog_id, name, billing_type) -> service_id of the user's own
    service with the same entry, or the same name and billing; active first, then lowest id."""
    by_entry = wanted.where("catalog_id IS NOT NULL").join(services.select("user_id", "catalog_id", "service_id", "is_active"), ["user_id", "catalog_id"])
    key = lambda df: df.withColumn("low", F.lower(t.one_line(F.col("name"))))
    by_name = key(wanted).join(key(services).select("user_id", "low", "billing_type", "service_id", "is_active"), ["user_id", "low", "billing_type"])
    columns = ["request_id", "service_id", "is_active"]
    both = by_entry.select(columns).unionByName(by_name.select(columns)).distinct()
    order = Window.partitionBy("request_id").orderBy(F.desc("is_active"), "service_id")
    return both.withColumn("n", F.row_number().over(order)).where("n = 1").select("request_id", "service_id")


def component_merchants(components: DataFrame, keys: DataFrame) -> DataFrame:
    """components with merchant_key: that of a known merchant in the service's label, else that of the payee. keys is
    the result of merchant_keys for the payees. Components without a key go, since they fit no line."""
    known = t.known_merchant(F.col("service_label"))
    named = components.join(keys.withColumnRenamed("text", "payee"), "payee", "left")
    return named.withColumn("merchant_key", F.coalesce(F.when(known != "", known), F.col("merchant_key"))).where("merchant_key IS NOT NULL")


def unresolved_context(receipts: DataFrame, services: DataFrame, catalog: DataFrame) -> DataFrame:
    """receipt_id, text that names the merchant of a receipt that gave no component: its label, else its payee, else
    its service's name with the entry's aliases, else its memo; for merchant_keys. Receipts without any go."""
    spelled = catalog_aliases(catalog).groupBy("catalog_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), " ").alias("all"))
    named = services.select("service_id", "catalog_id", F.col("name").alias("own_name"), "billing_type").join(spelled, "catalog_id", "left")
    joined = receipts.join(named.drop("catalog_id"), "service_id", "left")
    given = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    service = F.when(F.col("own_name").isNotNull(), F.concat_ws(" ", t.service_name(F.col("own_name"), F.col("billing_type")), "all"))
    text = F.coalesce(given(F.col("service_label")), given(F.col("payee")), service, given(F.col("memo")))
    return joined.select("receipt_id", text.alias("text")).where("text IS NOT NULL")
