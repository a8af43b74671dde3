"""Secrets in texts, and credentials whose parts stand apart.

Patterns give spans of strong kinds, which are always reported, and of weak ones. A weak span counts
only as part of a credential: an interval join within a scope of characters links access identifiers,
secrets and endpoints, and weak spans without their complement are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

# Kinds in order of report, their patterns, least lengths, and the group that the length counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
STRONG = (("assign", ASSIGN, 12, 2), ("access", r"AKIA[A-Z0-9]+", 18, 0), ("hex", r"[0-9a-f]+", 16, 0))
WEAK = (("key", r"[A-Za-z0-9+/]{40,}", 40, 0), ("endpoint", r"https?://[A-Za-z0-9.-]+[^\s\"'<>]*", 12, 0))

KINDS = STRONG + WEAK
#: Cheap tests that each text with a span of the kind passes.
HINTS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{14}", "hex": "[0-9a-f]{16}", "key": "[A-Za-z0-9+/]{40}", "endpoint": "https?://"}
SCOPE = 256


def _matches(kind: str, pattern: str, least: int, group: int) -> Column:
    """Per match, in order: the characters since the last one, its own, and whether it counts."""
    body = F.col("body")
    if kind == "hex":
        pattern = f"[0-9a-f]{{{least},}}"  # the same spans, since runs are maximal
    gaps = F.transform(F.split(body, pattern, -1), F.length)
    found, counted = (F.regexp_extract_all(body, F.lit(pattern), F.lit(g)) for g in (0, group))
    good = F.transform(counted, lambda x: F.length(x) >= least)
    if kind == "key":
        good = F.transform(counted, lambda x: x.rlike("[A-Z]") & x.rlike("[a-z]") & x.rlike("[0-9]"))
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), F.transform(found, F.length).alias("size"), good.alias("good"))
    return F.when(body.rlike(HINTS[kind]), F.transform(zipped, lambda x: F.struct(F.lit(kind).alias("kind"), x["gap"].alias("gap"), x["size"].alias("size"), x["good"].alias("good"))))


def find_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): row_no and doc_id of each row; row_no, rank of the kind, start, end of each span."""
    body = docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", text_or_empty().alias("body"))
    found = materialize(body.select("row_no", "doc_id", *[_matches(*k).alias(k[0]) for k in KINDS]), "secret-matches")
    each = None
    for kind, *_ in KINDS:
        one = found.where(F.size(kind) > 0).select("row_no", F.posexplode(kind).alias("at", "m"))
        each = one if each is None else each.unionByName(one)
    so_far = Window.partitionBy("row_no", "m.kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.array_position(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("m.kind")).cast("int")
    spans = (
        each.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(so_far))
        .where("m.good")
        .select("row_no", rank.alias("rank"), (F.col("end") - F.col("m.size")).alias("start"), "end")
    )
    return found.select("row_no", "doc_id"), materialize(spans, "secret-spans")


def _near(parts: DataFrame, others: DataFrame, scope: int) -> DataFrame:
    """Rows of parts with one of others at most scope characters away in the same text.

    A part stands under each cell that it covers, the others under each within their scope, so that two
    that are near have a common cell.
    """
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))
    left = parts.withColumn("cell", cells(F.col("start"), F.col("end")))
    right = others.select(
        F.col("row_no").alias("o_row"), F.col("start").alias("o_start"), F.col("end").alias("o_end"),
        cells(F.col("start") - scope, F.col("end") + scope).alias("o_cell"),
    )
    met = (
        (F.col("row_no") == F.col("o_row")) & (F.col("cell") == F.col("o_cell"))
        & (F.col("start") <= F.col("o_end") + scope) & (F.col("o_start") <= F.col("end") + scope)
    )
    return left.join(right, met, "left_semi").drop("cell").distinct()


def link_credentials(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The spans to report: all strong ones; a weak key near an access identifier; an endpoint near an
    access identifier and near a secret, which is an assignment, a hex run or such a key."""
    kinds = [k[0] for k in KINDS]
    of = {k: spans.where(F.col("rank") == i + 1) for i, k in enumerate(kinds)}
    strong = spans.where(F.col("rank") <= len(STRONG))
    keys = _near(of["key"], of["access"], scope)
    secrets = of["assign"].unionByName(of["hex"]).unionByName(keys)
    endpoints = _near(_near(of["endpoint"], of["access"], scope), secrets, scope)
    return strong.unionByName(keys).unionByName(endpoints)


def secret_report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, by start and then kind. Null and empty texts have none,
    repeated rows are reported each, an empty table gives an empty result, and columns other than
    doc_id and text are not read.
    """
    rows, spans = find_spans(docs)
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    line = lambda x: F.concat_ws(":", F.element_at(names, x["rank"]), x["start"], x["end"])
    of_rank = lambda rank: lambda x: x["rank"] == rank
    joined = link_credentials(spans, scope).groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("all"))
    told = joined.select(
        "row_no",
        *[F.size(F.filter("all", of_rank(i + 1))).cast("long").alias(f"n_{k[0]}") for i, k in enumerate(STRONG)],
        F.array_join(F.transform(F.filter("all", lambda x: x["rank"] <= len(STRONG)), line), ",").alias("base"),
        F.array_join(F.transform("all", line), ",").alias("spans"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.join(told, "row_no", "left").select(
        "doc_id",
        *[zero(f"n_{k[0]}") for k in STRONG],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
