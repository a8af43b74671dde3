"""Containment against brute force, in one lot and in many."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import resolve
from tallyloom.operators.containment import contained_texts
from tallyloom.operators.resolve import catalog_strength


@pytest.mark.parametrize("most", [8_000_000, 60])
def test_contained_texts(spark, most):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé語") for _ in range(n))
    texts = [word(rng.randint(0, 12)) for _ in range(200)] + [None, ""]
    patterns = [word(rng.randint(1, 4)) for _ in range(60)] + [None, "", texts[0], texts[1]]
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "value string")
    got = contained_texts(frame(texts + texts[:9]), frame(patterns + patterns), most)
    want = {(t, p) for t in texts if t for p in patterns if p and p in t and p != t}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert contained_texts(frame([]), frame(patterns)).count() == 0 == contained_texts(frame(texts), frame([])).count()


def test_many_names_meet_many_aliases(spark):
    names = spark.range(200_000).select(F.concat(F.lit("SQ *VENDOR"), F.col("id") % 40_000, F.lit("X SHOP "), "id").alias("text"))
    aliases = spark.range(20_000).select(F.col("id").alias("catalog_id"), F.concat(F.lit("vendor "), "id", F.lit("x")).alias("alias"))
    began = time.time()
    found = catalog_strength(names, aliases)
    hits = found.where("strength = 3").count()
    assert hits == 5 * 20_000 and time.time() - began < 240


def related_names(spark):
    """Thirty names of one word and a number, some of them entries as they are, and entries that repeat a token."""
    names = [f"Supplier {k:05d}" for k in range(30)] + [f"supplier: {k:05d} / TOKYO" for k in range(5)] + ["Supplier Elsewhere Supplier", "GLOBEX", "nothing here", "globex works"]
    aliases = [(k, f"Supplier {k:05d}") for k in range(20)] + [(k, f"Supplier 000{k:02d} Works Globex") for k in range(5)] + [(None, "Supplier Nobody"), (None, "GLOBEX"), (7, "Elsewhere")]
    return spark.createDataFrame([(n,) for n in names + names[:3]], "text string"), spark.createDataFrame(aliases, "catalog_id long, alias string")


def test_pairs_by_token_are_the_same_in_squares_of_any_size(spark):
    names, aliases = related_names(spark)
    left, right = resolve._sides(names, aliases)
    strong = resolve._by_text(left, right)
    words = lambda text: {w for w in re.findall("[A-Z0-9]{3,}", text.upper()) if len(w) >= 4}
    known = {(r.text, r.catalog_id) for r in strong.collect()}
    want = {(n.text, a.catalog_id) for n in names.collect() for a in aliases.collect() if words(n.text) & words(a.alias)} - known
    for meeting in (3, 2_000):
        got = [(r.text, r.catalog_id) for r in resolve._by_token(left, right, strong, meeting).collect()]
        assert len(got) == len(set(got)) and set(got) == want and ("GLOBEX", None) in known
    assert {(r.text, r.catalog_id): r.strength for r in catalog_strength(names, aliases).collect() if r.strength > 2}[("GLOBEX", None)] == 4


def test_best_entries_list_no_pairs_that_are_weaker(spark, monkeypatch):
    names, aliases = related_names(spark)
    want = sorted(map(str, resolve.catalog_best(catalog_strength(names, aliases)).select("text", "catalog_id", "strength").collect()))
    asked, by_token = [], resolve._by_token
    monkeypatch.setattr(resolve, "_by_token", lambda left, *rest: asked.extend(r.text for r in left.collect()) or by_token(left, *rest))
    assert sorted(map(str, resolve.best_entries(names, aliases).collect())) == want
    assert "Supplier 00003" not in asked and "Supplier 00025" in asked
