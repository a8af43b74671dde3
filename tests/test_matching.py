"""The literal scenarios of one-to-one matching, netting and plan changes, and brute force on small blocks."""

import datetime as dt
import re
import time
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import assignment as a
from tallyloom.operators import exclusive as e
from tallyloom.operators import leftovers as lo
from tallyloom.operators import matching as m
from tallyloom.operators import plan_change as p
from tallyloom.operators.parts import connected_parts

LINE = "statement_id int, line_key string, sequence int, line_date date, merchant_key string, original_amount decimal(14,2), original_currency string, amount_jpy decimal(14,2)"
PIECE = (
    "statement_id int, component_key string, receipt_id int, receipt_order int, merchant_key string, signed_amount decimal(14,2), currency string, event_date date, "
    "role string, document_kind string, invoice_number string, transaction_id string, related_transaction_id string"
)


def day(n):
    return dt.date(2026, 7, n)


def line(key, n, amount, merchant="OPENAI"):
    return (1, key, n, day(n), merchant, Decimal(amount), "USD", None)


def piece(key, n, amount, order=0, merchant="OPENAI", role="charge", kind="charge", invoice="", transaction="", related="", currency="USD"):
    return (1, key, order, order, merchant, Decimal(amount), currency, day(n), role, kind, invoice, transaction, related)


def run(spark, lines, pieces):
    out = m.reconcile(spark.createDataFrame(lines, LINE), spark.createDataFrame(pieces, PIECE)).collect()
    return {r["line_key"]: (r["match_type"], list(r["component_keys"])) for r in out}


def test_more_matches_go_before_nearer_days(spark):
    got = run(spark, [line("L1", 10, "22"), line("L2", 11, "22")], [piece("C1", 10, "22"), piece("C2", 9, "22", 1)])
    assert got == {"L1": ("direct", ["C2"]), "L2": ("direct", ["C1"])}


def test_amounts_and_merchants_must_be_equal(spark):
    assert run(spark, [line("L1", 10, "22")], [piece("C1", 10, "22.01"), piece("C2", 10, "22", merchant="GITHUB"), piece("C3", 10, "22", currency="EUR")]) == {}


def test_twenty_lines_with_nineteen_charges(spark):
    got = run(spark, [line(f"L{n}", n, "22") for n in range(1, 21)], [piece(f"C{n}", n, "22", n) for n in range(1, 20)])
    used = [k for _, keys in got.values() for k in keys]
    assert len(got) == 19 and len(set(used)) == 19


def test_charge_in_a_refund_document(spark):
    assert run(spark, [line("L1", 3, "22")], [piece("C1", 3, "22", kind="refund")]) == {"L1": ("original_charge", ["C1"])}


def test_linked_refund_may_be_far(spark):
    pieces = [piece("C1", 2, "42.90", transaction="SALE-123"), piece("R1", 24, "-11.44", 1, role="refund", kind="refund", related="sale 123")]
    assert run(spark, [line("L1", 2, "31.46")], pieces) == {"L1": ("linked_refund_net", ["C1", "R1"])}


def test_near_refunds_net(spark):
    pieces = [piece("C1", 23, "137.26"), piece("R1", 22, "-66.48", 1, role="refund", kind="refund"), piece("R2", 22, "-6.78", 2, role="refund", kind="refund")]
    assert run(spark, [line("L1", 23, "64")], pieces) == {"L1": ("merchant_refund_net", ["C1", "R1", "R2"])}
    far = [pieces[0], *[(*x[:7], day(n), *x[8:]) for x, n in zip(pieces[1:], (4, 8), strict=True)]]
    assert run(spark, [line("L1", 23, "64")], far) == {}


@pytest.mark.parametrize(
    ("pieces", "kept"),
    [
        ([piece("C1", 1, "22", kind="invoice", invoice="INV-1"), piece("C2", 2, "22", 1, invoice="inv 1")], {"C2"}),
        ([piece("C1", 1, "22", invoice="INV-1"), piece("C2", 1, "23", 1, invoice="INV-1")], {"C1", "C2"}),
        ([piece("C1", 1, "22"), piece("C2", 1, "22", 1)], {"C1", "C2"}),
        ([piece("C1", 1, "22", transaction="T1"), piece("C2", 9, "25", 1, transaction="t-1")], {"C1"}),
    ],
)
def test_evidence_is_the_same_only_by_reference(spark, pieces, kept):
    assert {r["component_key"] for r in m.unique_evidence(spark.createDataFrame(pieces, PIECE)).collect()} == kept


def random_problem(rng):
    purses = ["A", "B"]
    lines = [(int(rng.integers(1, 6)), set(rng.choice(purses, int(rng.integers(1, 3)))), int(rng.integers(1, 4))) for _ in range(int(rng.integers(1, 4)))]
    charges = []
    for _ in range(int(rng.integers(1, 5))):
        steps = [[int(rng.integers(0, 4)), int(rng.integers(1, 3))] for _ in range(int(rng.integers(1, 4)))]
        charges.append((int(rng.integers(1, 6)), str(rng.choice(purses)), sorted(map(tuple, steps))))
    return lines, charges


def cheapest_pairs(rows, columns, cost):
    """(-pairs, cost) of the best one-to-one choice, by trying every one."""
    states = {0: (0, 0)}
    for i in range(rows):
        after = dict(states)
        for used, (pairs, price) in states.items():
            for j in range(columns):
                if not used >> j & 1 and cost(i, j) is not None:
                    new = (pairs - 1, price + cost(i, j))
                    if used | 1 << j not in after or new < after[used | 1 << j]:
                        after[used | 1 << j] = new
        states = after
    return min(states.values())


def test_flows_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(150):
        lines, charges = random_problem(rng)
        units = [(day, purses) for day, purses, n in lines for _ in range(n)]
        singles = [(day, purse, cost) for day, purse, steps in charges for cost, n in steps for _ in range(n)]
        if len(singles) > 11:
            continue
        price = lambda i, j: (abs(units[i][0] - singles[j][0]) << a.DAY) + singles[j][2] if singles[j][1] in units[i][1] and abs(units[i][0] - singles[j][0]) <= 1 else None  # noqa: B023, E731
        flow = a.cheapest_flow(lines, charges, 1)
        spent = sum(abs(lines[i][0] - charges[j][0]) * n << a.DAY for (i, j), n in flow.items())
        for j, (_, _, steps) in enumerate(charges):
            taken = sum(n for (_, k), n in flow.items() if k == j)
            spent += sum([cost for cost, n in steps for _ in range(n)][:taken])
        assert all(sum(n for (k, _), n in flow.items() if k == i) <= lines[i][2] for i in range(len(lines)))
        assert all(charges[j][1] in lines[i][1] and n > 0 for (i, j), n in flow.items())
        assert (-sum(flow.values()), spent) == cheapest_pairs(len(units), len(singles), price)


def test_a_large_merchant_is_solved(spark):
    lines = [(1, f"L{i}", i, day(1 + i % 28), "M", Decimal(20), "USD", None) for i in range(1500)]
    pieces = [piece(f"C{i}", 1 + (i * 5) % 28, "20", i, merchant="M") for i in range(1400)]
    found = m.direct_assign(spark.createDataFrame(lines, LINE), m.unique_evidence(spark.createDataFrame(pieces, PIECE))).toPandas()
    assert len(found) == found.line_key.nunique() == found.component_key.nunique() == 1400


def test_a_hundred_thousand_equal_lines_are_matched(spark):
    """One merchant and amount over 28 days: ten thousand million pairs that nobody lists."""
    n = 100_000
    at = F.date_add(F.lit("2026-07-01").cast("date"), (F.col("id") % 28).cast("int"))
    lines = spark.range(n).select(
        F.lit(1).alias("statement_id"), F.concat(F.lit("L"), "id").alias("line_key"), F.col("id").cast("int").alias("sequence"), at.alias("line_date"), F.lit("M").alias("merchant_key"),
        F.lit(20).cast("decimal(14,2)").alias("original_amount"), F.lit("USD").alias("original_currency"), F.lit(None).cast("decimal(14,2)").alias("amount_jpy"),
    )
    unique = spark.range(n).select(
        F.lit(1).alias("statement_id"), F.concat(F.lit("C"), "id").alias("component_key"), F.lit("M").alias("merchant_key"), F.lit(20).cast("decimal(14,2)").alias("signed_amount"), F.lit("USD").alias("currency"),
        F.date_add(F.lit("2026-07-01").cast("date"), ((F.col("id") * F.col("id")) % 28).cast("int")).alias("event_date"), F.lit("charge").alias("role"), F.lit("charge").alias("document_kind"),
        (F.col("id") % 3).cast("int").alias("quality"), F.col("id").cast("int").alias("component_index"),
    )
    began = time.time()
    found = m.direct_assign(lines, unique).select("line_key", "component_key", "days").toPandas()
    assert len(found) == found.line_key.nunique() == found.component_key.nunique() and found.days.max() <= 1
    took = time.time() - began
    # the most pairs: each day's charges take free lines of the day before, then of the day, then of the day after
    asked, given = (np.bincount(v % 28, minlength=28) for v in (np.arange(n), np.arange(n) ** 2))
    most, free = 0, asked.tolist()
    for d in range(28):
        need = int(given[d])
        for k in range(max(d - 1, 0), min(d + 2, 28)):
            used = min(need, free[k])
            free[k], need, most = free[k] - used, need - used, most + used
    assert took < 60 and len(found) == most


def test_random_blocks_have_most_pairs_at_least_cost(spark):
    rng = np.random.default_rng(1)
    lines, pieces = [], []
    for block in range(60):
        for i in range(int(rng.integers(1, 6))):
            both = rng.random() < 0.4
            lines.append((block, f"L{i}", i, day(int(rng.integers(8, 13))), "M", Decimal(int(rng.integers(1, 3))), "USD", Decimal(int(rng.integers(1, 3)) * 100) if both else None))
        for i in range(int(rng.integers(1, 7))):
            home = rng.random() < 0.3
            amount = str(rng.integers(1, 3) * (100 if home else 1))
            kind = ("charge", "invoice", "unknown")[int(rng.integers(0, 3))]
            pieces.append((block, *piece(f"C{i}", int(rng.integers(8, 13)), amount, i, merchant="M", kind=kind, currency="JPY" if home else "USD")[1:]))
    lines, unique = spark.createDataFrame(lines, LINE), m.unique_evidence(spark.createDataFrame(pieces, PIECE))
    edges = m.direct_edges(m.amount_options(lines), unique).toPandas()
    for steps in (1024, 1):
        rows = a.assign_by_counts(lines, unique, m.option_list(), 1, steps=steps).toPandas()
        merged = rows.merge(edges, on=["statement_id", "line_key", "component_key"], suffixes=("", "_e"))
        assert len(merged) == len(rows) and (merged.cost == merged.cost_e).all() and (merged.basis == merged.basis_e).all()
        assert not rows.duplicated(["statement_id", "line_key"]).any() and not rows.duplicated(["statement_id", "component_key"]).any()
        for block, part in edges.groupby("statement_id"):
            price = {(x.line_key, x.component_key): (x.days << 80) + (x.quality << 40) + (x.component_index if steps > 1 else 0) for x in part.itertuples()}
            left, right = sorted({k for k, _ in price}), sorted({k for _, k in price})
            mine = rows[rows.statement_id == block]
            spent = sum((x.days << 80) + (x.quality << 40) + (x.component_index if steps > 1 else 0) for x in mine.itertuples())
            assert (-len(mine), spent) == cheapest_pairs(len(left), len(right), lambda i, j: price.get((left[i], right[j])))  # noqa: B023


@pytest.mark.parametrize("steps", [1, 2, 3])
def test_places_count_exactly_in_classes_of_any_size(spark, steps):
    """Two lines between two days of charges that are cut into a few steps: the averages of a step name the wrong charges."""
    rng = np.random.default_rng(steps)
    lines, pieces = [], []
    for block in range(40):
        per_day = [int(rng.integers(1, 6)) for _ in range(3)]
        order = rng.permutation(sum(per_day))
        at = np.repeat([9, 10, 11], per_day)
        pieces += [(block, *piece(f"C{k}", int(at[k]), "5", int(place), merchant="M", kind=("charge", "invoice")[int(rng.integers(0, 2))])[1:]) for k, place in enumerate(order)]
        lines += [(block, f"L{k}", k, day(int(rng.choice([8, 10, 12]))), "M", Decimal(5), "USD", None) for k in range(int(rng.integers(1, 6)))]
    lines, unique = spark.createDataFrame(lines, LINE), m.unique_evidence(spark.createDataFrame(pieces, PIECE))
    edges = m.direct_edges(m.amount_options(lines), unique).toPandas()
    rows = a.assign_by_counts(lines, unique, m.option_list(), 1, steps=steps).toPandas()
    assert not rows.duplicated(["statement_id", "line_key"]).any() and not rows.duplicated(["statement_id", "component_key"]).any()
    worth = lambda x: (x.days << 80) + (x.quality << 40) + x.component_index
    for block, part in edges.groupby("statement_id"):
        price = {(x.line_key, x.component_key): worth(x) for x in part.itertuples()}
        left, right = sorted({k for k, _ in price}), sorted({k for _, k in price})
        mine = rows[rows.statement_id == block]
        assert (-len(mine), sum(worth(x) for x in mine.itertuples())) == cheapest_pairs(len(left), len(right), lambda i, j: price.get((left[i], right[j])))  # noqa: B023


def walked(rows):
    used, taken = set(), []
    for at, names in sorted(rows):
        if used.isdisjoint(names):
            used.update(names)
            taken.append(at)
    return taken


@pytest.mark.parametrize("block", [1_000, 40, 4])
def test_greedy_choices_equal_a_walk(spark, block):
    """Whole scopes, connected parts and rounds give the same choice."""
    rng = np.random.default_rng(block)
    rows = [(int(k), int(s), sorted({f"{s}:{x}" for x in rng.integers(0, width, 3)})) for k, s, width in zip(rng.permutation(400), rng.choice([0, 0, 0, 1, 2], 400), rng.choice([5, 400, 2000], 400), strict=True)]
    df = spark.createDataFrame(rows, "at int, scope int, names array<string>").repartition(3)
    found = e.greedy_choice(df, [F.col("at")], F.col("names"), ["scope"], block)
    assert found.columns == df.columns and sorted(r["at"] for r in found.collect()) == walked([(at, names) for at, _, names in rows])
    assert e.greedy_choice(df.limit(0), [F.col("at")], F.col("names"), ["scope"], block).count() == 0


def test_a_long_chain_takes_few_jobs(spark):
    rows = spark.range(10_000).select("id", F.array(F.col("id").cast("string"), (F.col("id") + 1).cast("string")).alias("names"), F.lit(1).alias("scope"))
    spark.sparkContext.setJobGroup("chain", "chain")
    found = {r["id"] for r in e.greedy_choice(rows, [F.col("id")], F.col("names"), ["scope"]).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == set(range(0, 10_000, 2)) and jobs <= 10
    beyond = {r["id"] for r in e.greedy_choice(rows.where("id < 60"), [F.col("id")], F.col("names"), ["scope"], 20).collect()}
    assert beyond == set(range(0, 60, 2))


def test_places_and_parts(spark):
    rng = np.random.default_rng(3)
    rows = [(None if k > 7 else int(k), int(v)) for k, v in zip(rng.choice([1, 1, 1, 1, 2, 9], 500), rng.permutation(500), strict=True)]
    got = e.placed_rows(spark.createDataFrame(rows, "k int, v int").repartition(7), ["k"], [F.col("v")], "n").collect()
    for key in (None, 1, 2):
        values = sorted(v for k, v in rows if k == key)
        assert {(r["v"], r["n"]) for r in got if r["k"] == key} == {(v, n) for n, v in enumerate(values, 1)}
    edges = [(5, 6), (6, 7), (1, 2), (2, 1), (9, 9), (3, None), (20, 10), (10, 15), (15, 30)]
    assert {tuple(r) for r in connected_parts(spark.createDataFrame(edges, "a int, b int")).collect()} == {(5, 5), (6, 5), (7, 5), (1, 1), (2, 1), (20, 10), (10, 10), (15, 10), (30, 10)}


CHANGE = "change_id int, user_id int, merchant_key string, previous_plan string, change_date date, previous_plan_end date, confidence double"
OLD = "evidence_key string, user_id int, merchant_key string, plan_name string, event_date date, amount decimal(14,2), currency string, quality int, recurring boolean, source string"


def plan(spark, lines, changes, old):
    options = m.amount_options(spark.createDataFrame(lines, LINE))
    best = p.plan_change_best(p.plan_change_candidates(options, spark.createDataFrame(changes, CHANGE), spark.createDataFrame(old, OLD)))
    return {r["line_key"]: r["change_id"] for r in p.plan_change_alloc(best).collect()}


def test_plan_change_needs_every_condition_and_one_user(spark):
    at, before = dt.date(2026, 6, 8), dt.date(2026, 5, 8)
    rows = [(1, "0343", 1, at, "ANTHROPIC", Decimal("22"), "USD", None)]
    change = (341, 7, "ANTHROPIC", "Claude Pro", dt.date(2026, 6, 6), at, 0.98)
    old = ("r285", 7, "ANTHROPIC", "Pro", before, Decimal("22"), "USD", 0, True, "receipt")
    named = ("r285", 7, "ANTHROPIC", "Claude Pro", *old[4:])
    assert plan(spark, rows, [change], [named]) == {"0343": 341}
    for other in ((*named[:1], 8, *named[2:]), (*named[:4], dt.date(2026, 4, 8), *named[5:]), (*named[:5], Decimal("23"), *named[6:]), (*named[:3], "Max", *named[4:])):
        assert plan(spark, rows, [change], [other]) == {}
    rival, rival_old = (342, 8, *change[2:]), ("r286", 8, *named[2:])
    assert plan(spark, rows, [change, rival], [named, rival_old]) == {}
    two = [(1, "0340", 1, dt.date(2026, 6, 7), *rows[0][4:]), (1, "0343", 2, at, *rows[0][4:])]
    assert plan(spark, two, [change], [named]) == {"0343": 341}


def test_evidence_is_kept_and_numbered_without_a_join_of_all_rows(spark):
    columns = "statement_id long, component_key string, receipt_id long, receipt_order long, merchant_key string, signed_amount decimal(14,2), currency string, event_date date, role string, document_kind string, invoice_number string, transaction_id string, related_transaction_id string"
    row = lambda key, order, kind, invoice: (1, key, 1, order, "M", Decimal(5), "USD", dt.date(2026, 1, 2), "charge", kind, invoice, "", "")
    rows = spark.createDataFrame([row("a", 3, "invoice", "I-1"), row("b", 4, "charge", "i1"), row("c", None, "charge", ""), row("d", 2, "charge", None)], columns)
    unique = m.unique_evidence(rows)
    assert [(r.component_key, r.component_index, r.quality) for r in unique.orderBy("component_index").collect()] == [("c", 0, 0), ("d", 1, 0), ("b", 2, 0)]
    # the rows in order are written, so no later reader sorts or joins them again
    plan = unique._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan and "Aggregate" not in plan


def test_pairs_are_grouped_where_they_meet(spark):
    lines = spark.range(8).selectExpr("1L AS statement_id", "id AS line_key", "id AS sequence", "DATE '2026-01-02' AS line_date", "'M' AS merchant_key", "CAST(5 AS DECIMAL(14,2)) AS original_amount", "'USD' AS original_currency", "CAST(5 AS DECIMAL(14,2)) AS amount_jpy")
    unique = spark.range(8).selectExpr(
        "1L AS statement_id", "'M' AS merchant_key", "IF(id % 2 = 0, 'USD', 'JPY') AS currency", "CAST(5 AS DECIMAL(14,2)) AS signed_amount", "DATE '2026-01-01' AS event_date", "id AS component_key", "'charge' AS role",
        "'charge' AS document_kind", "0 AS quality", "CAST(id AS INT) AS component_index",
    )
    edges = m.direct_edges(m.amount_options(lines), unique)
    assert edges.count() == 64 and edges.where("basis = IF(currency = 'USD', 'original', 'jpy')").count() == 64
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = edges._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plan.count("Exchange hashpartitioning") == 2


NETS = [piece("C1", 23, "137.26"), piece("R1", 22, "-66.48", 1, role="refund", kind="refund"), piece("R2", 22, "-6.78", 2, role="refund", kind="refund")]


@pytest.mark.parametrize("placed", [True, False])
def test_nets_try_all_refunds_of_lines_with_a_merchant(spark, placed):
    """A refund over zero lifts a set back to the amount; refunds come in the order of the statement, which is not that of their sign; a line without merchant has no net."""
    refund = {"role": "refund", "kind": "refund"}
    pieces = [piece("C1", 10, "20"), piece("R1", 10, "-9", 1, **refund), piece("R3", 10, "2", 3, **refund), piece("R2", 11, "-1", 2, **refund)]
    pieces += [piece("C4", 10, "20", 4, merchant=""), piece("R5", 10, "-8", 5, merchant="", **refund)]
    evidence = spark.createDataFrame(pieces, PIECE)
    unique = m.net_evidence(m.unique_evidence(evidence, m.NET_COLUMNS) if placed else m.kept_evidence(evidence))
    assert ("component_index" in unique.columns) == placed
    options = m.amount_options(spark.createDataFrame([line("L1", 10, "12"), line("L2", 10, "13"), line("L3", 10, "12", merchant="")], LINE))
    got = m.refund_net_candidates(options, unique, linked=False).collect()
    assert sorted((r.line_key, r.charge_key, *r.refund_keys) for r in got) == [("L1", "C1", "R1", "R2", "R3"), ("L2", "C1", "R1", "R3")]


def test_near_nets_are_not_shuffled_by_line(spark):
    options = m.amount_options(spark.createDataFrame([line("L1", 23, "64"), line("L2", 24, "70.78")], LINE))
    nets = m.refund_net_candidates(options, m.net_evidence(m.kept_evidence(spark.createDataFrame(NETS, PIECE))), linked=False)
    assert {(r.line_key, r.charge_key, tuple(r.refund_keys)) for r in nets.collect()} == {("L1", "C1", ("R1", "R2"))}
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = nets.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    # slots, charges and refunds go by merchant and day; but for what fits, nothing goes by line
    by = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert [re.sub(r"#\d+L?", "", x) for x in by if "line_key" in x] == ["statement_id, line_key, charge_key, refund_keys, 4"]


def test_linked_refunds_meet_their_charge_before_lines(spark):
    pieces = [piece("C1", 2, "42.90", transaction="SALE-123", invoice="sale123"), piece("C2", 2, "9"), piece("R1", 24, "-11.44", 1, role="refund", kind="refund", related="sale 123")]
    unique = m.kept_evidence(spark.createDataFrame(pieces, PIECE))
    assert [tuple(r) for r in m.refund_links(unique).select("charge_key", "refund_key").collect()] == [("C1", "R1")]
    nets = m.refund_net_candidates(m.amount_options(spark.createDataFrame([line("L1", 3, "31.46")], LINE)), unique, linked=True)
    assert [(r.line_key, r.charge_key, list(r.refund_keys), r.charge_days, r.worst) for r in nets.collect()] == [("L1", "C1", ["R1"], 1, 21)]
    assert nets._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 0


def test_lines_without_a_charge_need_no_pairs(spark):
    rng = np.random.default_rng(5)
    lines = [(1, f"L{i}", i, day(int(rng.integers(1, 28))), ("M", "N", "")[int(rng.integers(0, 3))], Decimal(int(rng.integers(1, 4))), "USD", Decimal(int(rng.integers(1, 4)))) for i in range(60)]
    pieces = [piece(f"C{i}", int(rng.integers(1, 28)), str(rng.integers(1, 4)), i, merchant="MN"[i % 2], currency=("USD", "JPY")[i % 3 > 1]) for i in range(30)]
    options, evidence = m.amount_options(spark.createDataFrame(lines, LINE)), spark.createDataFrame(pieces, PIECE)
    edges = {r.line_key for r in m.direct_edges(options, m.unique_evidence(evidence)).collect()}
    got = [r.line_key for r in m.without_charge(options, m.kept_evidence(evidence)).collect()]
    assert sorted(got) == sorted(f"L{i}" for i in range(60) if f"L{i}" not in edges) and 0 < len(got) < 60


def test_a_summary_counts_each_table_once(spark):
    lines = spark.createDataFrame([line("L1", 23, "64"), line("L2", 24, "5"), line("L3", 25, "6")], LINE)
    pieces = [*NETS, piece("C2", 24, "5", 3), piece("C3", 9, "8", 4, transaction="T1"), piece("C4", 9, "9", 5, transaction="t-1")]
    evidence = spark.createDataFrame(pieces, PIECE)
    unique = m.unique_evidence(evidence)
    matched = m.reconcile(lines, None, unique)
    out = lo.statement_summary(lines, matched, unique, evidence)
    assert [r.asDict() for r in out.collect()] == [
        {"statement_id": 1, "lines": 3, "direct": 1, "original_charge": 0, "linked_refund_net": 0, "merchant_refund_net": 1, "matched": 2, "unused": 1, "duplicates": 1, "unmatched": 1, "status": "needs_review"}
    ]
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()
