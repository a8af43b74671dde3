"""One-to-one assignment of lines and charges by counts: pairs of a hot merchant and amount are never listed.

Lines of one day and the same amounts are interchangeable, and so are charges of one day and amount but for their
quality and place. Both are counted by such classes. What is left is a transport of counts between classes at most
`tolerance` days apart: trivial where one class meets one, else solved exactly island by island. Rows are then
dealt to the flows by their place in their class, which comes from sorted parts and prefix sums.
"""

from __future__ import annotations

from collections import deque
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import staged
from .exclusive import in_order, same_keys
from .parts import connected_parts

#: Rows of classes that one task solves, and steps that a class of charges is cut into at a time.
BLOCK_ROWS, STEPS = 5_000, 1024
PURSE = ["statement_id", "merchant_key", "currency", "amount"]
CHARGE_CLASS = [*PURSE, "event_date"]
LINE_CLASS = ["statement_id", "merchant_key", "line_date", "options"]
DAY, QUALITY, PLACE = 100, 60, 20


def cheapest_flow(lines: list[tuple], charges: list[tuple], tolerance: int) -> dict[tuple[int, int], int]:
    """{(line class, charge class): pairs} with the most pairs and, among those, the least cost.

    lines: (day, purses, rows). charges: (day, purse, steps), steps being (cost of a row, rows) with rising
    costs. A pair costs its days first, then what its charge costs. Augments along shortest paths of the residual network,
    as many rows at a time as the path bears.
    """
    reach = [[(j, abs(day - s) << DAY) for j, (s, purse, _) in enumerate(charges) if purse in purses and abs(day - s) <= tolerance] for day, purses, _ in lines]
    free = [rows for _, _, rows in lines]
    step, room = [0] * len(charges), [steps[0][1] if steps else 0 for _, _, steps in charges]
    flow: list[dict[int, int]] = [{} for _ in charges]  # rows of each line class that a charge class takes
    while True:
        far: list[int | None] = [0 if n else None for n in free]
        charge_far: list[int | None] = [None] * len(charges)
        line_from: list[int | None] = [None] * len(lines)
        charge_from: list[int | None] = [None] * len(charges)
        queue = deque(i for i, n in enumerate(free) if n)
        waiting = set(queue)
        while queue:
            i = queue.popleft()
            waiting.discard(i)
            for j, cost in reach[i]:
                d = far[i] + cost
                if charge_far[j] is None or d < charge_far[j]:
                    charge_far[j], charge_from[j] = d, i
                    for k in flow[j]:
                        back = d - (abs(lines[k][0] - charges[j][0]) << DAY)
                        if far[k] is None or back < far[k]:
                            far[k], line_from[k] = back, j
                            if k not in waiting:
                                waiting.add(k)
                                queue.append(k)
        ends = [(charge_far[j] + charges[j][2][step[j]][0], j) for j in range(len(charges)) if charge_far[j] is not None and step[j] < len(charges[j][2])]
        if not ends:
            return {(i, j): n for j, of in enumerate(flow) for i, n in of.items()}
        end = min(ends)[1]
        path, j = [], end
        while True:
            i = charge_from[j]
            path.append((i, j))
            if line_from[i] is None:
                break
            j = line_from[i]
        most = min(free[i], room[end])
        for (back, _), (_, j) in zip(path, path[1:]):
            most = min(most, flow[j][back])
        free[i] -= most
        room[end] -= most
        if not room[end]:
            step[end] += 1
            room[end] = charges[end][2][step[end]][1] if step[end] < len(charges[end][2]) else 0
        for i, j in path:
            flow[j][i] = flow[j].get(i, 0) + most
        for (back, _), (_, j) in zip(path, path[1:]):
            flow[j][back] -= most
            if not flow[j][back]:
                del flow[j][back]


def solve_islands(rows: pd.DataFrame, tolerance: int) -> pd.DataFrame:
    """Flows (line_class, charge_class, pairs, line_from, charge_from) of the islands of a block."""
    out = []
    order = rows.sort_values(["pool", "island", "day", "name", "quality", "step"], kind="stable").itertuples(index=False)
    for _, island in groupby(order, key=lambda r: (r.pool, r.island)):
        lines, charges = [], {}
        for r in island:
            if r.is_line:
                lines.append((r.id, (r.day, {r.purse, r.other}, r.n)))
            else:
                known = charges.setdefault(r.id, (r.day, r.purse, []))
                known[2].append(((r.quality << QUALITY) + (r.places << PLACE) // r.n, r.n))
        names = list(charges)
        flows = cheapest_flow([x for _, x in lines], list(charges.values()), tolerance)
        line_at, charge_at = [0] * len(lines), [0] * len(names)
        for (i, j), n in sorted(flows.items()):
            out.append((lines[i][0], names[j], n, line_at[i], charge_at[j]))
            line_at[i] += n
            charge_at[j] += n
    return pd.DataFrame(out, columns=["line_class", "charge_class", "pairs", "line_from", "charge_from"])


def assign_by_counts(lines: DataFrame, unique: DataFrame, options, tolerance: int, block_rows: int = BLOCK_ROWS, steps: int = STEPS) -> DataFrame:
    """Pairs of lines and charges, each once: the most pairs, then the least days, quality and places in sum.

    Lines take charges of their statement and merchant that equal one of `options`, an array of (amount, currency,
    basis), at most `tolerance` days apart. Of interchangeable rows those with the lowest quality and place, or sequence, go first. The
    optimum is exact for classes of any size: `steps` is only how finely they are cut at a time. Rows without day,
    merchant or options, and refunds, have no pairs.
    """
    wanted = lines.where((F.coalesce(F.col("merchant_key").cast("string"), F.lit("")) != "") & F.col("line_date").isNotNull())
    wanted = wanted.select("statement_id", "merchant_key", "line_date", "sequence", "line_key", options.alias("options")).where(F.size("options") > 0)
    charges = unique.where("role = 'charge' AND signed_amount >= 0 AND event_date IS NOT NULL").select(
        "statement_id", "merchant_key", "currency", F.col("signed_amount").alias("amount"), "event_date", "quality", "component_index", "component_key", "document_kind"
    )
    line_rows, line_spans = in_order(wanted, LINE_CLASS, [F.col("sequence"), F.col("line_key")])
    charge_rows, charge_spans = in_order(charges, CHARGE_CLASS, [F.col("quality"), F.col("component_index"), F.col("component_key")])
    line_spans, charge_spans = staged(line_spans, "line-spans"), staged(charge_spans, "charge-spans")

    supply = staged(
        charge_spans.groupBy(*CHARGE_CLASS).agg(F.sum("_n").alias("n")).withColumn("charge_class", F.monotonically_increasing_id())
        .withColumn("purse", F.min("charge_class").over(Window.partitionBy(*PURSE))), "charge-classes",
    )
    demand = line_classes(staged(line_spans.groupBy(*LINE_CLASS).agg(F.sum("_n").alias("n")).withColumn("full", F.monotonically_increasing_id()), "line-kinds"), supply, tolerance)
    flows = staged(class_flows(demand, supply, charge_rows, charge_spans, tolerance, block_rows, steps), "flows")

    # flows of a class of lines fall to the kinds of lines in it, and those to sorted parts, by places
    overlap = (F.col("line_from") < F.col("offset") + F.col("n")) & (F.col("offset") < F.col("line_from") + F.col("pairs"))
    low, high = F.greatest("line_from", "offset"), F.least(F.col("line_from") + F.col("pairs"), F.col("offset") + F.col("n"))
    parts = demand.join(flows, "line_class").where(overlap).select(
        *LINE_CLASS, "charge_class", (low - F.col("offset")).alias("_low"), (high - F.col("offset")).alias("_high"), (F.col("charge_from") + low - F.col("line_from")).alias("_to")
    )
    inside = (F.col("_low") < F.col("s._ahead") + F.col("s._n")) & (F.col("s._ahead") < F.col("_high"))
    spread = line_spans.alias("s").join(parts.alias("p"), same_keys(LINE_CLASS, "s", "p") & inside).select("s.*", "charge_class", "_low", "_high", "_to")
    place = F.col("_at") - F.col("_first") + F.col("_ahead")
    dealt = line_rows.alias("r").join(spread.alias("s"), same_keys([*LINE_CLASS, "_part"], "r", "s")).select("r.*", "charge_class", "_low", "_high", "_to", place.alias("_place"))
    dealt = dealt.where("_place >= _low AND _place < _high").withColumn("_place", F.col("_to") + F.col("_place") - F.col("_low")).drop("_low", "_high", "_to", "_at", "_part", "statement_id", "merchant_key")
    placed = charge_places(charge_rows, charge_spans, supply).select(*PURSE, "event_date", "quality", "component_index", "component_key", "document_kind", "charge_class", "_place")
    same = F.filter("options", lambda o: (o["amount"] == F.col("amount")) & (o["currency"] == F.col("currency")))
    days = F.abs(F.datediff("line_date", "event_date"))
    cost = days.cast("long") * 1_000_000 + F.col("quality") * 10_000 + F.col("component_index")
    return dealt.join(placed, ["charge_class", "_place"]).select(
        "statement_id", "merchant_key", "line_key", "component_key", same[0]["basis"].alias("basis"), cost.cast("long").alias("cost"), days.alias("days"), "quality", "line_date", "event_date",
        "currency", "amount", "sequence", "component_index", "document_kind",
    )


def charge_places(rows: DataFrame, spans: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with the class and its size, and their place in it from 0."""
    known = spans.alias("s").join(classes.alias("c"), same_keys(CHARGE_CLASS, "s", "c")).select("s.*", "charge_class", F.col("c.n").alias("size"))
    met = rows.alias("r").join(known.alias("s"), same_keys([*CHARGE_CLASS, "_part"], "r", "s"))
    return met.select("r.*", "charge_class", "size", (F.col("_at") - F.col("_first") + F.col("_ahead")).alias("_place"))


def line_classes(kinds: DataFrame, supply: DataFrame, tolerance: int) -> DataFrame:
    """kinds of lines (same day and options) with the class of those that reach the same purses, and their offset in it."""
    around = F.sequence(F.date_sub("event_date", tolerance), F.date_add("event_date", tolerance))
    near = supply.select(*PURSE, "purse", F.explode(around).alias("line_date")).distinct()
    asked = kinds.select("full", "statement_id", "merchant_key", "line_date", F.explode("options").alias("o")).select("*", "o.currency", "o.amount")
    name = F.concat_ws(" ", "currency", F.col("amount").cast("string"))
    live = asked.join(near, [*PURSE, "line_date"]).groupBy("full").agg(F.array_sort(F.collect_set(F.struct(name.alias("name"), "purse"))).alias("live"))
    whole = Window.partitionBy("line_date", "live")
    before = whole.orderBy("options").rowsBetween(Window.unboundedPreceding, -1)
    return staged(
        kinds.join(live, "full").withColumn("line_class", F.min("full").over(whole)).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .select(*LINE_CLASS, "line_class", "offset", "n", "live"), "line-classes",
    )


def class_flows(demand: DataFrame, supply: DataFrame, charge_rows: DataFrame, charge_spans: DataFrame, tolerance: int, block_rows: int, steps: int) -> DataFrame:
    """line_class, charge_class, pairs, and the places in both from which they are taken."""
    classes = demand.groupBy("line_class", "line_date", "live").agg(F.sum("n").alias("n"))
    purse, other = F.col("live")[0]["purse"], F.when(F.size("live") > 1, F.col("live")[1]["purse"])
    asked = classes.select(
        F.col("line_class").alias("id"), F.lit(True).alias("is_line"), F.datediff("line_date", F.lit("1970-01-01").cast("date")).alias("day"), "n", purse.alias("purse"), other.alias("other"),
        F.array_join(F.transform("live", lambda x: x["name"]), ";").alias("name"),
    )
    given = supply.select(
        F.col("charge_class").alias("id"), F.lit(False).alias("is_line"), F.datediff("event_date", F.lit("1970-01-01").cast("date")).alias("day"), "n", "purse", F.lit(None).cast("long").alias("other"),
        F.concat_ws(" ", "currency", F.col("amount").cast("string")).alias("name"),
    )
    both = staged(asked.unionByName(given), "classes")
    links = staged(both.where("other IS NOT NULL").select(F.col("purse").alias("a"), F.col("other").alias("b")).distinct(), "purse-links")
    # purses that a line could pay from either of are one pool
    pools = connected_parts(links).select(F.col("node").alias("purse"), F.col("part").alias("pool"))
    order = Window.partitionBy("pool").orderBy("day")
    starts = F.col("day") - F.lag("day").over(order) > tolerance
    islands = (
        both.join(pools, "purse", "left").withColumn("pool", F.coalesce("pool", "purse")).withColumn("starts", F.coalesce(starts.cast("int"), F.lit(0)))
        .withColumn("island", F.sum("starts").over(order.rangeBetween(Window.unboundedPreceding, 0))).drop("starts")
    )
    inside = Window.partitionBy("pool", "island")
    counted = staged(islands.withColumn("lines", F.count_if("is_line").over(inside)).withColumn("charges", F.count_if(~F.col("is_line")).over(inside)), "islands")
    single = counted.where("lines = 1 AND charges = 1")
    plain = single.where("is_line").alias("l").join(single.where("NOT is_line").alias("c"), ["pool", "island"]).where("c.purse = l.purse OR c.purse = l.other").select(
        F.col("l.id").alias("line_class"), F.col("c.id").alias("charge_class"), F.least("l.n", "c.n").alias("pairs"), F.lit(0).cast("long").alias("line_from"), F.lit(0).cast("long").alias("charge_from")
    )
    hard = counted.where("lines > 0 AND charges > 0 AND lines + charges > 2").drop("lines", "charges")
    placed = charge_places(charge_rows, charge_spans, supply.join(hard.where("NOT is_line").select(F.col("id").alias("charge_class")), "charge_class", "left_semi"))
    return plain.unionByName(exact_flows(hard, placed, tolerance, block_rows, steps))


def exact_flows(hard: DataFrame, placed: DataFrame, tolerance: int, block_rows: int, steps: int) -> DataFrame:
    """The flows of islands of several classes; a task holds some steps of a class at a time, however many charges it has.

    A class of more than `steps` charges is cut into steps that count with their averages. The last charge that a flow takes
    of a class and the first one that it leaves decide whether another flow is cheaper: if they do not stand alone, the steps that hold them
    are cut again and the island is solved anew. Once they do in all classes of an island, no exchange of one charge for another
    is cheaper, and as later charges of a class cost no less, no other flow is.
    """
    width = F.ceil(F.col("size") / steps)
    left, settled = hard, None
    priced = placed.select(F.col("charge_class").alias("id"), "quality", "component_index", F.col("_place").alias("place"), (F.col("_place") - F.col("_place") % width).alias("step"), width.alias("width"))
    while True:
        rows = staged(in_steps(left, priced), "islands-to-solve")
        blocks = max(1, -(-rows.count() // block_rows))
        solved = rows.drop("width").withColumn("block", F.pmod(F.xxhash64("pool", "island"), F.lit(blocks))).groupBy("block").applyInPandas(
            lambda part: solve_islands(part, tolerance), "line_class long, charge_class long, pairs long, line_from long, charge_from long"
        )
        wide = rows.where("NOT is_line AND width > 1")
        if wide.isEmpty():
            return solved if settled is None else settled.unionByName(solved)
        solved = staged(solved, "solved")
        used = solved.groupBy(F.col("charge_class").alias("id")).agg(F.sum("pairs").alias("used"))
        vague = wide.groupBy("pool", "island", "id", "step").agg(F.sum("n").alias("n")).where("n > 1").join(used, "id", "left").where("step <= coalesce(used, 0) AND coalesce(used, 0) <= step + n")
        vague = staged(vague.select("pool", "island", "id", "step"), "vague-steps")
        left = staged(left.join(vague, ["pool", "island"], "left_semi"), "islands-again")
        done = solved.join(left.where("is_line").select(F.col("id").alias("line_class")), "line_class", "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        if vague.isEmpty():
            return settled
        marked = priced.join(left.where("NOT is_line"), "id", "left_semi").join(vague.select("id", "step", F.lit(True).alias("cut")), ["id", "step"], "left")
        finer = F.when(F.col("cut"), F.ceil(F.col("width") / max(steps, 2))).otherwise(F.col("width"))
        priced = marked.select("id", "quality", "component_index", "place", (F.col("place") - (F.col("place") - F.col("step")) % finer).alias("step"), finer.alias("width"))
        priced = staged(priced, "priced")


def in_steps(hard: DataFrame, priced: DataFrame) -> DataFrame:
    """Classes of lines and steps of classes of charges, whose places are added up, of the islands."""
    graded = priced.groupBy("id", "quality", "step", "width").agg(F.count(F.lit(1)).alias("n"), F.sum("component_index").alias("places"))
    charges = hard.where("NOT is_line").drop("n").join(graded, "id")
    empty = {c: F.lit(0).cast("long") for c in ("quality", "step", "width", "places")}
    columns = ["pool", "island", "id", "is_line", "day", "n", "purse", "other", "name", "quality", "step", "width", "places"]
    return hard.where("is_line").withColumns(empty).select(columns).unionByName(charges.select(columns)).fillna(-1, ["other"])
