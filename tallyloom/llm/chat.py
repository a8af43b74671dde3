"""Tool calls in chats: linked to results, ordered, validated and written as canonical JSON.

Messages, calls and results are rows, and stay rows: a conversation is never gathered in one task.
Positions are sort keys: (level, turn, kind), where the level is the longest chain of links before a
row: runs of calls with one predecessor are doubled over, and forks are placed one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: tool -> argument -> (type, required, least, most); lengths for strings, values for integers.
Schemas = dict[str, dict[str, tuple[str, bool, int, int]]]
VARIANT_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and without spaces, null if text is no JSON or repeats a key in an object.

    Plain decimals lose trailing zeros (1.0 and 1.50 become 1 and 1.5), whole numbers keep all digits, -0 is 0, and
    numbers with an exponent are doubles (1e3 becomes 1000.0).
    """
    return F.to_json(F.try_parse_json(text))


def schema_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Problems of a call, in the order of the schemas, joined by commas; empty if the call is valid."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    keys = F.map_keys(F.from_json(arguments, "map<string,string>"))
    problems = [F.when(~name.isin(*schemas) | name.isNull(), "unknown tool"), F.when(~is_object, "arguments are no object")]
    for tool, fields in schemas.items():
        own = (name == tool) & is_object
        for field, (kind, required, least, most) in fields.items():
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            found = F.schema_of_variant(value)
            absent = value.isNull() | (found == "VOID")
            right = found.startswith(VARIANT_TYPES[kind])
            if kind == "string":
                amount = F.length(F.try_variant_get(parsed, f"$.{field}", "string"))
            else:
                amount = F.try_variant_get(parsed, f"$.{field}", "long") if kind == "integer" else F.lit(least)
            if required:
                problems.append(F.when(own & absent, f"{field} missing"))
            problems.append(F.when(own & ~absent & ~right, f"{field} is no {kind}"))
            problems.append(F.when(own & ~absent & right & ~amount.between(least, most), f"{field} out of range"))
        extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(f) for f in fields]).cast("array<string>")))
        problems.append(F.when(own & (F.size(extra) > 0), F.concat(F.lit("unexpected "), F.array_join(extra, "+"))))
    return F.array_join(F.array_compact(F.array(*problems)), ",")


def _chain_tops(edges: DataFrame) -> DataFrame:
    """conv_id, call_id, top, steps for calls of exactly one need: the first call behind it, `steps` needs away,
    that has none or several. Pointers double their reach each round, so n calls in a row take log n
    rounds; those that no round brings to an end lie on cycles and are left out."""
    counted = edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("top"))
    single = materialize(counted.where("n = 1").select("conv_id", "call_id", "top"), "chat-single")
    inner = single.select("conv_id", F.col("call_id").alias("top"), F.lit(True).alias("inner"))
    at = materialize(single.join(inner, ["conv_id", "top"], "left").select("conv_id", "call_id", "top", F.lit(1).cast("long").alias("steps"), "inner"), "chat-pointers")
    waiting = at.where("inner").count()
    while waiting:
        ahead = at.select("conv_id", F.col("call_id").alias("top"), F.col("top").alias("next"), F.col("steps").alias("more"), F.col("inner").alias("on"))
        step = at.join(ahead, ["conv_id", "top"], "left")
        moved = step.select("conv_id", "call_id", F.coalesce("next", "top").alias("top"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.when(F.col("next").isNotNull(), F.col("on")).alias("inner"))
        at = materialize(moved, "chat-pointers")
        left = at.where("inner").count()
        if left == waiting:
            break
        waiting = left
    return at.where("inner IS NULL").select("conv_id", "call_id", "top", "steps")


def _fork_depths(nodes: DataFrame, edges: DataFrame, tops: DataFrame) -> DataFrame:
    """conv_id, call_id, depth of calls without needs or with several. Runs of single needs count as one edge of
    their length, so rounds go by forks that follow each other and not by calls."""
    behind = edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n"))
    free = nodes.join(behind, ["conv_id", "call_id"], "left_anti").withColumn("depth", F.lit(0).cast("long"))
    several = edges.join(behind.where("n > 1").select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi")
    runs = tops.select("conv_id", F.col("call_id").alias("need"), "top", "steps")
    inner = behind.where("n = 1").select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("inner"))
    short = several.join(runs, ["conv_id", "need"], "left").join(inner, ["conv_id", "need"], "left")
    # a need on a cycle of single needs has no top: its call can never be placed
    top = F.when(F.col("inner") & F.col("top").isNull(), None).otherwise(F.coalesce("top", "need"))
    at = materialize(short.select("conv_id", "call_id", top.alias("top"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), F.lit(None).cast("long").alias("depth")), "chat-forks")
    placed = fresh = materialize(free, "chat-free")
    while not at.isEmpty():
        known = fresh.select("conv_id", F.col("call_id").alias("top"), F.col("depth").alias("at_top"))
        at = at.join(known, ["conv_id", "top"], "left").select("conv_id", "call_id", "top", "steps", F.coalesce("depth", F.col("at_top") + F.col("steps")).alias("depth"))
        at = materialize(at, "chat-forks")
        done = at.groupBy("conv_id", "call_id").agg(F.max("depth").alias("depth"), F.count_if(F.col("depth").isNull()).alias("open")).where("open = 0").drop("open")
        fresh = materialize(done, "chat-placed")
        if fresh.isEmpty():
            break
        placed = placed.unionByName(fresh)
        at = at.join(fresh.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
    return placed


def call_depths(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """conv_id, call_id, depth of each call: 0 without needs, else one more than the deepest need.

    needs has conv_id, call_id, need. Needs of no known call are left out. Calls on a cycle, or behind
    one, have no depth and are not returned. An empty table gives an empty result; other columns are not read.
    """
    nodes = materialize(calls.select("conv_id", "call_id").distinct(), "chat-calls")
    known = nodes.withColumnRenamed("call_id", "need")
    edges = needs.select("conv_id", "call_id", "need").join(known, ["conv_id", "need"]).join(nodes, ["conv_id", "call_id"])
    edges = materialize(edges.select("conv_id", "call_id", "need").distinct(), "chat-needs")
    tops = materialize(_chain_tops(edges), "chat-tops")
    forks = materialize(_fork_depths(nodes, edges, tops), "chat-depths")
    ends = forks.select("conv_id", F.col("call_id").alias("top"), "depth")
    runs = tops.join(ends, ["conv_id", "top"]).select("conv_id", "call_id", (F.col("depth") + F.col("steps")).alias("depth"))
    return forks.unionByName(runs)


def link_tool_calls(messages: DataFrame, calls: DataFrame, results: DataFrame, needs: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per message, call and result: conv_id, level, turn, kind, call_id, status, errors, json.

    messages: conv_id, turn, role, content. calls: conv_id, turn, call_id, name, arguments (JSON text).
    results: conv_id, turn, call_id, content. needs: conv_id, call_id, need (an id whose result the call
    uses). A call is at level 2 * depth, its result at the next; plain messages are at level 0 and keep
    their turns. Of calls that share an id the earliest is linked, others are "duplicate"; a result
    without call is "orphan", a call without result "unanswered", a call on a cycle "cyclic" (level -1).
    Null ids link to nothing; null contents and empty texts are empty strings in the JSON. Rows that repeat
    stay rows of their own. Any table may be empty; columns beyond those named are not read, whatever their names.
    """
    order = F.struct("turn", "arguments", "name")
    named = calls.where("call_id IS NOT NULL AND conv_id IS NOT NULL")
    first = named.groupBy("conv_id", "call_id").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).select("conv_id", "call_id", "f.turn", "f.arguments", "f.name", "n")
    first = materialize(first, "chat-first")
    depths = call_depths(first, needs)
    answered = results.where("call_id IS NOT NULL").select("conv_id", "call_id").distinct().withColumn("answered", F.lit(True))
    linked = first.join(depths, ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left")
    linked = materialize(linked, "chat-linked")
    call_line = F.to_json(
        F.struct(
            F.coalesce(F.try_parse_json(F.col("arguments")), F.try_parse_json(F.lit("null"))).alias("arguments"),
            F.coalesce("call_id", F.lit("")).alias("id"), F.coalesce("name", F.lit("")).alias("name"), F.lit("tool_call").alias("type"),
        )
    )
    status = F.when(F.col("depth").isNull(), "cyclic").when(F.col("answered"), "linked").otherwise("unanswered")
    columns = ["conv_id", "level", "turn", "kind", "call_id", "status", "errors", "json"]
    errors = schema_errors(F.col("name"), F.col("arguments"), schemas)
    call_rows = linked.select(
        "conv_id", F.coalesce(F.col("depth") * 2, F.lit(-1)).cast("int").alias("level"), "turn", F.lit("call").alias("kind"), "call_id",
        status.alias("status"), errors.alias("errors"), call_line.alias("json"),
    )
    key = F.struct("turn", "arguments", "name")
    spare = named.join(first.select("conv_id", "call_id", key.alias("f"), "n").where("n > 1"), ["conv_id", "call_id"])
    spare = spare.withColumn("same", (F.col("f").eqNullSafe(key))).select("conv_id", "call_id", "turn", "arguments", "name", "same", "n")
    counts = spare.groupBy("conv_id", "call_id", "turn", "arguments", "name", "same").agg(F.count(F.lit(1)).alias("k"))
    spare = counts.withColumn("k", F.col("k") - F.col("same").cast("int")).where("k > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))))
    spare = spare.unionByName(calls.where("call_id IS NULL OR conv_id IS NULL"), allowMissingColumns=True)
    spare_rows = spare.select(
        "conv_id", F.lit(0).alias("level"), "turn", F.lit("call").alias("kind"), "call_id",
        F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), "unanswered").otherwise("duplicate").alias("status"), errors.alias("errors"), call_line.alias("json"),
    )
    owner = linked.select("conv_id", "call_id", F.col("depth"), F.lit(True).alias("known"))
    result_line = F.to_json(F.struct(F.coalesce("content", F.lit("")).alias("content"), F.coalesce("call_id", F.lit("")).alias("id"), F.lit("tool_result").alias("type")))
    result_rows = results.join(owner, ["conv_id", "call_id"], "left").select(
        "conv_id",
        F.when(F.col("known") & F.col("depth").isNotNull(), F.col("depth") * 2 + 1).when(F.col("known"), -1).otherwise(0).cast("int").alias("level"),
        "turn", F.lit("result").alias("kind"), "call_id",
        F.when(F.col("known") & F.col("depth").isNull(), "cyclic").when(F.col("known"), "linked").otherwise("orphan").alias("status"),
        F.lit("").alias("errors"), result_line.alias("json"),
    )
    line = F.to_json(F.struct(F.coalesce("content", F.lit("")).alias("content"), F.coalesce("role", F.lit("")).alias("role"), F.lit("message").alias("type")))
    message_rows = messages.select(
        "conv_id", F.lit(0).alias("level"), "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"),
        F.lit("plain").alias("status"), F.lit("").alias("errors"), line.alias("json"),
    )
    return call_rows.unionByName(spare_rows).unionByName(result_rows).unionByName(message_rows).select(columns)


#: Tools of the query over conversations; "archive" calls name a tool without schema.
DEMO_SCHEMAS: Schemas = {
    "search": {"query": ("string", True, 1, 250), "limit": ("integer", True, 1, 50)},
    "summarise": {"query": ("string", True, 20, 100_000), "limit": ("integer", False, 5, 40)},
    "translate": {"query": ("string", True, 1, 100_000), "lang": ("string", True, 2, 2)},
}


def calls_of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(messages, calls, results, needs) of plain conversations, read as tool use: a user turn calls a
    tool with its text, the next turn of the assistant is the result, and each call needs the one two
    turns before. Other turns are messages."""
    text = F.coalesce("text", F.lit(""))
    size = F.length(text)
    name = F.element_at(F.array(*[F.lit(t) for t in ("search", "summarise", "translate", "archive")]), (size % 4 + 1).cast("int"))
    arguments = F.to_json(F.struct(text.alias("query"), (size % 60).alias("limit"), F.when(size % 3 == 0, "en").alias("lang")))
    calls = turns.where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("call_"), "turn").alias("call_id"), name.alias("name"), arguments.alias("arguments"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("call_"), F.col("turn") - 1).alias("call_id"), text.alias("content"))
    messages = turns.where("role IS NULL OR role NOT IN ('user', 'assistant')").select("conv_id", "turn", "role", text.alias("content"))
    needs = calls.select("conv_id", "call_id", F.concat(F.lit("call_"), F.col("turn") - 2).alias("need"))
    return messages, calls, results, needs
