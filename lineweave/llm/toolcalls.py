"""Tool-call linking for chat data: calls and results are joined by identifier, ordered, checked and serialised.

Messages are rows (conv_id, pos, role, content, call_id, after_id, name, arguments, reply_to): a call has a
``call_id``, a ``name`` and its ``arguments`` as a map of strings, and may name the call that it comes after; a
result has ``reply_to``. Every message thus waits for at most one other, and its depth in this forest is found by
pointer doubling, in as many joins as the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: What the queries' calls must look like: (tool, argument, type, required).
REPLY_SCHEMA = [("reply", "prompt", "string", True), ("reply", "turn", "integer", True)]
_FITS = {"string": r"(?s)\A.*\z", "integer": r"\A-?[0-9]{1,18}\z", "number": r"\A-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z", "boolean": r"\A(?:true|false)\z"}


def schemas(spark: SparkSession, rows: list[tuple] = REPLY_SCHEMA) -> DataFrame:
    """Argument schemas as a table."""
    return spark.createDataFrame(rows, "name string, arg string, type string, required boolean")


def json_string(c: Column) -> Column:
    """A JSON string literal with the escapes that JSON demands and no others."""
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    for code in [*range(8), 11, *range(14, 32)]:
        c = F.replace(c, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), c, F.lit('"'))


def _value(type_: Column, value: Column) -> Column:
    return F.when(type_.isin("integer", "number", "boolean"), value).otherwise(json_string(value))


def validate(calls: DataFrame, schema: DataFrame) -> DataFrame:
    """(row, valid, json): whether a call's arguments fit its tool's schema, and the arguments as canonical JSON.

    A call is invalid if its tool is unknown, an argument is unknown or of another type, or a required one is
    missing or null. Keys are sorted; unknown arguments and those that don't fit their type are written as strings.
    """
    given = calls.select("row", "name", F.explode_outer("arguments").alias("arg", "value"))
    typed = given.join(schema.select("name", "arg", "type", "required"), ["name", "arg"], "left")
    pattern = F.create_map(*(F.lit(x) for pair in _FITS.items() for x in pair))
    fits = F.coalesce(F.regexp_like("value", pattern[F.col("type")]), F.lit(False))
    shown = F.when(F.col("value").isNull(), "null").when(fits, _value(F.col("type"), F.col("value"))).otherwise(json_string(F.col("value")))
    good = F.col("type").isNotNull() & (fits | (F.col("value").isNull() & ~F.col("required")))
    typed = typed.withColumns({"fit": F.col("arg").isNull() | good, "have": F.coalesce(F.col("required"), F.lit(False)) & F.col("value").isNotNull(), "text": F.concat(json_string(F.col("arg")), F.lit(":"), shown)})
    per = typed.groupBy("row", "name").agg(F.every("fit").alias("fit"), F.count_if("have").alias("have"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("arg", "text"))), lambda x: x.text), ",").alias("inner"))
    need = schema.groupBy("name").agg(F.count_if("required").alias("need"))
    return per.join(need, "name", "left").select("row", (F.col("fit") & F.col("need").isNotNull() & (F.col("have") == F.col("need"))).alias("valid"), F.concat(F.lit("{"), F.coalesce("inner", F.lit("")), F.lit("}")).alias("json"))


def depths(nodes: DataFrame) -> DataFrame:
    """(row, depth) in the forest of nodes (row, parent): 0 for roots, null on or behind a cycle."""
    now = cut(nodes.select("row", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")), "depths")
    limit = max(1, now.count()).bit_length() + 1
    for _ in range(limit):
        if not now.where("up is not null").limit(1).count():
            break
        above = now.select(F.col("row").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        now = cut(now.join(above, "up", "left").select("row", F.col("further").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depths")
    return now.select("row", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link(messages: DataFrame, schema: DataFrame) -> DataFrame:
    """Every message with ``row``, ``parent``, ``depth``, ``status``, ``valid``, ``place`` and ``json``.

    Results join calls by conversation and identifier; of calls that share one, the first owns it. ``status`` is
    message, call, linked, orphan (a result without its call), duplicate (a repeated identifier, or a further
    result of one call) or cycle. ``place`` is a topological order: by depth, then position. Null conversations
    are one conversation of their own; a null role is written as null, null content as the empty string.
    """
    keep = ["conv_id", "pos", "role", "content", "call_id", "after_id", "name", "arguments", "reply_to"]
    rows = cut(messages.select(*keep).withColumn("row", F.monotonically_increasing_id()), "messages")
    first = lambda c: F.row_number().over(Window.partitionBy("conv_id", c).orderBy("pos", "row"))
    calls = rows.where("call_id is not null").select("conv_id", "call_id", "row", first("call_id").alias("nth"))
    owners = calls.where("nth = 1").select(F.col("conv_id").alias("of_conv"), F.col("call_id").alias("of_call"), F.col("row").alias("parent"))
    asks = F.coalesce("reply_to", "after_id")
    linked = rows.join(owners, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (asks == F.col("of_call")), "left").drop("of_conv", "of_call")
    repeats = calls.where("nth > 1").select("row").unionByName(rows.where("reply_to is not null").select("row", first("reply_to").alias("nth")).where("nth > 1").select("row")).distinct().withColumn("repeat", F.lit(True))
    checked = validate(rows.where("call_id is not null").select("row", "name", "arguments"), schema)
    deep = depths(linked.select("row", "parent"))
    out = linked.join(repeats, "row", "left").join(deep, "row").join(checked, "row", "left")
    status = (
        F.when(F.col("depth").isNull(), "cycle").when(F.col("repeat"), "duplicate").when(F.col("reply_to").isNotNull() & F.col("parent").isNull(), "orphan")
        .when(F.col("reply_to").isNotNull(), "linked").when(F.col("call_id").isNotNull(), "call").otherwise("message")
    )
    out = out.withColumn("status", status)
    order = Window.partitionBy("conv_id").orderBy(F.col("depth").isNull(), "depth", F.col("pos").asc_nulls_last(), "row")
    parts = [
        F.when(F.col("call_id").isNotNull(), F.concat(F.lit('"arguments":'), "json")), F.when(F.col("call_id").isNotNull(), F.concat(F.lit('"call_id":'), json_string(F.col("call_id")))),
        F.concat(F.lit('"content":'), json_string(F.coalesce("content", F.lit("")))), F.when(F.col("name").isNotNull(), F.concat(F.lit('"name":'), json_string(F.col("name")))),
        F.when(F.col("reply_to").isNotNull(), F.concat(F.lit('"reply_to":'), json_string(F.col("reply_to")))), F.concat(F.lit('"role":'), F.coalesce(json_string(F.col("role")), F.lit("null"))),
    ]
    line = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return out.withColumns({"place": F.row_number().over(order), "json": line})


def as_calls(conversations: DataFrame) -> DataFrame:
    """Conversation turns as tool calls: a user turn calls the tool ``reply``, the assistant's next turn is its result.

    Calls of a conversation come one after the other. Turns of other roles are plain messages.
    """
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    name = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    return conversations.select(
        "conv_id", F.col("turn").alias("pos"), "role", F.col("text").alias("content"),
        F.when(user, name(F.col("turn"))).alias("call_id"),
        F.when(user & (F.col("turn") > 1), name(F.col("turn") - 2)).alias("after_id"),
        F.when(user, "reply").alias("name"),
        F.when(user, F.create_map(F.lit("prompt"), F.col("text"), F.lit("turn"), F.col("turn").cast("string"))).alias("arguments"),
        F.when(assistant, name(F.col("turn") - 1)).alias("reply_to"),
    )


def transcripts(linked: DataFrame) -> DataFrame:
    """One row for each message of ``link``, without what only the join needs."""
    return linked.select("conv_id", "pos", "place", "depth", "status", "valid", "json")
