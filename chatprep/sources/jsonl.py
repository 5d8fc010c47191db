"""Lenient scan of chat JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.functions.text import strip
from chatprep.operators.common import pin

LINE_FIELDS = ("id", "text", "conversations", "tools")
MESSAGE_FIELDS = ("role", "content", "tool_calls", "reasoning_content")


def _kind(value: Column) -> Column:
    """ARRAY, OBJECT, STRING, ... of a variant; null stays null."""
    return F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)


def _as_text(value: Column) -> Column:
    """Lists and objects as JSON text, scalars as they are, JSON null as null."""
    return F.try_variant_get(value, "$", "string")


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Parsed lines with a ``reason`` on the bad ones.

    Columns: ``id, text, conversations, tools, options, reason, line``; ``options`` maps the
    other fields of the line, without nulls, to their text.  Works on batch and streaming
    frames alike.

    A line is taken apart once, as a map of its fields, and so is each message; what is no object
    gives no map, so that no value's kind needs a look of its own.
    """
    trimmed = strip(F.col("line"))
    parsed = pin(lines.select(F.col(line).alias("line")), v=F.try_parse_json(trimmed), t=trimmed)
    parsed = pin(parsed.filter(F.col("t") != ""), fields=F.try_variant_get("v", "$", "map<string,variant>"))
    conv = F.try_element_at("fields", F.lit("conversations"))
    parsed = pin(
        parsed,
        absent=conv.isNull() | F.is_variant_null(conv),
        items=F.try_variant_get(conv, "$", "array<map<string,variant>>"),
        tools=F.try_element_at("fields", F.lit("tools")),
    )
    reason = (
        F.when(F.col("v").isNull(), "not JSON")
        .when(F.col("fields").isNull(), "not an object")
        .when(~F.col("absent") & F.col("items").isNull(), "conversations is not a list")
    )
    messages = F.transform(
        F.filter("items", lambda m: m.isNotNull()),
        lambda m: F.struct(*[_as_text(F.try_element_at(m, F.lit(f))).alias(f) for f in MESSAGE_FIELDS]),
    )
    empty = F.array().cast(
        "array<struct<role:string,content:string,tool_calls:string,reasoning_content:string>>"
    )
    tools = F.col("tools")
    text = _as_text(tools)
    quoted = F.startswith(F.to_json(tools), F.lit('"'))
    inner = F.when(quoted, F.try_parse_json(text))
    as_json = (
        F.when(tools.isNull(), F.lit(None).cast("string"))
        .when(F.is_variant_null(tools), "[]")
        .when(inner.isNotNull(), F.to_json(inner))
        .when(quoted, text)
        .otherwise(F.to_json(tools))
    )
    return parsed.select(
        _as_text(F.try_element_at("fields", F.lit("id"))).alias("id"),
        _as_text(F.try_element_at("fields", F.lit("text"))).alias("text"),
        F.coalesce(messages, empty).alias("conversations"),
        as_json.alias("tools"),
        _other_fields(F.col("fields")).alias("options"),
        reason.alias("reason"),
        "line",
    )


def _other_fields(fields: Column) -> Column:
    """The fields of an object that have no column of their own, as text."""
    other = F.map_filter(fields, lambda name, value: ~name.isin(*LINE_FIELDS) & ~F.is_variant_null(value))
    return F.coalesce(F.transform_values(other, lambda _, value: _as_text(value)), F.create_map().cast("map<string,string>"))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Usable records of JSON line files."""
    return good_lines(parse_lines(spark.read.text(path)))


def good_lines(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason", "line")


def quarantine(parsed: DataFrame) -> DataFrame:
    """Lines that could not be used, with the reason."""
    return parsed.filter(F.col("reason").isNotNull()).select("reason", "line")


# --- tool calls -----------------------------------------------------------------------


def clean_tool_calls(text: Column) -> Column:
    """Tool calls from JSON text: ``array<struct<id, type, function<name, arguments>>>``.

    Unparsable text gives null (the field is removed), entries that are not objects
    are dropped, arguments given as text are parsed and become ``{}`` when broken.
    """
    parsed = F.try_parse_json(text)
    calls = F.filter(F.try_variant_get(parsed, "$", "array<variant>"), lambda c: _kind(c) == "OBJECT")

    def field(value: Column, path: str, default: str) -> Column:
        return F.coalesce(F.try_variant_get(value, path, "string"), F.lit(default))

    def arguments(call: Column) -> Column:
        raw = F.try_variant_get(call, "$.function.arguments", "variant")
        text_args = F.try_variant_get(raw, "$", "string")
        inner = F.try_parse_json(text_args)
        return (
            F.when(raw.isNull(), "{}")
            .when(_kind(raw) == "STRING", F.coalesce(F.to_json(inner), F.lit("{}")))
            .otherwise(F.to_json(raw))
        )

    def clean(call: Column) -> Column:
        func = F.try_variant_get(call, "$.function", "variant")
        made = F.struct(
            field(call, "$.function.name", "").alias("name"), arguments(call).alias("arguments")
        )
        return F.struct(
            field(call, "$.id", "").alias("id"),
            field(call, "$.type", "function").alias("type"),
            F.when(func.isNull() | (_kind(func) == "OBJECT"), made).alias("function"),
        )

    return F.when(_kind(parsed) == "ARRAY", F.transform(calls, clean))


def sanitise_messages(conversation: Column, keep_reasoning: bool = False) -> Column:
    """Whitelisted message fields only, tool calls cleaned."""

    def keep(m: Column) -> Column:
        fields = [m["role"].alias("role"), m["content"].alias("content"), clean_tool_calls(m["tool_calls"]).alias("tool_calls")]
        if keep_reasoning:
            fields.append(m["reasoning_content"].alias("reasoning_content"))
        return F.struct(*fields)

    return F.transform(conversation, keep)


def parse_tools(tools: Column) -> Column:
    """Tools text as a variant list; null, broken or other JSON gives ``[]``."""
    parsed = F.try_parse_json(tools)
    return F.when(_kind(parsed) == "ARRAY", parsed).otherwise(F.parse_json(F.lit("[]")))


def render_options(df: DataFrame, columns: list[str]) -> DataFrame:
    """Named extra columns as a per-row ``render_options`` map; nulls are left out.

    A name that is no column is looked up in the ``options`` of a scan.
    """
    if missing := [c for c in columns if c not in df.columns]:
        df = df.withColumns({c: F.try_element_at("options", F.lit(c)) for c in missing})
        return render_options(df, columns).drop(*missing)
    pairs = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c), F.col(c).cast("string"))) for c in columns]
    made = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull()))
    return df.withColumn("render_options", made)
