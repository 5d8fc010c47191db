"""Chat templates and rendering of conversations to text."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    assistant_header: str | None = None
    user_header: str | None = None
    system_prompt: str | None = None
    end_of_turn_token: str | None = None
    parser_type: str = "general"
    assistant_pattern_type: str = "general"
    enable_thinking: bool = False
    ignore_token: tuple[str, ...] = ()


# System prompts, headers and end tokens of public chat models.
HELPFUL = "You are a helpful assistant."
RESPECTFUL = (
    "You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, "
    "while being safe.  Your answers should not include any harmful, unethical, racist, sexist, "
    "toxic, dangerous, or illegal content. Please ensure that your responses are socially unbiased "
    "and positive in nature.\n\nIf a question does not make any sense, or is not factually coherent, "
    "explain why instead of answering something not correct. If you don't know the answer to a "
    "question, please don't share false information."
)
_IM_ASSISTANT, _IM_USER, _IM_END = "<|im_start|>assistant\n", "<|im_start|>user\n", "<|im_end|>\n"
_THINK = {"parser_type": "thinking", "enable_thinking": True}

# name: (assistant header, user header, system prompt, end of turn, other fields)
_BUILT_IN: dict[str, tuple] = {
    "llama3": (
        "<|start_header_id|>assistant<|end_header_id|>\n\n",
        "<|start_header_id|>user<|end_header_id|>",
        RESPECTFUL,
        "<|eot_id|>",
        {},
    ),
    "llama4": (
        "<|header_start|>assistant<|header_end|>\n\n",
        "<|header_start|>user<|header_end|>",
        HELPFUL,
        "<|eot|>",
        {},
    ),
    "qwen": (_IM_ASSISTANT, _IM_USER, HELPFUL, _IM_END, {}),
    "qwen2-vl": (_IM_ASSISTANT, _IM_USER, HELPFUL, _IM_END, {}),
    "phi3": ("<|assistant|>\n", "<|user|>\n", HELPFUL, "<|end|>\n", {}),
    "phi4": (
        "<|im_start|>assistant<|im_sep|>",
        "<|im_start|>user<|im_sep|>",
        HELPFUL,
        "<|im_end|>",
        {},
    ),
    "phi4-mini": ("<|assistant|>", "<|user|>", HELPFUL, "<|end|>", {}),
    "gpt-oss-naive": (
        "<|start|>assistant<|channel|>analysis<|message|>",
        "<|start|>user<|message|>",
        None,
        "<|end|>",
        {},
    ),
    "gpt-oss": (None, None, None, None, {"parser_type": "openai-harmony"}),
    "deepseek-r1-distill": ("<｜Assistant｜>", "<｜User｜>", None, None, {}),
    "qwen3-thinking": (_IM_ASSISTANT, _IM_USER, HELPFUL, _IM_END, _THINK),
    "qwen3-instruct": (
        _IM_ASSISTANT,
        _IM_USER,
        HELPFUL,
        _IM_END,
        {"ignore_token": ("<think>\n\n</think>\n\n",)},
    ),
    "qwen3-next-thinking": (_IM_ASSISTANT + "<think>\n", _IM_USER, HELPFUL, _IM_END, _THINK),
    "kimi-k2-thinking": (
        "<|im_assistant|>assistant<|im_middle|>",
        _IM_USER,
        HELPFUL,
        "<|im_end|>",
        _THINK,
    ),
    "kimi-k2-instruct": (
        "<|im_assistant|>assistant<|im_middle|>",
        _IM_USER,
        HELPFUL,
        "<|im_end|>",
        {},
    ),
    "deepseek-v3": ("<｜Assistant｜>", "<｜User｜>", HELPFUL, "<｜end▁of▁sentence｜>", {}),
    "ling-flash-2.0": (
        "<role>ASSISTANT</role>",
        "<role>HUMAN</role>",
        HELPFUL,
        "<|role_end|>",
        {},
    ),
    "deepseek-v32": ("<｜Assistant｜>", "<｜User｜>", "", "<｜end▁of▁sentence｜>", _THINK),
    "gemma": ("<start_of_turn>model\n", "<start_of_turn>user\n", HELPFUL, "<end_of_turn>\n", {}),
    "longcat": (
        " ASSISTANT:",
        " USER:",
        HELPFUL,
        "</longcat_s>",
        {"assistant_pattern_type": "longcat"},
    ),
    "longcat_xml": ("<longcat_assistant>", "<longcat_user>", HELPFUL, "</longcat_s>", {}),
    "qwen3.5": (_IM_ASSISTANT + "<think>\n", _IM_USER, "", _IM_END, _THINK),
}

_REGISTRY: dict[str, ChatTemplate] = {
    name: ChatTemplate(a, u, s, e, **more) for name, (a, u, s, e, more) in _BUILT_IN.items()
}


def register_template(name: str, override: bool = False, **fields) -> ChatTemplate:
    """Add a template; an existing name needs ``override=True``."""
    if name in _REGISTRY and not override:
        raise ValueError(f"template {name!r} exists; pass override=True to replace it")
    _REGISTRY[name] = ChatTemplate(**fields)
    return _REGISTRY[name]


def get_template(name: str) -> ChatTemplate:
    try:
        return _REGISTRY[name]
    except KeyError:
        raise ValueError(f"unknown template {name!r}; known: {template_names()}") from None


def template_names() -> list[str]:
    return list(_REGISTRY)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of constants, built in the JVM."""
    names = [part.strip().split(" ") for part in schema.split(",")]
    structs = [
        F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, names)]) for row in rows
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*structs)))


TEMPLATE_SCHEMA = (
    "name string, assistant_header string, user_header string, system_prompt string, "
    "end_of_turn_token string, parser_type string, assistant_pattern_type string, "
    "enable_thinking boolean, ignore_token array<string>"
)


def templates_table(spark: SparkSession) -> DataFrame:
    """The registry as a table (one row per registered name)."""
    rows = [
        (name, *[list(v) if isinstance(v, tuple) else v for v in dataclasses.astuple(t)])
        for name, t in _REGISTRY.items()
    ]
    return literal_table(spark, rows, TEMPLATE_SCHEMA)


def with_template(df: DataFrame, name_column: str) -> DataFrame:
    """Join each row with the template it names, as a struct ``template``.

    The registry is code, not data: the broadcast side does not grow with the input.
    """
    table = templates_table(df.sparkSession)
    packed = table.select(F.col("name").alias(name_column), F.struct("*").alias("template"))
    return df.join(F.broadcast(packed), name_column, "left")


# --- rendering ------------------------------------------------------------------


def role_header(template: ChatTemplate, role: str) -> str:
    """Header of a role; roles without one of their own borrow the user's wording."""
    if role == "assistant":
        return template.assistant_header or ""
    user = template.user_header or ""
    if role == "user":
        return user
    for word in ("user", "User", "USER", "HUMAN"):
        if word in user:
            return user.replace(word, role if word.islower() else role.upper())
    return ""


def _by_role(role: Column, template: ChatTemplate) -> Column:
    known = ("user", "system", "tool", "assistant")
    out = F.when(role == known[0], F.lit(role_header(template, known[0])))
    for name in known[1:]:
        out = out.when(role == name, F.lit(role_header(template, name)))
    return out.otherwise(F.lit(""))


def tool_call_text(calls: Column) -> Column:
    """Cleaned tool calls as text: one ``<tool_call>`` block per call that names a function,
    holding an object of its name and its arguments."""

    def block(call: Column) -> Column:
        made = call["function"]
        name = F.to_json(F.struct(made["name"].alias("name")))
        body = F.concat(F.substring(name, F.lit(1), F.length(name) - 1), F.lit(',"arguments":'), made["arguments"], F.lit("}"))
        return F.concat(F.lit("<tool_call>\n"), body, F.lit("\n</tool_call>"))

    named = F.filter(calls, lambda c: F.coalesce(c["function"]["name"] != "", F.lit(False)))
    return F.coalesce(F.array_join(F.transform(named, block), "\n"), F.lit(""))


def render_message(
    role: Column,
    content: Column,
    template: ChatTemplate,
    reasoning: Column | None = None,
    tool_calls: Column | None = None,
) -> Column:
    """header + content + end token of one message.

    With ``reasoning`` (thinking models) an assistant reply is preceded by its
    reasoning inside a think block when there is any.  With ``tool_calls`` (cleaned, see
    ``sources.jsonl.clean_tool_calls``) an assistant reply is followed by its calls, on a
    line of their own when it has a text; the reply of a tool is a message of its role.
    """
    text = F.coalesce(content, F.lit(""))
    if tool_calls is not None:
        calls = tool_call_text(tool_calls)
        gap = F.when((text == "") | (calls == ""), F.lit("")).otherwise(F.lit("\n"))
        text = F.when(role == "assistant", F.concat(text, gap, calls)).otherwise(text)
    if reasoning is not None:
        opened = (template.assistant_header or "").endswith("<think>\n")
        block = F.concat(F.lit("" if opened else "<think>\n"), reasoning, F.lit("\n</think>\n\n"))
        text = F.when((role == "assistant") & (reasoning != ""), F.concat(block, text)).otherwise(text)
    return F.concat(_by_role(role, template), text, F.lit(template.end_of_turn_token or ""))


def render_conversation(
    system: Column, messages: Column, template: ChatTemplate, thinking: bool = False, tools: bool = False
) -> Column:
    """Whole conversation as one text: optional system message, then every message.

    With ``tools`` the messages carry cleaned ``tool_calls``, which are rendered.
    """
    head = F.when(system.isNull(), F.lit("")).otherwise(
        render_message(F.lit("system"), system, template)
    )
    parts = F.transform(
        messages,
        lambda m: render_message(
            m["role"],
            m["content"],
            template,
            m["reasoning_content"] if thinking else None,
            m["tool_calls"] if tools else None,
        ),
    )
    return F.concat(head, F.array_join(parts, ""))


def fallback_message(role: Column, content: Column, template: ChatTemplate) -> Column:
    """One message for tokenizers without a template of their own.

    The system text stands bare, user messages have no end token, other roles
    are left out (empty text).
    """
    user, assistant = template.user_header or "", template.assistant_header or ""
    end = template.end_of_turn_token or ""
    return (
        F.when(role == "system", content)
        .when(role == "user", F.concat(F.lit(user), content))
        .when(role == "assistant", F.concat(F.lit(assistant), content, F.lit(end)))
        .otherwise(F.lit(""))
    )


def fallback_conversation(system: Column, messages: Column, template: ChatTemplate, bos: str | None = None) -> Column:
    parts = F.transform(messages, lambda m: fallback_message(m["role"], m["content"], template))
    return F.concat(F.lit(bos or ""), F.coalesce(system, F.lit("")), F.array_join(parts, ""))


# --- channel-tagged ("harmony") conversations -----------------------------------

# The preamble and the tags of the format.
HARMONY_PREAMBLE = (
    "You are ChatGPT, a large language model trained by OpenAI.\nKnowledge cutoff: 2024-06\n"
    "Current date: 2025-06-28\n\nReasoning: {effort}\n\n# Valid channels: analysis, commentary, "
    "final. Channel must be included for every message."
)
HARMONY_CHANNELS = {
    "assistant_analysis": "analysis",
    "assistant_commentary": "commentary",
    "assistant_final": "final",
}
DEFAULT_EFFORT = "low"
HARMONY_ROLES = ("system", "assistant_reasoning_effort", "user", *HARMONY_CHANNELS)


HARMONY_RESETS = ("system", "assistant_reasoning_effort")  # replace what was before them


def harmony_message(role: Column, content: Column) -> Column:
    """One tagged message; an unknown role is an error."""

    def tagged(head: str, text: Column) -> Column:
        return F.concat(F.lit(f"<|start|>{head}<|message|>"), text, F.lit("<|end|>"))

    before, after = HARMONY_PREAMBLE.split("{effort}")
    effort = F.concat(F.lit(before), F.lower(content), F.lit(after))
    out = F.when(role == "system", tagged("system", content))
    out = out.when(role == "assistant_reasoning_effort", tagged("system", effort))
    out = out.when(role == "user", tagged("user", content))
    for name, channel in HARMONY_CHANNELS.items():
        out = out.when(role == name, tagged(f"assistant<|channel|>{channel}", content))
    return out.otherwise(F.raise_error(F.concat(F.lit("Unknown role: "), role)))


def harmony_conversation(conversation: Column) -> Column:
    """Tagged text of a conversation.

    It opens with the default effort preamble; a system or effort message replaces
    everything before it, so the text starts at the last of those.
    """
    replaces = F.transform(
        conversation, lambda m: m["role"].isin(*HARMONY_RESETS)
    )
    from_end = F.array_position(F.reverse(replaces), F.lit(True))
    start = F.when(from_end > 0, F.size(conversation) - from_end + 1).otherwise(F.lit(1))
    tail = F.slice(conversation, start.cast("int"), F.size(conversation))
    parts = F.transform(tail, lambda m: harmony_message(m["role"], m["content"]))
    preamble = harmony_message(F.lit("assistant_reasoning_effort"), F.lit(DEFAULT_EFFORT))
    strange = F.filter(
        F.slice(conversation, F.lit(1), start.cast("int") - 1), lambda m: ~m["role"].isin(*HARMONY_ROLES)
    )
    text = F.concat(F.when(from_end > 0, F.lit("")).otherwise(preamble), F.array_join(parts, ""))
    return F.when(F.size(strange) <= 0, text).otherwise(
        F.raise_error(F.concat(F.lit("Unknown role: "), F.get(strange, F.lit(0))["role"]))
    )


def harmony_segments(content: Column) -> Column:
    """Tagged reply as ``array<struct<channel, content>>``; untagged text is one
    segment on channel ``text``."""
    from chatprep.functions.text import strip

    pattern = r"(?s)<\|channel\|>(.*?)<\|message\|>(.*?)<\|end\|>"
    channels = F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
    bodies = F.regexp_extract_all(content, F.lit(pattern), F.lit(2))
    tagged = F.zip_with(
        channels, bodies, lambda c, b: F.struct(strip(c).alias("channel"), strip(b).alias("content"))
    )
    plain = F.array(F.struct(F.lit("text").alias("channel"), content.alias("content")))
    return F.when(F.size(channels) > 0, tagged).otherwise(plain)


def explode_segments(df: DataFrame, conversation: str = "conversations", key: str = "id") -> DataFrame:
    """One row per segment: ``(key, turn, segment, role, channel, content)``."""
    turns = df.select(key, F.posexplode(conversation).alias("turn", "m"))
    return turns.select(
        key, "turn", F.col("m.role").alias("role"), F.posexplode(harmony_segments(F.col("m.content"))).alias("segment", "s")
    ).select(key, "turn", "segment", "role", F.col("s.channel").alias("channel"), F.col("s.content").alias("content"))
