"""Which tokens should the draft vocabulary keep, and how much do they cover?

Long form from end to end: a message is rendered, tokenised and masked where it lies;
only its position in the conversation, and for some templates whether a reply is still
open, cross row borders.  A conversation is never put into one row, so its length does
not matter.

Rendered messages meet where a token ends, and no header or terminator reaches over a
border, so this gives the tokens and the mask of a search through the whole rendered
text: for replies that hold an end token or a header as text, for templates without an
end token and with round markers, and with ignore texts as well.  The one exception:
a message of an unknown role has no header, and leading white space of its text then
makes a token of its own instead of joining the line break before it.  In channel-tagged
conversations a system or effort message replaces all before it, so that places count
from the last one; the turn rule does not hold there, as in ``templates.harmony_conversation``.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.functions.arrays import ones, zeros
from chatprep.operators.spans import SpanRule, clear_literals, find_spans, span_mask, span_rule
from chatprep.operators.templates import DEFAULT_EFFORT, HARMONY_RESETS, ChatTemplate, harmony_message, render_message
from chatprep.operators.tokens import hashed_ids, table_ids, token_count, tokens
from chatprep.operators.turns import walk_segments, walk_turns
from chatprep.operators.vocabulary import coverage, frequency

_MORE = "\u0000"  # stands for the text that follows a message


def place_messages(
    turns: DataFrame,
    template: ChatTemplate,
    key: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Every message with ``rendered``, ``n_tokens``, ``kept`` (it stands before the
    first misplaced one), ``own_system`` (the record leads with a system message, seen
    from this message on), ``start``, the number of tokens before it, and ``mask``, its
    0/1 loss mask."""
    rule, tagged = span_rule(template), template.parser_type == "openai-harmony"
    rendered = (harmony_message if tagged else partial(render_message, template=template))(F.col(role), F.col(text))
    counted = turns.withColumn("n_tokens", token_count(rendered))
    if tagged:
        resets = F.col(role).isin(*HARMONY_RESETS)
        state = F.when(resets, _state_after(rendered, rule, False)).otherwise(_fixed_state(rendered, rule))
        placed = walk_segments(counted, resets, F.col("n_tokens"), state, key, order, role, text).withColumnRenamed("open", "__open")
    else:
        lasts = {"__open": _fixed_state(rendered, rule)} if rule.carries else {}
        placed = walk_turns(counted, key, order, role, text, sums={"start": F.col("n_tokens")}, lasts=lasts)
    placed = placed.withColumn("rendered", rendered)
    size = F.col("n_tokens")
    if rule.carries:
        # The text ends with the last kept message, and an open reply before its final line break.
        mask = _carried_mask(F.col("rendered"), size, rule, F.coalesce("__open", F.lit(False)), F.col("last"))
    else:
        mask = _closed_mask(F.col("rendered"), size, rule)
    placed = placed.withColumn("mask", mask)
    for literal in template.ignore_token:
        cleared = clear_literals(F.col("mask"), F.col("rendered"), (literal,))
        placed = placed.withColumn("mask", F.when(F.contains("rendered", F.lit(literal)), cleared).otherwise(F.col("mask")))
    opening = system_text(template)
    if opening is not None:
        placed = placed.withColumn("start", F.col("start") + F.when(F.col("own_system"), 0).otherwise(token_count(opening)))
    return placed.drop("__open", "last", "misplaced", "position")


def _closed_mask(rendered: Column, size: Column, rule: SpanRule) -> Column:
    """Mask of a message that closes its own reply.

    A message with one header, at its start, and one end token, at its end, needs no
    search: the header is a constant and so is its number of tokens.
    """
    head, stop = rule.header, rule.terminator or ""
    n_head = token_count(F.lit(head))
    opens = F.startswith(rendered, F.lit(head)) & F.lit(bool(head))
    closes = F.locate(stop, rendered, len(head) + 1) == F.length(rendered) - len(stop) + 1
    searched = span_mask(rendered, find_spans(rendered, rule), size, rule.how)
    return (
        F.when(~F.contains(rendered, F.lit(head)), zeros(size))
        .when(opens & closes, F.concat(zeros(n_head), ones(size - n_head)))
        .otherwise(searched)
    )


def _open_text(rendered: Column, rule: SpanRule, is_open: bool) -> Column:
    return F.concat(F.lit(rule.header if is_open else ""), rendered, F.lit(_MORE))


def _fixed_state(rendered: Column, rule: SpanRule) -> Column:
    """Whether a reply is open after a message: true or false where that does not depend
    on what was before it, else null."""

    opened, closed = (_state_after(rendered, rule, is_open) for is_open in (True, False))
    return F.when(opened == closed, opened)


def _state_after(rendered: Column, rule: SpanRule, is_open: bool) -> Column:
    whole = _open_text(rendered, rule, is_open)
    ends = F.transform(find_spans(whole, rule), lambda s: s["end"])
    return F.coalesce(F.array_max(ends) == F.length(whole), F.lit(False))


def _carried_mask(rendered: Column, size: Column, rule: SpanRule, is_open: Column, last: Column) -> Column:
    """Mask of a message whose reply may have begun before it or go on after it."""
    head = F.when(is_open, F.lit(rule.header)).otherwise(F.lit(""))
    whole = F.concat(head, rendered, F.when(last, F.lit("")).otherwise(F.lit(_MORE)))
    shift = F.length(head)
    spans = F.transform(
        find_spans(whole, rule),
        lambda s: F.struct(
            (s["start"] - shift).cast("int").alias("start"),
            F.least(s["end"] - shift, F.length(rendered)).cast("int").alias("end"),
        ),
    )
    return span_mask(rendered, spans, size, rule.how)


def system_text(template: ChatTemplate) -> Column | None:
    """What the text opens with where the data have no system message (null: nothing)."""
    if template.parser_type == "openai-harmony":
        return harmony_message(F.lit("assistant_reasoning_effort"), F.lit(DEFAULT_EFFORT))
    return render_message(F.lit("system"), F.lit(template.system_prompt), template) if template.system_prompt else None


def placed_messages(turns: DataFrame, template: ChatTemplate, **columns: str) -> DataFrame:
    """The kept messages with their place."""
    return place_messages(turns, template, **columns).filter("kept").drop("kept", "own_system")


def training_samples(
    turns: DataFrame,
    template: ChatTemplate,
    max_length: int = 2048,
    key: str = "conv_id",
    last_only: bool = False,
    vocabulary: DataFrame | None = None,
    unknown: int = 0,
    **columns: str,
) -> DataFrame:
    """``(key, input_ids, loss_mask)`` per conversation, at most ``max_length`` long.

    Ids come from a stored ``(token, token_id)`` table, where one is given, and are hashes of
    16 bits without one, which different tokens may share.

    A message is at least one token, so no more than ``max_length`` parts of a key are
    collected; the others are left out before the shuffle, which carries one partial
    row per key and task.  With ``last_only`` only the last reply is supervised, for
    templates whose replies end with their message.
    """
    if last_only and span_rule(template).carries:
        raise ValueError("the last reply of this template may span messages; use masked_sample")
    placed = place_messages(turns, template, key=key, **columns)
    room = F.greatest(F.lit(max_length) - F.col("start"), F.lit(0)).cast("int")
    ids_of = hashed_ids if vocabulary is None else lambda words: words
    part = F.struct(
        F.col("start"),
        F.slice(ids_of(tokens(F.col("rendered"))), F.lit(1), room).alias("ids"),
        F.slice("mask", F.lit(1), room).alias("mask"),
    )
    parts = F.sort_array(F.collect_list(F.when(F.col("kept") & (room > 0), part)))
    reply = F.col("kept") & F.contains("rendered", F.lit(span_rule(template).header))
    grouped = placed.groupBy(key).agg(
        parts.alias("parts"), F.max("own_system").alias("own"), F.max(F.when(reply, F.col("start"))).alias("reply")
    )
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    masks = F.flatten(
        F.transform("parts", lambda p: F.when(p["start"] == F.col("reply"), p["mask"]).otherwise(zeros(F.size(p["mask"]))) if last_only else p["mask"])
    )
    opening = system_text(template)
    if opening is not None:
        head = F.slice(ids_of(tokens(opening)), 1, max_length)
        ids = F.when(F.col("own"), ids).otherwise(F.concat(head, ids))
        masks = F.when(F.col("own"), masks).otherwise(F.concat(zeros(F.size(head)), masks))
    samples = grouped.select(key, ids.alias("input_ids"), masks.alias("loss_mask"))
    if vocabulary is None:
        return samples
    return table_ids(samples, key, "input_ids", vocabulary, unknown=unknown).select(key, "input_ids", "loss_mask")


def supervised_words(
    turns: DataFrame, template: ChatTemplate, max_length: int | None = 2048, key: str = "conv_id", **columns: str
) -> DataFrame:
    """One row per supervised token (its text), cut at ``max_length`` tokens of the
    conversation."""
    placed = placed_messages(turns, template, key=key, **columns).filter(F.exists("mask", lambda m: m == 1))
    words = F.arrays_zip(tokens(F.col("rendered")).alias("token"), F.col("mask").alias("m"))
    if max_length is not None:
        words = F.slice(words, F.lit(1), F.greatest(F.lit(max_length) - F.col("start"), F.lit(0)).cast("int"))
    return placed.select(F.inline(words)).filter("m = 1").select("token")


def draft_coverage(
    turns: DataFrame, template: ChatTemplate, draft_size: int, max_length: int | None = 2048
) -> DataFrame:
    """Size, covered and total supervised tokens, and their ratio."""
    return coverage(frequency(supervised_words(turns, template, max_length)), draft_size)
