"""Turn-level rules, in long form (one row per message) and in array form (one
row per conversation).

Long form is for tables of messages: nothing ever holds a whole conversation.
Array form is row-local: no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatprep.functions.arrays import let
from chatprep.operators.common import pin
from chatprep.operators.ordered import BLK, BLOCK, HEAD, TIE, block_rows, earlier_blocks, in_blocks, once, with_heads

# Who may precede whom.
BEFORE_TOOL = ["assistant", "tool"]
BEFORE_ASSISTANT = ["user", "tool"]


def breaks_order(role: Column, previous: Column, first: Column) -> Column:
    """True when a message may not stand where it stands.

    The first message must come from the user, a tool message must follow an
    assistant or tool message, an assistant message a user or tool message.
    """
    return (
        F.when(first, role != "user")
        .when(role == "tool", ~previous.isin(BEFORE_TOOL))
        .when(role == "assistant", ~previous.isin(BEFORE_ASSISTANT))
        .otherwise(F.lit(False))
    )


# --- array form -----------------------------------------------------------------


def non_empty(df: DataFrame, column: str = "conversations") -> DataFrame:
    """Drop records whose conversation is null or empty."""
    return df.filter(F.size(column) > 0)


def leads_with_system(conversation: Column) -> Column:
    return F.coalesce(F.get(conversation, F.lit(0))["role"] == "system", F.lit(False))


def body(conversation: Column) -> Column:
    """The conversation without one leading system message."""
    return F.when(
        leads_with_system(conversation),
        F.slice(conversation, F.lit(2), F.greatest(F.size(conversation) - 1, F.lit(0))),
    ).otherwise(conversation)


def first_violation(messages: Column) -> Column:
    """Zero-based index of the first misplaced message, or the length."""

    def scan(roles: Column) -> Column:
        bad = F.transform(
            roles,
            lambda role, i: F.coalesce(breaks_order(role, F.get(roles, i - 1), i == 0), F.lit(True)),
        )
        hit = F.array_position(bad, F.lit(True))
        return F.when(hit > 0, hit - 1).otherwise(F.size(roles)).cast("int")

    return let(F.transform(messages, lambda m: m["role"]), scan)


def valid_prefix(messages: Column) -> Column:
    """The messages before the first violation."""
    return let(messages, lambda ms: F.slice(ms, F.lit(1), first_violation(ms)))


def system_prompt(conversation: Column, template_prompt: str | None) -> Column:
    """The record's own system message, else the template's, else null."""
    return F.when(
        leads_with_system(conversation), F.get(conversation, F.lit(0))["content"]
    ).otherwise(F.lit(template_prompt or None).cast("string"))


def prepare(df: DataFrame, template_prompt: str | None, column: str = "conversations") -> DataFrame:
    """Non-empty records with ``system`` and ``messages`` resolved."""
    conv = F.col(column)
    return pin(
        non_empty(df, column),
        system=system_prompt(conv, template_prompt),
        messages=valid_prefix(body(conv)),
    )


# --- long form ------------------------------------------------------------------
#
# Messages stand in the order of their turn numbers.  Those without a number come first, and
# messages with the same number in the order of the md5 of role and text; rows that are equal in
# number, role and text are repeats and count once (which of them stays, where other columns
# differ, is left open).  ``misnumbered`` reports both.


def is_misplaced(role: Column, previous: Column, position: Column) -> Column:
    """True when a message may not stand at this position (from 0) of its conversation.

    A leading system message is allowed; the message after it counts as the first.
    """
    leads = (position == 0) & (role == "system")
    first = (position == 0) | ((position == 1) & (previous == "system"))
    return F.coalesce(F.when(leads, F.lit(False)).otherwise(breaks_order(role, previous, first)), F.lit(True))


def walk_turns(
    turns: DataFrame,
    key: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """One pass over messages that keeps to the turn rule.

    Adds ``position`` in the conversation, ``misplaced``, ``kept`` (no message up to this one is
    misplaced), ``own_system`` (the conversation leads with a system message, seen from this
    message on), ``last`` (the last kept message), ``sums`` of expressions over all earlier messages
    and ``lasts``, the last value of an expression before this message that is not null.

    Whether a message is misplaced depends on the message before it and, for the first two, on
    the position.  So a block of messages is a function of what came before it that only its
    first two messages decide: their roles, the last role and the rest's misplaced messages are
    all that is kept of it, and these rows are composed from block to block.
    """
    sums, lasts, ties = dict(sums or {}), dict(lasts or {}), [role, text]
    total, last = ({new: f"__{kind}_{new}" for new in of} for kind, of in (("sum", sums), ("last", lasts)))
    values = {total[new]: F.coalesce(e, F.lit(0)).cast("bigint") for new, e in sums.items()}
    values |= {last[new]: e for new, e in lasts.items()}
    placed = in_blocks(turns, order, ties, block).withColumns(values)

    n = F.col("__n")
    narrow = once(placed.select(key, order, role, BLK, TIE, *values), [key], order, ties)
    rows = block_rows([key], order)
    narrow = narrow.withColumns({"__n": F.row_number().over(rows), "__prev": F.lag(role).over(rows)})
    rest = is_misplaced(F.col(role), F.col("__prev"), F.lit(2)) & (n > 2)
    blocks, earlier = earlier_blocks([key])
    heads = (
        narrow.groupBy(key, BLK)
        .agg(
            F.max("__n").alias("__n"),
            F.max(F.when(n == 1, F.col(role))).alias("__first"),
            F.max(F.when(n == 2, F.col(role))).alias("__second"),
            F.max_by(role, "__n").alias("__end"),
            F.sum(rest.cast("bigint")).alias("__bad"),
            *[F.sum(c).alias(c) for c in total.values()],
            *[F.max_by(c, F.when(F.col(c).isNotNull(), n)).alias(c) for c in last.values()],
        )
        .withColumns(
            {
                "__one": F.coalesce(F.sum("__n").over(earlier), F.lit(0)),
                role: F.lag("__end").over(blocks),
                "__led": F.coalesce(F.first("__first").over(blocks) == "system", F.lit(False)),
            }
            | {c: F.sum(c).over(earlier) for c in total.values()}
            | {c: F.last(c, ignorenulls=True).over(earlier) for c in last.values()}
        )
    )
    opens = is_misplaced(F.col("__first"), F.col(role), F.col("__one"))
    second = (n > 1) & is_misplaced(F.col("__second"), F.col("__first"), F.col("__one") + 1)
    heads = heads.withColumn("__opens", opens).withColumn("__bad", F.col("__bad") + F.col("__opens").cast("bigint") + second.cast("bigint"))
    heads = heads.withColumns({"__bad": F.coalesce(F.sum("__bad").over(earlier), F.lit(0)), "__next": F.lead("__opens").over(blocks)})
    # A key of one block needs no head.
    heads = heads.filter((F.col("__one") > 0) | F.col("__next").isNotNull()).select(key, BLK, role, "__one", "__led", "__bad", "__next", *values)

    rows = block_rows([key], order, heads=True)
    above, upto = (rows.rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0))
    out = once(with_heads(placed, heads), [key], order, ties, heads=True)
    one = F.coalesce(F.col("__one"), F.lit(1))
    out = out.withColumns(
        {"position": F.coalesce(F.sum(one).over(above), F.lit(0)), "__prev": F.lag(role).over(rows)}
        | {new: F.coalesce(F.sum(c).over(above), F.lit(0)).cast("bigint") for new, c in total.items()}
        | {new: F.last(c, ignorenulls=True).over(above) for new, c in last.items()}
    )
    out = out.withColumn("misplaced", is_misplaced(F.col(role), F.col("__prev"), F.col("position")))
    leads = F.coalesce("__led", (F.col("position") == 0) & (F.col(role) == "system"), F.lit(False))
    bad = F.coalesce("__bad", F.col("misplaced").cast("bigint"))
    out = out.withColumns(
        {
            "kept": F.sum(bad).over(upto) == 0,
            "own_system": F.max(leads).over(upto),
            "__ends": F.coalesce(F.lead("misplaced").over(rows), F.first("__next").over(upto), F.lit(True)),
        }
    )
    out = out.withColumn("last", F.col("kept") & F.col("__ends")).filter(~F.col(HEAD))
    return out.drop(BLK, TIE, HEAD, "__one", "__prev", "__led", "__bad", "__next", "__ends", *values)


def walk_segments(
    turns: DataFrame,
    resets: Column,
    size: Column,
    state: Column,
    key: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """One pass over messages of which some (``resets``) replace all that was before them.

    Adds ``start``, the sum of ``size`` over the messages since the last reset, that one included,
    ``kept`` (no later message is a reset), ``own_system`` (a reset was met), ``open``, the last
    ``state`` since then that is not null (null: none), and ``last`` message of the conversation.
    A block is kept as its sums, the sum before its last reset, and the states and resets it has.
    """
    ties = [role, text]
    values = {"__size": F.coalesce(size, F.lit(0)).cast("bigint"), "__reset": F.coalesce(resets, F.lit(False)).cast("bigint"), "__state": state}
    placed = in_blocks(turns, order, ties, block).withColumns(values)
    n, is_reset = F.col("__n"), F.col("__reset") > 0

    narrow = once(placed.select(key, order, BLK, TIE, *values), [key], order, ties)
    rows = block_rows([key], order)
    before = F.coalesce(F.sum("__size").over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    narrow = narrow.withColumns({"__n": F.row_number().over(rows), "__before": before})
    blocks, earlier = earlier_blocks([key])
    whole = blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A reset also forgets the state: what a block hands on is the last state since its last reset.
    since = F.max(F.when(is_reset, n))
    heads = narrow.withColumn("__since", since.over(Window.partitionBy(key, BLK)))
    told = F.col("__state").isNotNull() & (n >= F.coalesce("__since", F.lit(0)))
    heads = heads.groupBy(key, BLK).agg(
        F.sum("__size").alias("__total"),
        F.sum("__reset").alias("__resets"),
        F.max_by("__before", F.when(is_reset, n)).alias("__cut"),
        F.max_by("__state", F.when(told, n)).alias("__told"),
    )
    heads = heads.withColumn("__size", F.coalesce(F.sum("__total").over(earlier), F.lit(0)))
    mark = F.when(F.col("__resets") > 0, F.col("__size") + F.col("__cut"))
    handed = F.when(F.col("__told").isNotNull() | (F.col("__resets") > 0), F.struct(F.col("__told").alias("state")))
    heads = heads.withColumns(
        {
            "__mark": F.last(mark, ignorenulls=True).over(earlier),
            "__state": F.last(handed, ignorenulls=True).over(earlier)["state"],
            "__reset": F.coalesce(F.sum("__resets").over(earlier), F.lit(0)),
            "__all": F.sum("__resets").over(whole),
            "__next": F.lead(F.lit(True)).over(blocks),
            "__seen": F.lag(F.lit(True)).over(blocks),
        }
    )
    heads = heads.filter(F.col("__seen") | F.col("__next")).select(key, BLK, *values, "__mark", "__all", "__next")

    rows = block_rows([key], order, heads=True)
    above, upto = (rows.rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0))
    out = once(with_heads(placed, heads), [key], order, ties, heads=True)
    own = F.when(~F.col(HEAD), F.col("__reset"))
    out = out.withColumns(
        {
            "__before": F.coalesce(F.sum("__size").over(above), F.lit(0)),
            "__resets": F.sum("__reset").over(upto),
            "__all": F.coalesce(F.first("__all").over(upto), F.sum(own).over(rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))),
            "last": F.lead(HEAD).over(rows).isNull() & F.first("__next").over(upto).isNull(),
        }
    )
    mark = F.when(F.col(HEAD), F.col("__mark")).when(is_reset, F.col("__before"))
    # The state of a row, with that of a reset told even where it is null.
    handed = F.when(F.col("__state").isNotNull() | (is_reset & ~F.col(HEAD)), F.struct(F.col("__state").alias("state")))
    out = out.withColumns(
        {
            "start": F.col("__before") - F.coalesce(F.last(mark, ignorenulls=True).over(upto), F.lit(0)),
            "open": F.when(is_reset & ~F.col(HEAD), None).otherwise(F.last(handed, ignorenulls=True).over(above)["state"]),
            "kept": F.col("__resets") == F.col("__all"),
            "own_system": F.col("__resets") > 0,
        }
    )
    return out.filter(~F.col(HEAD)).drop(BLK, TIE, HEAD, "__before", "__resets", "__all", "__next", "__mark", *values)


def valid_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Messages before the first misplaced one of their conversation."""
    return walk_turns(turns, key, order, role, text, block=block).filter("kept").select(*turns.columns)


def misnumbered(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """What the rules above settle: ``key, order``, ``n`` rows and ``different`` messages of turn
    numbers that are missing or stand more than once in a conversation."""
    per_message = turns.groupBy(key, order, role, text).agg(F.count("*").alias("n"))
    per_turn = per_message.groupBy(key, order).agg(F.sum("n").alias("n"), F.count("*").alias("different"))
    return per_turn.filter(F.col(order).isNull() | (F.col("n") > 1))


def distinct_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every message once, combined before it moves: for tables in which one row fills much of a conversation."""
    return turns.select(key, order, role, text).distinct()


def system_prompts(
    turns: DataFrame,
    template_prompt: str | None,
    key: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: the prompt it is trained with (null: none)."""
    placed = in_blocks(turns, order, [role, text])
    place = F.struct(F.col(order).isNotNull().alias("numbered"), F.col(order).alias("order"), F.col(TIE).alias("tie"))
    head = F.min_by(F.struct(F.col(role).alias("role"), F.col(text).alias("text")), place)
    return placed.groupBy(key).agg(head.alias("head")).select(
        key,
        F.when(F.col("head.role") == "system", F.col("head.text"))
        .otherwise(F.lit(template_prompt or None).cast("string"))
        .alias("system"),
        (F.col("head.role") == "system").alias("from_data"),
    )
