"""Chat formatting after collapse of cumulative snapshots, in DataFrame functions only.

Logs often hold a conversation once per turn, each time from its start.  Every turn gets the
rolling hash of the prefix that it ends: all hashes of (place, role, text) up to it, combined by
exclusive or, twice 64 bits.  A conversation whose whole hash is the hash of a shorter prefix of
another one goes; of equal ones the smallest conv_id stays.  What stays is rendered with a role
template.

Conversations are worked on in groups of ``BLOCK`` turn numbers; a group of more than ``CROWD``
turns (a log that writes one number, or none, for all) is split by number, role and the first
digits of the text's hash, which keeps its order.  So no task holds a long conversation whole.
Rendering gives one row per ``BLOCK`` turns, counted by their place, which is one row for all but
very long conversations.

Nulls: a null role or text is empty, a null turn comes first.  A row without a conv_id is a
conversation of its own that is not collapsed; equal ones are one row with their number.  Repeated
rows (same conversation, turn, role and text) count once; ties in turn go by role and the md5 of the
text.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatprep.llm.common import store

BLOCK = 1024
CROWD = 8 * BLOCK
DIGITS = 3  # hex digits of the text's hash by which a crowded group is split
START, AFTER_ROLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def _rows(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    return conversations.select(
        conversations[conv_id].cast("long").alias("conv_id"),
        F.coalesce(conversations[turn].cast("long"), F.lit(-(1 << 62))).alias("turn"),
        F.coalesce(conversations[role].cast("string"), F.lit("")).alias("role"),
        F.coalesce(conversations[text].cast("string"), F.lit("")).alias("text"),
    )


def _grouped(narrow: DataFrame) -> DataFrame:
    """Turns with ``group``: bounded groups of a conversation, in the order of its turns."""
    numbers = F.floor(F.col("turn") / BLOCK)
    blocked = narrow.withColumn("_block", numbers)
    crowded = blocked.groupBy("conv_id", "_block").count().where(F.col("count") > CROWD)
    crowded = crowded.select("conv_id", "_block", F.lit(True).alias("_crowded"))
    split = F.coalesce("_crowded", F.lit(False))
    group = F.struct(
        F.col("_block").alias("block"),
        F.when(split, F.col("turn")).alias("turn"),
        F.when(split, F.col("role")).alias("role"),
        F.when(split, F.substring("hash", 1, DIGITS)).alias("hash"),
    )
    return blocked.join(crowded, ["conv_id", "_block"], "left").withColumn("group", group).drop("_block", "_crowded")


def _earlier(column: str, groups: Window) -> Column:
    """Exclusive or over all earlier rows of the window."""
    return F.coalesce(F.bit_xor(column).over(groups.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def placed_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, hash, n, size`` and the hashes of each distinct turn at its place n; stored."""
    narrow = turns.select("conv_id", "turn", "role", F.md5("text").alias("hash")).distinct()
    grouped = store(_grouped(narrow), "turns")
    in_group = Window.partitionBy("conv_id", "group").orderBy("turn", "role", "hash")
    sizes = grouped.groupBy("conv_id", "group").agg(F.count("*").alias("_size"))
    in_conv = Window.partitionBy("conv_id")
    sizes = sizes.select(
        "conv_id",
        "group",
        (F.sum("_size").over(in_conv.orderBy("group")) - F.col("_size")).alias("_before"),
        F.sum("_size").over(in_conv).alias("size"),
    )
    placed = grouped.withColumn("_i", F.row_number().over(in_group)).join(sizes, ["conv_id", "group"])
    placed = placed.withColumn("n", F.col("_before") + F.col("_i")).drop("_before", "_i")
    return store(placed.withColumns({"_a": F.xxhash64("n", "role", "hash"), "_b": F.xxhash64("hash", "n", "role")}), "turn-hashes")


def prefixes(placed: DataFrame) -> DataFrame:
    """``conv_id, n, whole, h1, h2``: the prefix of the first n turns; ``whole`` marks the last."""
    totals = placed.groupBy("conv_id", "group").agg(F.bit_xor("_a").alias("_ta"), F.bit_xor("_b").alias("_tb"))
    groups = Window.partitionBy("conv_id").orderBy("group")
    totals = totals.select("conv_id", "group", _earlier("_ta", groups).alias("_pa"), _earlier("_tb", groups).alias("_pb"))
    rolling = Window.partitionBy("conv_id", "group").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumns({"_ra": F.bit_xor("_a").over(rolling), "_rb": F.bit_xor("_b").over(rolling)})
        .join(totals, ["conv_id", "group"])
        .select(
            "conv_id",
            "n",
            (F.col("n") == F.col("size")).alias("whole"),
            F.col("_ra").bitwiseXOR(F.col("_pa")).alias("h1"),
            F.col("_rb").bitwiseXOR(F.col("_pb")).alias("h2"),
        )
    )


def maximal(found: DataFrame) -> DataFrame:
    """``conv_id, n_copies`` of the conversations that no longer one starts with."""
    key = ["n", "h1", "h2"]
    whole = found.where("whole").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    parts = found.where("NOT whole").select(*key).distinct()
    return whole.join(parts, key, "left_anti").select("conv_id", "n_copies")


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(AFTER_ROLE), text, F.lit(END))


def render(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, part, n_turns, n_copies, text``: the rendered maximal conversations."""
    rows = _rows(conversations, conv_id, turn, role, text)
    turns = rows.where("conv_id IS NOT NULL")
    placed = placed_turns(turns)
    kept = store(maximal(store(prefixes(placed), "prefixes")), "maximal")
    places = placed.join(kept, "conv_id").select("conv_id", "turn", "role", "hash", "n", "n_copies")
    one = turns.withColumn("hash", F.md5("text")).join(places, ["conv_id", "turn", "role", "hash"])
    part = F.floor((F.col("n") - 1) / BLOCK).cast("long").alias("part")
    whole = (
        one.groupBy("conv_id", part)
        .agg(F.array_sort(F.collect_set(F.struct("n", "role", "text"))).alias("turns"), F.first("n_copies").alias("n_copies"))
        .select(
            "conv_id",
            "part",
            F.size("turns").cast("long").alias("n_turns"),
            "n_copies",
            F.array_join(F.transform("turns", lambda t: _rendered(t["role"], t["text"])), "").alias("text"),
        )
    )
    lone = rows.where("conv_id IS NULL").groupBy("conv_id", "role", "text").agg(F.count("*").alias("n_copies"))
    number = F.lit(0).cast("long")
    return whole.unionByName(
        lone.select("conv_id", number.alias("part"), (number + 1).alias("n_turns"), "n_copies", _rendered(F.col("role"), F.col("text")).alias("text"))
    )


SQL = f"""
WITH r AS (SELECT conv_id, coalesce(turn, -4611686018427387904) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
t AS (SELECT DISTINCT * FROM r WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list(md5(role || chr(10) || text) ORDER BY turn, role, md5(text)) AS l FROM t GROUP BY conv_id),
prefix AS (SELECT conv_id, k = len(l) AS whole, array_to_string(l[1:k], ',') AS p FROM lists, unnest(range(1, len(l) + 1)) AS r(k)),
kept AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies FROM prefix WHERE whole
         AND p NOT IN (SELECT p FROM prefix WHERE NOT whole) GROUP BY p),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) AS n FROM t)
SELECT conv_id, ((n - 1) // {BLOCK})::BIGINT AS part, count(*)::BIGINT AS n_turns, max(n_copies)::BIGINT AS n_copies,
       string_agg('{START}' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY n) AS text
FROM n JOIN kept USING (conv_id) GROUP BY conv_id, (n - 1) // {BLOCK}
UNION ALL
SELECT NULL, 0, 1, count(*)::BIGINT, '{START}' || role || chr(10) || text || '<|im_end|>' || chr(10) FROM r WHERE conv_id IS NULL GROUP BY role, text
"""
