"""How the test tables stand in for chat data, in Spark and in SQL.

``turns``      ``conversations`` with some roles changed, so that rules are broken
``pairs``      user messages with the assistant message that follows
``doc_chats``  ``documents`` read as conversations: every line is a message
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.operators.common import pin
from chatprep.operators.templates import ChatTemplate, role_header
from chatprep.operators.tokens import TOKEN_PATTERN


def lit(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


# --- turns -------------------------------------------------------------------------------

TURNS = """turns AS (
  SELECT conv_id, turn, text,
    CASE WHEN (conv_id * 7 + turn) % 11 = 0 THEN 'tool'
         WHEN (conv_id * 5 + turn) % 13 = 0 THEN 'assistant'
         ELSE role END AS role
  FROM conversations)"""


def turns(t) -> DataFrame:
    c, n = F.col("conv_id"), F.col("turn")
    role = (
        F.when((c * 7 + n) % 11 == 0, "tool")
        .when((c * 5 + n) % 13 == 0, "assistant")
        .otherwise(F.col("role"))
    )
    return t.conversations.select("conv_id", "turn", "text", role.alias("role"))


VALID = f"""{TURNS},
ordered AS (
  SELECT *, row_number() OVER w - 1 AS pos, lag(role) OVER w AS prev
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
flagged AS (
  SELECT *, CASE
      WHEN pos = 0 AND role = 'system' THEN false
      WHEN pos = 0 OR (pos = 1 AND prev = 'system') THEN role <> 'user'
      WHEN role = 'tool' THEN prev NOT IN ('assistant', 'tool')
      WHEN role = 'assistant' THEN prev NOT IN ('user', 'tool')
      ELSE false END AS bad
  FROM ordered),
valid AS (
  SELECT f.conv_id, f.turn, f.role, f.text FROM flagged f
  LEFT JOIN (SELECT conv_id, min(turn) AS first_bad FROM flagged WHERE bad GROUP BY conv_id) b USING (conv_id)
  WHERE b.first_bad IS NULL OR f.turn < b.first_bad)"""


RUMPLED = """rumpled AS (
  SELECT conv_id, role, text, CASE WHEN (conv_id + turn) % 17 = 0 THEN NULL WHEN (conv_id * 3 + turn) % 19 = 0 THEN turn - 1 ELSE turn END AS turn
  FROM (SELECT conv_id, turn, text, CASE WHEN (conv_id * 7 + turn) % 31 = 0 THEN 'tool' ELSE role END AS role FROM conversations)),
turns AS (
  SELECT conv_id, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, chr(2)) || chr(1) || coalesce(text, chr(2)))) - 1 AS turn
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM rumpled))"""


def rumpled_turns(t) -> DataFrame:
    """A log as logs are: lost turn numbers, numbers that stand twice, rows that stand twice."""
    c, n = F.col("conv_id"), F.col("turn")
    role = F.when((c * 7 + n) % 31 == 0, "tool").otherwise(F.col("role"))
    turn = F.when((c + n) % 17 == 0, None).when((c * 3 + n) % 19 == 0, n - 1).otherwise(n)
    rows = t.conversations.select("conv_id", "text", role.alias("role"), turn.alias("turn"))
    return rows.unionByName(rows.filter(c % 4 == 1))


# --- pairs -------------------------------------------------------------------------------

PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def pairs(t) -> DataFrame:
    c = t.conversations
    asked = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = c.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(said, ["conv_id", "turn"])


# --- documents as conversations --------------------------------------------------------------

DOC_CHATS = """doc_chats AS (
  SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: {
    'role': CASE WHEN i = 1 AND doc_id % 5 = 0 THEN 'system'
                 WHEN (doc_id * 7 + i) % 29 = 0 THEN 'tool'
                 WHEN (i + (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END)) % 2 = 1 THEN 'user'
                 ELSE 'assistant' END,
    'content': x}) AS conv
  FROM documents)"""

MESSAGES = f"""{DOC_CHATS},
messages AS (
  SELECT doc_id, unnest(range(len(conv))) AS pos, unnest(conv).role AS role, unnest(conv).content AS content
  FROM doc_chats),
shifted AS (
  SELECT m.*, lag(role) OVER w AS prev, first_value(role) OVER w AS first_role
  FROM messages m WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
judged AS (
  SELECT *, CASE
      WHEN pos = 0 AND role = 'system' THEN false
      WHEN pos = 0 OR (pos = 1 AND first_role = 'system') THEN role <> 'user'
      WHEN role = 'tool' THEN prev NOT IN ('assistant', 'tool')
      WHEN role = 'assistant' THEN prev NOT IN ('user', 'tool')
      ELSE false END AS bad
  FROM shifted),
kept AS (
  SELECT j.doc_id, j.pos, j.role, j.content FROM judged j
  LEFT JOIN (SELECT doc_id, min(pos) AS first_bad FROM judged WHERE bad GROUP BY doc_id) b USING (doc_id)
  WHERE b.first_bad IS NULL OR j.pos < b.first_bad)"""


def doc_conversation() -> Column:
    """The lines of ``text`` as messages (roles mostly alternate)."""
    d = F.col("doc_id")
    led = F.when(d % 5 == 0, 1).otherwise(0)

    def message(x: Column, i: Column) -> Column:
        role = (
            F.when((i == 0) & (d % 5 == 0), "system")
            .when((d * 7 + i + 1) % 29 == 0, "tool")
            .when((i + 1 + led) % 2 == 1, "user")
            .otherwise("assistant")
        )
        return F.struct(role.alias("role"), x.alias("content"))

    return F.transform(F.split("text", "\n", -1), message)


def doc_chats(t) -> DataFrame:
    return pin(t.documents.select("doc_id", "text"), conversations=doc_conversation()).drop("text")


# --- rendering in SQL ----------------------------------------------------------------------


def sql_header(role: str, template: ChatTemplate) -> str:
    cases = " ".join(
        f"WHEN {role} = '{r}' THEN {lit(role_header(template, r))}" for r in ("user", "system", "tool", "assistant")
    )
    return f"CASE {cases} ELSE '' END"


def sql_render(role: str, content: str, template: ChatTemplate) -> str:
    return f"({sql_header(role, template)} || {content} || {lit(template.end_of_turn_token or '')})"


def rendered_sql(template: ChatTemplate) -> str:
    """CTEs up to ``chat_text(doc_id, text)``: valid messages under a template."""
    system = sql_render("'system'", lit(template.system_prompt or ""), template) if template.system_prompt else "''"
    body = sql_render("role", "content", template)
    return f"""{MESSAGES},
heads AS (SELECT doc_id, conv[1].role = 'system' AS own FROM doc_chats),
bodies AS (SELECT doc_id, string_agg({body}, '' ORDER BY pos) AS body FROM kept GROUP BY doc_id),
chat_text AS (
  SELECT h.doc_id, (CASE WHEN h.own THEN '' ELSE {system} END) || coalesce(b.body, '') AS text
  FROM heads h LEFT JOIN bodies b USING (doc_id))"""


TOKENS_SQL = f"regexp_extract_all(text, {lit(TOKEN_PATTERN)})"


def token_rows_sql(source: str, key: str = "doc_id", name: str = "toks") -> str:
    """CTE with one row per token: ``(key, i, tok, s, e)``, offsets in characters."""
    return f"""{name}_l AS (SELECT {key}, {TOKENS_SQL} AS tk FROM {source}),
{name}_r AS (SELECT {key}, unnest(range(len(tk))) AS i, unnest(tk) AS tok FROM {name}_l),
{name} AS (
  SELECT {key}, i, tok,
    sum(length(tok)) OVER (PARTITION BY {key} ORDER BY i) - length(tok) AS s,
    sum(length(tok)) OVER (PARTITION BY {key} ORDER BY i) AS e
  FROM {name}_r)"""


HASH_ID_SQL = "('0x' || md5({0})[1:4])::INT"


# --- token samples -----------------------------------------------------------------------------

SAMPLES = f"""samples AS (
  SELECT doc_id, list_transform(tk, lambda x: {HASH_ID_SQL.format("x")}) AS ids,
    list_transform(tk, lambda x, i: (((i - 1) // 8 + doc_id) % 2)::INT) AS mask
  FROM (SELECT doc_id, {TOKENS_SQL} AS tk FROM documents)),
positions AS (
  SELECT doc_id, unnest(range(len(ids))) AS i, unnest(ids) AS id, unnest(mask) AS m, len(ids) AS n FROM samples)"""


def samples(t) -> DataFrame:
    """``documents`` as token samples; the mask changes every eight tokens."""
    from chatprep.operators.tokens import hashed_ids_batch, tokens

    tk = tokens(F.col("text"))
    base = pin(t.documents.select("doc_id", "text"), tk=tk).drop("text")
    eights = F.transform(F.sequence(F.lit(0), F.shiftright(F.size("tk"), 3)), lambda k: F.array_repeat(((k + F.col("doc_id")) % 2).cast("int"), 8))
    mask = F.slice(F.flatten(eights), F.lit(1), F.size("tk"))
    return base.select("doc_id", hashed_ids_batch("tk").alias("input_ids"), mask.alias("loss_mask"))


def joined(column, sep: str = ",") -> Column:
    """Whole numbers, none of them null, as one text: as JSON, which makes no text of each."""
    plain = F.btrim(F.to_json(column), F.lit("[]"))
    return plain if sep == "," else F.replace(plain, F.lit(","), F.lit(sep))
