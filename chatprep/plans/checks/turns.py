from pyspark.sql import functions as F

from chatprep.operators import templates as R
from chatprep.operators import turns as C
from chatprep.operators.common import pin
from chatprep.plans import standins as S
from chatprep.plans.catalog import query
from chatprep.sources import normalise as N

QWEN, LLAMA, PHI = R.get_template("qwen"), R.get_template("llama3"), R.get_template("phi3")


def flat(column):
    """Messages as one text per row, for comparison."""
    return F.array_join(F.transform(column, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")


# --- validity ------------------------------------------------------------------------------


@query(
    f"""WITH {S.DOC_CHATS} SELECT doc_id, len(conv)::BIGINT AS n FROM (
  SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN [] WHEN doc_id % 7 = 5 THEN NULL ELSE conv END AS conv FROM doc_chats)
WHERE len(conv) > 0"""
)
def non_empty_conversations(t):
    conv = F.col("conversations")
    holes = (
        F.when(F.col("doc_id") % 7 == 3, F.slice(conv, 1, 0))
        .when(F.col("doc_id") % 7 == 5, F.lit(None))
        .otherwise(conv)
    )
    df = S.doc_chats(t).withColumn("conversations", holes)
    return C.non_empty(df).select("doc_id", F.size("conversations").cast("bigint").alias("n"))


@query(f"WITH {S.VALID} SELECT conv_id, turn, role, text FROM valid")
def valid_turns(t):
    return C.valid_turns(S.turns(t)).select("conv_id", "turn", "role", "text")


_RUMPLED = S.VALID.replace(S.TURNS, S.RUMPLED)


@query(f"WITH {_RUMPLED} SELECT conv_id, role, text FROM valid")
def valid_turns_repeated_rows(t):
    return C.valid_turns(S.rumpled_turns(t)).select("conv_id", "role", "text")


@query(
    f"""WITH {S.RUMPLED}, logged AS (SELECT * FROM rumpled UNION ALL SELECT * FROM rumpled WHERE conv_id % 4 = 1)
SELECT conv_id, turn, count(*) AS n, count(DISTINCT md5(coalesce(role, chr(2)) || chr(1) || coalesce(text, chr(2)))) AS different
FROM logged GROUP BY conv_id, turn HAVING turn IS NULL OR count(*) > 1"""
)
def misnumbered_turns(t):
    return C.misnumbered(S.rumpled_turns(t))


@query(
    f"""WITH {S.RUMPLED} SELECT conv_id, CASE WHEN arg_min(role, turn) = 'system' THEN arg_min(text, turn) ELSE {S.lit(QWEN.system_prompt)} END AS system,
  arg_min(role, turn) = 'system' AS from_data FROM turns GROUP BY conv_id"""
)
def system_prompts_null_turns(t):
    return C.system_prompts(S.rumpled_turns(t), QWEN.system_prompt)


@query(f"WITH {S.MESSAGES} SELECT doc_id, count(*)::BIGINT AS n, string_agg(role || ':' || content, '|' ORDER BY pos) AS body FROM kept WHERE NOT (pos = 0 AND role = 'system') GROUP BY doc_id")
def valid_prefixes(t):
    df = S.doc_chats(t).select("doc_id", C.valid_prefix(C.body(F.col("conversations"))).alias("m"))
    return df.filter(F.size("m") > 0).select("doc_id", F.size("m").cast("bigint").alias("n"), flat("m").alias("body"))


@query(
    f"""WITH {S.TURNS} SELECT conv_id, CASE WHEN arg_min(role, turn) = 'system' THEN arg_min(text, turn) ELSE {S.lit(QWEN.system_prompt)} END AS system,
  arg_min(role, turn) = 'system' AS from_data FROM turns GROUP BY conv_id"""
)
def system_prompts(t):
    return C.system_prompts(S.turns(t), QWEN.system_prompt)


@query(
    f"""WITH {S.DOC_CHATS} SELECT doc_id, CASE WHEN conv[1].role = 'system' THEN conv[1].content ELSE {S.lit(QWEN.system_prompt)} END AS system,
  CASE WHEN conv[1].role = 'system' THEN conv[1].content END AS own FROM doc_chats"""
)
def record_system_prompts(t):
    c = F.col("conversations")
    return S.doc_chats(t).select(
        "doc_id", C.system_prompt(c, QWEN.system_prompt).alias("system"), C.system_prompt(c, "").alias("own")
    )


# --- rendering ------------------------------------------------------------------------------


def rendered(t, template):
    df = C.prepare(S.doc_chats(t), template.system_prompt)
    text = R.render_conversation(F.col("system"), F.col("messages"), template)
    return pin(df, text=text).select("doc_id", "text")


for _name in ("qwen", "llama3", "ling-flash-2.0", "longcat"):
    _template = R.get_template(_name)
    query(
        f"WITH {S.rendered_sql(_template)} SELECT doc_id, text FROM chat_text",
        name="render_" + _name.replace("-", "_").replace(".", "_"),
    )(lambda t, template=_template: rendered(t, template))


@query(
    f"""WITH {S.VALID} SELECT conv_id, turn, {S.sql_render("role", "text", LLAMA)} AS piece FROM valid"""
)
def render_messages(t):
    return C.valid_turns(S.turns(t)).select(
        "conv_id", "turn", R.render_message(F.col("role"), F.col("text"), LLAMA).alias("piece")
    )


_BODY = f"""CASE role WHEN 'system' THEN content WHEN 'user' THEN {S.lit(PHI.user_header)} || content
  WHEN 'assistant' THEN {S.lit(PHI.assistant_header)} || content || {S.lit(PHI.end_of_turn_token)} ELSE '' END"""


@query(
    f"""WITH {S.MESSAGES}, heads AS (SELECT doc_id, conv[1].role = 'system' AS own FROM doc_chats),
bodies AS (SELECT doc_id, string_agg({_BODY}, '' ORDER BY pos) AS body FROM kept GROUP BY doc_id)
SELECT h.doc_id, '<s>' || (CASE WHEN own THEN '' ELSE {S.lit(PHI.system_prompt)} END) || coalesce(body, '') AS text
FROM heads h LEFT JOIN bodies USING (doc_id)"""
)
def render_fallback(t):
    df = C.prepare(S.doc_chats(t), PHI.system_prompt)
    text = R.fallback_conversation(F.col("system"), F.col("messages"), PHI, bos="<s>")
    return df.select("doc_id", text.alias("text"))


# --- channel-tagged conversations ------------------------------------------------------------------

_HARMONY_ROLES = ("user", "assistant_analysis", "assistant_final", "assistant_commentary")
_BEFORE, _AFTER = R.HARMONY_PREAMBLE.split("{effort}")


def harmony_chats(t):
    d = F.col("doc_id")

    def message(x, i):
        role = F.when((i == 3) & (d % 6 == 0), "system").when((i == 2) & (d % 10 == 1), "assistant_reasoning_effort")
        for k, r in enumerate(_HARMONY_ROLES):
            role = role.when((d + i) % 4 == k, r)
        return F.struct(role.alias("role"), x.alias("content"))

    return t.documents.select("doc_id", F.transform(F.split("text", "\n", -1), message).alias("conversations"))


_HARMONY_SQL = f"""hm AS (
  SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
hr AS (
  SELECT doc_id, i, content, CASE WHEN i = 3 AND doc_id % 6 = 0 THEN 'system' WHEN i = 2 AND doc_id % 10 = 1 THEN 'assistant_reasoning_effort'
    WHEN (doc_id + i) % 4 = 0 THEN 'user' WHEN (doc_id + i) % 4 = 1 THEN 'assistant_analysis'
    WHEN (doc_id + i) % 4 = 2 THEN 'assistant_final' ELSE 'assistant_commentary' END AS role FROM hm),
ht AS (
  SELECT doc_id, i, role, CASE role
    WHEN 'system' THEN '<|start|>system<|message|>' || content || '<|end|>'
    WHEN 'assistant_reasoning_effort' THEN '<|start|>system<|message|>' || {S.lit(_BEFORE)} || lower(content) || {S.lit(_AFTER)} || '<|end|>'
    WHEN 'user' THEN '<|start|>user<|message|>' || content || '<|end|>'
    WHEN 'assistant_analysis' THEN '<|start|>assistant<|channel|>analysis<|message|>' || content || '<|end|>'
    WHEN 'assistant_final' THEN '<|start|>assistant<|channel|>final<|message|>' || content || '<|end|>'
    ELSE '<|start|>assistant<|channel|>commentary<|message|>' || content || '<|end|>' END AS piece FROM hr),
hl AS (SELECT doc_id, max(i) FILTER (WHERE role IN ('system', 'assistant_reasoning_effort')) AS at FROM ht GROUP BY doc_id),
harmony AS (
  SELECT t.doc_id, (CASE WHEN any_value(l.at) IS NULL THEN '<|start|>system<|message|>' || {S.lit(_BEFORE)} || 'low' || {S.lit(_AFTER)} || '<|end|>' ELSE '' END)
    || string_agg(piece, '' ORDER BY i) AS text
  FROM ht t JOIN hl l USING (doc_id) WHERE l.at IS NULL OR t.i >= l.at GROUP BY t.doc_id)"""


@query(f"WITH {_HARMONY_SQL} SELECT doc_id, text FROM harmony")
def render_harmony(t):
    return harmony_chats(t).select("doc_id", R.harmony_conversation(F.col("conversations")).alias("text"))


_TAGGED = r"(?s)<\|channel\|>(.*?)<\|message\|>(.*?)<\|end\|>"


@query(
    f"""WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS turn, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
tagged AS (
  SELECT doc_id, turn, CASE WHEN (doc_id + turn) % 3 = 0 THEN line ELSE
    '<|channel|> analysis <|message|> ' || line || ' <|end|><|start|>assistant<|channel|>final<|message|>' || line || '<|end|>' END AS content FROM lines),
found AS (
  SELECT doc_id, turn, content, regexp_extract_all(content, '{_TAGGED}', 1) AS c, regexp_extract_all(content, '{_TAGGED}', 2) AS b FROM tagged)
SELECT doc_id, turn, k AS segment, 'assistant' AS role, trim(c) AS channel, trim(b) AS content
  FROM (SELECT doc_id, turn, unnest(range(len(c))) AS k, unnest(c) AS c, unnest(b) AS b FROM found)
UNION ALL SELECT doc_id, turn, 0, 'assistant', 'text', content FROM found WHERE len(c) = 0"""
)
def harmony_segments(t):
    d = F.col("doc_id")

    def tag(x, i):
        both = F.concat(
            F.lit("<|channel|> analysis <|message|> "), x, F.lit(" <|end|><|start|>assistant<|channel|>final<|message|>"), x, F.lit("<|end|>")
        )
        text = F.when((d + i) % 3 == 0, x).otherwise(both)
        return F.struct(F.lit("assistant").alias("role"), text.alias("content"))

    df = t.documents.select("doc_id", F.transform(F.split("text", "\n", -1), tag).alias("conversations"))
    out = R.explode_segments(df, key="doc_id")
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("turn", "segment")})


_NEXT = R.get_template("qwen3-thinking")


@query(
    f"""WITH {S.PAIRS} SELECT conv_id, turn,
  {S.lit(_NEXT.user_header)} || question || {S.lit(_NEXT.end_of_turn_token)} || {S.lit(_NEXT.assistant_header)} ||
  (CASE WHEN turn % 3 = 0 THEN '' ELSE '<think>' || chr(10) || question || chr(10) || '</think>' || chr(10) || chr(10) END)
  || answer || {S.lit(_NEXT.end_of_turn_token)} AS text FROM pairs"""
)
def render_thinking(t):
    def message(role, text, thought):
        return F.struct(F.lit(role).alias("role"), text.alias("content"), thought.alias("reasoning_content"))

    none = F.lit(None).cast("string")
    thought = F.when(F.col("turn") % 3 != 0, F.col("question"))
    messages = F.array(message("user", F.col("question"), none), message("assistant", F.col("answer"), thought))
    return S.pairs(t).select(
        "conv_id", "turn", R.render_conversation(none, messages, _NEXT, thinking=True).alias("text")
    )


# --- templates as a table -------------------------------------------------------------------------

_NAMES = R.template_names()
_VALUES = ", ".join(
    f"({i}, {S.lit(n)}, {len(R.get_template(n).assistant_header or '')}, {len(R.get_template(n).end_of_turn_token or '')}, {S.lit(R.get_template(n).parser_type)})"
    for i, n in enumerate(_NAMES)
)


@query(
    f"""WITH names(i, name, header, stop, parser) AS (VALUES {_VALUES})
SELECT doc_id, name, header::BIGINT AS header, stop::BIGINT AS stop, parser FROM documents JOIN names ON i = doc_id % {len(_NAMES)}"""
)
def template_per_row(t):
    named = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("doc_id") % len(_NAMES)).cast("int"))
    df = R.with_template(t.documents.select("doc_id", named.alias("name")), "name")
    return df.select(
        "doc_id",
        "name",
        F.length(F.coalesce("template.assistant_header", F.lit(""))).cast("bigint").alias("header"),
        F.length(F.coalesce("template.end_of_turn_token", F.lit(""))).cast("bigint").alias("stop"),
        F.col("template.parser_type").alias("parser"),
    )


# --- image conversations ---------------------------------------------------------------------------


@query(
    f"""WITH {S.MESSAGES}, firsts AS (SELECT doc_id, role <> 'user' AS cut FROM messages WHERE pos = 0),
rest AS (SELECT m.doc_id, m.role, row_number() OVER (PARTITION BY m.doc_id ORDER BY pos) - 1 AS i
  FROM messages m JOIN firsts f USING (doc_id) WHERE NOT (f.cut AND m.pos = 0))
SELECT f.doc_id, coalesce(bool_and(role = CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END), true) AS alternates,
  count(role)::BIGINT AS n FROM firsts f LEFT JOIN rest USING (doc_id) GROUP BY f.doc_id"""
)
def image_alternation(t):
    rest = N.drop_leading_non_user(F.col("conversations"))
    return S.doc_chats(t).select(
        "doc_id", N.alternates(rest).alias("alternates"), F.size(rest).cast("bigint").alias("n")
    )
