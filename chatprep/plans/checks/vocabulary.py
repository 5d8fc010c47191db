from pyspark.sql import functions as F

from chatprep.operators import vocabulary as V
from chatprep.operators.templates import get_template, render_message, role_header
from chatprep.operators.tokens import TOKEN_PATTERN, hashed_id
from chatprep.plans import standins as S
from chatprep.plans.catalog import query
from chatprep.plans.draft_vocabulary import draft_coverage, placed_messages, supervised_words, training_samples as build_samples
from chatprep.session import scratch_folder
from chatprep.sources.files import keyed_stage
from chatprep.sources.vocabulary import load_mapping, save_mapping

QWEN = get_template("qwen")
MAX_LENGTH, DRAFT = 512, 200

# Whole conversations rendered and tokenised, mask by searching the text.
WORDS_SQL = f"""{S.VALID},
heads AS (SELECT conv_id, arg_min(role, turn) = 'system' AS own FROM turns GROUP BY conv_id),
texts AS (
  SELECT h.conv_id, (CASE WHEN h.own THEN '' ELSE {S.sql_render("'system'", S.lit(QWEN.system_prompt), QWEN)} END)
    || coalesce(string_agg({S.sql_render("v.role", "v.text", QWEN)}, '' ORDER BY v.turn), '') AS text
  FROM heads h LEFT JOIN valid v USING (conv_id) GROUP BY h.conv_id, h.own),
{S.token_rows_sql("texts", "conv_id")},
pieces AS (
  SELECT conv_id, regexp_extract_all(text, '(?s)(.*?)(?:(<\\|im_start\\|>assistant\\n)(.*?<\\|im_end\\|>\\n)|\\z)', 1) AS g,
    regexp_extract_all(text, '(?s)(.*?)(?:(<\\|im_start\\|>assistant\\n)(.*?<\\|im_end\\|>\\n)|\\z)', 2) AS h,
    regexp_extract_all(text, '(?s)(.*?)(?:(<\\|im_start\\|>assistant\\n)(.*?<\\|im_end\\|>\\n)|\\z)', 3) AS b
  FROM texts),
piece_rows AS (
  SELECT conv_id, unnest(range(len(g))) AS k, unnest(g) AS g, unnest(h) AS h, unnest(b) AS b FROM pieces),
spans AS (
  SELECT conv_id, upto - length(b) AS s, upto AS e FROM (
    SELECT *, sum(length(g) + coalesce(length(h), 0) + coalesce(length(b), 0)) OVER (PARTITION BY conv_id ORDER BY k) AS upto
    FROM piece_rows) WHERE h <> ''),
words AS (
  SELECT t.tok AS token FROM toks t WHERE t.i < {MAX_LENGTH}
    AND EXISTS (SELECT 1 FROM spans p WHERE p.conv_id = t.conv_id AND t.s >= p.s AND t.s < p.e)),
freq AS (SELECT token, count(*) AS n FROM words GROUP BY token)"""


def words(t):
    return supervised_words(S.turns(t), QWEN, MAX_LENGTH)


def freq(t):
    return V.frequency(words(t))


@query(f"WITH {WORDS_SQL} SELECT token, n FROM freq")
def token_frequency(t):
    return freq(t)


@query(
    f"""WITH {WORDS_SQL}, top AS (SELECT * FROM freq ORDER BY n DESC, token LIMIT {DRAFT})
SELECT (SELECT count(*) FROM top) AS draft_tokens, (SELECT count(*) FROM freq) AS distinct_tokens,
  (SELECT sum(n)::BIGINT FROM top) AS covered, (SELECT sum(n)::BIGINT FROM freq) AS total,
  round((SELECT sum(n) FROM top) / (SELECT sum(n) FROM freq)::DOUBLE, 6) AS coverage"""
)
def draft_vocabulary_coverage(t):
    return draft_coverage(S.turns(t), QWEN, DRAFT, MAX_LENGTH).withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {WORDS_SQL} SELECT token, n FROM freq ORDER BY n DESC, token LIMIT {DRAFT}")
def top_tokens(t):
    return V.top_tokens(freq(t), DRAFT)


@query(
    f"""WITH {WORDS_SQL} SELECT token, (row_number() OVER (ORDER BY n DESC, token) - 1)::INT AS token_id, n
FROM freq ORDER BY n DESC, token LIMIT {DRAFT}"""
)
def learnt_vocabulary(t):
    return V.learn_vocabulary(freq(t), DRAFT)


# --- numeric ids ------------------------------------------------------------------------------

TARGET, SMALL = 65536, 500
IDS_SQL = f"""{WORDS_SQL}, idfreq AS (
  SELECT {S.HASH_ID_SQL.format("token")} AS token, sum(n)::BIGINT AS n FROM freq GROUP BY 1),
best AS (SELECT token FROM idfreq ORDER BY n DESC, token LIMIT {SMALL})"""


def id_freq(t):
    return V.frequency(words(t).select(hashed_id(F.col("token")).alias("token")))


def best(t):
    return V.top_tokens(id_freq(t), SMALL).select(F.col("token").alias("token_id"))


@query(
    f"""WITH {IDS_SQL} SELECT (row_number() OVER (ORDER BY token) - 1)::BIGINT AS draft_id,
  token::BIGINT AS token_id, (token - (row_number() OVER (ORDER BY token) - 1))::BIGINT AS d2t_offset FROM best"""
)
def draft_to_target(t):
    d = V.draft_to_target(best(t))
    return d.select(*[F.col(c).cast("bigint").alias(c) for c in d.columns])


@query(
    f"""WITH {IDS_SQL} SELECT r.i AS token_id, b.token IS NOT NULL AS in_draft
FROM (SELECT unnest(range({TARGET})) AS i) r LEFT JOIN best b ON b.token = r.i"""
)
def target_to_draft(t):
    return V.target_to_draft(t.spark, best(t), TARGET)


PAD = 70000  # more than there are hashed ids, so padding always happens


@query(
    f"""WITH {IDS_SQL}, missing AS (
  SELECT i AS token, row_number() OVER (ORDER BY i) AS k FROM (SELECT unnest(range({PAD})) AS i)
  WHERE i NOT IN (SELECT token FROM idfreq))
SELECT token::BIGINT AS token, n FROM idfreq UNION ALL
SELECT token::BIGINT, 0 FROM missing WHERE k <= {PAD} - (SELECT count(*) FROM idfreq)"""
)
def padded_frequency(t):
    return V.pad_frequency(id_freq(t), PAD).select(F.col("token").cast("bigint").alias("token"), "n")


def _positions(t):
    """One row per token of the valid messages, with its mask."""
    from chatprep.operators.tokens import token_count, tokens

    skip = token_count(F.lit(role_header(QWEN, "assistant")))
    rows = placed_messages(S.turns(t), QWEN).select(
        "conv_id", "turn", "role", F.posexplode(tokens(F.col("rendered"))).alias("i", "token")
    )
    mask = ((F.col("role") == "assistant") & (F.col("i") >= skip)).cast("int")
    return rows.select("conv_id", "turn", "i", hashed_id(F.col("token")).alias("token_id"), mask.alias("loss_mask"))


POSITIONS_SQL = f"""all_tokens AS (
  SELECT conv_id, turn, role, unnest(range(len(tk))) AS i, unnest(tk) AS token FROM (
    SELECT conv_id, turn, role, regexp_extract_all({S.sql_render("role", "text", QWEN)}, {S.lit(TOKEN_PATTERN)}) AS tk FROM valid)),
positions AS (
  SELECT conv_id, turn, i, {S.HASH_ID_SQL.format("token")} AS token_id,
    (role = 'assistant' AND i >= len(regexp_extract_all({S.lit(role_header(QWEN, "assistant"))}, {S.lit(TOKEN_PATTERN)})))::INT AS loss_mask
  FROM all_tokens)"""


@query(
    f"""WITH {IDS_SQL}, {POSITIONS_SQL}
SELECT conv_id, turn, sum(loss_mask)::BIGINT AS supervised,
  sum(loss_mask * (token_id IN (SELECT token FROM best))::INT)::BIGINT AS trainable
FROM positions GROUP BY conv_id, turn"""
)
def trainable_positions(t):
    masked = V.position_mask(_positions(t), V.draft_words(best(t)))
    return masked.groupBy("conv_id", "turn").agg(
        F.sum("loss_mask").cast("bigint").alias("supervised"), F.sum("position_mask").cast("bigint").alias("trainable")
    )


@query(
    f"""WITH {IDS_SQL}, {POSITIONS_SQL}
SELECT conv_id, turn, string_agg((loss_mask * (token_id IN (SELECT token FROM best))::INT)::VARCHAR, '' ORDER BY i) AS mask
FROM positions GROUP BY conv_id, turn"""
)
def trainable_masks(t):
    """Whole arrays of ids against the set, without a join or an explode."""
    from chatprep.operators.tokens import hashed_ids, token_count, tokens

    skip = token_count(F.lit(role_header(QWEN, "assistant")))
    rows = placed_messages(S.turns(t), QWEN).withColumn("ids", hashed_ids(tokens(F.col("rendered"))))
    mask = F.transform("ids", lambda _, i: ((F.col("role") == "assistant") & (i >= skip)).cast("int"))
    words = V.draft_words(best(t))
    return rows.select("conv_id", "turn", F.array_join(V.position_masks(F.col("ids"), mask, words), "").alias("mask"))


@query(
    f"""WITH {IDS_SQL}, {POSITIONS_SQL}, m AS (
  SELECT loss_mask, loss_mask * (token_id IN (SELECT token FROM best))::INT AS pm FROM positions)
SELECT sum(loss_mask)::BIGINT AS supervised, sum(pm)::BIGINT AS trainable,
  round(sum(pm) / sum(loss_mask)::DOUBLE, 6) AS share FROM m"""
)
def trainable_share(t):
    return V.kept_share(V.position_mask(_positions(t), V.draft_words(best(t)))).withColumn("share", F.round("share", 6))


@query(
    f"""WITH {WORDS_SQL}, m AS (
  SELECT t.conv_id, t.i, t.tok, (CASE WHEN EXISTS (SELECT 1 FROM spans p WHERE p.conv_id = t.conv_id AND t.s >= p.s AND t.s < p.e) THEN 1 ELSE 0 END) AS m
  FROM toks t WHERE t.i < {MAX_LENGTH})
SELECT conv_id, string_agg({S.HASH_ID_SQL.format("tok")}::VARCHAR, ',' ORDER BY i) AS ids, string_agg(m::VARCHAR, '' ORDER BY i) AS mask FROM m GROUP BY conv_id"""
)
def training_samples(t):
    out = build_samples(S.turns(t), QWEN, MAX_LENGTH)
    return out.select("conv_id", F.array_join("input_ids", ",").alias("ids"), F.array_join("loss_mask", "").alias("mask"))


# --- samples of other templates ---------------------------------------------------------------------


def whole_text_sql(template, texts: str, last: bool = False) -> str:
    """Samples by searching whole rendered texts; ``texts`` holds CTEs up to ``turns``."""
    from chatprep.functions.text import quote_regex
    from chatprep.operators.spans import span_rule

    rule = span_rule(template)
    stop = rule.stop_pattern()
    pattern = S.lit(rf"(?s)(.*?)(?:({quote_regex(rule.header)})(.*?)({stop}|\n?\z)|\z)")
    parts = ", ".join(f"regexp_extract_all(text, {pattern}, {i}) AS {c}" for i, c in enumerate("ghbz", 1))
    tail = "CASE WHEN z <> chr(10) THEN length(z) ELSE 0 END" if rule.included else "0"
    system = S.sql_render("'system'", S.lit(template.system_prompt), template) if template.system_prompt else "''"
    hidden = "".join(
        f""" AND NOT EXISTS (SELECT 1 FROM literals p WHERE p.conv_id = t.conv_id AND t.s >= p.s AND t.s < p.e)""" for _ in template.ignore_token[:1]
    )
    literal = template.ignore_token[0] if template.ignore_token else "\x01"
    return f"""{texts},
heads AS (SELECT conv_id, arg_min(role, turn) = 'system' AS own FROM turns GROUP BY conv_id),
texts AS (
  SELECT h.conv_id, (CASE WHEN h.own THEN '' ELSE {system} END)
    || coalesce(string_agg({S.sql_render("v.role", "v.text", template)}, '' ORDER BY v.turn), '') AS text
  FROM heads h LEFT JOIN valid v USING (conv_id) GROUP BY h.conv_id, h.own),
{S.token_rows_sql("texts", "conv_id")},
pieces AS (SELECT conv_id, {parts} FROM texts),
piece_rows AS (
  SELECT conv_id, unnest(range(len(g))) AS k, unnest(g) AS g, coalesce(unnest(h), '') AS h, coalesce(unnest(b), '') AS b, coalesce(unnest(z), '') AS z
  FROM pieces),
all_spans AS (
  SELECT conv_id, k, upto - length(z) - length(b) AS s, upto - length(z) + {tail} AS e FROM (
    SELECT *, sum(length(g) + length(h) + length(b) + length(z)) OVER (PARTITION BY conv_id ORDER BY k) AS upto
    FROM piece_rows) WHERE h <> ''),
spans AS (SELECT * FROM all_spans a WHERE {'k = (SELECT max(k) FROM all_spans z WHERE z.conv_id = a.conv_id)' if last else 'true'}),
literal_parts AS (
  SELECT conv_id, unnest(range(len(p))) AS k, length(unnest(p)) AS w, len(p) AS n
  FROM (SELECT conv_id, string_split(text, {S.lit(literal)}) AS p FROM texts)),
literal_ends AS (SELECT *, sum(w + {len(literal)}) OVER (PARTITION BY conv_id ORDER BY k) AS e FROM literal_parts),
literals AS (SELECT conv_id, e - {len(literal)} AS s, e FROM literal_ends WHERE k < n - 1),
m AS (
  SELECT t.conv_id, t.i, t.tok, (EXISTS (SELECT 1 FROM spans p WHERE p.conv_id = t.conv_id AND t.s >= p.s AND t.s < p.e){hidden})::INT AS m
  FROM toks t)"""


SAMPLE_ROWS = f"""SELECT c.conv_id, coalesce(string_agg({S.HASH_ID_SQL.format("tok")}::VARCHAR, ',' ORDER BY i), '') AS ids,
  coalesce(string_agg(m::VARCHAR, '' ORDER BY i), '') AS mask
FROM texts c LEFT JOIN (SELECT * FROM m WHERE i < {MAX_LENGTH}) USING (conv_id) GROUP BY c.conv_id"""

_THINK_BLOCK = "<think>\n\n</think>\n\n"
# Turns with empty think blocks, with round markers, and with headers and end tokens as text.
_VARIANTS = {
    "think": (
        f"CASE WHEN (conv_id + turn) % 3 = 0 THEN {S.lit(_THINK_BLOCK)} || text WHEN turn % 5 = 4 THEN text || {S.lit(_THINK_BLOCK)} ELSE text END",
        lambda c, n, x: F.when((c + n) % 3 == 0, F.concat(F.lit(_THINK_BLOCK), x)).when(n % 5 == 4, F.concat(x, F.lit(_THINK_BLOCK))).otherwise(x),
    ),
    "round": (
        "CASE WHEN (conv_id + turn) % 4 = 0 THEN '[Round ' || turn || '] USER:' || text WHEN turn % 3 = 1 THEN text || '[Round 7] USER:' ELSE text END",
        lambda c, n, x: F.when((c + n) % 4 == 0, F.concat(F.lit("[Round "), n.cast("string"), F.lit("] USER:"), x))
        .when(n % 3 == 1, F.concat(x, F.lit("[Round 7] USER:")))
        .otherwise(x),
    ),
    "marks": (
        f"CASE WHEN (conv_id + turn) % 4 = 0 THEN text || {S.lit(QWEN.end_of_turn_token)} || text WHEN turn % 4 = 2 THEN {S.lit(QWEN.assistant_header)} || text ELSE text END",
        lambda c, n, x: F.when((c + n) % 4 == 0, F.concat(x, F.lit(QWEN.end_of_turn_token), x))
        .when(n % 4 == 2, F.concat(F.lit(QWEN.assistant_header), x))
        .otherwise(x),
    ),
    "plain": ("text", lambda c, n, x: x),
}


def _variant_sql(name: str) -> str:
    """The turns and their valid part, with changed texts."""
    return S.VALID.replace("SELECT conv_id, turn, text,", f"SELECT conv_id, turn, {_VARIANTS[name][0]} AS text,", 1)


def _variant(t, name: str):
    return S.turns(t).withColumn("text", _VARIANTS[name][1](F.col("conv_id"), F.col("turn"), F.col("text")))


def _sample_rows(df):
    return df.select("conv_id", F.array_join("input_ids", ",").alias("ids"), F.array_join("loss_mask", "").alias("mask"))


for _name, _template, _texts, _last in [
    ("qwen3_instruct", "qwen3-instruct", "think", False),
    ("longcat", "longcat", "round", False),
    ("deepseek_r1_distill", "deepseek-r1-distill", "plain", False),
    ("marks_in_text", "qwen", "marks", False),
    ("last_reply", "qwen", "plain", True),
]:

    def _samples(t, template=get_template(_template), texts=_texts, last=_last):
        return _sample_rows(build_samples(_variant(t, texts), template, MAX_LENGTH, last_only=last))

    query(f"WITH {whole_text_sql(get_template(_template), _variant_sql(_texts), _last)} {SAMPLE_ROWS}", name=f"training_samples_{_name}")(_samples)


for _name, _template in [("null_turns", "qwen"), ("null_turns_longcat", "longcat")]:

    def _rumpled(t, template=get_template(_template)):
        return _sample_rows(build_samples(S.rumpled_turns(t), template, MAX_LENGTH))

    query(f"WITH {whole_text_sql(get_template(_template), S.VALID.replace(S.TURNS, S.RUMPLED))} {SAMPLE_ROWS}", name=f"training_samples_{_name}")(_rumpled)


@query(
    f"""WITH {whole_text_sql(get_template("qwen3-instruct"), _variant_sql("think"))}
SELECT tok AS token, count(*) AS n FROM m WHERE m = 1 AND i < {MAX_LENGTH} GROUP BY tok"""
)
def token_frequency_ignored_text(t):
    return V.frequency(supervised_words(_variant(t, "think"), get_template("qwen3-instruct"), MAX_LENGTH))


@query(
    f"""WITH {whole_text_sql(QWEN, S.VALID)},
vocab AS (SELECT tok, row_number() OVER (ORDER BY count(*) DESC, tok) - 1 AS token_id FROM m WHERE m = 1 AND i < {MAX_LENGTH} GROUP BY tok
  ORDER BY count(*) DESC, tok LIMIT {DRAFT})
SELECT c.conv_id, coalesce(string_agg(coalesce(v.token_id, {DRAFT})::VARCHAR, ',' ORDER BY i), '') AS ids,
  coalesce(string_agg(m::VARCHAR, '' ORDER BY i), '') AS mask
FROM texts c LEFT JOIN (SELECT * FROM m WHERE i < {MAX_LENGTH}) a USING (conv_id) LEFT JOIN vocab v ON v.tok = a.tok GROUP BY c.conv_id"""
)
def training_samples_with_vocabulary(t):
    folder = scratch_folder(t.spark, "vocabulary")
    vocab = keyed_stage(V.learn_vocabulary(freq(t), DRAFT).select("token", "token_id"), folder, {"draft": DRAFT})
    return _sample_rows(build_samples(S.turns(t), QWEN, MAX_LENGTH, vocabulary=vocab, unknown=DRAFT))


@query(
    f"""WITH {IDS_SQL}, d AS (
  SELECT (row_number() OVER (ORDER BY token) - 1)::BIGINT AS draft_id, token::BIGINT AS token_id FROM best)
SELECT r.i AS token_id, d.token_id IS NOT NULL AS in_draft, d.draft_id, d.token_id - d.draft_id AS d2t_offset
FROM (SELECT unnest(range({TARGET})) AS i) r LEFT JOIN d ON d.token_id = r.i"""
)
def mapping_round_trip(t):
    folder = scratch_folder(t.spark, "mapping")
    save_mapping(best(t), TARGET, folder)
    d2t, t2d = load_mapping(t.spark, folder)
    return t2d.join(d2t.withColumn("draft_id", F.col("draft_id").cast("bigint")), "token_id", "left")
