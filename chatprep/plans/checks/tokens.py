from pyspark.sql import functions as F

from chatprep.functions import arrays as A
from chatprep.operators import spans as P
from chatprep.operators import templates as R
from chatprep.operators import tokens as T
from chatprep.operators.common import pin
from chatprep.plans import standins as S
from chatprep.plans.catalog import query
from chatprep.plans.checks.turns import _HARMONY_SQL, harmony_chats, rendered
from chatprep.plans.draft_vocabulary import supervised_words, training_samples
from chatprep.session import scratch_folder
from chatprep.sources.files import keyed_stage

QWEN = R.get_template("qwen")


def text(mask):
    """A mask as a string of digits."""
    return F.array_join(mask, "")


# --- tokens ----------------------------------------------------------------------------------


@query(
    f"""SELECT doc_id, len({S.TOKENS_SQL})::BIGINT AS n, sum(length(text))::BIGINT AS chars,
  array_to_string(list_transform({S.TOKENS_SQL}, lambda x: length(x)), ',') AS widths FROM documents GROUP BY doc_id, text"""
)
def regex_tokens(t):
    tk = T.tokens(F.col("text"))
    return t.documents.select(
        "doc_id",
        F.size(tk).cast("bigint").alias("n"),
        F.length("text").cast("bigint").alias("chars"),
        F.array_join(F.transform(tk, F.length), ",").alias("widths"),
    )


@query(
    f"""SELECT doc_id, array_to_string(list_transform(list_slice({S.TOKENS_SQL}, 1, 256), lambda x: {S.HASH_ID_SQL.format("x")}), ',') AS ids
FROM documents"""
)
def truncated_ids(t):
    ids = A.truncate(T.tokens(F.col("text")), 256)
    return t.documents.select("doc_id", F.array_join(T.hashed_ids(ids), ",").alias("ids"))


@query(f"SELECT doc_id, repeat('1', len({S.TOKENS_SQL})) AS mask FROM documents")
def attention_masks(t):
    return t.documents.select("doc_id", text(A.attention_mask(T.tokens(F.col("text")))).alias("mask"))


# --- spans --------------------------------------------------------------------------------------


def spans_sql(source: str, header: str, stop: str, included: bool) -> str:
    """CTE ``spans(doc_id, k, s, e)``; ``stop`` is a pattern."""
    from chatprep.functions.text import quote_regex

    pattern = S.lit(rf"(?s)(.*?)(?:({quote_regex(header)})(.*?)({stop}|\n?\z)|\z)")
    tail = f"(CASE WHEN {'true' if included else 'false'} AND st <> '' AND st <> chr(10) THEN length(st) ELSE 0 END)"
    cols = ", ".join(f"regexp_extract_all(text, {pattern}, {g}) AS g{g}" for g in (1, 2, 3, 4))
    return f"""cut AS (SELECT doc_id, {cols} FROM {source}),
cut_rows AS (
  SELECT doc_id, unnest(range(len(g1))) AS k, length(unnest(g1)) AS gap, coalesce(unnest(g2), '') AS hd,
    length(coalesce(unnest(g3), '')) AS body, coalesce(unnest(g4), '') AS st FROM cut),
cut_sums AS (
  SELECT *, sum(gap + length(hd) + body + length(st)) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM cut_rows),
spans AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS k,
    upto - length(st) - body AS s, upto - length(st) + {tail} AS e
  FROM cut_sums WHERE hd <> '')"""


SPAN_LIST = """SELECT c.doc_id, coalesce(string_agg(s::BIGINT || '-' || e::BIGINT, ',' ORDER BY k), '') AS spans
FROM chat_text c LEFT JOIN spans USING (doc_id) GROUP BY c.doc_id"""

HOW = {
    "prefix": "t.s >= p.s AND t.s < p.e",
    "containment": "t.s >= p.s AND t.e <= p.e",
    "overlap": "t.e > p.s AND t.s <= p.e",
}


def mask_sql(how: str, spans: str = "spans") -> str:
    return f"""masked AS (
  SELECT t.doc_id, t.i, t.tok, (CASE WHEN EXISTS (
    SELECT 1 FROM {spans} p WHERE p.doc_id = t.doc_id AND {HOW[how]}) THEN 1 ELSE 0 END) AS m FROM toks t)"""


MASK_TEXT = """SELECT c.doc_id, coalesce(string_agg(m::VARCHAR, '' ORDER BY i), '') AS mask
FROM chat_text c LEFT JOIN masked USING (doc_id) GROUP BY c.doc_id"""


def span_list(column):
    return F.array_join(F.transform(column, lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")


def quote(s):
    from chatprep.functions.text import quote_regex

    return quote_regex(s)


_LONGCAT = R.get_template("longcat")


def round_chats(t):
    """Texts with round markers in place of end tokens."""
    body = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.when(
            i % 2 == 0, F.concat(F.lit("[Round "), F.floor(i / 2).cast("string"), F.lit("] USER:"), x)
        ).otherwise(F.concat(F.lit(" ASSISTANT:"), x)),
    )
    return t.documents.select("doc_id", F.array_join(body, "").alias("text"))


ROUND_SQL = """chat_text AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
    CASE WHEN i % 2 = 1 THEN '[Round ' || ((i - 1) // 2)::VARCHAR || '] USER:' || x ELSE ' ASSISTANT:' || x END), '') AS text
  FROM documents)"""

_HARMONY_TEXT = f"{_HARMONY_SQL}, chat_text AS (SELECT doc_id, text FROM harmony)"


def harmony_text(t):
    text = R.harmony_conversation(F.col("conversations"))
    return pin(harmony_chats(t), text=text).select("doc_id", "text")


QWEN_TEXT = S.rendered_sql(QWEN)
_CASES = {
    # name: (texts in SQL, texts in Spark, template, style, header, stop pattern, included, mapping)
    "general": (QWEN_TEXT, lambda t: rendered(t, QWEN), QWEN, "general", QWEN.assistant_header, quote(QWEN.end_of_turn_token), True, "prefix"),
    "round": (f"{ROUND_SQL}", round_chats, _LONGCAT, "round", " ASSISTANT:", r"\[Round \d+\] USER:", True, "prefix"),
    "harmony": (_HARMONY_TEXT, harmony_text, R.get_template("gpt-oss"), "harmony", P.HARMONY_ASSISTANT, quote(P.HARMONY_USER), False, "containment"),
    "strict": (
        QWEN_TEXT,
        lambda t: rendered(t, QWEN),
        QWEN,
        "strict",
        QWEN.end_of_turn_token + QWEN.assistant_header,
        quote(QWEN.end_of_turn_token + QWEN.user_header),
        False,
        "overlap",
    ),
}

for _case, (_sql, _texts, _tpl, _style, _head, _stop, _in, _how) in _CASES.items():
    _spans = f"WITH {_sql}, {spans_sql('chat_text', _head, _stop, _in)}"

    def _find(t, texts=_texts, tpl=_tpl, style=_style):
        found = P.find_spans(F.col("text"), P.span_rule(tpl, style))
        df = pin(texts(t), sp=found)
        return df.select("doc_id", span_list(F.col("sp")).alias("spans"))

    def _mask(t, texts=_texts, tpl=_tpl, style=_style, how=_how):
        df = texts(t)
        df = pin(df, sp=P.find_spans(F.col("text"), P.span_rule(tpl, style)))
        mask = P.span_mask(F.col("text"), F.col("sp"), T.token_count(F.col("text")), how)
        return df.select("doc_id", text(mask).alias("mask"))

    query(f"{_spans} {SPAN_LIST}", name=f"spans_{_case}")(_find)
    query(
        f"{_spans}, {S.token_rows_sql('chat_text')}, {mask_sql(_how)} {MASK_TEXT}", name=f"mask_{_case}_{_how}"
    )(_mask)


@query(
    f"""WITH {QWEN_TEXT}, {spans_sql('chat_text', QWEN.assistant_header, quote(QWEN.end_of_turn_token), True)},
{S.token_rows_sql('chat_text')}, last_spans AS (SELECT * FROM spans s WHERE k = (SELECT max(k) FROM spans q WHERE q.doc_id = s.doc_id)),
{mask_sql('prefix', 'last_spans')} {MASK_TEXT}"""
)
def mask_last_reply(t):
    df = rendered(t, QWEN)
    sp = P.last_span(P.find_spans(F.col("text"), P.span_rule(QWEN)))
    df = pin(df, sp=sp)
    return df.select(
        "doc_id", text(P.span_mask(F.col("text"), F.col("sp"), T.token_count(F.col("text")))).alias("mask")
    )


# --- ignore texts -----------------------------------------------------------------------------------

_EMPTY_THINK = "<think>\n\n</think>\n\n"
_THINK_CHATS = f"""chat_text AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
    CASE WHEN i % 2 = 1 THEN {S.lit(QWEN.user_header)} || x || {S.lit(QWEN.end_of_turn_token)}
    ELSE {S.lit(QWEN.assistant_header)} || (CASE WHEN (doc_id + i) % 3 = 0 THEN {S.lit(_EMPTY_THINK)} ELSE '' END) || x || {S.lit(QWEN.end_of_turn_token)} END), '') AS text
  FROM documents)"""


def think_chats(t):
    d = F.col("doc_id")
    body = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.when(
            i % 2 == 0, F.concat(F.lit(QWEN.user_header), x, F.lit(QWEN.end_of_turn_token))
        ).otherwise(
            F.concat(
                F.lit(QWEN.assistant_header),
                F.when((d + i + 1) % 3 == 0, _EMPTY_THINK).otherwise(""),
                x,
                F.lit(QWEN.end_of_turn_token),
            )
        ),
    )
    return t.documents.select("doc_id", F.array_join(body, "").alias("text"))


@query(
    f"""WITH {_THINK_CHATS}, {spans_sql('chat_text', QWEN.assistant_header, quote(QWEN.end_of_turn_token), True)},
{S.token_rows_sql('chat_text')}, parts AS (
  SELECT doc_id, unnest(range(len(p))) AS k, length(unnest(p)) AS w, len(p) AS n FROM (SELECT doc_id, string_split(text, {S.lit(_EMPTY_THINK)}) AS p FROM chat_text)),
hidden AS (
  SELECT doc_id, sum(w + {len(_EMPTY_THINK)}) OVER (PARTITION BY doc_id ORDER BY k) - {len(_EMPTY_THINK)} AS s,
    sum(w + {len(_EMPTY_THINK)}) OVER (PARTITION BY doc_id ORDER BY k) AS e, k, n FROM parts),
masked AS (
  SELECT t.doc_id, t.i, (CASE WHEN EXISTS (SELECT 1 FROM spans p WHERE p.doc_id = t.doc_id AND {HOW['prefix']})
    AND NOT EXISTS (SELECT 1 FROM hidden p WHERE p.doc_id = t.doc_id AND p.k < p.n - 1 AND {HOW['prefix']}) THEN 1 ELSE 0 END) AS m FROM toks t)
{MASK_TEXT}"""
)
def mask_without_ignored(t):
    df = think_chats(t)
    out = P.masked_sample(df, R.get_template("qwen3-instruct"), max_length=None)
    return out.select("doc_id", text("loss_mask").alias("mask"))


@query(
    f"""WITH {QWEN_TEXT}, {spans_sql('chat_text', QWEN.assistant_header, quote(QWEN.end_of_turn_token), True)},
{S.token_rows_sql('chat_text')}, {mask_sql('prefix')}
SELECT c.doc_id, coalesce(string_agg({S.HASH_ID_SQL.format('tok')}::VARCHAR, ',' ORDER BY i), '') AS ids,
  coalesce(string_agg(m::VARCHAR, '' ORDER BY i), '') AS mask, count(i)::BIGINT AS attended
FROM chat_text c LEFT JOIN (SELECT * FROM masked WHERE i < 300) USING (doc_id) GROUP BY c.doc_id"""
)
def masked_samples(t):
    out = P.masked_sample(rendered(t, QWEN), QWEN, max_length=300)
    return out.select(
        "doc_id",
        F.array_join("input_ids", ",").alias("ids"),
        text("loss_mask").alias("mask"),
        A.supervised(F.col("attention_mask")).alias("attended"),
    )


@query(
    f"""WITH {QWEN_TEXT}, {spans_sql('chat_text', QWEN.assistant_header, quote(QWEN.end_of_turn_token), True)},
{S.token_rows_sql('chat_text')}, {mask_sql('prefix')},
edges AS (SELECT *, CASE WHEN m IS DISTINCT FROM lag(m) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS edge FROM masked),
runs AS (SELECT *, sum(edge) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS run FROM edges)
SELECT doc_id, run::BIGINT AS run, any_value(m)::BIGINT AS mask, string_agg(tok, '' ORDER BY i) AS text FROM runs GROUP BY doc_id, run"""
)
def mask_runs(t):
    df = rendered(t, QWEN).filter("text <> ''")
    df = pin(df, tok=T.tokens(F.col("text")), sp=P.find_spans(F.col("text"), P.span_rule(QWEN)))
    df = pin(df, mask=P.span_mask(F.col("text"), F.col("sp"), F.size("tok")))
    runs = P.mask_runs(df, "doc_id", "tok", "mask")
    return runs.withColumns({c: F.col(c).cast("bigint") for c in ("run", "mask")})


# --- messages of channel-tagged conversations ------------------------------------------------------

_TAGGED_ROLE = """CASE WHEN (conv_id * 5 + turn) % 11 = 3 THEN 'system' WHEN (conv_id * 3 + turn) % 13 = 5 THEN 'assistant_reasoning_effort'
  WHEN role = 'user' THEN 'user' WHEN (conv_id + turn) % 3 = 0 THEN 'assistant_analysis' WHEN (conv_id + turn) % 3 = 1 THEN 'assistant_final'
  ELSE 'assistant_commentary' END"""
_TAGGED_SQL = f"""hr AS (SELECT conv_id AS doc_id, turn AS i, text AS content, {_TAGGED_ROLE} AS role FROM conversations),
{_HARMONY_SQL[_HARMONY_SQL.index("ht AS ("):]}, chat_text AS (SELECT doc_id, text FROM harmony),
{spans_sql('chat_text', P.HARMONY_ASSISTANT, quote(P.HARMONY_USER), False)}, {S.token_rows_sql('chat_text')}, {mask_sql('containment')}"""


def tagged_turns(t):
    return t.conversations.select("conv_id", "turn", "text", F.expr(_TAGGED_ROLE).alias("role"))


@query(
    f"""WITH {_TAGGED_SQL}
SELECT c.doc_id AS conv_id, coalesce(string_agg({S.HASH_ID_SQL.format('tok')}::VARCHAR, ',' ORDER BY i), '') AS ids,
  coalesce(string_agg(m::VARCHAR, '' ORDER BY i), '') AS mask
FROM chat_text c LEFT JOIN (SELECT * FROM masked WHERE i < 512) USING (doc_id) GROUP BY c.doc_id"""
)
def training_samples_gpt_oss(t):
    out = training_samples(tagged_turns(t), R.get_template("gpt-oss"), 512)
    return out.select("conv_id", F.array_join("input_ids", ",").alias("ids"), text("loss_mask").alias("mask"))


@query(f"WITH {_TAGGED_SQL} SELECT tok AS token, count(*) AS n FROM masked WHERE m = 1 AND i < 512 GROUP BY tok")
def token_frequency_gpt_oss(t):
    from chatprep.operators.vocabulary import frequency

    return frequency(supervised_words(tagged_turns(t), R.get_template("gpt-oss"), 512))


# --- masks from token offsets ----------------------------------------------------------------------

_OFFSETS = f"""WITH {QWEN_TEXT}, {spans_sql('chat_text', QWEN.assistant_header, quote(QWEN.end_of_turn_token), True)},
{S.token_rows_sql('chat_text')}"""


def spans_of(t):
    """Rendered texts with their spans."""
    return pin(rendered(t, QWEN), sp=P.find_spans(F.col("text"), P.span_rule(QWEN)))


def offsets(t):
    """Rendered texts with the offsets of their tokens and their spans."""
    df = pin(spans_of(t), ends=A.prefix_sums(F.transform(T.tokens(F.col("text")), F.char_length)))
    n = F.size("ends") - 1
    return df.select("doc_id", "sp", F.slice("ends", F.lit(1), n).alias("starts"), F.slice("ends", F.lit(2), n).alias("ends"))


for _how in HOW:

    def _by_offsets(t, how=_how):
        return offsets(t).select("doc_id", text(P.offset_mask(F.col("starts"), F.col("ends"), F.col("sp"), how)).alias("mask"))

    def _by_sweep(t, how=_how):
        df = offsets(t)
        tokens = df.select("doc_id", F.posexplode(F.arrays_zip("starts", "ends")).alias("i", "o")).select("doc_id", "i", "o.starts", "o.ends")
        tokens = tokens.toDF("doc_id", "i", "start", "end").withColumns({c: F.col(c).cast("int") for c in ("start", "end")})
        spans = spans_of(t).select("doc_id", F.inline("sp")).select("doc_id", "start", "end")
        masked = P.offset_mask_rows(tokens, spans, ["doc_id"], how)
        sums = [F.count("*").alias("n"), F.sum("mask").cast("bigint").alias("supervised"), F.sum(F.col("i").cast("bigint") * F.col("mask")).cast("bigint").alias("places")]
        return masked.groupBy("doc_id").agg(*sums)

    query(f"{_OFFSETS}, {mask_sql(_how)} {MASK_TEXT}", name=f"offset_mask_{_how}")(_by_offsets)
    query(
        f"{_OFFSETS}, {mask_sql(_how)} SELECT doc_id, count(*) AS n, sum(m)::BIGINT AS supervised, sum(i * m)::BIGINT AS places FROM masked GROUP BY doc_id",
        name=f"offset_rows_{_how}",
    )(_by_sweep)


# --- a learnt vocabulary applied to long tokens ---------------------------------------------------


@query(
    f"""WITH w AS (SELECT doc_id, unnest({S.TOKENS_SQL}) AS token FROM documents),
vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS token_id FROM w GROUP BY token
  ORDER BY count(*) DESC, token LIMIT 300)
SELECT coalesce(v.token_id, 0)::BIGINT AS token_id, count(*) AS n FROM w LEFT JOIN vocab v USING (token) GROUP BY 1"""
)
def word_level_ids(t):
    from chatprep.operators.vocabulary import frequency, learn_vocabulary

    w = t.documents.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    learnt = learn_vocabulary(frequency(w), 300).withColumn("token_id", F.col("token_id") + 1)
    vocab = keyed_stage(learnt, scratch_folder(t.spark, "vocabulary"), {"size": 300})
    return T.with_vocabulary(w, vocab).groupBy(F.col("token_id").cast("bigint").alias("token_id")).agg(F.count("*").alias("n"))


@query()
def byte_pair_samples(t):
    """Real tokenizer through Arrow: ids and a containment mask by offsets."""
    import public_tokenizers

    encode = T.tokenizer_udf(T.tokenizer_file(public_tokenizers.path("byte_bpe_50k.json")))
    df = spans_of(t).withColumn("e", encode("text"))
    mask = P.offset_mask(F.col("e.starts"), F.col("e.ends"), F.col("sp"), "prefix")
    return df.select(
        "doc_id",
        F.size("e.ids").cast("bigint").alias("n"),
        A.supervised(mask).alias("supervised"),
    )
