from pyspark.sql import functions as F

from chatprep.functions import answers as A
from chatprep.functions import prompts as P
from chatprep.functions.text import SPACE_CHARS
from chatprep.operators import scoring
from chatprep.operators.common import pin
from chatprep.plans import standins as S
from chatprep.plans.catalog import query

# --- replies made of line items -------------------------------------------------------------------

_Q, _K = "l_quantity::INT", "(l_orderkey + l_linenumber) % 10"
REPLIES_SQL = f"""replies AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CASE {_K}
    WHEN 0 THEN 'so \\boxed{{x = ' || {_Q} || '}} done 77'
    WHEN 1 THEN 'thus \\boxed ' || {_Q} || ' or 3'
    WHEN 2 THEN 'First 12. The Answer: ' || {_Q} || ' units, answer ' || l_linenumber
    WHEN 3 THEN 'we get a value that equals' || {_Q} || ' '
    WHEN 4 THEN 'values 12 and ' || l_partkey || ' and ' || {_Q} || ' then 5,000 and 1234x'
    WHEN 5 THEN 'no number here'
    WHEN 6 THEN '\\boxed{{a+b}} = -' || l_discount
    WHEN 7 THEN 'ANSWER 00' || {_Q} || ' total 1,234'
    WHEN 8 THEN 'x = ' || l_extendedprice
    ELSE 'about +' || {_Q} || '.5 or .25' END AS reply
  FROM lineitem)"""


def replies(t):
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 10
    q = F.col("l_quantity").cast("int").cast("string")
    lit = F.lit
    reply = (
        F.when(k == 0, F.concat(lit("so \\boxed{x = "), q, lit("} done 77")))
        .when(k == 1, F.concat(lit("thus \\boxed "), q, lit(" or 3")))
        .when(k == 2, F.concat(lit("First 12. The Answer: "), q, lit(" units, answer "), F.col("l_linenumber").cast("string")))
        .when(k == 3, F.concat(lit("we get a value that equals"), q, lit(" ")))
        .when(k == 4, F.concat(lit("values 12 and "), F.col("l_partkey").cast("string"), lit(" and "), q, lit(" then 5,000 and 1234x")))
        .when(k == 5, "no number here")
        .when(k == 6, F.concat(lit("\\boxed{a+b} = -"), F.col("l_discount").cast("string")))
        .when(k == 7, F.concat(lit("ANSWER 00"), q, lit(" total 1,234")))
        .when(k == 8, F.concat(lit("x = "), F.format_string("%.2f", "l_extendedprice")))
        .otherwise(F.concat(lit("about +"), q, lit(".5 or .25")))
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", reply.alias("reply"))


REPLIES_SQL = REPLIES_SQL.replace("|| l_extendedprice", "|| printf('%.2f', l_extendedprice)")
_KEY = "l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey"


def keyed(df, *cols):
    return df.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", *cols)


def ex(pattern, group=1, source="reply"):
    return f"regexp_extract_all({source}, {S.lit(pattern)}, {group})"


BOX = ex(A.BOXED)
_WORDS = ex(r"[\p{L}\p{N}_]+", 0)
AIME_SQL = f"""coalesce(
  CASE WHEN len({BOX}) > 0 THEN coalesce(regexp_extract_all(trim({BOX}[1]), '\\p{{Nd}}+')[-1], trim({BOX}[1])) END,
  {ex(A.BOXED_BARE_INTEGER)}[1], {ex(A.ANSWER_INTEGER)}[-1], {ex(A.CLOSING_INTEGER)}[-1],
  list_filter({_WORDS}, lambda w: regexp_matches(w, '^0*[0-9]{{1,3}}$'))[-1])"""
MATH_SQL = f"""coalesce(CASE WHEN len({BOX}) > 0 THEN trim({BOX}[1]) END, {ex(A.BOXED_BARE)}[1],
  {ex(A.ANSWER_NUMBER)}[-1], {ex(A.CLOSING_NUMBER)}[-1], {ex(A.NUMBER, 0)}[-1])"""
_LAST = "regexp_extract_all(replace(reply, ',', ''), '\\d+')[-1]"
GSM_SQL = f"""CASE WHEN regexp_matches({_LAST}, '^0+$') THEN '0' WHEN regexp_matches({_LAST}, '^[1-9]') THEN {_LAST} ELSE '-9999999' END"""


@query(f"WITH {REPLIES_SQL} SELECT {_KEY}, {AIME_SQL} AS answer FROM replies")
def boxed_integers(t):
    return keyed(replies(t), A.boxed_integer(F.col("reply")).alias("answer"))


@query(f"WITH {REPLIES_SQL} SELECT {_KEY}, {MATH_SQL} AS answer FROM replies")
def boxed_values(t):
    return keyed(replies(t), A.boxed_value(F.col("reply")).alias("answer"))


@query(f"WITH {REPLIES_SQL} SELECT {_KEY}, {GSM_SQL} AS answer FROM replies")
def last_integers(t):
    return keyed(replies(t), A.last_integer(F.col("reply")).alias("answer"))


# --- accuracies -------------------------------------------------------------------------------------------

_LABEL_SQL = "CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_partkey % 4 = 1 THEN '+0' || l_linenumber ELSE answer END"


def labelled(t, extract):
    df = pin(replies(t), answer=extract(F.col("reply")))
    p = F.col("l_partkey") % 4
    label = F.when(p == 1, F.concat(F.lit("+0"), F.col("l_linenumber").cast("string"))).when(p > 1, F.col("answer"))
    return df.withColumn("label", label)


def with_label(sql):
    return f"WITH {REPLIES_SQL}, a AS (SELECT *, {sql} AS answer FROM replies), b AS (SELECT *, {_LABEL_SQL} AS label FROM a)"


_COUNTS = "count(*) AS num_questions, count(answer) AS num_valid_predictions"


def rounded(df):
    return df.withColumn("accuracy", F.round("accuracy", 6))


@query(
    f"""{with_label(AIME_SQL)} SELECT l_returnflag, round(count(*) FILTER (WHERE label IS NOT NULL AND
  (trim(answer) = trim(label) OR try_cast(trim(answer) AS BIGINT) = try_cast(trim(label) AS BIGINT)))::DOUBLE / count(label), 6) AS accuracy, {_COUNTS}
FROM b GROUP BY 1"""
)
def accuracy_labelled_integers(t):
    return rounded(scoring.score(labelled(t, A.boxed_integer), "aime", ["l_returnflag"]))


@query(
    f"""{with_label(MATH_SQL)} SELECT l_returnflag, round(count(*) FILTER (WHERE label IS NOT NULL AND
  (lower(trim(answer)) = lower(trim(label)) OR abs(try_cast(trim(answer) AS DOUBLE) - try_cast(trim(label) AS DOUBLE)) < 1e-6))::DOUBLE / count(label), 6) AS accuracy, {_COUNTS}
FROM b GROUP BY 1"""
)
def accuracy_labelled_numbers(t):
    return rounded(scoring.score(labelled(t, A.boxed_value), "math500", ["l_returnflag"]))


@query(
    f"""{with_label(GSM_SQL)} SELECT l_returnflag, round(count(*) FILTER (WHERE answer = label)::DOUBLE / count(*), 6) AS accuracy, {_COUNTS}
FROM b GROUP BY 1"""
)
def accuracy_all_rows(t):
    return rounded(scoring.score(labelled(t, A.last_integer), "gsm8k", ["l_returnflag"]))


@query(
    """SELECT l_shipmode AS grp, NULL::DOUBLE AS accuracy, n AS num_questions, n AS num_valid_predictions FROM (
  SELECT l_linestatus AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1)"""
)
def accuracy_without_labels(t):
    df = t.lineitem.select(F.col("l_linestatus").alias("grp"), F.lit("x").alias("reply"), F.lit(None).cast("string").alias("label"))
    none = F.col("label")
    return scoring.accuracy(df, ["grp"], A.same_integer(F.col("reply"), none), none, F.col("reply"))


# --- letters and texts ----------------------------------------------------------------------------------------

LETTERS_SQL = """letters AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, CASE o_orderkey % 9
    WHEN 0 THEN ' I think ' || chr((65 + o_custkey % 6)::INT) || ' fits' WHEN 1 THEN 'Answer: ' || chr((65 + o_custkey % 4)::INT) || ' '
    WHEN 2 THEN '(' || chr((97 + o_custkey % 4)::INT) || ')' WHEN 3 THEN '答案：' || chr((65 + o_custkey % 4)::INT) || 'xyz' WHEN 4 THEN 'zzz none'
    WHEN 5 THEN 'the best choice is nr ' || o_custkey WHEN 6 THEN 'Answer: B' || chr(10) || 'Answer: C ' WHEN 7 THEN '选择: ' || chr((65 + o_custkey % 4)::INT) || 'q'
    ELSE '  ' END AS reply, chr((65 + o_custkey % 4)::INT) AS label FROM orders)"""


def letters(t):
    k, c = F.col("o_orderkey") % 9, F.col("o_custkey")

    def char(base, mod):
        return F.char(F.lit(base) + c % mod)

    reply = (
        F.when(k == 0, F.concat(F.lit(" I think "), char(65, 6), F.lit(" fits")))
        .when(k == 1, F.concat(F.lit("Answer: "), char(65, 4), F.lit(" ")))
        .when(k == 2, F.concat(F.lit("("), char(97, 4), F.lit(")")))
        .when(k == 3, F.concat(F.lit("答案："), char(65, 4), F.lit("xyz")))
        .when(k == 4, "zzz none")
        .when(k == 5, F.concat(F.lit("the best choice is nr "), c.cast("string")))
        .when(k == 6, "Answer: B\nAnswer: C ")
        .when(k == 7, F.concat(F.lit("选择: "), char(65, 4), F.lit("q")))
        .otherwise("  ")
    )
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", reply.alias("reply"), char(65, 4).alias("label"))


_UP = "upper(trim(reply))"


def single(cls):
    return f"list_filter({ex('[\\p{L}\\p{N}_]+', 0, _UP)}, lambda w: regexp_matches(w, '^[{cls}]$'))[1]"


CEVAL_SQL = f"""coalesce({single('ABCD')}, {ex('答案[：:][ \\n]*([ABCD])', 1, _UP)}[1], {ex('ANSWER[：:][ \\n]*([ABCD])', 1, _UP)}[1], {ex('[ABCD]', 0, _UP)}[1])"""


def in_range(expr):
    return f"(CASE WHEN {expr} BETWEEN 'A' AND 'D' THEN {expr} END)"


MMSTAR_SQL = "coalesce(" + ", ".join(
    in_range(x)
    for x in (
        single("A-Z"),
        f"{ex('\\(([A-Z])\\)', 1, _UP)}[1]",
        f"{ex('\\[([A-Z])\\]', 1, _UP)}[1]",
        f"{ex('答案[：:][ \\n]*([A-Z])', 1, _UP)}[1]",
        f"{ex('选择[：:][ \\n]*([A-Z])', 1, _UP)}[1]",
    )
) + ")"
MARK_SQL = "CASE WHEN reply LIKE '%Answer: %' THEN trim(string_split(reply, 'Answer: ')[2], chr(10) || ' ') END"


@query(f"WITH {LETTERS_SQL} SELECT o_orderkey, {CEVAL_SQL} AS choice, {MMSTAR_SQL} AS bounded, {MARK_SQL} AS marked FROM letters")
def letter_answers(t):
    r = F.col("reply")
    return letters(t).select(
        "o_orderkey", A.choice_letter(r).alias("choice"), A.bounded_letter(r).alias("bounded"), A.after_answer_mark(r).alias("marked")
    )


def scored_letters(expr, over):
    return f"""WITH {LETTERS_SQL}, a AS (SELECT *, {expr} AS answer FROM letters)
SELECT o_orderstatus, round(count(*) FILTER (WHERE answer = label)::DOUBLE / {over}, 6) AS accuracy, {_COUNTS} FROM a GROUP BY 1"""


@query(scored_letters(CEVAL_SQL, "count(answer)"))
def accuracy_over_predictions(t):
    return rounded(scoring.score(letters(t), "ceval", ["o_orderstatus"]))


@query(scored_letters(MMSTAR_SQL, "count(label)"))
def accuracy_upper_case(t):
    return rounded(scoring.score(letters(t), "mmstar", ["o_orderstatus"]))


@query(scored_letters(MARK_SQL, "count(*)"))
def accuracy_marked(t):
    return rounded(scoring.score(letters(t), "gpqa", ["o_orderstatus"]))


# --- code ---------------------------------------------------------------------------------------------------

_F = "chr(96) || chr(96) || chr(96)"
CODE_SQL = f"""code AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'see ' || {_F} || 'python' || chr(10) || text || chr(10) || {_F} || ' end'
    WHEN 1 THEN text || chr(10) || 'def f' || doc_id || '(x):' || chr(10) || '  return x' || chr(10) || chr(10) || 'def g(y):' || chr(10) || '  pass'
    WHEN 2 THEN 'def f2(x): ' || text ELSE text END AS reply FROM documents)"""


def code_replies(t):
    d, text, fence = F.col("doc_id"), F.col("text"), "```"
    reply = (
        F.when(d % 4 == 0, F.concat(F.lit(f"see {fence}python\n"), text, F.lit(f"\n{fence} end")))
        .when(d % 4 == 1, F.concat(text, F.lit("\ndef f"), d.cast("string"), F.lit("(x):\n  return x\n\ndef g(y):\n  pass")))
        .when(d % 4 == 2, F.concat(F.lit("def f2(x): "), text))
        .otherwise(text)
    )
    return t.documents.select("doc_id", reply.alias("reply"))


def sql_strip(x):
    return f"regexp_replace(regexp_replace({x}, {S.lit(f'^[{SPACE_CHARS}]+')}, ''), {S.lit(f'[{SPACE_CHARS}]+$')}, '')"


CODE_EXPR = f"""coalesce({sql_strip(ex(A.FENCED_CODE) + '[1]')}, {sql_strip(ex(A.FUNCTION_CODE) + '[1]')}, nullif({sql_strip('reply')}, ''))"""


@query(f"WITH {CODE_SQL} SELECT doc_id, {CODE_EXPR} AS code FROM code")
def code_blocks(t):
    return code_replies(t).select("doc_id", A.code_block(F.col("reply")).alias("code"))


@query(
    f"""WITH {CODE_SQL}, c AS (SELECT doc_id, {CODE_EXPR} AS code, CASE WHEN doc_id % 8 = 2 THEN '' ELSE 'f' || doc_id END AS entry FROM code)
SELECT doc_id, CASE WHEN starts_with(code, 'def ') AND (entry = '' OR regexp_extract(code, '^def\\s+(\\w+)\\s*\\(', 1) = entry) THEN code
  ELSE 'def p():' || chr(10) || code END AS program FROM c"""
)
def candidate_programs(t):
    entry = F.when(F.col("doc_id") % 8 == 2, "").otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    df = code_replies(t).withColumns({"code": A.code_block(F.col("reply")), "entry": entry})
    return df.select("doc_id", A.candidate_program(F.lit("def p():"), F.col("code"), F.col("entry")).alias("program"))


# --- prompts -------------------------------------------------------------------------------------------------


@query(
    f"""WITH {S.PAIRS}, p AS (SELECT conv_id * 100 + turn AS idx, question, answer FROM pairs),
shots AS (SELECT string_agg('Question: ' || question || chr(10) || 'Answer: ' || answer || chr(10) || chr(10), '' ORDER BY idx) AS prefix FROM (SELECT * FROM p ORDER BY idx LIMIT 5))
SELECT idx, (SELECT prefix FROM shots) || 'Question: ' || question || chr(10) || 'Answer:' AS prompt FROM p"""
)
def few_shot_prompts(t):
    df = S.pairs(t).withColumn("idx", F.col("conv_id") * 100 + F.col("turn"))
    return P.few_shot_prompts(df, "idx", "question", "answer").select("idx", "prompt")


_CHOICE = f"""{S.lit(P.CHOICE_PROMPT)} || trim(q) || chr(10) || chr(10) || 'A) ' || trim(c[1]) || chr(10) || 'B) ' || trim(c[2]) || chr(10) || 'C) ' || trim(c[3]) || chr(10) || 'D) ' || trim(c[4])"""


@query(
    f"""WITH p AS (SELECT p_partkey, ' ' || p_name || ' ' AS q, [p_brand, ' ' || p_type, p_name || ' ', p_size::VARCHAR] AS c, p_size % 4 AS gold FROM part)
SELECT p_partkey, {_CHOICE} AS prompt, chr((65 + gold)::INT) AS label FROM p"""
)
def choice_prompts(t):
    c = F.array("p_brand", F.concat(F.lit(" "), "p_type"), F.concat("p_name", F.lit(" ")), F.col("p_size").cast("string"))
    q = F.concat(F.lit(" "), "p_name", F.lit(" "))
    return t.part.select("p_partkey", P.choice_prompt(q, c).alias("prompt"), P.letter(F.col("p_size") % 4).alias("label"))


@query(
    f"""WITH p AS (SELECT p_partkey, p_name AS q, (('0x' || md5('7:' || p_partkey)[1:7])::BIGINT % 4)::INT AS slot, [p_type, p_size::VARCHAR, p_name] AS w, p_brand AS r FROM part),
m AS (SELECT *, list_concat(list_concat(w[1:slot], [r]), w[slot + 1:3]) AS c FROM p)
SELECT p_partkey, {_CHOICE} AS prompt, chr(65 + slot) AS label FROM m"""
)
def gold_slot_prompts(t):
    slot = P.gold_slot(7, F.col("p_partkey"))
    c = P.with_gold([F.col("p_type"), F.col("p_size").cast("string"), F.col("p_name")], F.col("p_brand"), slot)
    return t.part.select("p_partkey", P.choice_prompt(F.col("p_name"), c).alias("prompt"), P.letter(slot).alias("label"))


@query(
    f"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS q, list_filter([p_brand, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END, CASE WHEN p_size % 5 < 4 THEN NULL ELSE p_name END], lambda x: x <> '') AS o,
  chr((65 + p_size % 6)::INT) AS l FROM part)
SELECT p_partkey, q || {S.lit(P.CHINESE_OPTIONS)} || array_to_string(list_transform(o, lambda x, i: chr(64 + i::INT) || '. ' || x || chr(10)), '') || {S.lit(P.CHINESE_ASK)} AS prompt, l AS label
FROM p WHERE q <> '' AND len(o) >= 2 AND l IN ('A', 'B', 'C', 'D')"""
)
def chinese_choice_prompts(t):
    s = F.col("p_size")
    options = F.array(
        "p_brand", F.when(s % 3 == 0, "").otherwise(F.col("p_type")), F.when(s % 5 >= 4, F.col("p_name"))
    )
    df = t.part.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.col("p_name")).alias("inputs"),
        options.alias("options"),
        F.concat(F.lit(" "), F.lower(F.char(F.lit(65) + s % 6))).alias("answer"),
    )
    return P.chinese_choice(df).select("p_partkey", "prompt", "label")


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE {S.lit(P.CONTEXT_PROMPT[0])} || {sql_strip('text')} || {S.lit(P.CONTEXT_PROMPT[1])} || lang END AS prompt,
  {sql_strip("chr(160) || text || chr(9)")} AS plain FROM documents"""
)
def context_prompts(t):
    context = F.when(F.col("doc_id") % 3 != 0, F.concat(F.col("text"), F.lit("\n")))
    padded = F.concat(F.lit(" "), "text", F.lit("\t"))
    return t.documents.select(
        "doc_id", P.context_prompt(context, F.col("lang")).alias("prompt"), P.plain_prompt(padded).alias("plain")
    )


@query(
    """SELECT conv_id, max(text) FILTER (WHERE turn = 0) AS question_1, max(text) FILTER (WHERE turn = 2) AS question_2
FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE turn = 2) > 0"""
)
def two_turn_prompts(t):
    c = t.conversations
    first = c.filter("turn = 0").select("conv_id", F.col("text").alias("a"))
    second = c.filter("turn = 2").select("conv_id", F.col("text").alias("b"))
    turns = first.join(second, "conv_id").withColumn("turns", F.array("a", "b"))
    return turns.select("conv_id", *P.two_turns(F.col("turns")))


_CFG = ", ".join(
    f"({S.lit(n)}, {S.lit(b.suffix)}, {b.max_tokens}, {len(b.stop)}, {'true' if b.system_prompt else 'false'})"
    for n, b in ((n, scoring.get_benchmark(n)) for n in scoring.benchmark_names())
)
_BENCH = "['aime', 'math500', 'gsm8k', 'ceval', 'gpqa', 'mmlu', 'humaneval', 'mtbench'][doc_id % 8 + 1]"


@query(
    f"""WITH cfg(bench, suffix, cap, stops, sys) AS (VALUES {_CFG}), q AS (SELECT doc_id, text, {_BENCH} AS bench FROM documents)
SELECT doc_id, bench, text || suffix AS prompt, cap::BIGINT AS max_tokens, stops::BIGINT AS stops, sys AS has_system FROM q JOIN cfg USING (bench)"""
)
def benchmark_requests(t):
    names = F.array(*[F.lit(x) for x in ("aime", "math500", "gsm8k", "ceval", "gpqa", "mmlu", "humaneval", "mtbench")])
    df = t.documents.select("doc_id", F.get(names, (F.col("doc_id") % 8).cast("int")).alias("bench"), F.col("text").alias("question"))
    return scoring.build_requests(df).select(
        "doc_id",
        "bench",
        "prompt",
        F.col("max_tokens").cast("bigint").alias("max_tokens"),
        F.size("stop").cast("bigint").alias("stops"),
        F.col("system_prompt").isNotNull().alias("has_system"),
    )


@query(
    """WITH q AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name ELSE p_name || ' Options: ' || 'A. ' || p_brand || chr(10) || 'B.' || p_type || chr(10) || 'x skip' || chr(10) || ' C. ' || p_size END AS full_q,
  ' ' || chr((97 + p_size % 6)::INT) AS a, CASE WHEN p_size % 4 = 0 THEN [] ELSE [p_brand, p_type, p_size::VARCHAR] END AS o FROM part)
SELECT p_partkey, trim(string_split(full_q, 'Options:')[1]) AS question, array_to_string(o, '|') AS options,
  CASE WHEN len(o) = 0 OR upper(trim(a)) <= chr((64 + len(o))::INT) THEN upper(trim(a)) END AS label FROM q"""
)
def option_split(t):
    s = F.col("p_size")
    full = F.when(s % 4 == 0, F.col("p_name")).otherwise(
        F.concat("p_name", F.lit(" Options: A. "), "p_brand", F.lit("\nB."), "p_type", F.lit("\nx skip\n C. "), s.cast("string"))
    )
    df = t.part.select("p_partkey", full.alias("q"), F.concat(F.lit(" "), F.char(F.lit(97) + s % 6)).alias("a"))
    df = df.withColumn("o", P.option_lines(F.col("q")))
    return df.select(
        "p_partkey",
        P.question_part(F.col("q")).alias("question"),
        F.array_join("o", "|").alias("options"),
        P.option_label(F.col("a"), F.col("o")).alias("label"),
    )


# --- run metrics -------------------------------------------------------------------------------------------------


def runs(t):
    """Answers made of events: type is the benchmark, user groups are runs."""
    u = F.col("user_id")
    return t.events.select(
        F.col("event_type").alias("bench"),
        (u % 3).alias("config"),
        (F.floor(u / 3) % 5).alias("run"),
        F.floor(F.col("value")).cast("bigint").alias("completion_tokens"),
        F.when(u % 3 > 0, F.floor(F.col("value") / (u % 3 + 1)).cast("bigint")).alias("spec_verify_ct"),
        ((F.floor(u / 3) % 5) * 1.5).alias("latency"),
    )


RUNS_SQL = """answers AS (
  SELECT event_type AS bench, user_id % 3 AS config, (user_id // 3) % 5 AS run, floor(value)::BIGINT AS tok,
    CASE WHEN user_id % 3 > 0 THEN floor(value / (user_id % 3 + 1))::BIGINT END AS ver, ((user_id // 3) % 5) * 1.5 AS latency FROM events),
metrics AS (
  SELECT bench, config, run, max(latency)::DOUBLE AS latency, sum(tok)::BIGINT AS output_tokens,
    CASE WHEN max(latency) > 0 THEN sum(tok) / max(latency)::DOUBLE ELSE 0 END AS output_throughput,
    CASE WHEN coalesce(sum(ver), 0) = 0 THEN 1.0 ELSE sum(tok)::DOUBLE / sum(ver) END AS accept_length, count(*) AS num_answers
  FROM answers GROUP BY 1, 2, 3)"""


@query(
    f"""WITH {RUNS_SQL} SELECT bench, config, run, latency, output_tokens, round(output_throughput, 6) AS output_throughput,
  round(accept_length, 6) AS accept_length, num_answers FROM metrics"""
)
def run_metrics(t):
    out = scoring.run_metrics(runs(t), ["bench", "config", "run"])
    return out.withColumns(
        {c: F.round(F.col(c).cast("double"), 6) for c in ("latency", "output_throughput", "accept_length")}
    )


@query(
    f"""WITH {RUNS_SQL} SELECT bench, config, round(avg(latency), 6) AS latency, round(avg(output_throughput), 6) AS output_throughput,
  round(avg(accept_length), 6) AS accept_length, round(avg(CASE WHEN run % 2 = 0 THEN run / 10.0::DOUBLE END), 6) AS accuracy FROM metrics GROUP BY 1, 2"""
)
def mean_over_runs(t):
    out = scoring.run_metrics(runs(t), ["bench", "config", "run"])
    out = out.withColumn("accuracy", F.when(F.col("run") % 2 == 0, F.col("run") / 10.0))
    means = scoring.mean_over_runs(out, ["bench", "config"])
    return means.withColumns(
        {c: F.round(F.col(c).cast("double"), 6) for c in ("latency", "output_throughput", "accept_length", "accuracy")}
    )


@query(
    """WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN lang || ':' || (doc_id % 50) ELSE lang || ':7:' || source || ',x' END AS spec FROM documents),
c(config, b, s, k, d) AS (VALUES ('1,0,0,0', 1, 0, 0, 0), ('1,3,1,4', 1, 3, 1, 4))
SELECT doc_id, config, string_split(spec, ':')[1] AS bench, string_split(spec, ':')[2]::BIGINT AS num_prompts, replace(string_split(spec, ':')[3], ',', '+') AS subsets,
  b::BIGINT AS batch_size, s.spec AS spec, c.s::BIGINT AS steps, k::BIGINT AS topk, d::BIGINT AS num_draft_tokens FROM s CROSS JOIN c"""
)
def run_plan(t):
    d = F.col("doc_id")
    spec = (
        F.when(d % 3 == 0, F.col("lang"))
        .when(d % 3 == 1, F.concat("lang", F.lit(":"), (d % 50).cast("string")))
        .otherwise(F.concat("lang", F.lit(":7:"), "source", F.lit(",x")))
    )
    out = scoring.run_plan(t.documents.select("doc_id", spec.alias("spec")), ["1,0,0,0", "1,3,1,4"])
    out = out.withColumn("subsets", F.when(F.col("subsets").isNotNull(), F.array_join("subsets", "+")))
    ints = ("num_prompts", "batch_size", "steps", "topk", "num_draft_tokens")
    return out.withColumns({c: F.col(c).cast("bigint") for c in ints})
