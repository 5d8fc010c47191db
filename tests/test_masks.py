"""Spans and masks against naive searches on random texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from chatprep.operators import spans as P
from chatprep.operators import templates as R
from chatprep.operators import tokens as T

HEAD, USER, END = "<A>", "<U>", "<E>\n"
TEMPLATE = R.ChatTemplate(HEAD, USER, None, END)
PIECES = ["foo", "bar", " ", "\n", "é", HEAD, USER, END, "<", "  ", "[Round 3] USER:", "x1", ".", "<T>"]
TOKEN = re.compile(r"\w+|[^\w\s]|\s+")


def offsets(text):
    return [m.span() for m in TOKEN.finditer(text)]


def naive_spans(text, style):
    q = re.escape
    pattern = {
        "general": q(HEAD) + r"([\s\S]*?(?:" + q(END) + "|$))",
        "round": q(HEAD) + r"([\s\S]*?(?:\[Round \d+\] USER:|$))",
        "strict": q(END + HEAD) + "(.*?)(?=" + q(END + USER) + "|$)",
    }[style]
    return [m.span(1) for m in re.finditer(pattern, text, re.DOTALL)]


def naive_mask(text, spans, how):
    mask = [0] * len(offsets(text))
    for s, e in spans:
        for i, (a, b) in enumerate(offsets(text)):
            hit = {
                "prefix": len(offsets(text[:s])) <= i < len(offsets(text[:e])),
                "containment": a >= s and b <= e,
                "overlap": not (b <= s or a > e),
            }[how]
            mask[i] = 1 if hit else mask[i]
    return mask


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(800)]
    return spark.createDataFrame([(t,) for t in made], "text string").cache()


@pytest.mark.parametrize("style", ["general", "round", "strict"])
def test_spans_and_masks(texts, style):
    text = F.col("text")
    df = texts.withColumn("sp", P.find_spans(text, P.span_rule(TEMPLATE, style)))
    hows = ["prefix", "containment", "overlap"]
    masks = [P.span_mask(text, F.col("sp"), T.token_count(text), how).alias(how) for how in hows]
    for row in df.select("text", "sp", *masks).collect():
        spans = naive_spans(row.text, style)
        assert [(s.start, s.end) for s in row.sp] == spans, row.text
        for how in hows:
            assert row[how] == naive_mask(row.text, spans, how), (row.text, how)


def test_last_span(texts):
    df = texts.select("text", P.last_span(P.find_spans(F.col("text"), P.span_rule(TEMPLATE))).alias("sp"))
    for row in df.collect():
        assert [(s.start, s.end) for s in row.sp] == naive_spans(row.text, "general")[-1:]


def test_literal_spans(texts):
    df = texts.select("text", P.literal_spans(F.col("text"), "<T>").alias("sp"))
    for row in df.collect():
        assert [(s.start, s.end) for s in row.sp] == [m.span() for m in re.finditer("<T>", row.text)]


def decoded(spark, template, messages, **options):
    """Supervised text of a rendered conversation."""
    df = spark.createDataFrame([(messages,)], "conversations array<struct<role:string,content:string>>")
    from chatprep.operators.turns import prepare

    df = prepare(df, template.system_prompt)
    df = df.withColumn("text", R.render_conversation(F.col("system"), F.col("messages"), template))
    out = P.masked_sample(df, template, **options).withColumn("tok", T.tokens(F.col("text"))).first()
    assert len(out.input_ids) == len(out.loss_mask) == len(out.attention_mask)
    return "".join(t for t, m in zip(out.tok, out.loss_mask) if m), out


CHAT = [
    ("user", "What is Python?"),
    ("assistant", "Python is a programming language."),
    ("user", "Thanks!"),
    ("assistant", "π ≈ 3.14, right."),
]


@pytest.mark.parametrize("name", ["qwen", "llama3", "llama4", "phi4", "gemma", "deepseek-v3", "longcat_xml"])
def test_supervised_text(spark, name):
    template = R.get_template(name)
    end = template.end_of_turn_token
    # White space between the header and the reply may share a token with the header.
    text, _ = decoded(spark, template, CHAT)
    assert text == f"Python is a programming language.{end}π ≈ 3.14, right.{end}"
    text, _ = decoded(spark, template, CHAT, last_only=True)
    assert text == f"π ≈ 3.14, right.{end}"


def test_truncation(spark):
    _, out = decoded(spark, R.get_template("qwen"), CHAT, max_length=40)
    assert len(out.input_ids) == 40


def test_template_without_end_token(spark):
    template = R.get_template("deepseek-r1-distill")
    text, _ = decoded(spark, template, CHAT)
    assert text == "Python is a programming language.π ≈ 3.14, right."


def test_mask_all_zero_without_reply(spark):
    text, out = decoded(spark, R.get_template("qwen"), CHAT[:1])
    assert text == "" and set(out.loss_mask) == {0}


def test_preformatted_text(spark):
    qwen = R.get_template("qwen")
    text = "<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\nHello.<|im_end|>\n"
    df = spark.createDataFrame([(text,)], "text string")
    row = P.masked_sample(df, qwen).withColumn("tok", T.tokens(F.col("text"))).first()
    assert "".join(t for t, m in zip(row.tok, row.loss_mask) if m) == "Hello.<|im_end|>\n"


def test_real_tokenizer(spark):
    pytest.importorskip("public_tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([("Größe π ok",), (None,), ("",)], "text string")
    encode = T.tokenizer_udf(T.tokenizer_file(path))
    rows = df.select("text", encode("text").alias("e")).collect()
    for row in rows:
        assert len(row.e.ids) == len(row.e.starts) == len(row.e.ends)
    assert rows[0].e.ends[-1] == len("Größe π ok")


def test_learnt_vocabulary_ids(spark):
    words = spark.createDataFrame([("a",), ("a",), ("b",), ("zz",)], "token string")
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "token string, token_id int")
    assert sorted(r.token_id for r in T.with_vocabulary(words, vocab).collect()) == [0, 1, 1, 2]


def test_masks_take_time_in_proportion_to_the_text(spark):
    """Ten times the replies take about ten times as long, not a hundred times."""
    import time

    template = R.get_template("qwen")
    one = f"{template.user_header}some question{template.end_of_turn_token}{template.assistant_header}a reply, here{template.end_of_turn_token}"
    took = {}
    for n in (2000, 2000, 20_000):  # the first run loads classes
        df = spark.range(1).select(F.repeat(F.lit(one), n).alias("text"))
        start = time.perf_counter()
        (row,) = P.masked_sample(df, template, max_length=None).select(F.size("loss_mask").alias("n"), F.aggregate("loss_mask", F.lit(0), lambda a, x: a + x).alias("ones")).collect()
        took[n] = time.perf_counter() - start
        assert row.ones == n * 12 and row.n % n == 0
    assert took[20_000] < 30 * took[2000] + 2


def meets(how, a, b, spans):
    if how == "prefix":
        return any(s <= a < e for s, e in spans)
    if how == "containment":
        return any(a >= s and b <= e for s, e in spans)
    return any(b > s and a <= e for s, e in spans)


@pytest.mark.parametrize("how", ["prefix", "containment", "overlap"])
def test_offset_masks(spark, how):
    """Tokens that share offsets, gaps between tokens, spans that touch, rows without spans or tokens."""
    rng = random.Random(how)
    rows = []
    for key in range(60):
        borders = sorted(rng.sample(range(200), 2 * rng.randint(0, 9)))
        spans = list(zip(borders[::2], borders[1::2]))
        if key % 5 == 0:  # the end of one is the start of the next
            spans = [(s, after[0]) for (s, _), after in zip(spans, spans[1:])] + spans[-1:]
        at = sorted(rng.choices(range(200), k=rng.choice([0, 1, 60])))
        rows.append((key, at, [x + rng.randint(0, 4) for x in at], spans))
    df = spark.createDataFrame(rows, "k int, starts array<int>, ends array<int>, spans array<struct<start:int,end:int>>")
    want = {k: [int(meets(how, a, b, sp)) for a, b in zip(s, e)] for k, s, e, sp in rows}
    got = df.select("k", P.offset_mask(F.col("starts"), F.col("ends"), F.col("spans"), how).alias("m")).collect()
    assert {r.k: r.m for r in got} == want
    tokens = df.select("k", F.posexplode(F.arrays_zip("starts", "ends")).alias("i", "o")).select("k", "i", F.col("o.starts").alias("start"), F.col("o.ends").alias("end"))
    spans = df.select("k", F.inline("spans"))
    swept = {(r.k, r.i): r["mask"] for r in P.offset_mask_rows(tokens, spans, ["k"], how).collect()}
    assert swept == {(k, i): m for k, ms in want.items() for i, m in enumerate(ms)}


def test_many_spans_cost_in_proportion(spark):
    """Ten times as many tokens and spans take far less than a hundred times as long."""

    def seconds(n):
        at = F.sequence(F.lit(0), F.lit(n - 1))
        spans = F.transform(at, lambda i: F.struct((3 * i).alias("start"), (3 * i + 2).alias("end")))
        df = spark.range(4).select(F.transform(at, lambda i: 3 * i).alias("s"), F.transform(at, lambda i: 3 * i + 1).alias("e"), spans.alias("sp")).repartition(2).cache()
        df.count()
        mask = P.offset_mask(F.col("s"), F.col("e"), F.col("sp"))
        begin = time.perf_counter()
        (total,) = df.select(F.sum(F.aggregate(mask, F.lit(0), lambda a, x: a + x))).first()
        assert total == 4 * n
        return time.perf_counter() - begin

    seconds(2000)
    assert seconds(20_000) < 30 * max(seconds(2000), 0.1)
