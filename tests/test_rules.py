"""Small rules: rendering, replay, extraction, vocabulary edges."""

import json

import pytest
from pyspark.sql import functions as F

from chatprep.functions import answers as A
from chatprep.functions import arrays as X
from chatprep.functions.text import strip, word_count
from chatprep.operators import regeneration as G
from chatprep.operators import samples as P
from chatprep.operators import scoring
from chatprep.operators import templates as R
from chatprep.operators import turns as C
from chatprep.operators import vocabulary as V

CONV = "array<struct<role:string,content:string>>"


def conversation(spark, *roles):
    return spark.createDataFrame([([(r, str(i)) for i, r in enumerate(roles)],)], f"conversations {CONV}")


@pytest.mark.parametrize(
    "roles, kept",
    [
        (["assistant", "user"], 0),
        (["user", "user", "assistant"], 3),
        (["user", "assistant", "assistant"], 2),
        (["user", "tool"], 1),
        (["system", "user", "assistant"], 2),
        (["system", "system"], 0),
        (["user", "assistant", "tool", "tool", "assistant"], 5),
        (["user", "other", "assistant"], 2),
        ([], 0),
    ],
)
def test_valid_prefix(spark, roles, kept):
    df = conversation(spark, *roles)
    (n,) = df.select(F.size(C.valid_prefix(C.body(F.col("conversations"))))).first()
    assert n == kept


def test_system_prompt(spark):
    df = conversation(spark, "system", "user")
    assert df.select(C.system_prompt(F.col("conversations"), "t")).first()[0] == "0"
    df = conversation(spark, "user")
    assert df.select(C.system_prompt(F.col("conversations"), "t")).first()[0] == "t"
    assert df.select(C.system_prompt(F.col("conversations"), "")).first()[0] is None


def test_harmony(spark):
    def text(*messages):
        df = spark.createDataFrame([(list(messages),)], f"c {CONV}")
        return df.select(R.harmony_conversation(F.col("c"))).first()[0]

    low = text(("user", "hi"), ("assistant_final", "yo"))
    assert "Reasoning: low" in low
    assert low.endswith("<|start|>user<|message|>hi<|end|><|start|>assistant<|channel|>final<|message|>yo<|end|>")
    assert text(("system", "S"), ("user", "hi")).startswith("<|start|>system<|message|>S<|end|><|start|>user")
    assert "Reasoning: high" in text(("assistant_reasoning_effort", "HIGH"), ("user", "x"))
    assert text(("user", "lost"), ("system", "S")) == "<|start|>system<|message|>S<|end|>"
    for bad in ([("user", "a"), ("who", "b")], [("who", "b"), ("system", "c")]):
        with pytest.raises(Exception, match="Unknown role"):
            text(*bad)


def test_harmony_segments(spark):
    df = spark.createDataFrame([("plain",), ("<|channel|> a <|message|> b\nc <|end|>x<|channel|>f<|message|>d<|end|>",)], "t string")
    rows = [[tuple(s) for s in r[0]] for r in df.select(R.harmony_segments(F.col("t"))).collect()]
    assert rows == [[("text", "plain")], [("a", "b\nc"), ("f", "d")]]


def test_thinking_header_is_not_doubled(spark):
    opened = R.get_template("qwen3.5")
    text = R.render_message(F.lit("assistant"), F.lit("ok"), opened, F.lit("hm"))
    assert spark.range(1).select(text).first()[0].count("<think>") == 1


def test_strip_and_words(spark):
    cases = ["  a b ", " x　", "\x1fy\n", "", "a\n\nb\tc"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    for c, s, n in df.select("t", strip(F.col("t")), word_count(F.col("t"))).collect():
        assert s == c.strip() and n == len(c.split())


# --- replay --------------------------------------------------------------------------------


def test_sampling_request():
    full = G.Sampling("m", 10, 0.5, top_p=0.9, top_k=5, repetition_penalty=1.1).request("low")
    assert full["presence_penalty"] == 1.1 and full["extra_body"] == {"top_k": 5} and full["reasoning_effort"] == "low"
    assert set(G.Sampling("m").request()) == {"model", "max_tokens", "temperature", "stream"}
    assert json.loads(G.request_json(G.Sampling("m")))["model"] == "m"
    for bad in ({"temperature": 1.5}, {"max_tokens": 0}):
        with pytest.raises(ValueError):
            G.Sampling("m", **bad)


def test_endpoints(spark):
    assert G.healthy(["a", "b"], lambda e: e == "b") == ["b"]
    with pytest.raises(ValueError):
        G.healthy(["a"], lambda e: False)
    with pytest.raises(ValueError):
        G.assign_endpoint([], F.lit(1))


def test_replay(spark):
    rows = [
        ("1", [("system", "s"), ("user", "a"), ("assistant", "old"), ("user", "b")]),
        ("2", [("assistant", "x")]),
        ("3", [("user", "fail")]),
        ("4", [("user", "a"), ("tool", "t")]),
        ("5", []),
    ]
    df = spark.createDataFrame(rows, f"id string, conversations {CONV}")

    def model(messages, request):
        if messages[-1]["content"] == "fail":
            raise RuntimeError("no answer")
        return f"re:{len(messages)}:{messages[-1]['content']}", "thought"

    out = {r.id: r for r in G.regenerate(df, model, G.Sampling("m"), reasoning=True, endpoints=["e"]).collect()}
    one = [(m.role, m.content, m.reasoning_content) for m in out["1"].conversations]
    assert one == [
        ("system", "s", None),
        ("user", "a", None),
        ("assistant", "re:2:a", "thought"),
        ("user", "b", None),
        ("assistant", "re:4:b", "thought"),
    ]
    assert out["2"].error == G.STARTS_WITH_ASSISTANT and out["3"].error == "no answer"
    assert out["4"].error == "Invalid message role: tool" and out["5"].error == "Empty conversation"
    assert [out[i].status for i in "12345"] == ["success", "error", "error", "error", "error"]


# --- extraction ------------------------------------------------------------------------------

EXTRACT = [
    (A.boxed_integer, r"\boxed{12}", "12"),
    (A.boxed_integer, r"\boxed{x = 3, y = 4}", "4"),
    (A.boxed_integer, r"\boxed{a}", "a"),
    (A.boxed_integer, r"\boxed 12", "12"),
    (A.boxed_integer, "The answer is 42", "42"),
    (A.boxed_integer, "Answer: 7 or 5000", "7"),
    (A.boxed_integer, "so x=12\n", "12"),
    (A.boxed_integer, "1234 then 56 then 7890", "56"),
    (A.boxed_integer, "none", None),
    (A.boxed_value, r"\boxed{ -1.5 }", "-1.5"),
    (A.boxed_value, r"\boxed x+1 ok", "x+1"),
    (A.boxed_value, "answer: -3.25.", "-3.25"),
    (A.boxed_value, "1,234", "234"),
    (A.last_integer, "1,234", "1234"),
    (A.last_integer, "agent 007", A.INVALID_INTEGER),
    (A.last_integer, "00", "0"),
    (A.last_integer, "no number", A.INVALID_INTEGER),
    (A.last_integer, "9" * 60, "9" * 60),
    (A.choice_letter, "(C)", "C"),
    (A.choice_letter, "答案：D", "D"),
    (A.choice_letter, "I said b", "B"),
    (A.choice_letter, "xyz", None),
    (A.choice_letter, "zebra", "B"),
    (A.bounded_letter, "Z", None),
    (A.bounded_letter, "[D]", "D"),
    (A.after_answer_mark, "Answer: B", "B"),
    (A.after_answer_mark, "x Answer:  A \n Answer: C", "A"),
    (A.after_answer_mark, "none", None),
    (A.code_block, "a\n```python\nx = 1\n```b", "x = 1"),
    (A.code_block, "t\ndef f(a):\n  return a\n\ndef g(): 1", "def f(a):\n  return a"),
    (A.code_block, "  ", None),
]


def test_extraction(spark):
    for fn, text, want in EXTRACT:
        got = spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]
        assert got == want, (fn.__name__, text, got)


def test_bounded_by_options(spark):
    df = spark.createDataFrame([("E", 5), ("E", 3), ("E", None)], "t string, n int")
    got = [r[0] for r in df.select(A.bounded_letter(F.col("t"), F.col("n"))).collect()]
    assert got == ["E", None, None]


def test_matching(spark):
    pairs = [("12", "12"), ("+012", "12"), ("1_000", "1000"), ("1.0", "1"), ("ABC", "abc"), (None, "1"), ("-0", "0")]
    df = spark.createDataFrame(pairs, "p string, l string")
    p, x = F.col("p"), F.col("l")
    assert [r[0] for r in df.select(A.same_integer(p, x)).collect()] == [True, True, True, False, False, False, True]
    assert [r[0] for r in df.select(A.same_number(p, x)).collect()] == [True, True, False, True, True, False, True]


def test_candidate_program(spark):
    cases = [("def f(x): 1", "f", "def f(x): 1"), ("def g(x): 1", "f", "P\ndef g(x): 1"), ("return 1", "f", "P\nreturn 1"), ("def g(): 1", "", "def g(): 1")]
    df = spark.createDataFrame(cases, "code string, entry string, want string")
    for got, want in df.select(A.candidate_program(F.lit("P"), F.col("code"), F.col("entry")), "want").collect():
        assert got == want


def test_benchmark_registry(spark):
    assert len(scoring.benchmark_names()) == 12
    with pytest.raises(ValueError):
        scoring.register_benchmark("aime")
    scoring.register_benchmark("mine", extract=A.last_integer)
    df = spark.createDataFrame([("is 4", "4"), ("is 5", "4")], "reply string, label string")
    assert scoring.score(df, "mine").first().accuracy == 0.5
    scoring._BENCHMARKS.pop("mine")


def test_no_predictions_and_no_labels(spark):
    df = spark.createDataFrame([("zzz", "A")], "reply string, label string")
    assert scoring.score(df, "ceval").first().accuracy == 0.0
    df = spark.createDataFrame([("1", None)], "reply string, label string")
    assert scoring.score(df, "aime").first().accuracy is None


def test_run_metrics_edges(spark):
    kind = "run int, completion_tokens int, spec_verify_ct int, latency double"
    df = spark.createDataFrame([(1, 10, None, 0.0), (2, 10, 0, 2.0), (3, 12, 4, 2.0)], kind)
    rows = {r.run: (r.output_throughput, r.accept_length) for r in scoring.run_metrics(df, ["run"]).collect()}
    assert rows == {1: (0.0, 1.0), 2: (5.0, 1.0), 3: (6.0, 3.0)}


@pytest.mark.parametrize("spec", ["a:b:c:d"])
def test_bad_specs(spark, spec):
    df = spark.createDataFrame([(spec,)], "spec string")
    with pytest.raises(Exception, match="invalid benchmark"):
        scoring.run_plan(df, ["1,2,3,4"]).collect()
    good = spark.createDataFrame([("a",)], "spec string")
    with pytest.raises(Exception, match="invalid configuration"):
        scoring.run_plan(good, ["1,2,3"]).collect()


# --- samples and vocabulary ---------------------------------------------------------------------


def test_shift_trim_pad(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "a array<int>")
    a = F.col("a")
    rows = df.select(X.shift_left(a), X.shift_right(a), X.trim_mask(a, 2), X.pad_right(a, F.lit(4)), X.shift_left(a, 5)).collect()
    assert list(rows[0]) == [[2, 3, 0], [0, 1, 2], [1, 0], [1, 2, 3, 0], [0, 0, 0]]
    assert list(rows[1]) == [[], [], [], [0, 0, 0, 0], []]


def test_few_anchors_fail(spark):
    df = spark.createDataFrame([("1", [1, 2, 3], [0, 1, 0])], "id string, input_ids array<int>, loss_mask array<int>")
    out = P.anchors(df, "id", 2, 4)
    assert out.first().anchors == []
    with pytest.raises(Exception, match="too few supervised"):
        P.require_anchors(out).collect()


def test_padding_and_coverage(spark):
    freq = spark.createDataFrame([(5, 3), (1, 2)], "token bigint, n bigint")
    assert sorted(map(tuple, V.pad_frequency(freq, 4).collect())) == [(0, 0), (1, 2), (2, 0), (5, 3)]
    assert sorted(map(tuple, V.pad_frequency(freq, 2).collect())) == [(1, 2), (5, 3)]
    assert V.coverage(freq, 1).first().coverage == 0.6
    assert V.coverage(freq.filter("n > 9"), 3).first().coverage == 0.0
    zero = spark.createDataFrame([([1, 2], [0, 0])], "input_ids array<int>, loss_mask array<int>")
    assert V.supervised_tokens(zero).count() == 0
