"""Whole plans against a plain loop, with one conversation that holds most messages."""

import hashlib
import json
import random
import re
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatprep.operators.spans import masked_sample, span_rule
from chatprep.operators.templates import get_template, harmony_conversation, render_conversation, template_names
from chatprep.operators.turns import prepare
from chatprep.operators.vocabulary import frequency
from chatprep.plans.draft_vocabulary import supervised_words, training_samples
from chatprep.streaming import jobs

QWEN = get_template("qwen")
TOKEN = re.compile(r"\w+|[^\w\s]|\s+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for key in range(8):
        # The longest one crosses a block border of the ordered scan.
        for turn in range(5000 if key == 0 else rng.randint(1, 9)):
            role = "user" if turn % 2 == 0 else "assistant"
            if key and rng.random() < 0.1:
                role = rng.choice(["tool", "system", "assistant"])
            out.append((key, turn, role, " ".join(rng.choice(["ab", "c", "é", "x."]) for _ in range(rng.randint(0, 4)))))
    out.append((9, 0, "assistant", "never kept"))
    return out


def naive(rows, limit):
    by = {}
    for key, turn, role, text in sorted(rows):
        by.setdefault(key, []).append((role, text))
    heads = {"user": "<|im_start|>user\n", "system": "<|im_start|>system\n", "tool": "<|im_start|>tool\n", "assistant": "<|im_start|>assistant\n"}
    samples = {}
    for key, messages in by.items():
        kept = []
        if messages[0][0] == "system":
            kept, messages = [messages[0]], messages[1:]
        else:
            kept = [("system", QWEN.system_prompt)]
        before = None
        for role, text in messages:
            if before is None and role != "user":
                break
            if before and role == "tool" and before not in ("assistant", "tool"):
                break
            if before and role == "assistant" and before not in ("user", "tool"):
                break
            kept.append((role, text))
            before = role
        text = "".join(heads[r] + t + "<|im_end|>\n" for r, t in kept)
        spans = [m.span(1) for m in re.finditer(r"<\|im_start\|>assistant\n([\s\S]*?<\|im_end\|>\n)", text)]
        tokens, k = [], 0
        for m in TOKEN.finditer(text):
            while k < len(spans) and spans[k][1] <= m.start():
                k += 1
            inside = k < len(spans) and spans[k][0] <= m.start()
            tokens.append((m.group(), int(inside)))
        samples[key] = tokens[:limit]
    return samples


@pytest.mark.parametrize("limit", [64, 20000, None])
def test_supervised_words(spark, rows, limit):
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {r.token: r.n for r in frequency(supervised_words(df, QWEN, limit)).collect()}
    want = Counter(t for s in naive(rows, limit).values() for t, m in s if m)
    assert got == dict(want)


@pytest.mark.parametrize("limit", [5, 64, 2048])
def test_training_samples(spark, rows, limit):
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r.loss_mask for r in training_samples(df, QWEN, limit).collect()}
    assert got == {k: [m for _, m in s] for k, s in naive(rows, limit).items()}


@pytest.mark.parametrize("name", [n for n in template_names() if n != "gpt-oss"])
def test_message_form_equals_the_text_form(spark, name):
    """Samples from messages against a search of the rendered conversation."""
    template = get_template(name)
    rng = random.Random(name)
    head, stop = template.assistant_header or "", template.end_of_turn_token or ""
    bits = ["ab", "c d", "é", "x.", "[Round 3] USER:", head, stop, "<think>\n\n</think>\n\n", "\n", "</think>"]
    rows = []
    for key in range(60):
        roles = ["user" if i % 2 == 0 else "assistant" for i in range(rng.randint(1, 7))]
        if rng.random() < 0.3:
            roles.insert(0, "system")
        if rng.random() < 0.3:
            roles[rng.randrange(len(roles))] = rng.choice(["tool", "system", "assistant"])
        rows += [(key, i, r, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 5)))) for i, r in enumerate(roles)]
    message = F.struct("turn", "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("reasoning_content"))

    def both(rows, limit, last_only=False):
        turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
        chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("conversations"))
        texts = prepare(chats, template.system_prompt)
        texts = texts.withColumn("text", render_conversation(F.col("system"), F.col("messages"), template))
        samples = masked_sample(texts, template, max_length=limit, last_only=last_only), training_samples(turns, template, limit, last_only=last_only)
        return [{r.conv_id: (r.input_ids, r.loss_mask) for r in df.collect()} for df in samples]

    for limit in (40, 4000):
        want, got = both(rows, limit)
        assert got == want
    if not span_rule(template).carries:
        # One reply per message: the last reply is that of the last message with one.
        want, got = both([(k, i, r, x.replace(head, "") if head else x) for k, i, r, x in rows], 4000, last_only=True)
        assert got == want


@pytest.mark.parametrize("step", [1, 3000])
def test_channel_tagged_messages(spark, step):
    """Samples of messages against those of whole texts; a step of 3000 spreads a conversation over blocks."""
    rng, template = random.Random(step), get_template("gpt-oss")
    roles = ["user"] * 4 + ["assistant_analysis", "assistant_final", "assistant_commentary"] * 2 + ["system", "assistant_reasoning_effort"]
    texts = ["a b", "High", "", "x <|start|>assistant y", "q <|start|>user<|message|> r", "end <|end|>"]
    rows = [(k, i * step, rng.choice(roles[: rng.choice([10, 12])]), rng.choice(texts)) for k in range(60) for i in range(rng.randint(1, 9))]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    message = F.struct("turn", "role", F.col("text").alias("content"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("conversations"))
    whole = chats.select("conv_id", harmony_conversation(F.col("conversations")).alias("text"))
    for limit in (70, 4000):
        want = {r.conv_id: (r.input_ids, r.loss_mask) for r in masked_sample(whole, template, max_length=limit).collect()}
        got = {r.conv_id: (r.input_ids, r.loss_mask) for r in training_samples(turns, template, limit).collect()}
        assert got == want


def test_unseen_reads_the_ledger_and_never_the_sink(spark, tmp_path):
    """The sink is made unreadable between the runs, and so are the ledger's parts that no new key falls into."""
    (tmp_path / "in").mkdir()

    def land(name, *ids):
        lines = [json.dumps({"id": i, "conversations": [{"role": "user", "content": "a"}]}) for i in ids]
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join([*lines, "broken"]) + "\n")

    def run(state):
        build = lambda df: df.select("id")
        jobs.build_unseen(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / state), build, rejected=str(tmp_path / "bad")).awaitTermination()

    def part(i):
        return "part=" + hashlib.md5(i.encode()).hexdigest()[: jobs.LEDGER_DIGITS]

    def spoil(path):
        path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
        path.write_bytes(b"not a table")

    old = [str(i) for i in range(300)]
    land("1", *old, old[0])
    run("state")
    assert sorted(r.id for r in jobs.read_built(spark, str(tmp_path / "out")).collect()) == sorted(old)
    new = next(str(i) for i in range(300, 9000) if part(str(i)) == part(old[5]))
    files = [f for f in (tmp_path / "out.keys").rglob("*.parquet") if part(new) not in str(f)]
    for f in [*(tmp_path / "out").rglob("*.parquet"), *files]:
        spoil(f)
    (tmp_path / "in" / "1.jsonl").unlink()
    land("2", new, old[5])
    run("other")  # a checkpoint that has seen nothing
    made = [f for f in (tmp_path / "out").rglob("*.parquet") if f.read_bytes()[:4] == b"PAR1"]
    assert [r.id for r in spark.read.parquet(*map(str, made)).collect()] == [new]
    assert len(list((tmp_path / "bad").glob("run=*/batch=0"))) == 2


def test_streaming_counts_survive_a_retry(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{"id": "1", "conversations": [{"role": "assistant", "content": "a b a"}]}\n'
    (tmp_path / "in" / "1.jsonl").write_text(line)
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    jobs.count_tokens(*args).awaitTermination()
    (tmp_path / "in" / "2.jsonl").write_text(line + "broken\n")
    jobs.count_tokens(*args).awaitTermination()

    def totals():
        return {r.token: r.n for r in jobs.token_totals(spark, str(tmp_path / "out")).collect()}

    assert totals() == {"a": 4, " ": 4, "b": 2}
    jobs.compact_counts(spark, str(tmp_path / "out"))
    (tmp_path / "in" / "3.jsonl").write_text(line)
    jobs.count_tokens(*args).awaitTermination()
    assert totals() == {"a": 6, " ": 6, "b": 3}
    shutil.copytree(tmp_path / "out", tmp_path / "before")
    jobs.compact_counts(spark, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("run=*/batch=*"))) == 1 and totals() == {"a": 6, " ": 6, "b": 3}
    shutil.copytree(tmp_path / "before", tmp_path / "out", dirs_exist_ok=True)  # as if the old folders had not gone
    assert totals() == {"a": 6, " ": 6, "b": 3}
    jobs.count_tokens(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "new")).awaitTermination()
    assert totals() == {"a": 12, " ": 12, "b": 6}
