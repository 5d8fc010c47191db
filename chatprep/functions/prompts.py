"""Evaluation prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.functions.hashing import seeded_bucket
from chatprep.functions.text import SPACE_CHARS, strip

# Prompt texts of public benchmarks.
CHOICE_PROMPT = (
    "Answer the following multiple choice question. The last line of your response should be of "
    "the following format: 'Answer: $LETTER' (without quotes) where LETTER is one of ABCD. Think "
    "step by step before answering.\n\n"
)
CONTEXT_PROMPT = ("Given the following context:\n\n", "\n\nCan you answer the following question?\n\n")
CHINESE_OPTIONS, CHINESE_ASK = "\n\n选项：\n", "\n请从A、B、C、D中选择一个答案。"
REASON_SUFFIX = "\nPlease reason step by step, and put your final answer within \\boxed{}."
LETTERS = ("A", "B", "C", "D")


# --- few-shot --------------------------------------------------------------------------


def example(question: Column, answer: Column | None = None) -> Column:
    text = F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))
    return text if answer is None else F.concat(text, F.lit(" "), answer)


def few_shot_prefix(df: DataFrame, order: str, question: str, answer: str, k: int = 5) -> Column:
    """The first ``k`` rows with their answers, as one scalar."""
    first = df.orderBy(order).limit(k)
    shown = F.struct(F.col(order), F.concat(example(F.col(question), F.col(answer)), F.lit("\n\n")).alias("t"))
    texts = F.transform(F.sort_array(F.collect_list(shown)), lambda x: x["t"])
    return first.agg(F.array_join(texts, "")).scalar()


def few_shot_prompts(df: DataFrame, order: str, question: str, answer: str, k: int = 5) -> DataFrame:
    """Prefix every question (the shown ones too) with the first ``k`` examples."""
    prefix = few_shot_prefix(df, order, question, answer, k)
    return df.withColumn("prompt", F.concat(prefix, example(F.col(question))))


# --- multiple choice -----------------------------------------------------------------------


def choice_prompt(question: Column, choices: Column) -> Column:
    """Question and four options; everything stripped."""
    lines = [F.concat(F.lit(f"{a}) "), strip(F.get(choices, F.lit(i)))) for i, a in enumerate(LETTERS)]
    return F.concat(F.lit(CHOICE_PROMPT), strip(question), F.lit("\n\n"), F.concat_ws("\n", *lines))


def letter(index: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in LETTERS]), index.cast("int"))


def gold_slot(seed: int | str, *key: Column) -> Column:
    """Where the right answer goes: 0 to 3, fixed by the key."""
    return seeded_bucket(seed, len(LETTERS), *key).cast("int")


def with_gold(wrong: Sequence[Column], right: Column, slot: Column) -> Column:
    """The wrong answers with the right one put into its slot."""
    return F.array_insert(F.array(*wrong), (slot + 1).cast("int"), right)


def chinese_choice_prompt(question: Column, options: Column) -> Column:
    lines = F.transform(
        options, lambda x, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), x, F.lit("\n"))
    )
    return F.concat(question, F.lit(CHINESE_OPTIONS), F.array_join(lines, ""), F.lit(CHINESE_ASK))


def first_given(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of several possible columns that the table has."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    return F.lit(None).cast("string")


def chinese_choice(df: DataFrame) -> DataFrame:
    """Add ``prompt`` and ``label``; rows without a question, with fewer than two
    options or without an answer A to D are dropped."""
    question = first_given(df, ["question", "inputs", "problem", "content"])
    source = next((c for c in ("options", "choices") if c in df.columns), None)
    kind = df.schema[source].dataType.typeName() if source else None
    if kind in ("map", "struct"):
        raw = F.array(*[F.try_element_at(F.col(source), F.lit(x)) if kind == "map" else F.col(source)[x] for x in LETTERS])
    elif source:
        raw = F.col(source)
    else:
        raw = F.array(*[first_given(df, [x, f"option_{x}"]) for x in LETTERS])
    options = F.transform(F.filter(raw, lambda x: F.coalesce(x, F.lit("")) != ""), strip)
    label = F.upper(strip(first_given(df, ["answer", "target", "label", "correct"]).cast("string")))
    return (
        df.withColumns({"__o": options, "__l": label})
        .filter((F.coalesce(question, F.lit("")) != "") & (F.size("__o") >= 2) & F.col("__l").isin(*LETTERS))
        .withColumns({"prompt": chinese_choice_prompt(question, F.col("__o")), "label": F.col("__l")})
        .drop("__o", "__l")
    )


def question_part(text: Column) -> Column:
    """What stands before ``Options:``, stripped."""
    return strip(F.get(F.split(text, F.lit("Options:"), F.lit(2)), F.lit(0)))


def option_lines(text: Column) -> Column:
    """Option texts after ``Options:``: lines that start with a capital and a dot."""
    part = F.coalesce(F.get(F.split(text, F.lit("Options:"), F.lit(2)), F.lit(1)), F.lit(""))
    lines = F.transform(F.split(strip(part), F.lit("\n")), strip)
    kept = F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"\A[A-Z]\.")))
    return F.transform(kept, lambda x: strip(F.regexp_replace(x, rf"\A[A-Z]\.[{SPACE_CHARS}]*", "")))


def option_label(answer: Column, options: Column) -> Column:
    """The label when it is one capital letter within the options (if there are any)."""
    text = F.upper(strip(answer))
    top = F.char(F.lit(64) + F.size(options))
    good = F.regexp_like(text, F.lit(r"\A[A-Z]\z")) & ((F.size(options) <= 0) | (text <= top))
    return F.when(good, text)


# --- other prompts ------------------------------------------------------------------------


def context_prompt(context: Column, question: Column) -> Column:
    before, between = CONTEXT_PROMPT
    asked = strip(question)
    return F.when(context.isNull(), asked).otherwise(
        F.concat(F.lit(before), strip(context), F.lit(between), asked)
    )


def plain_prompt(text: Column) -> Column:
    return strip(text)


def two_turns(turns: Column) -> tuple[Column, Column]:
    return F.get(turns, F.lit(0)).alias("question_1"), F.get(turns, F.lit(1)).alias("question_2")
