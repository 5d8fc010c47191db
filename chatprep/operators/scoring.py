"""Benchmarks: registry, accuracy, run metrics and the run plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.functions import answers as A
from chatprep.functions import prompts as P
from chatprep.operators.common import pin
from chatprep.operators.templates import RESPECTFUL, literal_table

# --- accuracy ------------------------------------------------------------------------------

# What the number of matches is divided by.
LABELLED, PREDICTED, ALL = "labelled", "predicted", "all"


def accuracy(
    df: DataFrame,
    by: Sequence[str],
    match: Column,
    label: Column,
    prediction: Column,
    over: str = LABELLED,
) -> DataFrame:
    """Accuracy per group.

    ``labelled``: over rows with a label, null when no row has one.
    ``predicted``: over rows with a prediction, 0 when none has one.
    ``all``: over every row.
    """
    hits = F.sum(F.coalesce(match, F.lit(False)).cast("bigint"))
    if over == LABELLED:
        hits = F.sum((F.coalesce(match, F.lit(False)) & label.isNotNull()).cast("bigint"))
        value = F.try_divide(hits.cast("double"), F.count(label))
    elif over == PREDICTED:
        shown = F.sum((F.coalesce(match, F.lit(False)) & prediction.isNotNull()).cast("bigint"))
        value = F.coalesce(F.try_divide(shown.cast("double"), F.count(prediction)), F.lit(0.0))
    elif over == ALL:
        value = F.try_divide(hits.cast("double"), F.count("*"))
    else:
        raise ValueError(f"unknown denominator {over!r}")
    return df.groupBy(*by).agg(
        value.alias("accuracy"),
        F.count("*").alias("num_questions"),
        F.count(prediction).alias("num_valid_predictions"),
    )


# --- registry ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Benchmark:
    """How one benchmark is asked and scored; every part is a column function."""

    extract: Callable[[Column], Column] = lambda c: c
    match: Callable[[Column, Column], Column] = A.same_text
    over: str | None = ALL
    suffix: str = ""
    system_prompt: str | None = None
    stop: tuple[str, ...] = ()
    max_tokens: int = 2048
    answer_keys: tuple[str, ...] = ("answer",)


_BENCHMARKS: dict[str, Benchmark] = {
    "aime": Benchmark(
        A.boxed_integer, A.same_integer, LABELLED, suffix=P.REASON_SUFFIX, max_tokens=32768
    ),
    "math500": Benchmark(A.boxed_value, A.same_number, LABELLED),
    "gsm8k": Benchmark(A.last_integer, A.same_text, ALL, stop=("Question", "Assistant:", "<|separator|>")),
    "ceval": Benchmark(A.choice_letter, A.same_text, PREDICTED),
    "gpqa": Benchmark(A.after_answer_mark, A.same_text, ALL),
    "mmlu": Benchmark(A.after_answer_mark, A.same_text, ALL),
    "mmstar": Benchmark(A.bounded_letter, A.same_upper, LABELLED),
    "humaneval": Benchmark(A.code_block, over=None, max_tokens=1024),
    "mtbench": Benchmark(over=None, system_prompt=RESPECTFUL, answer_keys=("answer_1", "answer_2")),
    "financeqa": Benchmark(over=None),
    "livecodebench": Benchmark(over=None),
    "simpleqa": Benchmark(over=None),
}


def register_benchmark(name: str, override: bool = False, **parts) -> Benchmark:
    if name in _BENCHMARKS and not override:
        raise ValueError(f"benchmark {name!r} exists; pass override=True to replace it")
    _BENCHMARKS[name] = Benchmark(**parts)
    return _BENCHMARKS[name]


def get_benchmark(name: str) -> Benchmark:
    try:
        return _BENCHMARKS[name]
    except KeyError:
        raise ValueError(f"unknown benchmark {name!r}; known: {benchmark_names()}") from None


def benchmark_names() -> list[str]:
    return list(_BENCHMARKS)


def benchmark_table(spark: SparkSession) -> DataFrame:
    """Suffix, system prompt, stop texts and token cap per benchmark."""
    rows = [(n, b.suffix, b.system_prompt, list(b.stop), b.max_tokens) for n, b in _BENCHMARKS.items()]
    return literal_table(
        spark, rows, "bench string, suffix string, system_prompt string, stop array<string>, max_tokens int"
    )


def build_requests(questions: DataFrame, bench: str = "bench", question: str = "question") -> DataFrame:
    """Join questions with their benchmark's settings and append the suffix.

    The settings are code: their size does not depend on the data.  A question of a benchmark
    that is not registered is an error.
    """
    table = benchmark_table(questions.sparkSession).withColumnRenamed("bench", bench)
    unknown = F.raise_error(F.concat(F.lit("unknown benchmark "), F.coalesce(F.col(bench), F.lit("null")))).cast("string")
    known = questions.join(F.broadcast(table), bench, "left")
    return known.withColumn("suffix", F.coalesce("suffix", unknown)).withColumn(
        "prompt", F.concat(F.col(question), F.col("suffix"))
    )


def score(replies: DataFrame, bench: str, by: Sequence[str] = (), reply: str = "reply", label: str = "label") -> DataFrame:
    """Extract and score the replies of one benchmark."""
    b = get_benchmark(bench)
    found = pin(replies, prediction=b.extract(F.col(reply)))
    if b.over is None:
        return found.groupBy(*by).agg(
            F.lit(None).cast("double").alias("accuracy"),
            F.count("*").alias("num_questions"),
            F.count("prediction").alias("num_valid_predictions"),
        )
    return accuracy(found, by, b.match(F.col("prediction"), F.col(label)), F.col(label), F.col("prediction"), b.over)


# --- run metrics -----------------------------------------------------------------------------


def run_metrics(replies: DataFrame, by: Sequence[str], latency: str = "latency") -> DataFrame:
    """Throughput and accept length per run.

    One row per answer with ``completion_tokens`` and ``spec_verify_ct``; ``latency``
    is the same on all rows of a run.
    """
    tokens, verify = F.sum("completion_tokens"), F.sum("spec_verify_ct")
    seconds = F.max(latency)
    return replies.groupBy(*by).agg(
        seconds.alias("latency"),
        tokens.cast("bigint").alias("output_tokens"),
        F.when(seconds > 0, tokens / seconds).otherwise(0.0).alias("output_throughput"),
        F.when(F.coalesce(verify, F.lit(0)) == 0, F.lit(1.0)).otherwise(tokens / verify).alias("accept_length"),
        F.count("*").alias("num_answers"),
    )


def mean_over_runs(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of each metric over runs; accuracy over runs that have one."""
    names = ("latency", "output_throughput", "accept_length", "accuracy")
    return runs.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names])


# --- the run plan -----------------------------------------------------------------------------


def parse_benchmark_spec(spec: Column) -> Column:
    """``name[:count[:subset,subset]]`` as a struct; more parts are an error."""
    parts = F.split(spec, F.lit(":"), F.lit(-1))
    made = F.struct(
        F.get(parts, F.lit(0)).alias("bench"),
        F.get(parts, F.lit(1)).cast("int").alias("num_prompts"),
        F.split(F.get(parts, F.lit(2)), F.lit(","), F.lit(-1)).alias("subsets"),
    )
    bad = F.raise_error(F.concat(F.lit("invalid benchmark: "), spec))
    return F.when(F.size(parts) <= 3, made).otherwise(bad)


def parse_config_spec(spec: Column) -> Column:
    """``batch,steps,topk,draft`` as a struct of integers; other arities are an error."""
    parts = F.split(spec, F.lit(","), F.lit(-1))
    names = ("batch_size", "steps", "topk", "num_draft_tokens")
    made = F.struct(*[F.get(parts, F.lit(i)).cast("int").alias(n) for i, n in enumerate(names)])
    bad = F.raise_error(F.concat(F.lit("invalid configuration: "), spec))
    return F.when(F.size(parts) == 4, made).otherwise(bad)


def run_plan(benchmarks: DataFrame, configs: Sequence[str], spec: str = "spec") -> DataFrame:
    """Every benchmark at every configuration.

    Configurations are command-line values, so they are attached to each row as a
    literal list; no join is involved.
    """
    if not configs:
        raise ValueError("no configuration given")
    listed = F.array(*[F.lit(c) for c in configs])
    rows = benchmarks.select("*", F.explode(listed).alias("config"))
    return rows.select(
        "*", parse_benchmark_spec(F.col(spec)).alias("b"), parse_config_spec(F.col("config")).alias("c")
    ).select(*benchmarks.columns, "config", "b.*", "c.*")
