"""Named sources: where rows come from is the caller's choice, what to do with
them is looked up here."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.sources import normalise as N
from chatprep.sources.files import load_by_suffix

Normaliser = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Source:
    normaliser: Normaliser
    subsets: tuple[str, ...] = ()
    renames: Mapping[str, str] | None = None
    index_id: bool = False


# Subset names of public sources.
CODE_SUBSETS = ("largescale_diverse_instruct", "filtered_infinity_instruct", "realuser_instruct")
MATH_SUBSETS = (
    "algebra",
    "counting_and_probability",
    "geometry",
    "intermediate_algebra",
    "number_theory",
    "prealgebra",
    "precalculus",
)
SCIENCE_SUBSETS = ("biology", "chemistry", "physics")

_SOURCES: dict[str, Source] = {
    "ultrachat": Source(N.messages_strict),
    "sharegpt": Source(N.from_value),
    "eaglechat": Source(N.passthrough),
    "perfectblend": Source(N.from_value, index_id=True),
    "perfectblend-llama3.1-8b-instruct": Source(N.passthrough, index_id=True),
    "perfectblend-llama3.3-70b-instruct": Source(N.passthrough, index_id=True),
    "perfectblend-llama4-scout-instruct": Source(N.passthrough, index_id=True),
    "perfectblend-llama4-maverick-instruct": Source(N.passthrough, index_id=True),
    "magpie-qwen2.5-pro-1m-v0.1": Source(N.from_value, renames={"uuid": "id"}),
    "sharegpt4v": Source(N.with_image),
    "allava4v": Source(N.with_image),
    "opc": Source(N.pair_source("instruction", "output"), CODE_SUBSETS),
    "gsm8k": Source(N.pair_source("question", "answer")),
    "hendrycks_math": Source(N.pair_source("problem", "solution"), MATH_SUBSETS),
    "math_qa": Source(N.question_with_options),
    "codealpaca-20k": Source(N.pair_source("instruction", "output")),
    "opencodeinstruct": Source(N.pair_source("input", "output", "id")),
    "magicoder-evol-instruct": Source(N.pair_source("instruction", "response")),
    "sciq": Source(N.shuffled_options),
    "camel": Source(N.pair_source("message_1", "message_2"), SCIENCE_SUBSETS),
}


def source_names() -> list[str]:
    return list(_SOURCES)


def register_source(name: str, normaliser: Normaliser, override: bool = False, **fields) -> None:
    if name in _SOURCES and not override:
        raise ValueError(f"source {name!r} exists; pass override=True to replace it")
    _SOURCES[name] = Source(normaliser, **fields)


def get_source(name: str) -> Source:
    try:
        return _SOURCES[name]
    except KeyError:
        raise ValueError(f"unknown source {name!r}; known: {source_names()}") from None


def concatenate(parts: Mapping[str, DataFrame], tag: str = "subset") -> DataFrame:
    """Union by column name, each part tagged with its name."""
    if not parts:
        raise ValueError("no subset could be loaded")
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def load_subsets(
    load: Callable[[str], DataFrame], names: Sequence[str], skip_missing: bool = False
) -> DataFrame:
    """Load and concatenate subsets.

    With ``skip_missing`` those whose path is not there are left out, and named in a warning; it
    is an error when none is left.  Any other failure is raised.
    """
    parts: dict[str, DataFrame] = {}
    gone = []
    for name in names:
        try:
            parts[name] = load(name)
        except AnalysisException as error:
            if not skip_missing or error.getCondition() != "PATH_NOT_FOUND":
                raise
            gone.append(name)
    if gone:
        warnings.warn(f"subsets without data: {', '.join(gone)}", stacklevel=2)
    return concatenate(parts)


def rename(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(renames))


def normalise(name: str, df: DataFrame) -> DataFrame:
    """Raw rows of a named source to canonical records.

    Sources without an id column get a content id, the md5 of their messages, in
    place of a row number: it needs no global order and survives re-reading.
    """
    source = get_source(name)
    if source.renames:
        df = rename(df, source.renames)
    if source.index_id and "id" not in df.columns:
        df = df.withColumn("id", F.md5(F.to_json("conversations")))
    return source.normaliser(df)


def read_source(spark, name: str, path: str, subset: str | None = None) -> DataFrame:
    """Read and normalise a named source.

    ``path`` is a file or directory for a single table, or a format string with
    ``{subset}`` for sources made of subsets.
    """
    source = get_source(name)
    if "{subset}" not in path:
        return normalise(name, load_by_suffix(spark, path))
    names = source.subsets if subset in (None, "all") else (subset,)
    unknown = [n for n in names if source.subsets and n not in source.subsets]
    if unknown:
        raise ValueError(f"{name!r} has no subset {unknown}")
    return normalise(name, load_subsets(lambda n: load_by_suffix(spark, path.format(subset=n)), names))
