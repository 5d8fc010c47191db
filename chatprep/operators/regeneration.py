"""Replaying conversations through a caller-supplied model."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.functions.hashing import seeded_bucket

# Error texts, effort levels and their weights out of ten.
STARTS_WITH_ASSISTANT = "Data starts with an assistant message"
INVALID_ROLE = "Invalid message role: "
EFFORTS = (("low", 4), ("medium", 4), ("high", 2))
ROLES = ("system", "user", "assistant")


@dataclass(frozen=True)
class Sampling:
    """Request parameters; unset optional fields are not sent."""

    model: str
    max_tokens: int = 4096
    temperature: float = 0.7
    top_p: float | None = None
    top_k: int | None = None
    repetition_penalty: float | None = None

    def __post_init__(self) -> None:
        if not 0.0 <= self.temperature <= 1.0:
            raise ValueError("temperature must be between 0.0 and 1.0")
        if self.max_tokens <= 0:
            raise ValueError("max_tokens must be greater than 0")

    def request(self, effort: str | None = None) -> dict[str, Any]:
        out: dict[str, Any] = {
            "model": self.model,
            "max_tokens": self.max_tokens,
            "temperature": self.temperature,
            "stream": False,
            "top_p": self.top_p,
            "presence_penalty": self.repetition_penalty,
            "extra_body": None if self.top_k is None else {"top_k": self.top_k},
            "reasoning_effort": effort,
        }
        return {k: v for k, v in out.items() if v is not None}


def row_error(conversation: Column) -> Column:
    """Why a record cannot be replayed, or null."""
    roles = F.transform(conversation, lambda m: m["role"])
    strange = F.get(F.filter(roles, lambda r: ~F.coalesce(r.isin(*ROLES), F.lit(False))), F.lit(0))
    foreign = F.exists(roles, lambda r: ~F.coalesce(r.isin(*ROLES), F.lit(False)))
    return (
        F.when(F.coalesce(F.size(conversation), F.lit(0)) <= 0, F.lit("Empty conversation"))
        .when(F.get(roles, F.lit(0)) == "assistant", F.lit(STARTS_WITH_ASSISTANT))
        .when(foreign, F.concat(F.lit(INVALID_ROLE), F.coalesce(strange, F.lit("null"))))
    )


def row_errors_long(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """``(key, status, error)`` per conversation of a message table."""
    strange = F.when(~F.col(role).isin(*ROLES), F.col(order))
    head = turns.groupBy(key).agg(
        F.min_by(role, F.col(order)).alias("first_role"),
        F.min_by(F.when(strange.isNotNull(), F.col(role)), strange).alias("strange"),
    )
    error = F.when(F.col("first_role") == "assistant", F.lit(STARTS_WITH_ASSISTANT)).when(
        F.col("strange").isNotNull(), F.concat(F.lit(INVALID_ROLE), F.col("strange"))
    )
    return head.select(
        key, F.when(error.isNull(), "success").otherwise("error").alias("status"), error.alias("error")
    )


def validate(df: DataFrame, column: str = "conversations") -> DataFrame:
    """Add ``status`` and ``error``."""
    return df.withColumn("error", row_error(F.col(column))).withColumn(
        "status", F.when(F.col("error").isNull(), "success").otherwise("error")
    )


def prompt_skeletons(df: DataFrame, key: str = "id", column: str = "conversations") -> DataFrame:
    """One row per user turn: the system and user messages it is asked with.

    New replies are put between the user messages when the turn is replayed.
    """
    asked = F.filter(column, lambda m: m["role"].isin("system", "user"))
    valid = df.filter(row_error(F.col(column)).isNull()).select(key, asked.alias("__asked"))
    turns = F.filter(
        F.transform("__asked", lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull()
    )
    return valid.select(key, "__asked", F.posexplode(turns).alias("user_turn", "__at")).select(
        key, "user_turn", F.slice("__asked", F.lit(1), F.col("__at") + 1).alias("messages")
    )


def effort(seed: int | str, *key: Column) -> Column:
    """low, medium or high in the ratio 4 : 4 : 2, fixed by the key."""
    draw = seeded_bucket(seed, sum(w for _, w in EFFORTS), *key)
    out, upto = None, 0
    for name, weight in EFFORTS:
        upto += weight
        out = F.when(draw < upto, name) if out is None else out.when(draw < upto, name)
    return out


def assign_endpoint(endpoints: Sequence[str], *key: Column) -> Column:
    """Even spread of records over endpoints, stable under retries."""
    if not endpoints:
        raise ValueError("no endpoint is available")
    return F.get(F.array(*[F.lit(e) for e in endpoints]), seeded_bucket("endpoint", len(endpoints), *key).cast("int"))


def healthy(endpoints: Sequence[str], probe: Callable[[str], bool]) -> list[str]:
    """Endpoints that answer the caller's probe; an error when none does."""
    alive = [e for e in endpoints if probe(e)]
    if not alive:
        raise ValueError("no endpoint is available")
    return alive


def remaining(records: DataFrame, *done: DataFrame, key: str = "id") -> DataFrame:
    """Records that have neither a success nor an error yet."""
    for part in done:
        records = records.join(part.select(key), key, "left_anti")
    return records


def capped(records: DataFrame, key: str, n: int | None) -> DataFrame:
    """At most ``n`` of the remaining records, in key order."""
    return records if n is None else records.orderBy(key).limit(n)


REGENERATED = (
    "id string, conversations array<struct<role:string,content:string,reasoning_content:string>>, "
    "status string, error string"
)
Generate = Callable[[list[dict[str, Any]], dict[str, Any]], Any]


def replay(messages: Sequence[Any], generate: Generate, request: dict[str, Any], reasoning: bool) -> list[dict[str, Any]]:
    """New replies for one conversation, each asked with all earlier new ones."""
    out: list[dict[str, Any]] = []
    for m in messages:
        if m["role"] == "assistant":
            continue
        out.append({"role": m["role"], "content": m["content"], "reasoning_content": None})
        if m["role"] == "user":
            reply = generate([{k: v for k, v in x.items() if v is not None} for x in out], request)
            text, thought = reply if isinstance(reply, tuple) else (reply, None)
            out.append({"role": "assistant", "content": text, "reasoning_content": thought if reasoning else None})
    return out


def regenerate(
    records: DataFrame,
    generate: Generate,
    sampling: Sampling,
    concurrency: int = 64,
    reasoning: bool = False,
    effort_seed: int | str | None = None,
    endpoints: Sequence[str] = (),
) -> DataFrame:
    """Replay records in parallel: Spark spreads them, threads overlap the waiting.  Records that
    cannot be replayed are told by columns and never leave Spark.

    ``generate(messages, request)`` returns a text or ``(text, reasoning)``; an
    exception makes an error row.  Arrow batches are small so that a lost executor
    costs little.
    """
    base = validate(records.select(F.col("id").cast("string").alias("id"), "conversations"))
    base = base.withColumn(
        "effort", effort(effort_seed, F.col("id")) if effort_seed is not None else F.lit(None).cast("string")
    ).withColumn(
        "endpoint", assign_endpoint(endpoints, F.col("id")) if endpoints else F.lit(None).cast("string")
    )

    def one(row: Any) -> dict[str, Any]:
        keep = [{"role": m["role"], "content": m["content"], "reasoning_content": None} for m in row.conversations]
        request = sampling.request(row.effort)
        if row.endpoint:
            request["endpoint"] = row.endpoint
        try:
            made = replay(keep, generate, request, reasoning)
        except Exception as e:
            return {"id": row.id, "conversations": keep, "status": "error", "error": str(e)}
        return {"id": row.id, "conversations": made, "status": "success", "error": None}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                yield pd.DataFrame(list(pool.map(one, batch.itertuples(index=False))), columns=["id", "conversations", "status", "error"])

    refused = base.filter("status = 'error'").select(
        "id",
        F.transform(
            F.coalesce("conversations", F.array()),
            lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.lit(None).cast("string").alias("reasoning_content")),
        ).alias("conversations"),
        "status",
        "error",
    )
    return base.filter("status = 'success'").mapInPandas(run, REGENERATED).unionByName(refused)


def request_json(sampling: Sampling, effort: str | None = None) -> str:
    return json.dumps(sampling.request(effort), ensure_ascii=False)
