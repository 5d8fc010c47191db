"""Tokenizers: a regex tokenizer in SQL and Arrow wrappers around real ones."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from chatprep.functions.text import SPACE_CHARS, WORD_CHARS

# Fixed value: runs of word characters, single symbols, runs of white space.
TOKEN_PATTERN = rf"[{WORD_CHARS}]+|[^{WORD_CHARS}{SPACE_CHARS}]|[{SPACE_CHARS}]+"
_JOINED = rf"\A(?:[{WORD_CHARS}]{{2}}|[{SPACE_CHARS}]{{2}})\z"

HASH_IDS = 65536


def tokens(text: Column) -> Column:
    """Token texts; joined together they give the input back."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN_PATTERN)).cast("int")


def joins_at(text: Column, at: Column) -> Column:
    """True when the character before ``at`` and the one after belong to one token."""
    pair = F.substring(text, at.cast("int"), F.lit(2))
    return (at > 0) & F.regexp_like(pair, F.lit(_JOINED))


def hashed_id(token: Column) -> Column:
    """A vocabulary-free id in ``[0, 65536)``: the first 16 bits of the md5."""
    return F.conv(F.substring(F.md5(token), 1, 4), 16, 10).cast("int")


def hashed_ids(token_texts: Column) -> Column:
    return F.transform(token_texts, hashed_id)


@F.arrow_udf(ArrayType(IntegerType()))
def hashed_ids_batch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same for a column of whole token arrays: each distinct token of a batch is hashed once."""
    for batch in batches:
        words = batch.flatten().dictionary_encode()
        known = [None if w is None else int.from_bytes(md5(w.encode()).digest()[:2], "big") for w in words.dictionary.to_pylist()]
        ends = np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(batch), 0).to_numpy()]), dtype=np.int32)
        ids = pc.take(pa.array(known, pa.int32()), words.indices)
        yield pa.ListArray.from_arrays(pa.array(ends), ids, mask=batch.is_null())


# --- real tokenizers ------------------------------------------------------------

ENCODING = "ids array<int>, starts array<int>, ends array<int>"
Encoder = Callable[[list[str]], list[tuple[list[int], list[int], list[int]]]]
SLICE_CHARS = 1 << 18  # texts that are encoded at once; their encodings take many times their size


def text_slices(texts: pa.Array, most: int = SLICE_CHARS) -> Iterator[list[str]]:
    """The texts in order (null: empty), in lists of about ``most`` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _lists(rows: list) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    values = np.concatenate([np.asarray(r, np.int32) for r in rows])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def tokenizer_udf(load: Callable[[], Encoder]):
    """Column function ``text -> struct<ids, starts, ends>``.

    ``load`` runs once per task and returns a batch encoder; offsets are code
    points.  Rows arrive in Arrow batches, which are encoded and sent back slice by
    slice: a worker holds the encodings of one slice, not of a batch of whole texts.
    """

    @F.arrow_udf(ENCODING)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = load()
        for batch in batches:
            for texts in text_slices(batch):
                parts = [_lists(list(part)) for part in zip(*encoder(texts))]
                yield pa.StructArray.from_arrays(parts, names=["ids", "starts", "ends"])

    return encode


def tokenizer_file(path: str) -> Callable[[], Encoder]:
    """Loader for a ``tokenizers`` JSON file."""

    def load() -> Encoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()

        def encode(texts: list[str]):
            found = []
            for text in texts:
                e = tok.encode(text, add_special_tokens=False)
                borders = np.array(e.offsets, np.int32).reshape(-1, 2)
                found.append((np.array(e.ids, np.int32), borders[:, 0], borders[:, 1]))
            return found

        return encode

    return load


# --- a vocabulary learnt from the data --------------------------------------------


def with_vocabulary(words: DataFrame, vocab: DataFrame, token: str = "token", unknown: int = 0) -> DataFrame:
    """Token ids from a ``(token, token_id)`` table; missing tokens get ``unknown``.

    Store a learnt vocabulary first (``sources.files.keyed_stage``): the planner then knows its
    size, and it is not learnt once more.
    """
    return words.join(vocab.select(token, "token_id"), token, "left").withColumn(
        "token_id", F.coalesce("token_id", F.lit(unknown)).cast("int")
    )


def table_ids(
    df: DataFrame, key: str, column: str, vocab: DataFrame, name: str = "input_ids", token: str = "token", unknown: int = 0
) -> DataFrame:
    """Replace an array of token texts by their ids from a ``(token, token_id)`` table.

    Only the tokens cross the join; a row's array comes back as one group, as large as the
    array was.  ``key`` is unique.
    """
    rows = df.select(key, F.posexplode(column).alias("__pos", token))
    found = with_vocabulary(rows, vocab, token, unknown).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("__pos", "token_id"))).alias("__found")
    )
    ids = F.transform(F.coalesce("__found", F.array().cast("array<struct<__pos:int,token_id:int>>")), lambda x: x["token_id"])
    return df.join(found, key, "left").withColumn(name, ids).drop("__found", *([] if name == column else [column]))
