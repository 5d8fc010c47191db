"""Secret scans, in DataFrame functions only.

Fixed patterns give assignments, access keys and long hexadecimal runs.  On top of them, every
long run of key characters is compared under two character Markov models, one of random strings
and one of ordinary identifiers; where the log-likelihood ratio per step exceeds ``MARGIN`` the
run is a span of kind ``markov``.  The models are tables of character pairs, counted by Spark over
a bounded sample of documents (``SAMPLE``): values that the fixed patterns find there are labelled
random; words outside of them are labelled ordinary, and so are neighbouring words joined as
identifiers are (``a_b``, ``a-b``, ``a/b``, ``AB``, ``A_B``), which texts hardly hold.  The table is a
literal in the plan.

Places count code points, ends are exclusive.  All work but the training is row-local.  A null or
empty text has no spans; repeated rows are scanned row by row; an empty table gives no rows, and
without labelled samples the models fall back to even chances.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.functions.arrays import let
from chatprep.llm.common import first_rows, store
from chatprep.llm.native import running_sums
from chatprep.operators.common import pin

# The patterns and least sizes of the base spans.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_SIZE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of 20 and more from the first AKIA; shorter ones fail as a whole
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]
MARKS = ["password", "passwd", "secret", "token", "apikey", "api_key"]

RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
WORD = r"[A-Za-z0-9+/_-]{4,}"
SAMPLE = 4000  # documents the models are counted on, those of the smallest hashes of doc_id
CHARS = 66  # characters of runs, for smoothing
SMOOTH, EVEN = 0.5, 0.5  # pseudo-count of ordinary pairs; share of even chances in random ones
MARGIN = 1.5


def _cut(pattern: str, marked: Column) -> Column:
    """Where ``marked``: the stretches between matches and the matches, as arrays."""
    text = F.col("text")
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(marked, both)


def _spans(cut: Column, kind: int, keep=None) -> Column:
    """Structs ``(start, kind, end)`` of the matches for which ``keep`` holds."""
    hits, sizes = cut["hits"], F.transform(cut["hits"], F.char_length)
    count = F.size(hits)
    before = F.concat(F.array(F.lit(0)), sizes)
    steps = F.zip_with(F.slice(F.transform(cut["gaps"], F.char_length), 1, count), F.slice(before, 1, count), lambda g, h: g + h)
    rows = F.arrays_zip(running_sums(steps).alias("start"), sizes.alias("size"), hits.alias("hit"))
    rows = F.filter(rows, lambda r: keep(r["hit"])) if keep else rows
    made = F.transform(
        rows, lambda r: F.struct(r["start"].alias("start"), F.lit(kind).alias("kind"), (r["start"] + r["size"]).cast("long").alias("end"))
    )
    return F.when(F.size(hits) > 0, made).otherwise(none())


def none() -> Column:
    return F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")


def assigned(hit: Column) -> Column:
    return F.char_length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_SIZE


def _codes(run: Column) -> Column:
    return F.transform(F.split(run, ""), F.ascii)


def ratio(run: Column, table: Column) -> Column:
    """Mean log-likelihood ratio, random to ordinary, of the steps of a run."""
    codes = _codes(run)
    n = F.char_length(run) - 1
    steps = F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: F.element_at(table, a * 128 + b + 1))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / n


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts cut at the matches of each pattern; cheap tests keep most texts from being cut."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    low = pin(rows, low=F.lower("text"))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.col("low").contains(mark)
    flags = low.withColumn("_a", marked).drop("low")
    return pin(
        flags,
        assign=_cut(ASSIGN, F.col("_a")),
        access=_cut(ACCESS, F.col("text").contains("AKIA")),
        hex=_cut(HEX, F.col("text").rlike(HEX)),
        runs=_cut(RUN, F.col("text").rlike(RUN)),
    ).drop("_a")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Log-likelihood ratios by pair of ASCII codes (128 x 128), from the sample."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    chosen = store(first_rows(rows.select("doc_id").distinct(), "doc_id", SAMPLE), "secret-sample")
    sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi")  # at most SAMPLE ids
    # One text of each id, so that a repeated one weighs no more than others.
    sample = sample.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    cut = _marked(store(sample, "secret-sample-texts"), "doc_id", "text")
    empty = F.array().cast("array<string>")
    values = F.transform(F.filter(F.coalesce(cut["assign"]["hits"], empty), assigned), lambda h: F.regexp_extract(h, ASSIGN, 2))
    random = F.concat(values, F.coalesce(cut["access"]["hits"], empty), F.coalesce(cut["hex"]["hits"], empty))
    rest = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    ordinary = let(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0)), lambda words: F.concat(words, identifiers(words)))
    both = F.array(F.struct(F.lit(1).alias("random"), random.alias("words")), F.struct(F.lit(0).alias("random"), ordinary.alias("words")))
    words = cut.select(F.inline(both)).select("random", F.explode("words").alias("word"))
    words = words.groupBy("random", "word").agg(F.count("*").alias("n"))
    pairs = words.select(
        "random",
        "n",
        F.explode(
            F.zip_with(
                F.slice(_codes(F.col("word")), 1, F.char_length("word") - 1),
                F.slice(_codes(F.col("word")), 2, F.char_length("word") - 1),
                lambda a, b: a * 128 + b,
            )
        ).alias("pair"),
    )
    counted = pairs.groupBy("random", "pair").agg(F.sum("n").alias("n")).collect()  # 2 x 128 x 128 rows at most
    return ratios({(r.random, r.pair): r.n for r in counted})


def identifiers(words: Column) -> Column:
    """Neighbouring words joined in the ways of identifiers."""
    n = F.greatest(F.size(words) - 1, F.lit(0))

    def joined(change, between: str) -> Column:
        made = F.transform(words, change)
        return F.zip_with(F.slice(made, F.lit(1), n), F.slice(made, F.lit(2), n), lambda a, b: F.concat(a, F.lit(between), b))

    def capital(word: Column) -> Column:
        return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))

    ways = [(F.lower, "_"), (F.lower, "-"), (F.lower, "/"), (capital, ""), (F.upper, "_")]
    return F.concat(*[joined(change, between) for change, between in ways])


def ratios(counted: dict[tuple[int, int], int]) -> list[float]:
    rows: Counter = Counter()
    for (random, pair), n in counted.items():
        rows[random, pair // 128] += n
    out = []
    for pair in range(128 * 128):
        a, even = pair // 128, 1 / CHARS
        seen = counted.get((1, pair), 0) / rows[1, a] if rows[1, a] else even
        p_random = EVEN * even + (1 - EVEN) * seen
        p_ordinary = (counted.get((0, pair), 0) + SMOOTH) / (rows[0, a] + SMOOTH * CHARS)
        out.append(math.log(p_random / p_ordinary))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[float] | None = None) -> DataFrame:
    """``doc_id, base, spans``: sorted arrays of ``(start, kind, end)``; kinds index ``KINDS``."""
    model = F.lit(np.array(train(docs, id_col, text_col) if table is None else table))
    cut = _marked(docs, id_col, text_col).drop("text")
    base = F.concat(
        F.coalesce(_spans(F.col("assign"), 0, assigned), none()),
        F.coalesce(_spans(F.col("access"), 1), none()),
        F.coalesce(_spans(F.col("hex"), 2), none()),
    )
    found = pin(cut, base=F.array_sort(base), more=F.coalesce(_spans(F.col("runs"), 3, lambda h: ratio(h, model) > MARGIN), none()))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[float] | None = None) -> DataFrame:
    """The table with secrets in its texts replaced by ``<kind>``; all columns stay."""
    model = F.lit(np.array(train(docs, id_col, text_col) if table is None else table))
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    low = pin(held, low=F.lower("text"))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.col("low").contains(mark)

    def swap(rows: DataFrame, pattern: str, kind: int, where: Column, keep) -> DataFrame:
        cut = pin(rows, _cut=_cut(pattern, where))
        gaps, hits = F.col("_cut.gaps"), F.col("_cut.hits")
        swapped = F.transform(hits, lambda h: F.when(keep(h), F.lit(f"<{KINDS[kind]}>")).otherwise(h))
        whole = F.array_join(F.zip_with(gaps, F.concat(swapped, F.array(F.lit(""))), lambda g, h: F.concat(g, h)), "")
        return cut.withColumn("text", F.coalesce(whole, "text")).drop("_cut")

    rows = swap(low, ASSIGN, 0, marked, assigned).drop("low")
    rows = swap(rows, ACCESS, 1, F.col("text").contains("AKIA"), lambda h: F.lit(True))
    rows = swap(rows, HEX, 2, F.col("text").rlike(HEX), lambda h: F.lit(True))
    rows = swap(rows, RUN, 3, F.col("text").rlike(RUN), lambda h: ratio(h, model) > MARGIN)
    kept = [F.when(F.col("_row")[c].isNotNull(), F.col("text")).alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names]
    return rows.select(*kept)


def listed(spans: str) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
