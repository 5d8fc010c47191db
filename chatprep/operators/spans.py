"""Which characters, and then which tokens, of a rendered text are supervised.

All but ``offset_mask_rows`` is row-local (``masked_sample`` hashes ids by Arrow batches).  One pattern cuts the text into consecutive pieces

    gap, header, reply, terminator

and always matches, so a text without a header costs one pass and not one pass
per position.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.functions.arrays import let, ones, prefix_sums, zero_ranges, zeros
from chatprep.functions.text import quote_regex
from chatprep.operators.common import pin
from chatprep.operators.packs import masked_rows
from chatprep.operators.templates import ChatTemplate
from chatprep.operators.tokens import hashed_ids_batch, joins_at, token_count, tokens

CHUNK = 1024  # characters

# The round marker and the tags of channel-tagged text.
ROUND_MARKER = r"\[Round \d+\] USER:"
HARMONY_ASSISTANT = "<|start|>assistant"
HARMONY_USER = "<|start|>user<|message|>"

# An open reply ends with the text, before one final line break.
_TEXT_END = r"\n?\z"


@dataclass(frozen=True)
class SpanRule:
    """A reply starts after ``header`` and stops at ``terminator``.

    ``pattern`` is the terminator as a regular expression when it is not a plain
    text; ``included`` says whether the terminator belongs to the reply; ``how`` maps
    its characters to tokens (see :func:`token_ranges`).
    """

    header: str
    terminator: str | None = None
    pattern: str | None = None
    included: bool = True
    how: str = "prefix"

    @property
    def carries(self) -> bool:
        """Whether a reply may run on beyond the end of its own message."""
        return self.pattern is not None or not self.terminator or not self.included

    def stop_pattern(self) -> str | None:
        return self.pattern or (quote_regex(self.terminator) if self.terminator else None)

    def piece_pattern(self) -> str:
        stop = self.stop_pattern()
        stop = f"{stop}|{_TEXT_END}" if stop else _TEXT_END
        return rf"(?s).*?(?:{quote_regex(self.header)}.*?(?:{stop})|\z)"


def span_rule(template: ChatTemplate, style: str | None = None) -> SpanRule:
    """Rule of a template; ``style`` is general, round, harmony or strict."""
    if style is None:
        if template.parser_type == "openai-harmony":
            style = "harmony"
        else:
            style = "round" if template.assistant_pattern_type == "longcat" else "general"
    end, user = template.end_of_turn_token or "", template.user_header or ""
    assistant = template.assistant_header or ""
    if style == "harmony":
        return SpanRule(HARMONY_ASSISTANT, HARMONY_USER, included=False, how="containment")
    if style == "strict":
        return SpanRule(end + assistant, end + user, included=False, how="overlap")
    if style == "round":
        return SpanRule(assistant, pattern=ROUND_MARKER)
    if style == "general":
        # Without an end token the reply runs to the next user header.
        return SpanRule(assistant, end or user or None, included=bool(end))
    raise ValueError(f"unknown span style {style!r}")


def find_spans(text: Column, rule: SpanRule) -> Column:
    """``array<struct<start, end>>``: zero-based, end exclusive, in text order.

    A second header inside an open span does not start another one.
    """
    pieces = F.regexp_extract_all(text, F.lit(rule.piece_pattern()), F.lit(0))
    head = len(rule.header)

    def measure(p: Column) -> Column:
        at = F.locate(rule.header, p)
        lead = at - 1 + head
        size = F.length(p)
        if rule.pattern:
            closed = F.regexp_like(p, F.lit(f"(?:{rule.pattern})\\z"))
            tail = F.lit(0)
        else:
            stop = rule.terminator or ""
            closed = F.endswith(p, F.lit(stop)) & (lead + len(stop) <= size) & F.lit(bool(stop))
            tail = F.lit(0 if rule.included else len(stop))
        broken = F.endswith(p, F.lit("\n")) & (lead < size)
        cut = F.when(closed, tail).when(broken, 1).otherwise(0)
        return F.struct(
            (at > 0).alias("hit"), lead.alias("lead"), (size - cut).alias("stop"), size.alias("size")
        )

    def place(ps: Column) -> Column:
        at = F.slice(prefix_sums(F.transform(ps, lambda p: p["size"])), F.lit(1), F.size(ps))
        placed = F.filter(F.arrays_zip(ps.alias("p"), at.alias("at")), lambda x: x["p"]["hit"])
        return F.transform(
            placed,
            lambda x: F.struct(
                (x["at"] + x["p"]["lead"]).cast("int").alias("start"), (x["at"] + x["p"]["stop"]).cast("int").alias("end")
            ),
        )

    return let(F.transform(pieces, measure), place)


def last_span(spans: Column) -> Column:
    """Only the last span (train on the final reply)."""
    return F.slice(spans, F.greatest(F.size(spans), F.lit(1)), F.lit(1))


def literal_spans(text: Column, literal: str) -> Column:
    """Every non-overlapping occurrence of a text, left to right."""
    pieces = F.split(text, F.lit(rf"\Q{literal}\E"), F.lit(-1))
    n = len(literal)

    def place(sizes: Column) -> Column:
        ends = F.slice(prefix_sums(F.transform(sizes, lambda w: w + n)), F.lit(2), F.size(sizes) - 1)
        return F.transform(ends, lambda e: F.struct((e - n).cast("int").alias("start"), e.cast("int").alias("end")))

    return let(F.transform(pieces, F.length), place)


# --- spans to tokens -------------------------------------------------------------


def token_ranges(text: Column, spans: Column, how: str = "prefix") -> Column:
    """Token index ranges ``array<struct<start, end>>`` covered by character spans.

    ``prefix``       tokens that start inside the span: as many tokens as the text
                     before the start has, up to as many as the text up to the end has
    ``containment``  tokens that lie wholly inside
    ``overlap``      tokens that touch the span; one starting right at its end counts

    Only the pieces between span borders are tokenised, each once.  The text is cut into
    chunks first and a piece taken from its own chunks, as a substring of the whole is
    found by walking there from the start: the cost is linear in the text.
    """
    if how not in ("prefix", "containment", "overlap"):
        raise ValueError(f"unknown mapping {how!r}")

    def ranges(chunks: Column, length: Column, sp: Column) -> Column:
        cuts = F.concat(F.array(F.lit(0)), F.flatten(F.transform(sp, lambda s: F.array(s["start"], s["end"]))))

        def piece(c: Column, stop: Column) -> Column:
            first = F.floor(c / CHUNK).cast("int")
            held = F.slice(chunks, first + 1, F.floor(stop / CHUNK).cast("int") - first + 1)
            return F.substring(F.array_join(held, ""), c - first * CHUNK + 1, stop - c)

        def joined(c: Column) -> Column:
            pair = piece(F.greatest(c - 1, F.lit(0)), F.least(c + 1, length))
            return (c > 0) & (c < length) & joins_at(pair, F.lit(1))

        def begun(c: Column, stop: Column) -> Column:
            # Tokens starting in a piece; one that runs over the left border does not.
            counted = token_count(piece(c, stop)) - joined(c).cast("int")
            return F.when(stop > c, counted).otherwise(0)

        def per_piece(cs: Column) -> Column:
            return F.transform(cs, lambda c, i: begun(c, F.coalesce(F.get(cs, i + 1), length)))

        def rng(s: Column, i: Column, sums: Column) -> Column:
            lo, hi = F.get(sums, 2 * i + 1), F.get(sums, 2 * i + 2)
            if how == "containment":
                hi = hi - joined(s["end"]).cast("int")
            elif how == "overlap":
                lo = lo - joined(s["start"]).cast("int")
                hi = hi + ((s["end"] < length) & ~joined(s["end"])).cast("int")
            return F.struct(lo.cast("int").alias("start"), hi.cast("int").alias("end"))

        return let(
            cuts,
            lambda cs: let(
                prefix_sums(per_piece(cs)),
                lambda sums: F.transform(sp, lambda s, i: rng(s, i, sums)),
            ),
        )

    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return let(
        cut, lambda chunks: let(F.length(text), lambda length: let(spans, lambda sp: ranges(chunks, length, sp)))
    )


def ranges_to_mask(ranges: Column, n: Column) -> Column:
    """0/1 array of length ``n`` from sorted index ranges; ends are clipped."""

    def build(rs: Column, size: Column) -> Column:
        def piece(r: Column, i: Column) -> Column:
            done = F.least(F.coalesce(F.when(i > 0, F.get(rs, i - 1)["end"]), F.lit(0)), size)
            lo = F.least(F.greatest(r["start"], done), size)
            hi = F.least(F.greatest(r["end"], lo), size)
            return F.concat(zeros(lo - done), ones(hi - lo))

        reach = F.array_max(F.transform(rs, lambda r: F.greatest(r["start"], r["end"])))
        end = F.least(F.coalesce(reach, F.lit(0)), size)
        mask = F.concat(F.flatten(F.transform(rs, piece)), zeros(size - end))
        return F.when(F.size(rs) > 0, mask).otherwise(zeros(size))

    return let(ranges, lambda rs: let(n, lambda size: build(rs, size)))


def span_mask(text: Column, spans: Column, n: Column, how: str = "prefix") -> Column:
    return ranges_to_mask(token_ranges(text, spans, how), n)


def clear_literals(mask: Column, text: Column, literals: tuple[str, ...]) -> Column:
    """Zero the mask under every occurrence of the given texts."""
    out = mask
    for literal in literals:
        hidden = span_mask(text, literal_spans(text, literal), F.size(mask))
        out = F.zip_with(out, hidden, lambda m, h: m * (1 - h))
    return out


def masked_sample(
    df: DataFrame,
    template: ChatTemplate,
    text: str = "text",
    max_length: int | None = 2048,
    style: str | None = None,
    last_only: bool = False,
) -> DataFrame:
    """Rendered text to ``input_ids``, ``loss_mask`` and ``attention_mask``.

    Uses the regex tokenizer; ids are cut to ``max_length`` first and the mask is
    clipped to what is left.
    """
    rule = span_rule(template, style)
    source = F.col(text)
    spans = find_spans(source, rule)
    out = pin(df, __tokens=tokens(source), __spans=last_span(spans) if last_only else spans)
    # The text is tokenised once: borders of tokens are running totals of their lengths.
    out = pin(out, __borders=prefix_sums(F.transform("__tokens", F.char_length)))
    n = F.size("__tokens")
    starts, ends = F.slice("__borders", F.lit(1), n), F.slice("__borders", F.lit(2), n)

    def build(first: Column, last: Column) -> Column:
        mask = ranges_to_mask(offset_ranges(first, last, F.col("__spans"), rule.how), n)
        for literal in template.ignore_token:
            mask = zero_ranges(mask, offset_ranges(first, last, literal_spans(source, literal), "prefix"))
        return mask

    mask = let(starts, lambda first: let(ends, lambda last: build(first, last)))
    out = pin(out, loss_mask=mask if max_length is None else F.slice(mask, 1, max_length))
    out = out.withColumn("input_ids", hashed_ids_batch(F.col("__tokens") if max_length is None else F.slice("__tokens", 1, max_length)))
    return out.withColumn("attention_mask", ones(F.size("input_ids"))).drop("__tokens", "__spans", "__borders")


# --- masks with a real tokenizer ---------------------------------------------------


def last_upto(values: Column, limit: Column) -> Column:
    """Index of the last entry of an ascending array that is at most ``limit``, or -1: halving, not a scan."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(values) + F.lit(2))).cast("int"))
    bounds = F.struct(F.lit(-1).alias("low"), F.size(values).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        below = F.get(values, middle) <= limit
        return F.when(acc["high"] - acc["low"] <= 1, acc).otherwise(
            F.struct(F.when(below, middle).otherwise(acc["low"]).alias("low"), F.when(below, acc["high"]).otherwise(middle).alias("high"))
        )

    return F.aggregate(steps, bounds, halve, lambda acc: acc["low"])


def _meets(how: str, start: Column, end: Column, span_end: Column) -> Column:
    """Whether a token meets the last span that begins in time."""
    hit = {"prefix": start < span_end, "containment": end <= span_end, "overlap": start <= span_end}[how]
    return F.coalesce(hit, F.lit(False)).cast("int")


def offset_ranges(starts: Column, ends: Column, spans: Column, how: str = "containment") -> Column:
    """Token index ranges ``array<struct<start, end>>`` of spans; starts and ends of tokens ascend.

    A span's tokens stand side by side: halving over the tokens finds the first and the last, so
    the cost goes with the number of spans.  A token that could meet two spans goes to the later one.
    """
    if how not in ("prefix", "containment", "overlap"):
        raise ValueError(f"unknown mapping {how!r}")

    def upto(values: Column, limit: Column) -> Column:
        return last_upto(values, limit) + 1

    def rng(s: Column, first: Column, last: Column) -> Column:
        lo = upto(last, s["start"]) if how == "overlap" else upto(first, s["start"] - 1)
        hi = {
            "prefix": lambda: upto(first, s["end"] - 1),
            "containment": lambda: upto(last, s["end"]),
            "overlap": lambda: upto(first, s["end"]),
        }[how]()
        return F.struct(lo.cast("int").alias("start"), hi.cast("int").alias("end"))

    def cut(found: Column) -> Column:
        """Each range ends before the next one starts."""

        def one(r: Column, i: Column) -> Column:
            following = F.coalesce(F.get(found, i + 1)["start"], r["end"])
            return F.struct(r["start"].alias("start"), F.greatest(F.least(r["end"], following), r["start"]).alias("end"))

        return F.transform(found, one)

    return let(starts, lambda first: let(ends, lambda last: let(F.transform(spans, lambda s: rng(s, first, last)), cut)))


def _ascends(values: Column) -> Column:
    """Whether an array without nulls ascends."""
    ordered = (F.sort_array(values) == values) & (F.get(values, F.lit(0)).isNotNull() | (F.size(values) == 0))
    return F.coalesce(ordered, F.lit(False))


def offset_mask(starts: Column, ends: Column, spans: Column, how: str = "containment") -> Column:
    """Loss mask from token offsets and spans, both inside one row; spans are in order and disjoint.

    A token counts with ``prefix`` once it starts inside a span, with ``containment`` when it lies in
    one, with ``overlap`` when it does not end before one or start after one.  Only the last span that
    starts in time can hold a token.  Where offsets ascend, as those of tokenizers do, the spans are
    sought among the tokens, else every token among the spans, both by halving.
    """

    def each(first: Column, last: Column, sp: Column) -> Column:
        begins, closes = F.transform(sp, lambda s: s["start"]), F.transform(sp, lambda s: s["end"])

        def one(a: Column, b: Column, bs: Column, cs: Column) -> Column:
            found = last_upto(bs, b - 1 if how == "overlap" else a)
            return _meets(how, a, b, F.get(cs, found))

        return let(begins, lambda bs: let(closes, lambda cs: F.zip_with(first, last, lambda a, b: one(a, b, bs, cs))))

    def mask(first: Column, last: Column, sp: Column) -> Column:
        fast = _ascends(first) & _ascends(last) & (F.size(first) == F.size(last)) & sp.isNotNull()
        return F.when(fast, ranges_to_mask(offset_ranges(first, last, sp, how), F.size(first))).otherwise(each(first, last, sp))

    return let(starts, lambda first: let(ends, lambda last: let(spans, lambda sp: mask(first, last, sp))))


def offset_mask_rows(token_rows: DataFrame, span_rows: DataFrame, keys: Sequence[str], how: str = "containment") -> DataFrame:
    """The same over rows: ``keys, i, start, end`` of tokens and ``keys, start, end`` of spans.

    Tokens move once, in packs of a few bytes a token, to the spans of their block of positions (see
    ``packs``): an interval join without a sort of rows, whatever the number of spans.  Rows equal in
    key, place and offset are repeats and count once.
    """
    return masked_rows(token_rows, span_rows, keys, how)


# --- reading masks ------------------------------------------------------------------


def mask_runs(df: DataFrame, key: str, token_texts: str, mask: str) -> DataFrame:
    """Consecutive tokens with equal mask as one text segment per row.

    Row-local: run borders are positions whose mask differs from the one before.
    """

    def segments(m: Column, toks: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda s, i: F.struct(
                F.get(m, s).alias("mask"),
                F.array_join(
                    F.slice(toks, s + 1, F.coalesce(F.get(starts, i + 1), F.size(m)) - s), ""
                ).alias("text"),
            ),
        )

    def borders(m: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(m) - 1),
            lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)),
        )

    cut = let(
        F.col(mask),
        lambda m: let(F.col(token_texts), lambda toks: let(borders(m), lambda b: segments(m, toks, b))),
    )
    runs = df.filter(F.size(mask) > 0).select(key, F.posexplode(cut).alias("run", "segment"))
    return runs.select(key, "run", "segment.mask", "segment.text")
