"""Answer extraction from model replies and comparison with labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatprep.functions.arrays import let
from chatprep.functions.text import SPACE_CHARS, first_match, last_match, strip

S = f"[{SPACE_CHARS}]"
INVALID_INTEGER = "-9999999"

# The places where an answer is looked for, in this order.
BOXED = r"\\boxed\{([^}]+)\}"
BOXED_BARE_INTEGER = rf"\\boxed{S}+(\p{{Nd}}+)"
BOXED_BARE = rf"\\boxed{S}+([^{SPACE_CHARS}]+)"
ANSWER_INTEGER = rf"(?i)answer[{SPACE_CHARS}:]+(\p{{Nd}}+)"
CLOSING_INTEGER = rf"(?i)(?:is|equals?|={S}*)(\p{{Nd}}+){S}*\z"
NUMBER = r"[-+]?\p{Nd}*\.?\p{Nd}+"
ANSWER_NUMBER = rf"(?i)answer[{SPACE_CHARS}:]+({NUMBER})"
CLOSING_NUMBER = rf"(?i)(?:is|equals?|={S}*)({NUMBER}){S}*\z"
ANSWER_MARK = "Answer: "
FENCED_CODE = r"(?s)```(?:python)?\n(.*?)```"
FUNCTION_CODE = (
    rf"(?s)(def{S}+[\p{{L}}\p{{N}}_]+\([^)]*\):.*?)(?:\n\ndef{S}|\z)"
)
_WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def boxed_integer(text: Column) -> Column:
    """Competition answers: the last integer in the first box (else the box), a bare
    box, "answer ...", a closing "is/equals/=", else the last integer up to 999."""
    in_box = let(
        strip(first_match(text, BOXED)), lambda box: F.coalesce(last_match(box, r"(\p{Nd}+)"), box)
    )
    small = F.filter(words(text), lambda w: F.regexp_like(w, F.lit(r"\A0*[0-9]{1,3}\z")))
    return F.coalesce(
        in_box,
        first_match(text, BOXED_BARE_INTEGER),
        last_match(text, ANSWER_INTEGER),
        last_match(text, CLOSING_INTEGER),
        F.try_element_at(small, F.lit(-1)),
    )


def boxed_value(text: Column) -> Column:
    """The first box as it is, a bare box, else the last number (sign, decimals)."""
    return F.coalesce(
        strip(first_match(text, BOXED)),
        strip(first_match(text, BOXED_BARE)),
        last_match(text, ANSWER_NUMBER),
        last_match(text, CLOSING_NUMBER),
        last_match(text, f"({NUMBER})"),
    )


def last_integer(text: Column) -> Column:
    """Last run of digits once commas are gone, as canonical digits of any length.

    Nothing found, or a leading zero before other digits: the invalid marker.
    """
    found = last_match(F.replace(text, F.lit(","), F.lit("")), r"(\p{Nd}+)")
    return (
        F.when(F.regexp_like(found, F.lit(r"\A0+\z")), F.lit("0"))
        .when(F.regexp_like(found, F.lit(r"\A[1-9][0-9]*\z")), found)
        .otherwise(F.lit(INVALID_INTEGER))
    )


def _one_letter(upper: Column, letters: str) -> Column:
    single = F.filter(words(upper), lambda w: F.regexp_like(w, F.lit(rf"\A[{letters}]\z")))
    return F.get(single, F.lit(0))


def choice_letter(text: Column) -> Column:
    """A to D: a letter on its own, after an answer mark, else the first one anywhere."""
    upper = F.upper(strip(text))
    return F.coalesce(
        _one_letter(upper, "ABCD"),
        first_match(upper, rf"答案[：:]{S}*([ABCD])"),
        first_match(upper, rf"ANSWER[：:]{S}*([ABCD])"),
        first_match(upper, r"([ABCD])"),
    )


def bounded_letter(text: Column, options: Column | None = None) -> Column:
    """First letter standing alone, in brackets or after a mark, if it is within the
    number of options (four when unknown)."""
    upper = F.upper(strip(text))
    count = F.lit(4) if options is None else F.when(F.coalesce(options, F.lit(0)) > 0, options).otherwise(4)
    top = F.char(F.lit(64) + count)
    found = [
        _one_letter(upper, "A-Z"),
        first_match(upper, r"\(([A-Z])\)"),
        first_match(upper, r"\[([A-Z])\]"),
        first_match(upper, rf"答案[：:]{S}*([A-Z])"),
        first_match(upper, rf"选择[：:]{S}*([A-Z])"),
    ]
    return F.coalesce(*[F.when((c >= "A") & (c <= top), c) for c in found])


def after_answer_mark(text: Column) -> Column:
    """Text between the first and the second answer mark, stripped; null without one."""
    parts = F.split(text, F.lit(rf"\Q{ANSWER_MARK}\E"), F.lit(-1))
    return F.when(F.size(parts) > 1, strip(F.get(parts, F.lit(1))))


def code_block(text: Column) -> Column:
    """First fenced block, else the first function up to a blank line before the next
    one, else the whole text; null when that is blank."""
    whole = strip(text)
    return F.coalesce(
        strip(first_match(text, FENCED_CODE, may_be_empty=True)),
        strip(first_match(text, FUNCTION_CODE)),
        F.when(whole != "", whole),
    )


def candidate_program(prompt: Column, code: Column, entry_point: Column) -> Column:
    """The program to test: a complete function stays, a body or another function
    is put behind the prompt."""
    body = strip(code)
    is_def = F.startswith(body, F.lit("def "))
    name = F.regexp_extract(body, rf"\Adef{S}+([\p{{L}}\p{{N}}_]+){S}*\(", 1)
    no_entry = F.coalesce(entry_point, F.lit("")) == ""
    complete = is_def & (no_entry | (name == entry_point))
    return F.when(complete, body).otherwise(F.concat(prompt, F.lit("\n"), body))


# --- comparing with labels --------------------------------------------------------------


def _integer_key(text: Column) -> Column:
    """Canonical integer text (any length), null when the text is not an integer."""
    plain = F.replace(text, F.lit("_"), F.lit(""))
    digits = F.regexp_replace(plain, r"\A[+-]?0*(?=[0-9])", "")
    sign = F.when(F.startswith(plain, F.lit("-")) & (digits != "0"), F.lit("-")).otherwise(F.lit(""))
    good = F.regexp_like(text, F.lit(r"\A[+-]?[0-9]+(?:_[0-9]+)*\z"))
    return F.when(good, F.concat(sign, digits))


def _double(text: Column) -> Column:
    good = F.regexp_like(text, F.lit(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?\z"))
    return F.when(good, text.try_cast("double"))


def same_integer(prediction: Column, label: Column) -> Column:
    """Equal texts or equal integers."""
    p, x = strip(prediction), strip(label)
    return F.coalesce((p == x) | F.coalesce(_integer_key(p) == _integer_key(x), F.lit(False)), F.lit(False))


def same_number(prediction: Column, label: Column) -> Column:
    """Equal lower-case texts or numbers less than 1e-6 apart."""
    p, x = F.lower(strip(prediction)), F.lower(strip(label))
    near = F.abs(_double(p) - _double(x)) < 1e-6
    return F.coalesce((p == x) | F.coalesce(near, F.lit(False)), F.lit(False))


def same_upper(prediction: Column, label: Column) -> Column:
    return F.coalesce(F.upper(strip(prediction)) == F.upper(strip(label)), F.lit(False))


def same_text(prediction: Column, label: Column) -> Column:
    return F.coalesce(prediction == label, F.lit(False))
