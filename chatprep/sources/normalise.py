"""Source rows to canonical ``{id, conversations}`` records (all row-local)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.functions.hashing import content_id, seeded_key

# Speaker names of public chat dumps.
ROLES = {
    "human": "user",
    "gpt": "assistant",
    "chatgpt": "assistant",
    "bing": "assistant",
    "bard": "assistant",
}
IMAGE_MARK = "<image>\n"
OPTION_LETTERS = ("a", "b", "c", "d")


def message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def question_and_reply(question: Column, reply: Column, given_id: Column | None = None) -> list[Column]:
    """A two-message record; its id is the md5 of both texts unless one is given."""
    made = content_id(question, reply)
    return [
        (made if given_id is None else F.coalesce(given_id.cast("string"), made)).alias("id"),
        F.array(message("user", question), message("assistant", reply)).alias("conversations"),
    ]


def messages_strict(df: DataFrame, id: str = "prompt_id", messages: str = "messages") -> DataFrame:
    """Records with user and assistant messages only; any other role fails the job."""

    def checked(m: Column) -> Column:
        known = m["role"].isin("user", "assistant")
        role = F.when(known, m["role"]).otherwise(
            F.raise_error(F.concat(F.lit("unexpected role: "), F.coalesce(m["role"], F.lit("null"))))
        )
        return message(role, m["content"])

    return df.select(F.col(id).alias("id"), F.transform(messages, checked).alias("conversations"))


def _role_map(roles: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])


def from_value(
    df: DataFrame, roles: Mapping[str, str] | None = None, id: str = "id", conversations: str = "conversations"
) -> DataFrame:
    """``from/value`` messages; speakers outside the role table are dropped and counted."""
    table = _role_map(roles or ROLES)
    known = list((roles or ROLES).keys())
    kept = F.filter(conversations, lambda m: F.coalesce(m["from"].isin(known), F.lit(False)))
    out = F.transform(kept, lambda m: message(F.try_element_at(table, m["from"]), m["value"]))
    return df.select(
        F.col(id).alias("id"),
        out.alias("conversations"),
        (F.size(conversations) - F.size(out)).cast("int").alias("skipped"),
        F.size(conversations).alias("seen"),
    )


def with_image(
    df: DataFrame,
    roles: Mapping[str, str] | None = None,
    images: DataFrame | None = None,
    root: str = "",
) -> DataFrame:
    """``from/value`` records about one image each.

    The image mark is cut from user texts.  With ``images`` (a table of existing
    ``path`` values, relative to ``root``) records whose image is missing are dropped.
    """
    path = F.concat(F.lit(root.rstrip("/") + "/" if root else ""), F.col("image"))
    base = df
    if images is not None:
        base = base.join(images.select(F.col("path").alias("image")), "image", "left_semi")
    base = base.withColumn("image", path)
    table = _role_map(roles or ROLES)
    known = list((roles or ROLES).keys())

    def clean(m: Column) -> Column:
        role = F.try_element_at(table, m["from"])
        text = F.when(role == "user", F.replace(m["value"], F.lit(IMAGE_MARK), F.lit(""))).otherwise(m["value"])
        return message(role, text)

    kept = F.filter("conversations", lambda m: F.coalesce(m["from"].isin(known), F.lit(False)))
    out = F.transform(kept, clean)
    return base.select(
        "id",
        "image",
        out.alias("conversations"),
        (F.size("conversations") - F.size(out)).cast("int").alias("skipped"),
        F.size("conversations").alias("seen"),
    )


def pair_source(question: str, reply: str, id: str | None = None):
    """Normaliser of a table with one question and one reply column."""

    def normalise(df: DataFrame) -> DataFrame:
        given = F.col(id) if id else None
        return df.select(*question_and_reply(F.col(question), F.col(reply), given))

    return normalise


def question_with_options(df: DataFrame) -> DataFrame:
    """``Problem`` and ``options`` on two lines; the rationale is the reply."""
    return df.select(*question_and_reply(F.concat(F.col("Problem"), F.lit("\n"), F.col("options")), F.col("Rationale")))


def shuffled_options(df: DataFrame, seed: int | str = 42, key: Column | None = None) -> DataFrame:
    """Four answers in seeded random order, lettered a to d.

    The letter in the reply is that of the first option equal to the right answer.
    """
    key = F.col("question") if key is None else key
    answers = F.array("distractor3", "distractor1", "distractor2", "correct_answer")
    drawn = F.sort_array(
        F.transform(answers, lambda x, i: F.struct(seeded_key(seed, key, i).alias("h"), x.alias("x")))
    )
    shuffled = F.transform(drawn, lambda s: s["x"])
    letters = F.array(*[F.lit(x) for x in OPTION_LETTERS])
    lines = F.zip_with(letters, shuffled, lambda a, x: F.concat(a, F.lit(") "), x))
    label = F.get(letters, F.array_position(shuffled, F.col("correct_answer")) - 1)
    question = F.concat(F.col("question"), F.lit("\n"), F.array_join(lines, "\n"))
    reply = F.concat(
        F.col("support"), F.lit("\nanswer: "), label, F.lit(") "), F.col("correct_answer")
    )
    return df.select(*question_and_reply(question, reply))


def passthrough(df: DataFrame) -> DataFrame:
    """Already canonical."""
    return df.select(F.col("id").cast("string").alias("id"), "conversations")


def skip_report(df: DataFrame, *by: str) -> DataFrame:
    """Dropped messages, seen messages and records (per source)."""
    return df.groupBy(*by).agg(
        F.coalesce(F.sum("skipped"), F.lit(0)).cast("bigint").alias("skipped_messages"),
        F.coalesce(F.sum("seen"), F.lit(0)).cast("bigint").alias("seen_messages"),
        F.count("*").alias("records"),
    )


def image_conversation(conversation: Column, image: Column, system_prompt: str | None) -> Column:
    """Messages with content parts: a leading non-user message is dropped, roles must
    alternate strictly, every user message carries the image."""
    part = "struct<type:string,text:string,image:string>"

    def text_part(text: Column) -> Column:
        return F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("image")).cast(part)

    shown = F.struct(
        F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), image.alias("image")
    ).cast(part)
    rest = drop_leading_non_user(conversation)

    def build(m: Column, i: Column) -> Column:
        wanted = F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
        role = F.when(m["role"] == wanted, m["role"]).otherwise(
            F.raise_error(F.concat(F.lit("unexpected role "), F.coalesce(m["role"], F.lit("null"))))
        )
        content = F.when(i % 2 == 0, F.array(shown, text_part(m["content"]))).otherwise(
            F.array(text_part(m["content"]))
        )
        return F.struct(role.alias("role"), content.alias("content"))

    head = F.array(
        F.struct(F.lit("system").alias("role"), F.array(text_part(F.lit(system_prompt).cast("string"))).alias("content"))
    )
    return F.when(F.size(conversation) > 0, F.concat(head, F.transform(rest, build)))


def drop_leading_non_user(conversation: Column) -> Column:
    return F.when(
        F.get(conversation, F.lit(0))["role"] != "user",
        F.slice(conversation, F.lit(2), F.greatest(F.size(conversation) - 1, F.lit(0))),
    ).otherwise(conversation)


def alternates(conversation: Column) -> Column:
    """True when roles alternate user, assistant from the first message on."""
    fits = F.transform(
        conversation,
        lambda m, i: F.coalesce(
            m["role"] == F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")), F.lit(False)
        ),
    )
    return F.forall(fits, lambda x: x)
