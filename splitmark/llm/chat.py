"""Chat formatting of typed content parts, with DataFrame functions alone.

A turn's content is a list of parts. A visitor goes through them in order: text is escaped, an image, audio or document part becomes a
placeholder, and its reference and the tokens that it will expand to are recorded. Turns are then framed by marks and joined.

Control strings all start with ``<|``. In texts and roles ``\\`` becomes ``\\b`` and ``<|`` becomes ``\\l``, so no text can hold a
control string, and two replacements in the other order give the text back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PLACEHOLDER = r"<\|(?:image|audio|document):\d+\|>"


@dataclass(frozen=True)
class ChatParams:
    patch: int = 28  # pixels of an image token's side
    audio_rate: float = 12.5  # tokens a second
    page_tokens: int = 256
    loss_role: str = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A list of one text part."""
    empty = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in empty.items()]))


def _expanded(part: Column, params: ChatParams) -> Column:
    """Tokens that stand in for an attachment, at least one; sizes that are unknown or not positive count as one unit."""
    side = lambda n: F.ceil(F.greatest(F.coalesce(part[n], F.lit(1)), F.lit(1)) / F.lit(params.patch))
    image = side("width") * side("height")
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * params.audio_rate)
    paper = F.coalesce(part["pages"], F.lit(1)).cast("bigint") * params.page_tokens
    return F.greatest(F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).otherwise(paper), F.lit(1)).cast("bigint")


def _visit(parts: Column, params: ChatParams) -> tuple[Column, Column]:
    """(body, attachments) of a turn's parts. Null parts and parts of unknown types count as their text, or as nothing."""
    attached = lambda p: F.coalesce(p["type"].isin("image", "audio", "document"), F.lit(False))
    body = F.array_join(F.transform(parts, lambda p, i: F.when(attached(p), F.concat(F.lit("<|"), p["type"], F.lit(":"), i.cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))), "")
    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p, params).alias("tokens")))
    return body, F.filter(numbered, attached)


def format_chat(turns: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, parts): conv_id, formatted, mask, attachments, attachment_tokens.

    ``mask`` has one span for every turn of the loss role: the turn's index, the span's start in that turn and its length, in code
    points; ``turn_chars`` has the length of each formatted turn, so that a running sum gives places in the whole string. ``attachments`` lists (turn, part, type, ref, tokens) in order.

    Turns go by turn, ties by role and then content; repeated rows stay. Null roles, texts and part lists count as empty, null turns
    come first, a null conv_id is a conversation of its own. An empty table gives an empty result. Other columns aren't read. A
    conversation becomes one string, so it meets in one task, as its digest needs.
    """
    body, attached = _visit(F.coalesce(F.col("parts"), F.from_json(F.lit("[]"), f"array<{PART}>")), params)
    framed = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), body.alias("body"), attached.alias("attached"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    framed = framed.select("conv_id", F.struct("turn", "role", "body", F.char_length(head).cast("bigint").alias("lead"), F.concat(head, "body", F.lit(END)).alias("framed"), "attached").alias("t"))
    joined = framed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    lengths = F.transform("t", lambda t: F.char_length(t["framed"]).cast("bigint"))
    joined = joined.select("conv_id", "t", lengths.alias("n"), F.array_join(F.transform("t", lambda t: t["framed"]), "").alias("formatted"))
    spans = F.filter(
        F.transform("t", lambda t, i: F.struct(i.alias("turn"), t["lead"].alias("at"), F.char_length(t["body"]).cast("bigint").alias("length"), (t["role"] == params.loss_role).alias("mine"))), lambda s: s["mine"]
    )
    attachments = F.flatten(F.transform("t", lambda t, i: F.transform(t["attached"], lambda a: F.struct(i.alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    made = joined.select("conv_id", "formatted", F.transform(spans, lambda s: F.struct(s["turn"].alias("turn"), s["at"].alias("at"), s["length"].alias("length"))).alias("mask"), "n", attachments.alias("attachments"))
    return made.select("conv_id", "formatted", "mask", F.col("n").alias("turn_chars"), "attachments", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>> and loss_text, from the strings and masks of :func:`format_chat` alone.

    Placeholders are left out of the texts. The turns' own cuts are found again by their marks.
    """
    cut = F.slice(F.split("formatted", r"<\|turn\|>"), 2, F.size(F.split("formatted", r"<\|turn\|>")))
    rows = formatted.select("conv_id", "formatted", "mask", cut.alias("cut"))
    plain = lambda c: unescape(F.regexp_replace(c, PLACEHOLDER, ""))
    turns = F.transform("cut", lambda c: F.struct(unescape(F.substring_index(c, TEXT, 1)).alias("role"), plain(F.replace(F.substring_index(c, TEXT, -1), F.lit(END), F.lit(""))).alias("text")))
    under = F.transform("mask", lambda m: plain(F.substring(F.concat(F.lit(TURN), F.get(F.col("cut"), m["turn"])), m["at"].cast("int") + 1, m["length"].cast("int"))))
    return rows.select("conv_id", "formatted", turns.alias("turns"), F.array_join(under, "").alias("loss_text"))


def op6_typed_parts(conversations: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """Every conversation and the one numbered -7, formatted and read back."""
    own = odd_conversation(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(own)
    back = read_back(format_chat(rows.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")), params))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def odd_conversation(spark: SparkSession) -> DataFrame:
    """A user and an assistant row whose text looks like a template's own marks."""
    odd = F.lit(r"\### Assistant: </turn> ok")
    return spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), odd.alias("text"))


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') "role", coalesce(text, '') "text" FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace("role", '\', '\b'), '<|', '\l')) + length(replace(replace("text", '\', '\b'), '<|', '\l')) + 23 n FROM c),
g AS (
  SELECT conv_id, count(*) n_turns, string_agg("role" || chr(10) || "text" || chr(10), '' ORDER BY turn NULLS FIRST, "role", "text") t,
    coalesce(string_agg(CASE WHEN "role" = 'assistant' THEN "text" END, '' ORDER BY turn NULLS FIRST, "role", "text"), '') l, sum(n) n
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) turns_sha256, length(l) loss_chars, sha256(l) loss_sha256, CAST(n AS BIGINT) formatted_chars FROM g
"""
