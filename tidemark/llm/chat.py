"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an ordered list of parts (kind, text, ref, units). A visitor turns each part into a segment: text
as it is, escaped; image, audio and document as an ordered placeholder, with an attachment record (its number in the
conversation, kind, reference) and its expanded token count. The template marks turns. Every control string holds
a bar; in texts and roles bars are written ``\\!`` and backslashes ``\\-``, so no text, nor any texts side by side, can
form a control string, and formatting is undone without loss. A loss mask covers the assistant's contents.

    <|turn:ROLE|>
    CONTENT<|end|>

Defined results: a null role or text is empty; a null kind is text, an unknown kind an error; turns that tie in number
are ordered by role and text; repeated rows are turns of their own; a null conv_id is a conversation like any other;
an empty table gives no rows; extra columns are ignored. Read back, text parts side by side are one part, empty ones are
left out, and a medium's number leads to its attachment. A conversation is one value of the result (and is hashed as
one), so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that one unit of a medium expands to: image tiles, seconds of audio, pages of a document.
EXPANSION = {"image": 256, "audio": 25, "document": 600}

OPEN, CLOSE, END = "<|turn:", "|>\n", "<|end|>\n"
PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escaped(text: Column) -> Column:
    """Backslashes to ``\\-``, bars to ``\\!``; ``unescaped`` is its inverse."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\-")), F.lit("|"), F.lit("\\!"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\!"), F.lit("|")), F.lit("\\-"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))).cast(f"array<{PART}>")


def _visit(part: Column) -> Column:
    """A part's segment before its number is known: what stands before and after the number, attachment, tokens."""
    kind = F.coalesce(F.lower(part["kind"]), F.lit("text"))
    none = F.lit(None).cast("string")
    expanded = F.lit(0).cast("long")
    for name, each in EXPANSION.items():
        expanded = F.when(kind == name, F.coalesce(part["units"], F.lit(1)) * each).otherwise(expanded)
    medium = kind.isin(*EXPANSION)
    known = F.when(medium | (kind == "text"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown content part: "), kind)))
    return F.struct(
        known.alias("kind"),
        F.when(medium, none).otherwise(escaped(F.coalesce(part["text"], F.lit("")))).alias("text"),
        F.when(medium, part["ref"]).otherwise(none).alias("ref"),
        expanded.alias("tokens"),
        medium.cast("int").alias("attached"),
    )


def format_conversations(turns: DataFrame, parts_column: str = "parts") -> DataFrame:
    """conv_id, turn, role, parts to one row a conversation: formatted text, loss spans, attachments, expanded tokens.

    ``loss`` holds (start, length) in code points, of the assistant's contents.
    """
    segments = F.transform(F.coalesce(F.col(parts_column), F.array().cast(f"array<{PART}>")), _visit)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), segments.alias("segments")).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    # Attachments are numbered through the conversation: those of earlier turns come first.
    attached = F.transform("turns", lambda t: F.aggregate(t["segments"], F.lit(0), lambda n, s: n + s["attached"]))
    firsts = F.aggregate(
        "attached",
        F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("n")),
        lambda acc, n: F.struct(F.concat(acc["starts"], F.array(acc["n"])).alias("starts"), (acc["n"] + n).alias("n")),
        lambda acc: acc["starts"],
    )
    # Most conversations have no attachment; then all numbers start at 0.
    numbered = whole.withColumn("attached", attached).withColumn(
        "starts", F.when(F.exists("attached", lambda n: n > 0), firsts).otherwise(F.transform("attached", lambda n: F.lit(0)))
    )

    def content(t: Column, start: Column) -> Column:
        def segment(s: Column, i: Column) -> Column:
            number = start + F.aggregate(F.slice(t["segments"], 1, i), F.lit(0), lambda n, x: n + x["attached"])
            return F.when(s["attached"] == 1, F.concat(F.lit("<|"), s["kind"], F.lit(":"), number, F.lit("|>"))).otherwise(s["text"])

        return F.array_join(F.transform(t["segments"], segment), "")

    pieces = F.transform(F.arrays_zip("turns", "starts"), lambda z: F.struct(
        F.concat(F.lit(OPEN), escaped(z["turns"]["role"]), F.lit(CLOSE)).alias("head"),
        content(z["turns"], z["starts"]).alias("body"),
        (z["turns"]["role"] == "assistant").alias("learn"),
    ))
    made = numbered.withColumn("pieces", pieces)
    # The piece lengths, summed up, give the spans under the loss mask; a long conversation costs no more than its turns.
    lengths = F.transform("pieces", lambda p: F.struct((F.length(p["head"])).cast("long").alias("head"), F.length(p["body"]).cast("long").alias("body"), p["learn"].alias("learn")))
    spans = F.aggregate(
        lengths,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["head"] + p["body"] + len(END)).alias("at"),
            F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["head"]).alias("start"), p["body"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    flat = F.flatten(F.transform("turns", lambda t: t["segments"]))
    attachments = F.transform(F.filter(flat, lambda s: s["attached"] == 1), lambda s, i: F.struct(i.alias("number"), s["kind"].alias("kind"), s["ref"].alias("ref"), s["tokens"].alias("tokens")))
    return made.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss"),
        attachments.alias("attachments"),
        F.aggregate(flat, F.lit(0).cast("long"), lambda n, s: n + s["tokens"]).alias("expanded_tokens"),
    )


#: A placeholder; texts hold no bar, so none of theirs is one.
_PLACEHOLDER = r"<\|(?:" + "|".join(EXPANSION) + r"):\d{1,10}\|>"


def read_back(formatted: Column, parts: bool = False) -> Column:
    """The turns (role, text) of a formatted conversation; placeholders stay in ``text`` as they are.

    With ``parts``, also the typed parts (kind, text, number) of each: texts as they were, media by their number.
    """
    ended = F.split(formatted, r"<\|end\|>\n")
    raw = lambda t: F.substring_index(F.substring(t, len(OPEN) + 1, 2**31 - 1), CLOSE, 1)

    def part(piece: Column) -> Column:
        medium = piece.startswith("<|")
        kind, number = (F.regexp_extract(piece, p, 1) for p in (r"<\|(\w+)", r":(\d+)"))
        return F.struct(F.when(medium, kind).otherwise("text").alias("kind"), F.when(~medium, unescaped(piece)).alias("text"), F.when(medium, number.try_cast("long")).alias("number"))

    def turn(t: Column) -> Column:
        body = F.substr(t, F.length(raw(t)) + F.lit(len(OPEN) + len(CLOSE) + 1))
        pieces = F.filter(F.split(body, f"(?={_PLACEHOLDER})|(?<={_PLACEHOLDER})"), lambda p: p != "")
        return F.struct(unescaped(raw(t)).alias("role"), unescaped(body).alias("text"), *([F.transform(pieces, part).alias("parts")] if parts else []))

    return F.transform(F.slice(ended, 1, F.size(ended) - 1), turn)


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    hard = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    turns = rows.unionByName(extra).withColumn("parts", text_part(F.col("text")))
    out = format_conversations(turns)
    back = out.withColumn("turns", read_back(F.col("formatted")))
    learned = unescaped(F.array_join(F.transform("loss", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.withColumn("learned", learned).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


# formatted_chars follows from the template: 7 + 3 + 8 characters a turn beside role and text, and one for each escape.
ORACLE_SQL = {
    "op3_chat_formatting": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        sized AS (
            SELECT *, length(replace(replace(text, '\', '\-'), '|', '\!'))
                    + length(replace(replace(role, '\', '\-'), '|', '\!')) + 18 AS chars
            FROM rows)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
}
