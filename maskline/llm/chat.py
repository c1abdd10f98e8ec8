"""Chat formatting with typed content parts, by DataFrame functions only.

A turn is `<|turn|>` role `<|body|>` content `<|end|>`. Content parts are visited in order: a text part
gives its text, an image, audio or document part a placeholder such as `<|image|>`, for which the
attachment's reference, its place and the tokens it expands to are recorded. Control strings inside
roles and texts are escaped: backslashes are doubled, and a backslash goes after the first character of
every control string; `unescape` undoes both. The loss mask is a list of character spans, one for every
text part of an assistant turn.

Cases: null texts and roles are empty ones; turns with equal numbers are ordered by role, then content,
and null numbers come first; a null conversation id is a conversation of its own; a turn without parts
has empty content; unknown kinds count as documents; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

BEGIN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: What a text may not contain unescaped: all markers here begin with the first; the others are common elsewhere.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]")
#: Tokens that one unit of an attachment takes: an image's tile, a second of audio, a document's page.
TOKENS = {"image": 256, "audio": 25, "document": 600}
PARTS = "array<struct<kind:string,text:string,ref:string,units:int>>"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    for c in CONTROLS:
        text = F.replace(text, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """Content of a single text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units"))).cast(PARTS)


def _kind(part: Column) -> Column:
    return F.when(part["kind"].isin("text", "image", "audio"), part["kind"]).otherwise("document")


def format_chats(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages(conv_id, turn, role, parts) -> a row for each conversation.

    formatted; loss: spans [start, end) of characters to learn; attachments: kind, ref, tokens and the
    placeholder's start, in order; attachment_tokens: their sum.
    """
    visited = F.transform(
        F.coalesce("parts", F.lit([]).cast(PARTS)),
        lambda p: F.struct(_kind(p).alias("kind"), p["ref"].alias("ref"), F.coalesce(p["units"], F.lit(1)).alias("units"), F.when(_kind(p) == "text", escape(p["text"])).otherwise(F.concat(F.lit("<|"), _kind(p), F.lit("|>"))).alias("out")),
    )
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visited.alias("v"))
    rows = rows.withColumn("head", F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(BODY)))
    rows = rows.withColumn("body", F.array_join(F.transform("v", lambda p: p["out"]), ""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    size = F.length("head") + F.length("body") + len(END)
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("start", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("body") - len(END))

    sizes = F.transform("v", lambda p: F.length(p["out"]))
    placed = F.transform(
        "v",
        lambda p, i: F.struct(
            p["kind"].alias("kind"),
            p["ref"].alias("ref"),
            (F.col("start") + F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda s, x: s + x)).alias("start"),
            F.length(p["out"]).alias("size"),
            (F.when(p["kind"] == "text", 0).when(p["kind"] == "image", TOKENS["image"]).when(p["kind"] == "audio", TOKENS["audio"]).otherwise(TOKENS["document"]) * p["units"]).cast("long").alias("tokens"),
        ),
    )
    rows = rows.withColumn("placed", placed)
    spans = F.when(F.col("role").isin(*learn), F.transform(F.filter("placed", lambda p: p["kind"] == "text"), lambda p: F.struct(p["start"].alias("start"), (p["start"] + p["size"]).alias("end"))))
    found = F.transform(F.filter("placed", lambda p: p["kind"] != "text"), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"), p["start"].alias("start")))
    turn = F.struct("at", F.concat("head", "body", F.lit(END)).alias("out"), F.coalesce(spans, F.lit([]).cast("array<struct<start:long,end:long>>")).alias("spans"), found.alias("found"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    out = chats.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["out"]), "").alias("formatted"),
        F.flatten(F.transform("t", lambda x: x["spans"])).alias("loss"),
        F.flatten(F.transform("t", lambda x: x["found"])).alias("attachments"),
    )
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, x: s + x["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped; placeholders stay as they are."""
    turns = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)
    cut = F.transform(turns, lambda t: F.split(F.substring(t, F.lit(1), F.length(t) - len(END)), r"<\|body\|>"))
    return F.transform(cut, lambda t: F.struct(unescape(t[0]).alias("role"), unescape(t[1]).alias("text")))


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = given.unionByName(odd)
    chats = format_chats(rows.select("conv_id", "turn", "role", text_parts(F.coalesce("text", F.lit(""))).alias("parts")))
    read = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))).alias("learnt"))
    joined = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        joined(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.aggregate("learnt", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("loss_chars"),
        joined(F.array_join("learnt", "")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for x in CONTROLS:
        out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
    return out


SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(BEGIN + BODY + END)} + length({_escaped_sql('role')}) + length({_escaped_sql('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
