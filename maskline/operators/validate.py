"""Strict validation of responses: from JSON content to accepted pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CODES

#: Literal and category of an item, and no others.
_ITEM_KEYS = ("exact_text", "identifier_type")


def whole_json(text: Column) -> Column:
    """Strict JSON as a VARIANT; null where it isn't.

    The parser refuses repeated keys at any depth, NaN and infinities, but not what follows a value. So the text is
    parsed as the only element of an array and as the only field of an object: whatever follows would have to close both.
    Nesting over 1,000 deep and numbers of over 1,000 digits are refused.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    return F.when(alone & field.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))


def _string(x: Column) -> Column:
    """The value of a VARIANT that is a string, else null."""
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def _item(x: Column) -> Column:
    own = F.try_variant_get(x, "$", "map<string,variant>")
    keys_ok = (F.size(own) == 2) & F.map_contains_key(own, F.lit(_ITEM_KEYS[0])) & F.map_contains_key(own, F.lit(_ITEM_KEYS[1]))
    of = lambda k: F.when(keys_ok, _string(own[k]))
    return F.struct(own.isNotNull().alias("is_object"), F.coalesce(own.isNotNull() & keys_ok, F.lit(False)).alias("keys_ok"), of(_ITEM_KEYS[0]).alias("literal"), of(_ITEM_KEYS[1]).alias("type"))


def parse_content(content: Column) -> Column:
    """What an answer says: whether it is usable (an object with a list of identifiers), has other keys, and its items."""

    def told(top: Column) -> Column:
        items = F.try_variant_get(top, "$.identifiers", "array<variant>")
        own = F.try_variant_get(top, "$", "map<string,variant>")
        usable = F.coalesce(own.isNotNull() & items.isNotNull(), F.lit(False))
        listed = F.when(usable, F.transform(items, _item))
        none = F.array().cast("array<struct<is_object:boolean,keys_ok:boolean,literal:string,type:string>>")
        return F.struct(usable.alias("usable"), (usable & (F.size(own) != 1)).alias("extra_keys"), F.coalesce(listed, none).alias("items"))

    # the text is parsed once, as the one element of an array
    return F.transform(F.array(whole_json(content)), told)[0]


def parsed(responses: DataFrame) -> DataFrame:
    """responses(..., finish_reason, content) with `parsed`, unless it is there; only finished, non-empty content is looked at."""
    if "parsed" in responses.columns:
        return responses
    open_ = (F.col("finish_reason") == "stop") & (F.coalesce(F.length("content"), F.lit(0)) > 0)
    return responses.withColumn("finish_reason", F.coalesce("finish_reason", F.lit("error"))).withColumn("parsed", parse_content(F.when(open_, F.col("content"))))


def verdicts(responses: DataFrame, *keys: str) -> DataFrame:
    """A row for each item of each response: its position, literal, type and verdict.

    Verdicts in order of trial: not_object, bad_keys, bad_literal, invalid_type, ungrounded (the literal
    isn't in the window), duplicate, ok.
    """
    rows = parsed(responses).select(*keys, "text", F.posexplode("parsed.items").alias("pos", "x"))
    literal, kind = F.col("x.literal"), F.col("x.type")
    # the text is looked at where it is: what moves has none
    rows = rows.select(*keys, "pos", "x", F.contains("text", literal).alias("grounded"))
    nth = F.row_number().over(Window.partitionBy(*keys, literal, kind).orderBy("pos"))
    verdict = (
        F.when(~F.col("x.is_object"), "not_object")
        .when(~F.col("x.keys_ok"), "bad_keys")
        .when(F.coalesce(F.length(literal), F.lit(0)) == 0, "bad_literal")
        .when(~F.coalesce(kind.isin(*CODES), F.lit(False)), "invalid_type")
        .when(~F.col("grounded"), "ungrounded")
        .when(nth > 1, "duplicate")
        .otherwise("ok")
    )
    return rows.select(*keys, "pos", literal.alias("exact_text"), kind.alias("identifier_type"), verdict.alias("verdict"))


def validations(responses: DataFrame, *keys: str) -> DataFrame:
    """A row for each response: usable, strictly valid, and counts of items by verdict.

    An item that is only ungrounded leaves a response strict; duplicates are not among the rejected.
    """
    base = parsed(responses).select(*keys, "finish_reason", F.col("parsed.usable").alias("envelope_usable"), F.col("parsed.extra_keys").alias("extra"))
    n = lambda *names: F.count_if(F.col("verdict").isin(*names))
    counts = verdicts(responses, *keys).groupBy(*keys).agg(
        F.count("*").alias("raw_items"),
        n("ok").alias("accepted"),
        F.count_if(~F.col("verdict").isin("ok", "duplicate")).alias("rejected"),
        n("duplicate").alias("duplicates"),
        n("ungrounded").alias("ungrounded"),
        n("invalid_type").alias("invalid_type"),
        F.bool_and(F.col("verdict").isin("ok", "ungrounded")).alias("items_strict"),
    )
    strict = F.col("envelope_usable") & ~F.col("extra") & F.coalesce("items_strict", F.lit(True))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return base.join(counts, list(keys), "left").select(*keys, "finish_reason", "envelope_usable", strict.alias("strict_schema_valid"), F.lit(False).alias("contains_literal_text"), *[zero(c) for c in ("raw_items", "accepted", "rejected", "duplicates", "ungrounded", "invalid_type")])


def pairs(found: DataFrame, *keys: str) -> DataFrame:
    """Accepted pairs of all of a note's windows, each once."""
    return found.where("verdict = 'ok'").select(*keys, "exact_text", "identifier_type").distinct()


def without_content(envelope: Column) -> Column:
    """A response envelope (choices array of structs) with blank contents and no reasoning text."""
    return envelope.withField("choices", F.transform(envelope["choices"], lambda c: c.withField("message", c["message"].dropFields("reasoning_content").withField("content", F.lit("")))))
