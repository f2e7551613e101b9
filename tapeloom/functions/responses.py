"""Parsing of model responses: streamed events and JSON bodies, with VARIANT and higher-order functions (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jscompat import js_trim


def _choices(v: Column, empty_falls_through: bool = False) -> Column:
    return F.coalesce(F.try_variant_get(v, "$.choices", "array<variant>"), F.try_variant_get(v, "$.output.choices", "array<variant>"), F.array().cast("array<variant>"))


def _texts(content: Column) -> Column:
    """The texts of a message's content: itself if it is a string, else the texts of its parts."""
    is_string = lambda v: F.schema_of_variant(v) == "STRING"
    part = lambda v: F.try_variant_get(v, "$.text", "variant")
    parts = F.transform(F.filter(F.coalesce(F.try_variant_get(content, "$", "array<variant>"), F.array().cast("array<variant>")), lambda p: is_string(part(p))), lambda p: F.try_variant_get(p, "$.text", "string"))
    return F.when(is_string(content), F.array(F.try_variant_get(content, "$", "string"))).otherwise(parts)


def extract_sse_text(raw: Column) -> Column:
    """A struct (text, parse_error) of an event stream: all deltas and messages in order, trimmed; a bad event gives no text."""
    lines = F.transform(F.split(raw, "\r?\n"), js_trim)
    data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: js_trim(F.substr(x, F.lit(6))))
    data = F.filter(data, lambda x: (x != "") & (x != "[DONE]"))
    of_choice = lambda c: F.concat(_texts(F.try_variant_get(c, "$.delta.content", "variant")), _texts(F.try_variant_get(c, "$.message.content", "variant")))
    texts = F.flatten(F.transform(data, lambda x: F.flatten(F.transform(_choices(F.try_parse_json(x)), of_choice))))
    bad = F.exists(data, lambda x: F.try_parse_json(x).isNull())
    return F.struct(F.when(~bad, js_trim(F.array_join(texts, ""))).alias("text"), F.coalesce(bad, F.lit(False)).alias("parse_error"))


def extract_chat_text(raw: Column) -> Column:
    """The first text of a JSON body that is not blank, trimmed: the output's own, then each choice's message; else ''."""
    v = F.try_parse_json(raw)
    own = _texts(F.try_variant_get(v, "$.output.text", "variant"))
    said = F.flatten(F.transform(_choices(v), lambda c: _texts(F.try_variant_get(c, "$.message.content", "variant"))))
    own = F.when(F.schema_of_variant(F.try_variant_get(v, "$.output.text", "variant")) == "STRING", own).otherwise(F.array().cast("array<string>"))
    found = F.filter(F.transform(F.concat(own, said), js_trim), lambda x: x != "")
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))


def is_event_stream(content_type: Column, raw: Column) -> Column:
    return F.coalesce(content_type.rlike("(?i)text/event-stream"), F.lit(False)) | F.coalesce(raw.rlike(r"(?m)^\s*data:"), F.lit(False))


def route_response(content_type: Column, raw: Column) -> Column:
    """A struct (text, parse_error): an event stream by its type or its lines, else a JSON body, an empty one as {}."""
    sse = extract_sse_text(raw)
    body = F.when(F.coalesce(raw, F.lit("")) == "", "{}").otherwise(raw)
    bad = F.try_parse_json(body).isNull()
    return F.when(is_event_stream(content_type, raw), sse).otherwise(F.struct(F.when(~bad, extract_chat_text(body)).alias("text"), bad.alias("parse_error")))


def require_text(answer: Column) -> Column:
    """A struct (text, error): an empty or unparsed answer is an error, not a result."""
    text = F.nullif(answer["text"], F.lit(""))
    return F.struct(text.alias("text"), F.when(answer["parse_error"], "bad_response").when(text.isNull(), "no_text").alias("error"))
