"""Provider payloads: JSON text to typed columns.

Payloads are parsed once into a variant, so a value's kind (text, list of
parts, absent) is known and text that merely looks like a list stays text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(data: Column) -> Column:
    """Variant of an object payload; NULL when the text is no JSON object."""
    value = F.try_parse_json(data)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def at(payload: Column, path: str) -> Column:
    """The variant at a path; JSON null counts as absent."""
    found = F.try_variant_get(payload, path, "variant")
    return F.when(~F.is_variant_null(found), found)


def text_at(payload: Column, path: str) -> Column:
    return F.try_variant_get(payload, path, "string")


def long_at(payload: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(payload, path, "bigint"), F.lit(0).cast("bigint"))


def content_text(value: Column) -> Column:
    """Text as it is, a list of parts joined, an absent value empty."""
    parts = F.try_variant_get(value, "$", "array<variant>")
    joined = F.array_join(
        F.transform(
            parts,
            lambda p: F.when(
                F.schema_of_variant(p).startswith("OBJECT"), F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))
            ).otherwise(F.coalesce(F.try_variant_get(p, "$", "string"), F.lit(""))),
        ),
        "",
    )
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), "")
        .when(kind.startswith("ARRAY"), joined)
        .otherwise(F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("")))
    )


def first_text(payload: Column, *paths: str) -> Column:
    """Text of the first path that holds any, as ``x or y`` picks it."""
    texts = [content_text(at(payload, p)) for p in paths]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def usage_columns(payload: Column, root: str = "$.usage") -> dict[str, Column]:
    cost = F.try_variant_get(payload, f"{root}.cost", "double")
    return {
        "prompt_tokens": long_at(payload, f"{root}.prompt_tokens"),
        "completion_tokens": long_at(payload, f"{root}.completion_tokens"),
        "reasoning_tokens": long_at(payload, f"{root}.completion_tokens_details.reasoning_tokens"),
        "cost_microdollars": F.coalesce(F.bround(cost * F.lit(1_000_000.0)).cast("bigint"), F.lit(0).cast("bigint")),
    }


def envelope_columns(payload: Column) -> dict[str, Column]:
    """One buffered response as call-log columns."""
    message = "$.choices[0].message"
    return {
        "response_text": content_text(at(payload, f"{message}.content")),
        "reasoning_text": first_text(payload, f"{message}.reasoning", f"{message}.reasoning_content"),
        "finish_reason": F.coalesce(text_at(payload, "$.choices[0].finish_reason"), F.lit("")),
        "provider": F.coalesce(text_at(payload, "$.provider"), F.lit("")),
        **usage_columns(payload),
    }


def stream_error(payload: Column) -> Column:
    """``stream error CODE: MESSAGE``, or NULL when the payload carries none.
    An error object without a message is shown as its JSON text."""
    error = at(payload, "$.error")
    is_object = F.schema_of_variant(error).startswith("OBJECT")
    code = F.coalesce(F.nullif(F.nullif(text_at(payload, "$.error.code"), F.lit("")), F.lit("0")), F.lit("unknown"))
    message = F.coalesce(F.nullif(text_at(payload, "$.error.message"), F.lit("")), F.to_json(error))
    plain = F.try_variant_get(payload, "$.error", "string")
    empty = plain.isin("", "false", "0", "{}", "[]")
    return (
        F.when(error.isNull() | F.coalesce(empty, F.lit(False)) | (F.to_json(error) == "{}"), None)
        .when(is_object, F.concat(F.lit("stream error "), code, F.lit(": "), message))
        .otherwise(F.concat(F.lit("stream error: "), plain))
    )
