"""Fields of loosely shaped records, whose writers name and nest things in different ways.

A record is a VARIANT column (``parse_json``), so one expression serves all shapes
and only the fields asked for are decoded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.text import gold_label, path_stem, strip

#: Names of a field, in the order in which they count.
ALIASES = {
    "source_id": ("source_id", "id", "example_id", "utterance_id", "uid"),
    "sample_idx": ("sample_idx", "generation_idx", "candidate_idx", "trajectory_idx", "sample_id"),
    "gold": ("label", "gold_label", "target", "y"),
    "logprob": ("mean_token_logprob", "mean_logprob", "mean_logp", "avg_logprob", "average_logprob", "response_mean_logprob"),
    "finish_reason": ("finish_reason", "stop_reason"),
    "response": ("response", "generated_text", "completion", "output", "prediction_text", "assistant_response"),
    "inside_response": ("content", "text", "response"),
}


def _at(record: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(record, path, kind)


def _kind(value: Column) -> Column:
    """``STRING``, ``OBJECT``, ``ARRAY``, or another type of a variant; null for null and for JSON's null."""
    return F.nullif(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit("VOID"))


def _string(value: Column) -> Column:
    """A variant that is a string, as such."""
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _filled(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def alias(record: Column, family: str) -> Column:
    """The first field of a family that is there and not null, as text (booleans as ``true`` and ``false``)."""
    return F.coalesce(*[_at(record, f"$.{name}", "string") for name in ALIASES[family]])


def required_alias(record: Column, family: str) -> Column:
    """Like :func:`alias`; raises where no field of the family is set."""
    none = F.raise_error(F.lit(f"none of {', '.join(ALIASES[family])} is set"))
    return F.coalesce(alias(record, family), none.cast("string"))


def gold(record: Column) -> Column:
    """0 or 1 from the first gold field; raises without one, or on other values."""
    return gold_label(required_alias(record, "gold"))


def logprob(record: Column) -> Column:
    """The first log-probability field as a number; null if it is none."""
    return alias(record, "logprob").try_cast("double")


def finish_reason(record: Column) -> Column:
    """The reason why generation ended, lower-cased: of the record, else of its first choice."""
    own = F.coalesce(alias(record, "finish_reason"), _at(record, "$.choices[0].finish_reason", "string"))
    return F.lower(strip(own))


def message_text(content: Column) -> Column:
    """The text of a message: a string, or the texts of a list of parts, joined by newlines; null without any."""
    part = lambda p: F.coalesce(_string(p), _string(_at(p, "$.text")))
    parts = F.filter(F.transform(F.try_variant_get(content, "$", "array<variant>"), part), lambda t: t.isNotNull())
    return F.when(_kind(content) == "STRING", _string(content)).when((_kind(content) == "ARRAY") & (F.size(parts) > 0), F.array_join(parts, "\n"))


def response(record: Column) -> Column:
    """The generated text: of the first response field, the last assistant message, or the first choice; null without one.

    A response field may be a string, or an object that holds one. Blank texts do not count.
    """
    tries = []
    for name in ALIASES["response"]:
        tries.append(_filled(_string(_at(record, f"$.{name}"))))
        tries += [_filled(_string(_at(record, f"$.{name}.{inner}"))) for inner in ALIASES["inside_response"]]
    turns = F.filter(F.try_variant_get(record, "$.messages", "array<variant>"), lambda m: _at(m, "$.role", "string") == "assistant")
    said = F.filter(F.transform(turns, lambda m: _filled(message_text(_at(m, "$.content")))), lambda t: t.isNotNull())
    tries.append(F.try_element_at(said, F.lit(-1)))
    tries.append(_filled(message_text(_at(record, "$.choices[0].message.content"))))
    tries.append(_filled(_string(_at(record, "$.choices[0].text"))))
    return F.coalesce(*tries)


def user_text(record: Column) -> Column:
    """The texts of all user messages, two newlines between them."""
    turns = F.filter(F.try_variant_get(record, "$.messages", "array<variant>"), lambda m: _at(m, "$.role", "string") == "user")
    said = F.filter(F.transform(turns, lambda m: _filled(message_text(_at(m, "$.content")))), lambda t: t.isNotNull())
    return F.array_join(said, "\n\n")


def sampled_source_id(record: Column) -> Column:
    """The source of a sampled record: its source id, an id that is no 32-digit hash, or the stem of its first local file; raises without one.

    Media are a name or a list of names, each plain or as ``{"path": ...}``; URLs and data do not count.
    """
    own = _filled(_at(record, "$.id", "string"))
    own = F.when(~F.regexp_like(own, F.lit("^[0-9a-fA-F]{32}$")), own)

    def stem(field: str) -> Column:
        value = _at(record, f"$.{field}")
        many = F.when(_kind(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>")).when(_kind(value).isNotNull(), F.array(value))
        names = F.transform(many, lambda v: _filled(F.coalesce(_string(v), _string(_at(v, "$.path")))))
        local = F.filter(names, lambda n: n.isNotNull() & ~F.regexp_like(n, F.lit("^(?:https?://|data:)")))
        return F.try_element_at(F.filter(F.transform(local, path_stem), lambda s: s != ""), F.lit(1))

    none = F.raise_error(F.lit("cannot tell the source of a record")).cast("string")
    return F.coalesce(_filled(_at(record, "$.source_id", "string")), own, stem("videos"), stem("audios"), none)
