"""Column functions over model output: tags, answers, templates, ids and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sections that a response must have, in order.
SECTIONS = ("text_evidence", "audio_evidence", "visual_evidence", "integration", "answer")
REASONING = SECTIONS[:4]

#: What Python's str.strip() and \s take for blank, as a class and as characters.
_SPACE = r"(?U)[\s\x1c-\x1f]"
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without blanks of any script at both ends."""
    return F.btrim(c, F.lit(_BLANKS))


def collapse(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, _SPACE + "+", " "))


def occurrences(text: Column, part: str) -> Column:
    """How often a string occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


# --- tags ---------------------------------------------------------------------


def tag(text: Column, name: str) -> Column:
    """The body of the only ``<name>..</name>``, any case, stripped; null if missing, repeated or blank."""
    found = F.regexp_extract_all(text, F.lit(rf"(?is)<{name}>(.*?)</{name}>"), F.lit(1))
    body = strip(F.get(found, F.lit(0)))
    return F.when((F.size(found) == 1) & (body != ""), body)


_TAGS = "|".join(SECTIONS)
#: Text up to and with the next opening or closing tag of a section, in any case, or up to the end. It never goes back over what it has read.
_CHUNK = rf"(?i)[^<]*+(?:<(?!/?(?:{_TAGS})>)[^<]*+)*+(?:</?(?:{_TAGS})>|\z)"


def with_sections(rows: DataFrame, response: str = "response", name: str = "parsed") -> DataFrame:
    """The rows with a struct of all sections, each as :func:`tag` reads it, from one pass over the response.

    The response is cut behind every tag once; sections are then found among the tags by their places. Each of the two
    steps is a generator of one row, which the optimizer takes as it is: it neither copies the steps into later uses nor into
    filters, while filters on other columns pass below them.
    """
    chunks, tags, found = (_unused(n, rows.columns) for n in ("_chunks", "_tags", "_found"))
    out = rows.withColumn(chunks, F.explode(F.array(F.regexp_extract_all(F.col(response), F.lit(_CHUNK), F.lit(0)))))
    # The tag at the end of a chunk, as "answer>" or "/answer>"; what follows the last tag has none.
    out = out.withColumn(tags, F.transform(chunks, lambda c: F.when(c.contains("<"), F.lower(F.substring_index(c, "<", -1))).otherwise("")))
    bodies = F.transform(F.array(*[F.lit(s) for s in SECTIONS]), lambda s: _body(s, F.col(tags), F.col(chunks)))
    out = out.withColumn(found, F.explode(F.array(bodies)))
    parsed = F.struct(*[F.get(found, F.lit(i)).alias(s) for i, s in enumerate(SECTIONS)])
    return out.withColumn(name, parsed).drop(chunks, tags, found)


def _unused(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _body(section: Column, tags: Column, chunks: Column) -> Column:
    """The body of a section that opens and closes once: what lies between its first opening tag and the next closing one."""
    opening, closing = F.concat(section, F.lit(">")), F.concat(F.lit("/"), section, F.lit(">"))
    behind = lambda a, i: F.slice(a, i + 1, F.size(a))

    def cut(first, rest, last):
        more = behind(rest, last)
        again = (F.array_position(more, opening) > 0) & (F.array_position(behind(more, F.array_position(more, opening)), closing) > 0)
        whole = F.array_join(F.slice(chunks, first + 1, last.cast("int")), "")
        body = strip(F.left(whole, F.length(whole) - F.length(closing) - 1))
        return F.when((first > 0) & (last > 0) & ~again, F.nullif(body, F.lit("")))

    return _let(F.array_position(tags, opening), lambda first: _let(behind(tags, first), lambda rest: _let(F.array_position(rest, closing), lambda last: cut(first, rest, last))))


def strict_tag_error(text: Column, names: tuple[str, ...] = SECTIONS) -> Column:
    """Why the first offending tag cannot be read, tags in exact case; null if all can.

    Reasons: ``<tag>_open_count_<n>``, ``<tag>_close_count_<n>``, ``<tag>_not_parseable``, ``<tag>_empty``.
    """
    reason = F.lit(None).cast("string")
    for name in reversed(names):
        opened, closed = occurrences(text, f"<{name}>"), occurrences(text, f"</{name}>")
        body = F.regexp_extract_all(text, F.lit(rf"(?s)<{name}>(.*?)</{name}>"), F.lit(1))
        reason = (
            F.when(opened != 1, F.concat(F.lit(f"{name}_open_count_"), opened.cast("string")))
            .when(closed != 1, F.concat(F.lit(f"{name}_close_count_"), closed.cast("string")))
            .when(F.size(body) < 1, F.lit(f"{name}_not_parseable"))
            .when(strip(F.get(body, F.lit(0))) == "", F.lit(f"{name}_empty"))
            .otherwise(reason)
        )
    return reason


def is_complete(text: Column) -> Column:
    """All closing tags are there, in exact case."""
    out = F.lit(True)
    for s in SECTIONS:
        out = out & text.contains(f"</{s}>")
    return F.coalesce(out, F.lit(False))


def format_valid(parsed: Column) -> Column:
    """All sections, and an answer of the strict two-word form."""
    out = answer_label(parsed["answer"], "exact").isNotNull()
    for s in REASONING:
        out = out & parsed[s].isNotNull()
    return out


def reasoning(parsed: Column) -> Column:
    """The reasoning sections without the answer, as tagged blocks; null if one is missing."""
    blocks = [F.concat(F.lit(f"<{s}>\n"), parsed[s], F.lit(f"\n</{s}>")) for s in REASONING]
    out = blocks[0]
    for b in blocks[1:]:
        out = F.concat(out, F.lit("\n\n"), b)
    return out


def canonical_target(parsed: Column) -> Column:
    """The training target: reasoning blocks and the normalised answer; null if anything is missing."""
    label = label_text(answer_label(parsed["answer"], "lenient"))
    return F.concat(reasoning(parsed), F.lit("\n\n<answer>\n"), label, F.lit("\n</answer>"))


# --- answers ------------------------------------------------------------------

#: Accepted spellings, after the mode's own normalisation.
_ANSWERS = {
    "spaced": (("sarcasm",), ("non-sarcasm", "non sarcasm")),
    "lenient": (("sarcasm", "sarcastic"), ("nonsarcasm", "nonsarcastic")),
    "words": (("sarcasm",), ("non sarcasm", "nonsarcasm")),
    "exact": (("sarcasm",), ("non-sarcasm",)),
    "verdict": (("SUPPORTED",), ("UNSUPPORTED",)),
}


def answer_label(answer: Column, mode: str = "lenient") -> Column:
    """1, 0 or null for an answer (or, in mode ``tagged``, for a whole response).

    Modes: ``spaced`` (blanks collapsed), ``lenient`` (blanks, ``_`` and ``-`` removed),
    ``words`` (``_`` and ``-`` as blanks), ``exact`` (lower-cased only), ``verdict``
    (SUPPORTED or UNSUPPORTED), ``tagged`` (first ``<answer>`` tag that holds an exact answer).
    """
    if mode == "tagged":
        found = F.lower(F.regexp_extract(answer, r"(?iU)<answer>\s*(Sarcasm|Non-Sarcasm)\s*</answer>", 1))
        return F.when(found == "sarcasm", 1).when(found == "non-sarcasm", 0)
    x = {
        "spaced": lambda: F.lower(collapse(answer)),
        "lenient": lambda: F.regexp_replace(F.lower(strip(answer)), r"(?U)[\s_-]+", ""),
        "words": lambda: collapse(F.regexp_replace(F.lower(strip(answer)), "[_-]", " ")),
        "exact": lambda: F.lower(strip(answer)),
        "verdict": lambda: F.upper(strip(answer)),
    }[mode]()
    yes, no = _ANSWERS[mode]
    return F.when(x.isin(*yes), 1).when(x.isin(*no), 0)


def gold_label(value: Column) -> Column:
    """0 or 1 from any spelling of a gold label; raises on others."""
    x = F.lower(strip(value.cast("string")))
    # Fixed values.
    yes = ("1", "1.0", "true", "sarcasm", "sarcastic")
    no = ("0", "0.0", "false", "non-sarcasm", "non_sarcasm", "nonsarcasm", "non-sarcastic", "non sarcastic")
    return F.when(x.isin(*yes), 1).when(x.isin(*no), 0).otherwise(F.raise_error(F.concat(F.lit("unsupported gold label: "), F.coalesce(x, F.lit("null")))).cast("int"))


def label_text(label: Column) -> Column:
    return F.when(label == 1, "Sarcasm").when(label == 0, "Non-Sarcasm")


def answer_error(response: Column) -> Column:
    """``missing_response``, ``missing_answer_tag``, ``multiple_answer_tags``, ``invalid_answer``, or null."""
    found = F.regexp_extract_all(response, F.lit(r"(?is)<answer>(.*?)</answer>"), F.lit(1))
    return (
        F.when(response.isNull() | (strip(response) == ""), "missing_response")
        .when(F.size(found) == 0, "missing_answer_tag")
        .when(F.size(found) > 1, "multiple_answer_tags")
        .when(answer_label(F.get(found, F.lit(0)), "lenient").isNull(), "invalid_answer")
    )


def parsed_answer(response: Column) -> Column:
    """The label of a response whose :func:`answer_error` is null."""
    found = F.regexp_extract_all(response, F.lit(r"(?is)<answer>(.*?)</answer>"), F.lit(1))
    return F.when(answer_error(response).isNull(), answer_label(F.get(found, F.lit(0)), "lenient"))


# --- templates and transcripts --------------------------------------------------


def fill(template: Column, values: dict[str, Column], required: bool = False) -> Column:
    """Replace ``{{KEY}}`` literally; with ``required``, raise where a placeholder is missing."""
    out = template
    for key, value in values.items():
        mark = "{{" + key + "}}"
        if required:
            out = F.when(template.contains(mark), F.replace(out, F.lit(mark), value)).otherwise(F.raise_error(F.lit(f"template lacks {mark}")).cast("string"))
        else:
            out = F.replace(out, F.lit(mark), value)
    return out


def transcript_line(message: Column) -> Column:
    """The rest of the first line that starts a transcript, unquoted; null without one."""
    found = F.regexp_extract(message, r"""(?isU)(?:transcript|utterance|text)\s*:\s*["']?(.+?)["']?(?:\n|\z)""", 1)
    return F.nullif(strip(found), F.lit(""))


#: Tried in order, the first match that is not blank wins.
TRANSCRIPTS = (
    r"""<transcript>\s*(.*?)\s*</transcript>""",
    r"""Transcript\s*:\s*["“](.*?)["”]""",
    r"""Transcript\s*:\s*\n\s*(.+?)(?:\n\s*\n|\z)""",
    r"""Transcript\s*:\s*(.+?)(?:\n\s*\n|\z)""",
    r"""Utterance\s*:\s*["“](.*?)["”]""",
    r"""Utterance\s*:\s*\n\s*(.+?)(?:\n\s*\n|\z)""",
)


def transcript(message: Column, *direct: Column, required: bool = False) -> Column:
    """The first direct field that is not blank, else the first pattern's match in the message.

    Null without any, or an error with ``required``.
    """
    filled = lambda c: F.nullif(strip(c), F.lit(""))
    tries = [*[filled(c) for c in direct], *[filled(F.regexp_extract(message, "(?isU)" + p, 1)) for p in TRANSCRIPTS]]
    if required:
        tries.append(F.raise_error(F.concat(F.lit("no transcript in: "), preview(F.coalesce(message, F.lit(""))))).cast("string"))
    return F.coalesce(*tries)


def content_text(parts: Column) -> Column:
    """Text parts (``type``, ``text``) of a message joined by newlines."""
    texts = F.filter(parts, lambda p: p["text"].isNotNull() & (F.coalesce(p["type"], F.lit("text")) == "text"))
    return F.array_join(F.transform(texts, lambda p: p["text"]), "\n")


def last_of_role(messages: Column, role: str) -> Column:
    """The content of the last message of a role."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"]


def preview(text: Column, limit: int = 70) -> Column:
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > limit, F.concat(F.substr(flat, F.lit(1), F.lit(limit - 3)), F.lit("..."))).otherwise(flat)


# --- ids and paths --------------------------------------------------------------


def path_stem(path: Column) -> Column:
    """The last component without its last suffix; a dot that begins or ends it begins no suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?/*$", 1)


def numeric_id(value: Column) -> Column:
    return F.regexp_replace(value, r"\.0$", "")


def source_id(source: Column, own: Column, video: Column, audio: Column, skip_hashes: bool = False) -> Column:
    """The first usable of: source id, own id, video stem, audio stem.

    With ``skip_hashes`` an own id of 32 hex digits does not count, nor do media that are URLs or data.
    """
    blank = lambda c: F.nullif(strip(c.cast("string")), F.lit(""))
    stem = lambda c: blank(path_stem(c))
    if skip_hashes:
        own = F.when(~F.regexp_like(own.cast("string"), F.lit("^[0-9a-fA-F]{32}$")), own)
        local = lambda c: F.when(~F.regexp_like(c, F.lit(r"^(?:[a-z]+://|data:)")), c)
        video, audio = local(video), local(audio)
    return F.coalesce(blank(source), blank(own), stem(video), stem(audio))


def judge_key(split: Column, source: Column, sample: Column, ordinal: Column) -> Column:
    return F.concat_ws(":", split.cast("string"), source.cast("string"), F.coalesce(sample.cast("string"), ordinal.cast("string")))


def method_family(variant: Column) -> Column:
    """``(family, method)`` of a run name such as ``grpo_best_8``."""
    family = F.regexp_extract(variant, "^(sft|grpo|grporm)_", 1)
    return F.struct(F.nullif(family, F.lit("")).alias("family"), F.nullif(F.regexp_extract(variant, "^(?:sft|grpo|grporm)_(.+)$", 1), F.lit("")).alias("method"))


def split_of(path: str) -> str:
    """The split that a file name tells; exactly one must match."""
    name = path.rsplit("/", 1)[-1].lower()
    found = {s for s, p in (("train", "train"), ("valid", "valid|dev"), ("test", "test")) if re.search(rf"(?:^|[_.-])(?:{p})(?:[_.-]|$)", name)}
    if len(found) != 1:
        raise ValueError(f"cannot tell the split of {path!r}: {sorted(found)}")
    return found.pop()
