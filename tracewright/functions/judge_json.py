"""Reading what judges return: labels, scores and verdicts as JSON.

``strict_labels`` is a native column function; the others need the exact rules
of Python's JSON and literals and are Arrow-batched pandas functions.
"""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tracewright.session import ship_package

#: Components of a judgement, of a quality score, and aliases of the latter.
COMPONENTS = ("text", "audio", "visual", "integration")
MODALITIES = ("text", "audio", "visual")


def strict_labels(raw: Column) -> Column:
    """``(text, audio, visual, integration, error)`` from a JSON object of four 0/1 integers.

    Errors: ``missing``, ``invalid_json``, ``not_json_object``, ``wrong_fields``, ``invalid_<component>_value``.
    Input with a repeated key counts as invalid JSON.
    """
    v = F.try_parse_json(raw)
    trimmed = F.btrim(raw, F.lit(" \t\r\n"))
    kinds = {c: F.schema_of_variant(F.try_variant_get(v, f"$.{c}", "variant")) for c in COMPONENTS}
    values = {c: F.try_variant_get(v, f"$.{c}", "int") for c in COMPONENTS}
    keys = F.array_sort(F.json_object_keys(raw))
    error = (
        F.when(raw.isNull() | (trimmed == ""), "missing")
        .when(v.isNull(), "invalid_json")
        .when(~F.regexp_like(trimmed, F.lit(r"(?s)^\{.*\}$")), F.when(F.regexp_like(trimmed, F.lit(r"^\{")), "invalid_json").otherwise("not_json_object"))
        .when(keys.isNull() | (F.array_join(keys, ",") != ",".join(sorted(COMPONENTS))), "wrong_fields")
    )
    for c in COMPONENTS:
        error = error.when(~(F.coalesce(kinds[c] == "BIGINT", F.lit(False)) & F.coalesce(values[c].isin(0, 1), F.lit(False))), f"invalid_{c}_value")
    return F.struct(*[F.when(error.isNull(), values[c]).alias(c) for c in COMPONENTS], error.alias("error"))


def read_labels(raw) -> dict:
    """The rules of :func:`strict_labels` with Python's JSON (the last of repeated keys counts)."""
    out = dict.fromkeys((*COMPONENTS, "error"))
    if isinstance(raw, dict):
        value = raw
    elif not isinstance(raw, str):
        return out | {"error": "missing" if raw is None else "invalid_type"}
    elif not raw.strip():
        return out | {"error": "missing"}
    else:
        try:
            value = json.loads(raw)
        except ValueError:
            return out | {"error": "invalid_json"}
    if not isinstance(value, dict):
        return out | {"error": "not_json_object"}
    if set(value) != set(COMPONENTS):
        return out | {"error": "wrong_fields"}
    for c in COMPONENTS:
        if type(value[c]) is not int or value[c] not in (0, 1):
            return out | {"error": f"invalid_{c}_value"}
    return out | value


def _unique(pairs: list) -> dict:
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError("repeated key")
    return dict(pairs)


def read_scores(raw) -> dict:
    """``(text, audio, visual, mode, error)`` from a JSON object of three scores, 1 to 3.

    A finished thinking part in front, one code fence around, and ``_evidence`` key names are accepted and recorded in ``mode``.
    """
    out = dict.fromkeys((*MODALITIES, "mode", "error"))
    if not isinstance(raw, str):
        return out | {"error": "not_a_string"}
    head, thought, body = raw.rpartition("</think>")
    mode = "after_think" if thought else "json"
    body = body.strip()
    if "<think>" in body:
        return out | {"error": "unfinished_thinking"}
    if fence := re.fullmatch(r"```(?:json)?\s*(.*?)\s*```", body, re.DOTALL):
        body, mode = fence[1], mode + "+fence"
    try:
        value = json.loads(body, object_pairs_hook=_unique)
    except ValueError:
        return out | {"error": "invalid_json"}
    if not isinstance(value, dict):
        return out | {"error": "wrong_fields"}
    if set(value) == {f"{m}_evidence" for m in MODALITIES}:
        value, mode = {m: value[f"{m}_evidence"] for m in MODALITIES}, mode + "+evidence_keys"
    if set(value) != set(MODALITIES):
        return out | {"error": "wrong_fields"}
    for m in MODALITIES:
        if type(value[m]) is not int or not 1 <= value[m] <= 3:
            return out | {"error": f"invalid_{m}_value"}
    return out | value | {"mode": mode}


def _objects(raw: str, unescape: bool):
    """Dicts that the text, its unfenced form or its outermost braces spell, as JSON or a Python literal."""
    text = raw.strip()
    forms = [text]
    if "```" in text:
        forms.append(re.sub(r"```(?:json|JSON)?", "", text).strip())
    if unescape and '\\"' in text:
        forms.append(text.replace('\\"', '"'))
    if 0 <= (lo := text.find("{")) < (hi := text.rfind("}")):
        forms.append(text[lo : hi + 1])
    for form in forms:
        for read in (json.loads, ast.literal_eval):
            try:
                value = read(form)
            except Exception:  # noqa: BLE001, S112 - any malformed text is just not a dict
                continue
            if isinstance(value, dict):
                yield value
            break


#: Issue names that judges use, and what they stand for.
ISSUES = {
    "OVERINTERPRETED": "OVERINTERPRETATION",
    "HALLUCINATION": "HALLUCINATED_CUE",
    "HALLUCINATED": "HALLUCINATED_CUE",
    "MISATTRIBUTED": "MISATTRIBUTION",
}
_VERDICTS = {"SUPPORTED": 1, "UNSUPPORTED": 0}


def read_verdict(raw, drift: bool = False, unescape: bool = False, issues: tuple[str, ...] = ()) -> dict:
    """``(verdict, grounded, issue, evidence, parse_ok, issue_ok)`` from a judge's answer, as leniently as possible.

    ``drift`` also reads answers whose verdict names an issue (unsupported) and those
    that only have an issue; ``issues`` are the issue names that count as valid.
    """
    out = {"verdict": None, "grounded": None, "issue": None, "evidence": None, "parse_ok": False, "issue_ok": False}
    if not isinstance(raw, str):
        return out
    for value in _objects(raw, unescape):
        verdict = str(value.get("verdict") or "").strip().upper()
        issue = str(value.get("issue") or "NONE").strip().upper()
        issue = ISSUES.get(issue, issue)
        if drift and verdict not in _VERDICTS:
            if verdict and verdict != "NONE":
                issue, verdict = ISSUES.get(verdict, verdict), "UNSUPPORTED"
            elif value.get("issue") is not None:
                verdict = "SUPPORTED" if issue == "NONE" else "UNSUPPORTED"
        if verdict in _VERDICTS:
            evidence = value.get("evidence")
            evidence = evidence if evidence is None or isinstance(evidence, str) else json.dumps(evidence, ensure_ascii=False)
            return {"verdict": verdict, "grounded": _VERDICTS[verdict], "issue": issue, "evidence": evidence, "parse_ok": True, "issue_ok": not issues or issue in issues}
    if found := re.search(r"""["']?verdict["']?\s*:\s*["']?(SUPPORTED|UNSUPPORTED)["']?""", raw, re.IGNORECASE):
        verdict = found[1].upper()
        return out | {"verdict": verdict, "grounded": _VERDICTS[verdict], "parse_ok": True}
    return out


def _frame(raw: pd.Series, read, columns: tuple[str, ...]) -> pd.DataFrame:
    return pd.DataFrame([read(x) for x in raw], columns=list(columns))


def labels_udf():
    """The exact label parser as a pandas function."""
    ship_package(SparkSession.active())

    @F.pandas_udf("text int, audio int, visual int, integration int, error string")
    def parse(raw: pd.Series) -> pd.DataFrame:
        return _frame(raw, read_labels, (*COMPONENTS, "error")).astype({c: "Int32" for c in COMPONENTS})

    return parse


def scores_udf():
    ship_package(SparkSession.active())

    @F.pandas_udf("text int, audio int, visual int, mode string, error string")
    def parse(raw: pd.Series) -> pd.DataFrame:
        return _frame(raw, read_scores, (*MODALITIES, "mode", "error")).astype({c: "Int32" for c in MODALITIES})

    return parse


def verdict_udf(drift: bool = False, unescape: bool = False, issues: tuple[str, ...] = ()):
    ship_package(SparkSession.active())

    @F.pandas_udf("verdict string, grounded int, issue string, evidence string, parse_ok boolean, issue_ok boolean")
    def parse(raw: pd.Series) -> pd.DataFrame:
        columns = ("verdict", "grounded", "issue", "evidence", "parse_ok", "issue_ok")
        return _frame(raw, lambda x: read_verdict(x, drift, unescape, issues), columns).astype({"grounded": "Int32"})

    return parse


def label_json(labels: dict[str, Column]) -> Column:
    """The compact target object, keys in fixed order."""
    parts = []
    for i, c in enumerate(COMPONENTS):
        parts += [F.lit(("{" if i == 0 else ",") + f'"{c}":'), labels[c].cast("string")]
    return F.concat(*parts, F.lit("}"))


def payload_json(transcript: Column, sections: dict[str, Column]) -> Column:
    """What a quality judge sees, as JSON: the transcript and the three evidence sections, and nothing that tells the answer."""
    shown = F.struct(*[sections[f"{m}_evidence"].alias(m) for m in MODALITIES])
    return F.to_json(F.struct(transcript.alias("TRANSCRIPT"), shown.alias("CANDIDATE_SECTIONS")), {"ignoreNullFields": "false"})
