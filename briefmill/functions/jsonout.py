"""Structured output from raw model text: the object is found in Arrow batches, then repaired, checked and rendered in the JVM.

Finding reads forward: a decoder starts at an opening brace and tells where its object ends. What belongs to a vocabulary is
repaired by ``normal_enum``; the contract of outputs is one JSON schema.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, StringType, StructField, StructType

from briefmill.functions.text import normal_enum
from briefmill.functions.vocab import CHART_ALIASES, CHARTS, LIKERT, NO_OUTPUT, RAW_CHARS, RAW_LEAD, REQUIRED_KEYS, SECTIONS, TABLE_HEAD, TASK_ALIASES, TASKS

DECODER = json.JSONDecoder(strict=False)
FENCED = re.compile(r"```(?:json)?\s*(?=\{)")
FENCE_END = re.compile(r"\s*```")

#: The contract of an output, as a JSON schema.
CONTRACT: dict[str, Any] = {
    "type": "object",
    "required": REQUIRED_KEYS,
    "properties": {
        **{k: {"type": "object"} for k in ("context_summary", "layout", "styling")},
        "interactions": {"type": "array"},
        "kpi_chart_mapping": {
            "type": "array",
            "items": {
                "type": "object",
                "required": ["task_type", "chart_type"],
                "properties": {"kpi": {"type": "string"}, "task_type": {"enum": TASKS}, "chart_type": {"enum": CHARTS}, "alternatives": {"type": "array"}, "encoding": {"type": "object"}},
            },
        },
        "rationales": {"type": "array", "items": {"type": "object", "properties": {"claim": {"type": "string"}, "principle": {"type": "string"}}}},
    },
}
#: The same for outputs that may lack keys.
PARTIAL = {k: v for k, v in CONTRACT.items() if k != "required"}
KINDS = {"object": dict, "array": list, "string": str}



def struct_of(**kinds: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


TEXT, TEXTS, FLAG = StringType(), ArrayType(StringType()), BooleanType()
ENTRY = struct_of(kpi=TEXT, task_type=TEXT, chart_type=TEXT, alternatives=TEXTS, encoding=TEXT, sound=FLAG)
REASON = struct_of(claim=TEXT, principle=TEXT)
FOUND = struct_of(object=TEXT, keys=TEXTS, filled_keys=TEXTS, valid=FLAG, sound=FLAG, entries=ArrayType(ENTRY), interactions=TEXTS, rationales=ArrayType(REASON))


def obeys(value: Any, schema: dict[str, Any]) -> bool:
    """Whether a value obeys a schema of types, enums, required keys, properties and items."""
    if "type" in schema and not isinstance(value, KINDS[schema["type"]]):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        inner = schema.get("properties", {})
        return all(k in value for k in schema.get("required", ())) and all(obeys(value[k], inner[k]) for k in inner.keys() & value.keys())
    return not isinstance(value, list) or "items" not in schema or all(obeys(v, schema["items"]) for v in value)


def object_at(text: str, at: int) -> tuple[dict[str, Any] | None, int]:
    """The JSON object that begins at ``at`` and the place behind it; None if there is none."""
    try:
        made, end = DECODER.raw_decode(text, at)
    except (ValueError, RecursionError):
        return None, at
    return made, end


def find_object(text: str | None) -> dict[str, Any] | None:
    """The object of a fence; else the first object if no brace is closed behind it, so two objects are none."""
    if not text:
        return None
    if fence := FENCED.search(text):
        made, end = object_at(text, fence.end())
        if made is not None and FENCE_END.match(text, end):
            return made
    start = text.find("{")
    made, end = object_at(text, start) if start >= 0 else (None, 0)
    return made if text.rfind("}") < end else None


def text_of(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def token_of(value: Any) -> str | None:
    """A value that should be a word of a vocabulary, as text without blanks around it."""
    return None if value is None else str(value).strip()


def listed(value: Any, kind: type | tuple[type, ...]) -> list[Any]:
    return [v for v in value if isinstance(v, kind)] if isinstance(value, list) else []


def read_output(text: str | None) -> dict[str, Any]:
    """What one raw text holds, before any repair of its vocabulary; ``sound`` says whether the rest obeys the contract."""
    found = find_object(text)
    if found is None:
        return {"object": None, "keys": [], "filled_keys": [], "valid": False, "sound": False, "entries": [], "interactions": [], "rationales": []}
    keys = [k for k in REQUIRED_KEYS if k in found]
    entries = [
        {
            "kpi": text_of(e.get("kpi", "")),
            "task_type": token_of(e.get("task_type")),
            "chart_type": token_of(e.get("chart_type")),
            "alternatives": [a.strip() for a in listed(e.get("alternatives"), str)],
            "encoding": text_of(e.get("encoding", {})),
            "sound": isinstance(e.get("kpi", ""), str) and isinstance(e.get("encoding", {}), dict),
        }
        for e in listed(found.get("kpi_chart_mapping"), dict)
    ]
    actions = found.get("interactions", [])
    actions = [actions] if isinstance(actions, dict) else actions
    reasons = [{"claim": r, "principle": ""} if isinstance(r, str) else r for r in listed(found.get("rationales"), (str, dict))]
    # The mapping is checked entry by entry after its repair; what can be put right is not held against the rest.
    rest = found | {"kpi_chart_mapping": [] if isinstance(found.get("kpi_chart_mapping", []), list) else None, "interactions": actions}
    rest["rationales"] = reasons if isinstance(found.get("rationales", []), list) else None
    return {
        "object": json.dumps(found, ensure_ascii=False),
        "keys": keys,
        "filled_keys": [k for k in keys if found[k] is not None and found[k] not in ([], {}, "")],
        "valid": obeys(found, CONTRACT),
        "sound": obeys(rest, PARTIAL),
        "entries": entries,
        "interactions": [text_of(i) for i in actions] if isinstance(actions, list) else [],
        "rationales": [{"claim": text_of(r.get("claim", "")), "principle": text_of(r.get("principle", ""))} for r in reasons],
    }


@F.pandas_udf(FOUND)
def read_outputs(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_output(t) for t in texts], columns=FOUND.fieldNames())


def parsed_output(raw: Column | str) -> Column:
    """Everything that metrics need of a raw text: object, keys, filled_keys, valid, and, repaired, mapping, interactions and rationales.

    Entries whose task or chart can't be told are left out; error is no_json_found or schema_error, with which the last three are null.
    """
    found = read_outputs(raw)

    def entry(e: Column) -> Column:
        known = F.filter(F.transform(e["alternatives"], lambda a: normal_enum(a, CHARTS, CHART_ALIASES)), lambda a: a.isNotNull())
        task, chart = normal_enum(e["task_type"], TASKS, TASK_ALIASES), normal_enum(e["chart_type"], CHARTS, CHART_ALIASES)
        return F.struct(e["kpi"].alias("kpi"), task.alias("task_type"), chart.alias("chart_type"), known.alias("alternatives"), e["encoding"].alias("encoding"), e["sound"].alias("sound"))

    kept = F.filter(F.transform(found["entries"], entry), lambda e: e["task_type"].isNotNull() & e["chart_type"].isNotNull())
    error = F.when(found["object"].isNull(), "no_json_found").when(~found["sound"] | F.exists(kept, lambda e: ~e["sound"]), "schema_error")
    ok = error.isNull()
    mapping = F.transform(kept, lambda e: F.struct(*[e[c].alias(c) for c in ("kpi", "task_type", "chart_type", "alternatives", "encoding")]))
    same = [found[c].alias(c) for c in ("object", "keys", "filled_keys", "valid")]
    return F.struct(*same, F.when(ok, mapping).alias("mapping"), *[F.when(ok, found[c]).alias(c) for c in ("interactions", "rationales")], error.alias("error"))


def judge_scores(answer: Column, dimensions: list[str]) -> Column:
    """The scores in a judge's answer by dimension, rounded half to even and held to the scale; null without any."""
    made = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), "map<string,string>", {"allowSingleQuotes": "false"})

    def score(d: str) -> Column:
        number = F.try_element_at(made, F.lit(d)).try_cast("double")
        held = F.least(F.lit(LIKERT[1]), F.greatest(F.lit(LIKERT[0]), F.bround(number).cast("int")))
        return F.struct(F.lit(d).alias("d"), F.when(F.abs(number) < 1e9, held).alias("s"))

    scored = F.filter(F.array(*[score(d) for d in dimensions]), lambda x: x["s"].isNotNull())
    return F.when(F.size(scored) > 0, F.map_from_entries(scored))


def rendered(parsed: Column, raw: Column) -> Column:
    """An output as a rater sees it: the sections that it has, one below the other, or the raw text where it could not be parsed."""

    def pairs(key: str) -> Column:
        own = F.from_json(F.get_json_object(parsed["object"], f"$.{key}"), "map<string,string>")
        return F.transform(F.map_entries(own), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))))

    def table(_: str) -> Column:
        cells = lambda m: F.concat_ws(" | ", m["kpi"], m["task_type"], m["chart_type"], F.array_join(m["alternatives"], ", "))
        rows = F.transform(parsed["mapping"], lambda m: F.concat(F.lit("| "), cells(m), F.lit(" |")))
        return F.when(F.size(rows) > 0, F.concat(F.array(*[F.lit(x) for x in TABLE_HEAD]), rows))

    def items(key: str) -> Column:
        return F.transform(parsed[key], lambda x: F.concat(F.lit("- "), x))

    def reasons(key: str) -> Column:
        return F.transform(parsed[key], lambda r: F.concat(F.lit("- "), r["claim"], F.lit(" — _"), r["principle"], F.lit("_")))

    kinds = {"pairs": pairs, "table": table, "items": items, "reasons": reasons}
    parts = []
    for title, key, kind in SECTIONS:
        lines = kinds[kind](key)
        parts.append(F.when(F.size(lines) > 0, F.concat(F.lit(f"**{title}**\n"), F.array_join(lines, "\n"), F.lit("\n"))))
    text = F.when(raw.isNull() | (raw == ""), NO_OUTPUT).otherwise(F.substring(raw, 1, RAW_CHARS))
    return F.when(parsed["error"].isNull(), F.concat_ws("\n", *parts)).otherwise(F.concat(F.lit(RAW_LEAD), text, F.lit("\n```")))
