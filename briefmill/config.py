"""Experiment configurations: groups of settings put together, overridden by dotted names, and hashed once."""

from __future__ import annotations

import copy
from typing import Any

from briefmill.functions.ids import config_hash

#: Groups and their options; an experiment names one option of each.
GROUPS: dict[str, dict[str, dict[str, Any]]] = {
    "method": {
        "prompt_only": {"name": "prompt_only", "retriever": None, "adapter_path": None},
        "rag": {"name": "rag", "retriever": "tfidf", "top_k": 3, "adapter_path": None},
        "ft": {"name": "ft", "retriever": None, "adapter_path": "adapters/latest"},
        "ft_rag": {"name": "ft_rag", "retriever": "tfidf", "top_k": 3, "adapter_path": "adapters/latest"},
    },
    "retriever": {"tfidf": {}, "bm25": {}, "dense": {"embed": "hashed"}},
    "eval": {
        "full": {"metrics": ["schema_compliance", "topk_accuracy", "macro_f1", "latency", "grounding", "robustness", "missing_info"]},
        "quick": {"metrics": ["schema_compliance", "topk_accuracy"]},
        "with_judge": {"metrics": ["schema_compliance", "topk_accuracy", "macro_f1", "latency", "grounding", "robustness", "missing_info", "g_eval"]},
    },
    "data": {"processed": {"folder": "data/processed", "max_samples": None}},
}
DEFAULT = {"experiment_name": "run", "seed": 42, "model": "echo", "method": "prompt_only", "retriever": "tfidf", "eval": "full", "data": "processed"}


def parsed(value: str) -> Any:
    low = value.lower()
    if low in ("null", "none", ""):
        return None
    if low in ("true", "false"):
        return low == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            continue
    return value


def compose(experiment: dict[str, Any] | None = None, overrides: list[str] | None = None) -> dict[str, Any]:
    """The full configuration of an experiment. An override is ``name=value``; the name of a group picks another option."""
    chosen = DEFAULT | (experiment or {})
    pairs = [o.split("=", 1) for o in overrides or []]
    for name, value in pairs:
        if name in GROUPS:
            chosen[name] = value
    out: dict[str, Any] = {k: v for k, v in chosen.items() if k not in GROUPS}
    wanted = {name: parsed(value) for name, value in pairs}.get("method.retriever", GROUPS["method"].get(chosen["method"], {}).get("retriever"))
    if wanted and not any(name == "retriever" for name, _ in pairs):
        chosen["retriever"] = wanted
    for group, options in GROUPS.items():
        if chosen[group] not in options:
            raise KeyError(f"no {group} {chosen[group]!r}; there are {', '.join(sorted(options))}")
        out[group] = copy.deepcopy(options[chosen[group]])
    # The options of a retriever are those of the one that the method uses.
    out["retriever_name"] = chosen["retriever"]
    for name, value in pairs:
        if name in GROUPS:
            continue
        at = out
        *way, last = name.split(".")
        for part in way:
            at = at.setdefault(part, {})
        at[last] = parsed(value)
    out["config_hash"] = config_hash(out)
    return out


def get(config: dict[str, Any], name: str, default: Any = None) -> Any:
    """A setting by its dotted name."""
    at: Any = config
    for part in name.split("."):
        if not isinstance(at, dict) or part not in at:
            return default
        at = at[part]
    return at
