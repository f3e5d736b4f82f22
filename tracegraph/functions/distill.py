"""Requests to, and replies from, a chat model that distils decisions; pure functions, and an injected client."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

CONFIDENCE = 0.9
EXTRACTOR = "byo-llm-v1"
DIALECTS = ("openai", "anthropic")
INSTRUCTION = (
    "List the durable engineering decisions in this chat turn. Answer with a JSON object only: "
    '{"decisions": [{"decision": "one sentence", "rationale": "why, or empty", "rejected": ["alternatives"]}]}, '
    "and an empty list if there is none."
)


@dataclass
class Distilled:
    decision: str
    rationale: str = ""
    rejected: list[str] = field(default_factory=list)


def dialect_of(endpoint: str, provider: str | None = None) -> str:
    """The dialect asked for, else the one the endpoint's name suggests."""
    if provider in DIALECTS:
        return provider
    return "anthropic" if "anthropic" in endpoint else "openai"


def build_request(dialect: str, model: str, text: str) -> dict:
    user = {"role": "user", "content": text}
    if dialect == "anthropic":
        return {"model": model, "max_tokens": 1024, "temperature": 0, "system": INSTRUCTION, "messages": [user]}
    return {"model": model, "temperature": 0, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": INSTRUCTION}, user]}


def _content(dialect: str, body: dict) -> str:
    try:
        if dialect == "anthropic":
            return next(b["text"] for b in body["content"] if isinstance(b.get("text"), str))
        content = body["choices"][0]["message"]["content"]
    except (KeyError, IndexError, TypeError, StopIteration, AttributeError) as e:
        raise ValueError(f"the {dialect} reply has no text") from e
    if not isinstance(content, str):
        raise ValueError(f"the {dialect} reply has no text")
    return content


def parse_response(dialect: str, body: dict) -> list[Distilled]:
    """Decisions of a reply: a list, one object, or a ``decisions`` wrapper, fenced or not; malformed items are skipped."""
    text = re.sub(r"^```(?:json)?\n*|\s*```$", "", _content(dialect, body).strip())
    try:
        value = json.loads(text)
    except ValueError:
        raise ValueError(f"the reply is no JSON: {len(text)} characters") from None
    if isinstance(value, dict):
        value = value["decisions"] if isinstance(value.get("decisions"), list) else [value]
    if not isinstance(value, list):
        raise ValueError("the reply is neither a list nor an object")
    out = []
    for item in value:
        if not isinstance(item, dict) or not isinstance(item.get("decision"), str) or not item["decision"].strip():
            continue
        why, rejected = item.get("rationale", ""), item.get("rejected", [])
        if isinstance(why, str) and isinstance(rejected, list) and all(isinstance(r, str) for r in rejected):
            out.append(Distilled(item["decision"], why, rejected))
    return out


def augment(candidates: DataFrame, call: Callable[[dict], dict], dialect: str, model: str) -> DataFrame:
    """Candidate decisions (session, idx, turn_text, text, …) with the model's where it gives any; on an error the cue's own stays.

    ``call`` posts a request and returns the reply; it runs on the executors.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                try:
                    got = parse_response(dialect, call(build_request(dialect, model, r["turn_text"])))
                except (ValueError, OSError):
                    got = []
                rows += [r | {"text": d.decision, "rationale": d.rationale, "rejected": d.rejected, "confidence": CONFIDENCE, "extractor": EXTRACTOR} for d in got] or [r]
            yield pd.DataFrame(rows, columns=pdf.columns)

    return candidates.mapInPandas(run, candidates.schema)
