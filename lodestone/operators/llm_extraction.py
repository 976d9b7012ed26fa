"""Entities and relations that a language model names in its answer."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from lodestone.operators.extraction import identity


@runtime_checkable
class LanguageModel(Protocol):
    def complete(self, prompt: str, temperature: float | None = None, max_tokens: int | None = None) -> str: ...

    def is_available(self) -> bool: ...


@runtime_checkable
class EmbeddingModel(Protocol):
    dimension: int

    def embed(self, text: str) -> list[float]: ...

    def is_available(self) -> bool: ...


EXTRACT = """List the entities of the text below, and how they relate.

Entity types: {entity_types}

Answer with one JSON object and nothing else:
{"entities": [{"name": "...", "type": "...", "description": "..."}],
 "relationships": [{"source": "...", "target": "...", "description": "...", "strength": 0.0}]}

Text:
{input_text}
"""

GLEAN = """Some entities or relations of the text may be missing from the list so far.

Entity types: {entity_types}
Known entities:
{previous_entities}
Known relations:
{previous_relationships}

Answer with a JSON object of the same form that holds only what is new; use empty lists if nothing is.

Text:
{input_text}
"""

COMPLETE = """Do these lists hold every entity and relation of the text? Answer YES or NO.

Entities:
{entities}
Relations:
{relationships}
Text:
{input_text}
"""

ANSWER = """Answer the question from the context alone. If the context does not hold the answer, say so.

Context:
{context}

Question: {question}
"""


def fill(template: str, values: dict[str, str]) -> str:
    """template with each {key} replaced once; unknown keys stay and inserted text is never looked at again."""
    return re.sub(r"\{(\w+)\}", lambda m: values.get(m[1], m[0]), template)


def _text(item: dict, *names: str) -> str | None:
    return next((item[n] for n in names if isinstance(item.get(n), str)), None)


def _decode(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    if not isinstance(found, dict):
        return None

    def listed(key: str) -> list[dict]:
        rows = found.get(key)
        return rows if isinstance(rows, list) and all(isinstance(x, dict) for x in rows) else []

    def strength(x: dict) -> float | None:
        return next((float(x[n]) for n in ("strength", "relationship_strength") if isinstance(x.get(n), (int, float)) and not isinstance(x[n], bool)), None)

    return {
        "entities": [{"name": _text(x, "name", "entity_name") or "", "type": _text(x, "type", "entity_type") or "", "description": _text(x, "description", "entity_description")} for x in listed("entities")],
        "relationships": [
            {"source": _text(x, "source", "source_entity") or "", "target": _text(x, "target", "target_entity") or "", "description": _text(x, "description", "relationship_description") or "", "strength": strength(x)}
            for x in listed("relationships")
        ],
    }


def _fenced(text: str) -> str | None:
    start = text.find("```")
    if start < 0:
        return None
    rest = text[start + 3 :]
    head, line, tail = rest.partition("\n")
    if line and head.strip().lower() in ("", "json"):
        rest = tail
    end = rest.find("```")
    return rest[:end] if end >= 0 else None


def parse(answer: str) -> dict | None:
    """The payload of an answer: the whole of it, a fenced block, or what lies from the first '{' to the last '}'."""
    first, last = answer.find("{"), answer.rfind("}")
    tries = (answer, _fenced(answer), answer[first : last + 1] if 0 <= first < last else None)
    return next((x for x in (_decode(t) for t in tries if t is not None) if x is not None), None)


def relation_label(description: str) -> str:
    words = ("".join(c for c in w if c.isalpha() or c.isnumeric()).upper() for w in description.split()[:3])
    return "_".join(w for w in words if w) or "RELATED_TO"


def token_range(needle: str, text: str) -> tuple[int, int] | None:
    """Where needle first stands as whole words."""
    at = 0
    while needle and (at := text.find(needle, at)) >= 0:
        end = at + len(needle)
        if not any(c.isalpha() or c.isnumeric() for c in (text[at - 1 : at], text[end : end + 1]) if c):
            return at, end
        at = end
    return None


def convert(payload: dict, text: str, chunk_id: str) -> tuple[list[dict], list[dict]]:
    """Entities (one per id, with the first whole-word mention) and the relations among them."""
    lowered, found, by_name = text.lower(), {}, {}
    for item in payload["entities"]:
        name = item["name"].strip()
        if not name:
            continue
        kind = item["type"].upper() or "CONCEPT"
        key = identity(kind, name)
        e = found.setdefault(key, {"entity_id": key, "name": name, "entity_type": kind, "confidence": 0.9, "mentions": []})
        if spot := token_range(name.lower(), lowered):
            e["mentions"].append({"chunk_id": chunk_id, "start_offset": spot[0], "end_offset": spot[1], "confidence": 0.9})
        by_name[name.lower()] = key
    edges = []
    for item in payload["relationships"]:
        ends = [by_name.get(item[x].strip().lower()) for x in ("source", "target")]
        if None not in ends:
            sure = 0.7 if item["strength"] is None else min(1.0, max(0.0, item["strength"]))
            edges.append({"source": ends[0], "target": ends[1], "relation_type": relation_label(item["description"]), "confidence": sure, "context": [chunk_id]})
    return list(found.values()), edges


@dataclass(frozen=True)
class ModelExtractor:
    """An extractor for extraction.extract(): asks the model, then asks `gleaning` times for what is missing."""

    model: LanguageModel
    entity_types: tuple[str, ...] = ("PERSON", "ORGANIZATION", "LOCATION", "EVENT", "CONCEPT")
    temperature: float = 0.0
    max_tokens: int = 1500
    gleaning: int = 0

    def _ask(self, template: str, **values: str) -> dict | None:
        prompt = fill(template, {"entity_types": ", ".join(self.entity_types), **values})
        return parse(self.model.complete(prompt, temperature=self.temperature, max_tokens=self.max_tokens))

    def __call__(self, text: str, chunk_id: str) -> tuple[list[dict], list[dict]]:
        whole = self._ask(EXTRACT, input_text=text) or {"entities": [], "relationships": []}
        for _ in range(self.gleaning):
            known = "\n".join(f"- {e['name']} ({e['type']})" for e in whole["entities"])
            edges = "\n".join(f"- {r['source']} -> {r['target']}" for r in whole["relationships"])
            more = self._ask(GLEAN, input_text=text, previous_entities=known or "(none)", previous_relationships=edges or "(none)")
            if not more or not (more["entities"] or more["relationships"]):
                break
            whole = {k: whole[k] + more[k] for k in whole}
        return convert(whole, text, chunk_id)
