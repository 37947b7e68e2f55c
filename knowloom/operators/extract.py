"""Entity extraction behind one interface: patterns offline, a language model where one is given."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Mention(NamedTuple):
    text: str
    label: str
    start: int
    end: int
    confidence: float | None = None
    metadata: dict | None = None


class Extractor(Protocol):
    """Finds mentions in a text; ``name`` goes into every id.

    One that has ``extract_all(texts)`` is given whole batches.
    """

    name: str

    def extract(self, text: str) -> list[Mention]: ...


# Patterns of the offline extractor, ASCII classes only.
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "MONEY": r"(?:INR|USD|EUR|GBP|Rs\.?|₹|€|£|\$) ?[0-9][0-9,]*(?:\.[0-9]+)?(?: (?:lakh|crore))?",
    "DATE": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}",
    "INVOICE_REFERENCE": r"(?:INV|DOC|TXN|PO|RC)-[0-9]{4,}",
    "MEASUREMENT": r"[0-9]+(?:\.[0-9]+)? (?:mg/dL|mmol/L|g/dL|ng/mL|µmol/L|%)",
    "LAB_TEST": r"HbA1c|TSH|creatinine|haemoglobin|vitamin D|ferritin|urea|platelet count|fasting glucose",
}


class PatternExtractor:
    """Deterministic extractor by patterns; runs without any service."""

    def __init__(self, patterns: dict[str, str] | None = None, name: str = "pattern:default"):
        self.name, self.patterns = name, dict(patterns or PATTERNS)

    def extract(self, text: str) -> list[Mention]:
        found = [Mention(m[0], label, m.start(), m.end()) for label, p in self.patterns.items() for m in re.finditer(p, text)]
        return sorted(found, key=lambda m: (m.start, m.end, m.label))


def locate(text: str, needle: str, start: int | None, end: int | None) -> tuple[int, int] | None:
    """The given span if it is in range and holds the needle in any case, else its first place."""
    if isinstance(start, int) and isinstance(end, int) and 0 <= start < end <= len(text) and needle.lower() in text[start:end].lower():
        return start, end
    at = text.lower().find(needle.lower())
    return (at, at + len(needle)) if needle and at >= 0 else None


def reply_text(payload: object) -> str:
    """The text inside a model server's reply: ``response``, ``output`` or the first choice."""
    if not isinstance(payload, dict):
        return ""
    for key in ("response", "output"):
        if isinstance(payload.get(key), str):
            return payload[key]
    choices = payload.get("choices")
    if isinstance(choices, list) and choices and isinstance(choices[0], dict):
        return (choices[0].get("message") or {}).get("content") or ""
    return ""


def without_fences(text: str) -> str:
    """Text without the code fence around it."""
    t = text.strip()
    return re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", t)).strip() if t.startswith("```") else t


def entity_items(text: str) -> list[dict]:
    """Entities of a model's answer: a list, an object with ``entities``, or one entity; nothing for other text."""
    try:
        value = json.loads(without_fences(text))
    except ValueError:
        return []
    if isinstance(value, dict):
        value = value["entities"] if isinstance(value.get("entities"), list) else [value]
    return [v for v in value if isinstance(v, dict)] if isinstance(value, list) else []


class ModelExtractor:
    """Extractor that asks a language model through ``call(prompt) -> reply payload``."""

    def __init__(self, call: Callable[[str], object], model: str, prompt: str = "List the entities of this text as JSON:\n{text}"):
        self.name, self.call = f"llm:{model}", call
        # A template without a place for the text gets one at its end.
        self.prompt = prompt if "{text}" in prompt else f"{prompt.rstrip()}\n\nText:\n{{text}}"

    def extract_all(self, texts: list[str], at_once: int = 8) -> list[list[Mention]]:
        """Several requests under way at a time; the model's server is waited for, not the text before."""
        with ThreadPoolExecutor(at_once) as pool:
            return list(pool.map(self.extract, texts))

    def extract(self, text: str) -> list[Mention]:
        out = []
        for e in entity_items(reply_text(self.call(self.prompt.replace("{text}", text.strip())))):
            needle = e.get("text") or e.get("span")
            needle = needle.strip() if isinstance(needle, str) else ""
            label = str(e.get("label") or e.get("type") or "ENTITY").strip()
            if not needle or not label:
                continue
            at = locate(text, needle, e.get("start_char", e.get("start")), e.get("end_char", e.get("end")))
            if at:
                attributes = e.get("attributes")
                out.append(Mention(needle, label, *at, e.get("confidence"), attributes if isinstance(attributes, dict) else None))
        return out


class HttpModel:
    """A model server that takes a prompt by POST; also the ``chat`` client of the agent."""

    def __init__(self, model: str, endpoint: str = "http://localhost:11434/api/generate", timeout: float = 60.0):
        self.model, self.endpoint, self.timeout = model, endpoint, timeout

    def __call__(self, prompt: str) -> object:
        from urllib.request import Request, urlopen

        data = json.dumps({"model": self.model, "prompt": prompt, "stream": False}).encode()
        with urlopen(Request(self.endpoint, data, {"Content-Type": "application/json"}), timeout=self.timeout) as reply:
            return json.load(reply)

    def chat(self, prompt: str) -> str:
        return reply_text(self(prompt))


def build(backend: str, model: str = "default", call: Callable[[str], object] | None = None) -> Extractor:
    """``pattern``, ``llm`` (through ``call``, or the default server) or ``spacy`` (where the library and its model are installed)."""
    if backend == "pattern":
        return PatternExtractor(name=f"pattern:{model}")
    if backend == "llm":
        return ModelExtractor(call or HttpModel(model), model)
    if backend == "spacy":
        return _SpacyExtractor(model)
    raise ValueError(f"unknown backend {backend}")


class _SpacyExtractor:
    def __init__(self, model: str):
        self.name, self.model, self._nlp = f"spacy:{model}", model, None

    def extract(self, text: str) -> list[Mention]:
        if self._nlp is None:
            import spacy

            self._nlp = spacy.load(self.model)
        return [Mention(e.text, e.label_, e.start_char, e.end_char) for e in self._nlp(text).ents]


MENTION_SCHEMA = T.StructType(
    [
        T.StructField("content_id", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("start_char", T.IntegerType()),
        T.StructField("end_char", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("attributes", T.StringType()),
    ]
)


def extract_mentions(segments: DataFrame, extractor: Extractor) -> DataFrame:
    """Mentions of segments (content_id, chunk_index, text); offsets count in the trimmed text, a missing confidence is 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            texts = [t.strip() if t else "" for t in pdf["text"]]
            full = [t for t in texts if t]
            mentions = iter(extractor.extract_all(full) if hasattr(extractor, "extract_all") else map(extractor.extract, full))
            for key, chunk, text in zip(pdf["content_id"], pdf["chunk_index"], texts):
                for m in next(mentions) if text else []:
                    meta = json.dumps(m.metadata, sort_keys=True) if m.metadata else None
                    rows.append((key, chunk, m.text, m.label, m.start, m.end, 1.0 if m.confidence is None else float(m.confidence), meta))
            yield pd.DataFrame(rows, columns=MENTION_SCHEMA.names)

    return segments.select("content_id", "chunk_index", "text").mapInPandas(run, MENTION_SCHEMA)
