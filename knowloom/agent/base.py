"""Tools: what they take, what they give, and how they are run."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Parameter:
    name: str
    description: str
    required: bool = False


@dataclass(frozen=True)
class Context:
    """Tables and defaults that tools work with."""

    tables: dict[str, Any] = field(default_factory=dict)
    extractor: str | None = None
    embedder: Any = None


@dataclass(frozen=True)
class Result:
    success: bool
    data: Any = None
    error: str | None = None

    @classmethod
    def ok(cls, data: Any) -> Result:
        return cls(True, data)

    @classmethod
    def failed(cls, error: str) -> Result:
        return cls(False, None, error)

    def to_dict(self) -> dict[str, Any]:
        return {"success": self.success, "data": self.data, "error": self.error}

    def is_empty(self) -> bool:
        """No data, or only empty lists and totals."""
        d = self.data
        if not d:
            return True
        if isinstance(d, dict):
            lists = [d[k] for k in ("results", "mentions", "events") if isinstance(d.get(k), list)]
            if lists:
                return not lists[0]
            return isinstance(d.get("totals"), dict) and not d["totals"]
        return False


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: tuple[Parameter, ...]
    run: Callable[..., Result]


@dataclass(frozen=True)
class Call:
    tool: str
    params: dict[str, Any]
    result: Result


@dataclass(frozen=True)
class Answer:
    text: str
    calls: list[Call]


class Executor:
    """Runs tools by name; an unknown tool and an exception are results, not errors."""

    def __init__(self, tools: dict[str, Tool], context: Context):
        self.tools, self.context = tools, context

    def execute(self, name: str, params: dict[str, Any] | None) -> Result:
        tool = self.tools.get(name)
        if tool is None:
            return Result.failed(f"unknown tool {name}")
        try:
            return tool.run(self.context, **(params or {}))
        except Exception as e:
            log.exception("tool %s", name)
            return Result.failed(str(e))
