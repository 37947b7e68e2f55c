"""Settings from an INI file, the environment and arguments, in rising order of weight."""

from __future__ import annotations

import configparser
import os
from dataclasses import dataclass
from pathlib import Path

#: Files looked for when none is named.
DEFAULT_FILES = ("knowloom.ini", "config/knowloom.ini")


@dataclass(frozen=True)
class Settings:
    database: str
    log_level: str = "INFO"
    task_queue: str | None = None
    structured_logging: bool = False
    source: str | None = None


def parse_bool(value: str | None) -> bool | None:
    """True for 1, true, yes, on; false for 0, false, no, off; None for anything else."""
    word = (value or "").strip().lower()
    return True if word in ("1", "true", "yes", "on") else False if word in ("0", "false", "no", "off") else None


def _file_values(path: str | None) -> dict[str, str]:
    for p in [path] if path else DEFAULT_FILES:
        if Path(p).is_file():
            c = configparser.ConfigParser()
            c.read(p, encoding="utf-8")
            flat = dict(c.defaults())
            for s in c.sections():
                flat |= dict(c.items(s))
            return flat | {"__path__": p}
    return {}


def load_settings(database: str | None = None) -> Settings:
    """Argument before environment before file before default."""
    env = lambda k: os.environ.get(f"KNOWLOOM_{k}")
    f = _file_values(env("CONFIG_FILE"))
    structured = parse_bool(env("STRUCTURED_LOGGING"))
    return Settings(
        database=database or env("DATABASE") or f.get("database_path") or "data/store",
        log_level=(env("LOG_LEVEL") or f.get("log_level") or "INFO").upper(),
        task_queue=env("TASK_QUEUE") or f.get("task_queue_url"),
        structured_logging=bool(parse_bool(f.get("structured_logging"))) if structured is None else structured,
        source=f.get("__path__"),
    )
