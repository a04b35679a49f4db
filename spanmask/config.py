"""Run configuration (Q4) and run id (Q5).

Settings are read from a mapping (Spark conf or a plain dict) on the driver and
validated before any job is planned, so a bad setting never starts a job.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import NamedTuple

# Defaults and accepted spellings of "true".
DEFAULT_MODEL_ID = "dictionary"
DEFAULT_THRESHOLD = 0.75
DEFAULT_CHUNK_SIZE = 1600
DEFAULT_OVERLAP = 200
TRUE_VALUES = frozenset({"1", "true", "yes", "on"})

KEY_MODEL_ID = "spanmask.model_id"
KEY_THRESHOLD = "spanmask.threshold"
KEY_DISABLE_MODEL = "spanmask.disable_model"
KEY_CHUNK_SIZE = "spanmask.chunk_size"
KEY_OVERLAP = "spanmask.overlap"


class Setting(NamedTuple):
    """One setting: the config field it fills, how its text is read, what it must be."""

    field: str
    read: Callable[[str], object]
    valid: Callable[[object], bool]
    meaning: str


def _flag(text: str) -> bool:
    return text.strip().lower() in TRUE_VALUES


#: Settings by key.  A text that cannot be read or is not valid is an error that names the
#: key; None, or "" where a model id is expected, leaves the default.
SETTINGS: dict[str, Setting] = {
    KEY_MODEL_ID: Setting("model_id", lambda t: t.strip() or DEFAULT_MODEL_ID, lambda v: isinstance(v, str), "a model id"),
    KEY_THRESHOLD: Setting("threshold", float, lambda v: isinstance(v, (int, float)) and 0 <= v <= 1, "a number from 0 to 1"),
    KEY_DISABLE_MODEL: Setting("disable_model", _flag, lambda v: isinstance(v, bool), "a flag"),
    KEY_CHUNK_SIZE: Setting("chunk_size", int, lambda v: isinstance(v, int) and v > 0, "a whole number over 0"),
    KEY_OVERLAP: Setting("overlap", int, lambda v: isinstance(v, int) and v >= 0, "a whole number, 0 or more"),
}


@dataclass(frozen=True)
class RedactConfig:
    model_id: str = DEFAULT_MODEL_ID
    threshold: float = DEFAULT_THRESHOLD
    disable_model: bool = False
    chunk_size: int = DEFAULT_CHUNK_SIZE
    overlap: int = DEFAULT_OVERLAP

    def __post_init__(self):
        wrong = [f"{key}: {getattr(self, s.field)!r} is not {s.meaning}" for key, s in SETTINGS.items() if not s.valid(getattr(self, s.field))]
        if wrong:
            raise ValueError("; ".join(wrong))


def load_config(settings: Mapping[str, str | None] | None = None) -> RedactConfig:
    """The config of string settings (unknown keys are left alone)."""
    given = {k: t for k, t in (settings or {}).items() if k in SETTINGS and t is not None}
    values = {}
    for key, text in given.items():
        try:
            values[SETTINGS[key].field] = SETTINGS[key].read(text)
        except ValueError:
            raise ValueError(f"{key}: {text!r} is not {SETTINGS[key].meaning}") from None
    return RedactConfig(**values)


def config_from_spark(spark) -> RedactConfig:
    return load_config({k: spark.conf.get(k, None) for k in SETTINGS})


def new_run_id() -> str:
    """12 hex characters, made once per run on the driver."""
    return uuid.uuid4().hex[:12]
