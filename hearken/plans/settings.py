"""A deployment's settings, from defaults and the environment, and its components, each loaded apart from the others."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields
from typing import Any

#: The names that override a setting from the environment.
NAMES = {
    "ip_hash_secret": "IP_HASH_SECRET", "max_requests": "RATE_LIMIT_MAX_REQUESTS", "window_seconds": "RATE_LIMIT_WINDOW_SECONDS", "timeout_seconds": "ANALYSIS_TIMEOUT_SECONDS",
    "max_new_tokens": "STT_MAX_NEW_TOKENS", "chunk_seconds": "STT_AUDIO_CHUNK_SECONDS", "runtime": "STT_RUNTIME",
}


@dataclass(frozen=True)
class Settings:
    ip_hash_secret: str = ""
    max_requests: int = 10
    window_seconds: float = 60.0
    timeout_seconds: float = 300.0
    max_new_tokens: int = 128
    chunk_seconds: float = 30.0
    runtime: str = "faster-whisper"

    def __post_init__(self) -> None:
        for name in ("max_requests", "window_seconds", "timeout_seconds", "max_new_tokens", "chunk_seconds"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")

    @classmethod
    def from_env(cls, environment: Mapping[str, str], **given: Any) -> "Settings":
        """Defaults, overridden by the environment, overridden by what is given; an empty variable does not count."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        found = {name: kinds[name](environment[variable]) for name, variable in NAMES.items() if environment.get(variable)}
        return cls(**found | given)


def loaded(factories: Mapping[str, Callable[[Settings], Any]], settings: Settings) -> tuple[dict[str, Any], dict[str, str]]:
    """Components by name and their status: ``ready``, or ``error`` for one whose factory failed, which leaves the others alone."""
    made, status = {}, {}
    for name, factory in factories.items():
        try:
            made[name], status[name] = factory(settings), "ready"
        except Exception:  # whatever a model's loader raises
            status[name] = "error"
    return made, status
