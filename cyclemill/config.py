"""Settings of the analyses, checked when they are made."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    store_path: str = "events"
    machine_id: str = "MCC"
    success_status: float = 0.0
    no_load_status: float = 2.0
    torque_min: float = 1.5
    torque_max: float = 2.5
    mad_k: float = 3.0
    mad_floor: float = 0.01
    idle_min_seconds: int = 300
    idle_max_gap_seconds: int = 600
    max_anomaly_items: int = 5000

    def __post_init__(self):
        for f in fields(self):
            kind, value = {"str": str, "float": (int, float), "int": int}[f.type], getattr(self, f.name)
            if isinstance(value, bool) or not isinstance(value, kind):
                raise ConfigError(f"{f.name} must have type {f.type}, got {value!r}")
        if not self.torque_min < self.torque_max:
            raise ConfigError(f"torque_min {self.torque_min} must lie under torque_max {self.torque_max}")
        for name in ("idle_min_seconds", "idle_max_gap_seconds", "mad_k", "max_anomaly_items"):
            if not getattr(self, name) > 0:
                raise ConfigError(f"{name} must be above 0, got {getattr(self, name)}")


#: Settings of a language model that a file may hold; nothing here uses one.
MODEL_KEYS = {"provider", "model", "max_tokens", "api_timeout_s", "effort", "ollama_host", "num_ctx", "think", "planning", "narrator_max_items"}


def load_config(path: str | None) -> Config:
    """From a JSON file; None gives the defaults. Unknown keys are refused."""
    if path is None:
        return Config()
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(found, dict):
        raise ConfigError(f"{path}: an object is expected")
    found = {k: v for k, v in found.items() if k not in MODEL_KEYS}
    if unknown := sorted(set(found) - {f.name for f in fields(Config)}):
        raise ConfigError(f"{path}: unknown keys {unknown}")
    return Config(**found)
