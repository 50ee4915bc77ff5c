"""Settings with defaults; values of the wrong kind fall back to them."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    warehouse: str = ".symgraph"
    max_file_size: int = 1 << 20
    blast_depth: int = 3
    debounce_seconds: float = 0.3
    idle_minutes: float = 0.0
    ignored: tuple[str, ...] = ()

    @classmethod
    def of(cls, raw: dict | None) -> Config:
        good = {}
        for f in fields(cls):
            value, default = (raw or {}).get(f.name), f.default
            if isinstance(default, tuple) and isinstance(value, (list, tuple)):
                good[f.name] = tuple(map(str, value))
            elif isinstance(default, str) and isinstance(value, str) and value:
                good[f.name] = value
            elif isinstance(default, (int, float)) and isinstance(value, (int, float)) and not isinstance(value, bool) and value >= 0:
                good[f.name] = type(default)(value)
        return cls(**good)
