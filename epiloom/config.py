"""Thresholds as typed, frozen values; options override them by name."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    window_s: float = 4.0
    reject_share: float = 0.7
    refractory_s: float = 0.3
    trough_depth: float = 0.06
    trough_gap_s: float = 1.5
    low_s: float = 1.3
    high_s: float = 4.0
    shift_s: float = 0.4
    quality_gate: bool = True
    bad_share: float = 0.5
    pose_source: str = "shipped"

    def with_options(self, options: dict[str, str]) -> Settings:
        """These settings with the given ones, each read as the type of the one it replaces; an unknown name is an error."""
        known = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        if unknown := set(options) - set(known):
            raise ValueError(f"no such settings: {', '.join(sorted(unknown))}")
        read = lambda kind, x: x.lower() in ("1", "true", "yes") if kind is bool else kind(x)
        return replace(self, **{k: read(known[k], v) for k, v in options.items()})


DEFAULT = Settings()
