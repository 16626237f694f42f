"""Declarative configuration of a tokenization; expressions are Spark SQL strings."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass
class Options:
    quantizer: str = "deciles"
    include_time_spacing_tokens: bool = True
    fused_category_values: bool = False
    detect_discrete: bool = False
    include_ref_ranges: bool = False
    max_padded_len: int | None = None
    max_event_days: float | None = None
    day_stay_filter: bool = False


@dataclass
class TimelineConfig:
    """Keys, options, the reference frame, static attributes and events."""

    subject_id: str
    group_id: str | None
    reference: dict[str, Any]
    options: Options = field(default_factory=Options)
    prefix: list[dict[str, Any]] = field(default_factory=list)
    suffix: list[dict[str, Any]] = field(default_factory=list)
    events: list[dict[str, Any]] = field(default_factory=list)
    times_qc: list[dict[str, Any]] = field(default_factory=list)

    @classmethod
    def from_dict(cls, raw: dict[str, Any], **overrides: Any) -> TimelineConfig:
        """``overrides`` replace options; the mapping stays as it was."""
        raw = copy.deepcopy(raw)
        options = Options(**{**raw.pop("options", {}), **{k: v for k, v in overrides.items() if v is not None}})
        if options.include_ref_ranges and options.quantizer != "ventiles":
            raise ValueError("reference ranges need ventiles")
        qc = raw.pop("times_qc", [])
        return cls(options=options, times_qc=[qc] if isinstance(qc, dict) else qc, **{"group_id": None, **raw})

    @classmethod
    def from_yaml(cls, path: str | Path, **overrides: Any) -> TimelineConfig:
        import yaml

        return cls.from_dict(yaml.safe_load(Path(path).read_text()), **overrides)
