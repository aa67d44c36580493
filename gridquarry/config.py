"""Run configuration: dataclasses, merging, validation."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

BACKENDS = ("auto", "cucim", "vips", "openslide", "asap", "pil")
METHODS = ("hsv", "otsu", "threshold", "model")


@dataclass(frozen=True)
class Tiling:
    tile_px: int = 256
    spacing_um: float = 0.5
    tolerance: float = 0.05
    overlap: float = 0.0
    backend: str = "auto"
    min_coverage: Mapping[str, float | None] = field(default_factory=lambda: {"tissue": 0.1})

    def __post_init__(self) -> None:
        if self.backend not in BACKENDS:
            raise ValueError(f"unknown backend {self.backend!r}")
        if not 0 <= self.overlap < 1 or self.tile_px < 1 or self.spacing_um <= 0:
            raise ValueError("tile_px and spacing_um must be positive and overlap in [0, 1)")

    def tissue_fraction(self) -> float:
        if self.min_coverage.get("tissue") is None:
            raise ValueError("min_coverage has no value for tissue")
        return float(self.min_coverage["tissue"])


@dataclass(frozen=True)
class Segmentation:
    method: str = "hsv"
    downsample: int = 64
    threshold: int = 8
    median: int = 7
    close: int = 4

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown segmentation method {self.method!r}")


@dataclass(frozen=True)
class Preview:
    mask: bool = True
    tiling: bool = True
    downsample: int = 32


def merged(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Deep merge, later layers winning; None takes a key of a mapping away."""
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in layer.items():
            if value is None and isinstance(out.get(key), (int, float, str, type(None))) and key in out:
                out.pop(key)
            elif isinstance(value, Mapping) and isinstance(out.get(key), Mapping):
                out[key] = merged(out[key], value)
            else:
                out[key] = value
    return out


def from_arguments(arguments: list[str]) -> dict[str, Any]:
    """`a.b=1` items as a nested mapping; values are JSON where they parse as such."""
    out: dict[str, Any] = {}
    for item in arguments:
        path, sep, raw = item.partition("=")
        if not sep:
            raise ValueError(f"expected key=value, got {item!r}")
        try:
            value = json.loads(raw)
        except ValueError:
            value = raw
        here = out
        *outer, last = path.split(".")
        for key in outer:
            here = here.setdefault(key, {})
        here[last] = value
    return out


def load(path: str | None = None, arguments: list[str] | None = None, defaults: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Defaults, then a JSON file, then arguments."""
    layers: list[Mapping[str, Any]] = [defaults or {}]
    if path:
        with open(path, encoding="utf-8") as f:
            layers.append(json.load(f))
    layers.append(from_arguments(arguments or []))
    return merged(*layers)


def build(kind: type, values: Mapping[str, Any]) -> Any:
    """A config dataclass from a mapping; unknown keys are an error."""
    known = {f.name for f in fields(kind)}
    if unknown := set(values) - known:
        raise ValueError(f"{kind.__name__}: unknown keys {sorted(unknown)}")
    return kind(**values)


def validate_labels(pixel_mapping: Mapping[str, int], colors: Mapping[str, Any] | None = None, active: tuple[str, ...] = ()) -> None:
    """Label values are distinct whole numbers in 0..255, colours have three of them, and every name used is declared."""
    values = list(pixel_mapping.values())
    if any(isinstance(v, bool) or not isinstance(v, int) or not 0 <= v <= 255 for v in values) or len(set(values)) != len(values):
        raise ValueError("label values must be distinct whole numbers from 0 to 255")
    for name, color in (colors or {}).items():
        if name not in pixel_mapping:
            raise ValueError(f"colour for undeclared label {name!r}")
        if color is not None and (len(color) != 3 or any(not 0 <= c <= 255 for c in color)):
            raise ValueError(f"colour of {name!r} must be three numbers from 0 to 255")
    if missing := set(active) - set(pixel_mapping):
        raise ValueError(f"undeclared labels {sorted(missing)}")
