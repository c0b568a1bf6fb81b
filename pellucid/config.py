"""Settings by dotted key, from YAML or a dict."""

from __future__ import annotations

import copy
from pathlib import Path
from typing import Any


class Config:
    def __init__(self, values: dict | None = None, path: str | None = None):
        self.values, self.path = copy.deepcopy(values or {}), path

    @classmethod
    def load(cls, path: str) -> Config:
        import yaml

        with open(path, encoding="utf-8") as f:
            values = yaml.safe_load(f) or {}
        if not isinstance(values, dict):
            raise ValueError(f"{path} does not hold a mapping")
        return cls(values, path)

    def get(self, key: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in key.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, key: str, value: Any) -> None:
        *above, last = key.split(".")
        at = self.values
        for part in above:
            if not isinstance(at.get(part), dict):
                at[part] = {}
            at = at[part]
        at[last] = value

    def section(self, key: str) -> dict:
        got = self.get(key, {})
        return dict(got) if isinstance(got, dict) else {}

    def merged(self, other: dict) -> Config:
        """With the keys of another dict, which win."""
        return Config({**self.values, **other}, self.path)

    def reload(self) -> None:
        if not self.path:
            raise ValueError("these settings come from no file")
        self.values = Config.load(self.path).values

    def save(self, path: str | None = None) -> None:
        import yaml

        Path(path or self.path).write_text(yaml.safe_dump(self.values, allow_unicode=True, sort_keys=False), encoding="utf-8")


def feature_settings(given: dict | None = None) -> dict:
    """Feature settings with defaults, checked."""
    out = {"groups": ("lbp", "glcm", "edge", "fft", "dct"), "dct_block": 8, "max_dct_blocks": 512, "radial_bins": 16, "wavelet_levels": 3} | (given or {})
    if out["dct_block"] not in (4, 8, 16, 32):
        raise ValueError("dct_block must be 4, 8, 16 or 32")
    for k in ("max_dct_blocks", "radial_bins", "wavelet_levels"):
        if int(out[k]) < 1:
            raise ValueError(f"{k} must be positive")
    return out


def template(path: str) -> str:
    """A prompt template's text."""
    text = Path(path).read_text(encoding="utf-8").strip()
    if not text:
        raise ValueError(f"{path} is empty")
    return text
