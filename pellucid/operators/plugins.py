"""Named feature extractors and tools, registered explicitly and switched by settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pellucid.functions import kernels


@dataclass
class Registry:
    """Things by name; names are unique."""

    items: dict[str, Any] = field(default_factory=dict)

    def register(self, name: str, item: Any) -> Any:
        if name in self.items:
            raise ValueError(f"{name} is registered twice")
        self.items[name] = item
        return item

    def enabled(self, switches: dict[str, bool] | None = None) -> dict[str, Any]:
        """Those that aren't switched off, in order of registration."""
        return {k: v for k, v in self.items.items() if (switches or {}).get(k, True)}


@dataclass
class Tool:
    name: str
    description: str
    execute: Callable[[str], dict]


def default_features() -> Registry:
    out = Registry()
    for name, kernel in kernels.KERNELS.items():
        out.register(name, kernel)
    return out


def default_tools(semantic: Callable[[str], dict]) -> Registry:
    """The one tool that exists: an image's semantic profile."""
    out = Registry()
    out.register("semantic_context_extraction", Tool("semantic_context_extraction", "Describes an image and its anomalies.", semantic))
    return out
