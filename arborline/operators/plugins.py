"""Registries: things by name, found by pattern and tag, made from configurations."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterable
from typing import Any


class Registry:
    """Factories by (name, tag), like a model and its weights."""

    def __init__(self, kind: str):
        self.kind = kind
        self.items: dict[tuple[str, str], Callable[..., Any]] = {}

    def add(self, name: str, factory: Callable[..., Any], tag: str = "") -> None:
        if (name, tag) in self.items:
            raise ValueError(f"there is a {self.kind} called {name} {tag}".rstrip())
        self.items[name, tag] = factory

    def names(self, pattern: str = "*") -> list[str]:
        """Names that fit a pattern, once each, in order."""
        return sorted({n for n, _ in self.items if fnmatch.fnmatchcase(n, pattern)})

    def tags(self, name: str) -> list[str]:
        return sorted(t for n, t in self.items if n == name)

    def by_tag(self, tag: str) -> list[str]:
        return sorted(n for n, t in self.items if t == tag)

    def get(self, name: str, tag: str | None = None) -> Callable[..., Any]:
        """The factory; a name that is not known raises, as does one with several tags where none is given."""
        found = [f for (n, t), f in sorted(self.items.items()) if n == name and tag in (None, t)]
        if not found:
            raise KeyError(f"no {self.kind} is called {name}" + (f" with tag {tag}" if tag else "") + f"; there are {', '.join(self.names()) or 'none'}")
        if len(found) > 1:
            raise KeyError(f"{name} has the tags {', '.join(self.tags(name))}")
        return found[0]

    def make(self, config: dict[str, Any]) -> Any:
        """An instance from {"name": ..., "tag": ..., other settings}; nested configurations are made first."""
        settings = {k: self.make(v) if isinstance(v, dict) and "name" in v else v for k, v in config.items() if k not in ("name", "tag")}
        return self.get(config["name"], config.get("tag"))(**settings)

    def make_all(self, configs: dict[str, dict[str, Any]] | None) -> list[Any]:
        """Instances of a table of configurations, in its order; entries without a name are left out."""
        return [self.make(c) for c in (configs or {}).values() if isinstance(c, dict) and "name" in c]


def metric(metrics: dict[str, Any], name: str | None) -> Any:
    """The value of a metric; none is asked for by an empty name, and an unknown one raises."""
    if not name:
        return None
    if name not in metrics:
        raise KeyError(f"no metric is called {name}; there are {', '.join(sorted(metrics)) or 'none'}")
    return metrics[name]


def collated(samples: Iterable[dict[str, Any]]) -> dict[str, list]:
    """A batch of samples as lists by field; fields that a sample lacks are None in it."""
    samples = list(samples)
    fields = dict.fromkeys(k for s in samples for k in s)
    return {f: [s.get(f) for s in samples] for f in fields}
