"""Configurations: YAML with dotted overrides, task lists."""

from __future__ import annotations

import copy
from typing import Any

from ..operators.filters import SpecError


def coerce(text: str) -> Any:
    """int, else float, else true/false/null, else the text."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "none": None}.get(text.lower(), text)


def override(config: dict, assignment: str) -> dict:
    """A copy of ``config`` with one ``a.b.c=value`` applied."""
    path, mark, text = assignment.partition("=")
    if not mark or not path:
        raise SpecError(f"not an assignment: {assignment}")
    out = copy.deepcopy(config)
    at = out
    *parents, last = path.split(".")
    for p in parents:
        at = at.setdefault(p, {})
        if not isinstance(at, dict):
            raise SpecError(f"{path}: {p} is no section")
    at[last] = coerce(text)
    return out


def load(path: str, overrides: list[str] | None = None) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        config = yaml.safe_load(f) or {}
    for o in overrides or []:
        config = override(config, o)
    return config


def check_mix(spec: dict) -> None:
    """Rules of a build: positive sizes, known split names, shares that sum to one, unique sources."""
    sources = spec.get("sources", [])
    if not sources:
        raise SpecError("no sources")
    names = [s.get("name") for s in sources]
    if None in names or len(set(names)) != len(names):
        raise SpecError("sources need unique names")
    shares = [s.get("frac", 0) for s in sources]
    if any(x <= 0 for x in shares) or abs(sum(shares) - 1) > 1e-6:
        raise SpecError("shares must be positive and sum to one")
    for split, n in spec.get("splits", {}).items():
        if split not in ("train", "val", "test"):
            raise SpecError(f"unknown split {split}")
        if not isinstance(n, int) or n < 0:
            raise SpecError(f"{split} needs a size")


def task_range(files: list[str], first: int, stop: int) -> list[tuple[int, str]]:
    """The half-open range of an explicit list, with indices."""
    if not 0 <= first <= stop <= len(files):
        raise SpecError(f"[{first}, {stop}) of {len(files)} files")
    return list(enumerate(files))[first:stop]
