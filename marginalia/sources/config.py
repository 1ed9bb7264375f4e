"""Small settings files on the driver: scalars, lists, lists of maps, rules, and plans that must be allowed."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any

from marginalia.functions.paragraphs import unmangle


def clean_value(x: str | None) -> str:
    """A cell of a settings file: blanks and one pair of quotes dropped, wrongly decoded text read again, ``${NAME}`` filled from the environment."""
    text = (x or "").strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        text = text[1:-1]
    return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), unmangle(text) or "")


def _entry(text: str) -> tuple[str, str] | None:
    name, colon, value = text.partition(":")
    return (name.strip(), value) if colon and re.fullmatch(r"[\w.-]+", name.strip()) else None


def parse_settings(text: str) -> dict[str, Any]:
    """``name: value`` lines; below a name without a value, ``- item`` lines are a list, of maps where items are ``name: value``.

    Comments and blank lines don't count. Deeper nesting is no part of the format: such lines are left out.
    """
    found: dict[str, Any] = {}
    section: list | None = None
    for raw in text.lstrip("﻿").splitlines():
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        if raw[0] not in " \t-":
            entry = _entry(line)
            section = None
            if entry:
                name, value = entry
                if value.strip():
                    found[name] = clean_value(value)
                else:
                    section = found[name] = []
        elif section is not None and line.startswith("-"):
            entry = _entry(line[1:].strip())
            section.append({entry[0]: clean_value(entry[1])} if entry else clean_value(line[1:]))
        elif section and isinstance(section[-1], dict) and _entry(line):
            name, value = _entry(line)
            section[-1][name] = clean_value(value)
    return found


def read_rules(path: str) -> dict[str, Any]:
    """A JSON object of rules; a file that isn't there has none."""
    return json.loads(Path(path).read_text(encoding="utf-8-sig")) if Path(path).exists() else {}


def first_found(candidates: Iterable[str], read: Callable[[str], Any]) -> Any:
    """What the first candidate gives that exists and isn't empty; None if there is none."""
    for path in candidates:
        if Path(path).exists() and (value := read(path)):
            return value
    return None


def read_plan(path: str, must: Iterable[str] = (), must_not: Iterable[str] = ()) -> dict[str, Any]:
    """A plan document; refused unless every flag of ``must`` is true in it and none of ``must_not``."""
    plan = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    wrong = [f for f in must if plan.get(f) is not True] + [f for f in must_not if plan.get(f)]
    if wrong:
        raise PermissionError(f"the plan doesn't allow it: {', '.join(wrong)}")
    return plan
