"""The client's grammar for one line, without Spark; the same rules as the column form."""

from __future__ import annotations

import re

_RULES = (
    ("get", re.compile(r"get[ \t]+(.*)\Z", re.I | re.S)),
    ("set", re.compile(r"set[ \t]+([^= \t][^=]*)=([^=]+)", re.I | re.S)),
    ("delete", re.compile(r"delete[ \t]+(.*)\Z", re.I | re.S)),
    ("exit", re.compile(r"exit", re.I)),
)


def parse_line(line: str) -> tuple[str, str | None, str | None]:
    """(op, key, value); op is invalid where nothing matches."""
    for op, rule in _RULES:
        if m := rule.match(line):
            parts = [g.strip() for g in m.groups()]
            return op, parts[0] if parts else None, parts[1] if len(parts) > 1 else None
    return "invalid", None, None
