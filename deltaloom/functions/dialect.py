"""Translates linear-time-engine regular expressions and replacements to Java's dialect."""

from __future__ import annotations

import re

_NAMED_GROUP = re.compile(r"\(\?P<")
_REFERENCE = re.compile(r"\$(?:\$|\{(\w+)\}|(\w+))")


def java_pattern(pattern: str) -> str:
    r"""Unicode classes, ``\n`` as the only line end, Java's named groups, and ``$`` as the very end of the text."""
    out, in_class, k = [], False, 0
    pattern = _NAMED_GROUP.sub("(?<", pattern)
    multiline = re.match(r"\(\?[a-zA-Z]*m", pattern) is not None
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            out.append(pattern[k : k + 2])
            k += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        out.append(r"\z" if c == "$" and not in_class and not multiline else c)
        k += 1
    return "(?Ud)" + "".join(out)


def java_replacement(replacement: str) -> str:
    r"""``$1``, ``${1}``, ``$name``, ``${name}`` and ``$$`` as Java writes them; all else is literal."""
    out, end = [], 0
    for m in _REFERENCE.finditer(replacement):
        out.append(_literal(replacement[end : m.start()]))
        name = m[1] or m[2]
        if name is None:
            out.append(r"\$")
        elif name.isdigit():
            out.append(f"${name}")
        else:
            out.append(f"${{{name}}}")
        end = m.end()
    return "".join(out) + _literal(replacement[end:])


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")
