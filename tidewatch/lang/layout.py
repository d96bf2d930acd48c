"""Re-indents a text by the depth of its braces and leaves one blank line at most."""

from __future__ import annotations

import re

_SKIP = re.compile(r'"[^"]*"|//.*')


def layout(text: str, indent: str = "    ") -> str:
    out: list[str] = []
    depth = 0
    for line in text.splitlines():
        bare = line.strip()
        if not bare:
            if out and out[-1]:
                out.append("")
            continue
        code = _SKIP.sub("", bare)
        first = len(code) - len(code.lstrip("})"))
        out.append(indent * max(0, depth - first) + bare)
        depth = max(0, depth + code.count("{") + code.count("(") - code.count("}") - code.count(")"))
    while out and not out[-1]:
        out.pop()
    return "\n".join(out) + "\n" if out else ""
