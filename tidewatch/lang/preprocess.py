"""Variables in rule texts: $NAME, ${NAME}, ${NAME:default}; $$ is a dollar sign.

Strings, comments and the bodies of patterns are left as they are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from .tokens import RuleError

_PIECE = re.compile(r'"[^"]*"|//[^\n]*|\$\$|\$\{(?P<braced>[A-Za-z_]\w*)(?::(?P<default>[^}]*))?\}|\$(?P<plain>[A-Za-z_]\w*)|(?P<pattern>\bpattern\b)')


def _body_end(text: str, at: int) -> int:
    """The place after the brace that closes the first one from ``at`` on."""
    depth, k = 0, text.find("{", at)
    if k < 0:
        return len(text)
    for m in re.compile(r'"[^"]*"|//[^\n]*|[{}]').finditer(text, k):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0 and m[0] == "}":
            return m.end()
    return len(text)


def substitute(text: str, variables: Mapping[str, str], environment: bool = False) -> str:
    known = {**os.environ, **variables} if environment else dict(variables)
    out, at = [], 0
    while m := _PIECE.search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        name = m["braced"] or m["plain"]
        if m["pattern"]:
            at = _body_end(text, m.end())
            out.append(text[m.start() : at])
        elif m[0] == "$$":
            out.append("$")
        elif not name:
            out.append(m[0])
        elif name in known:
            out.append(known[name])
        elif m["default"] is not None:
            out.append(m["default"])
        else:
            raise RuleError(f"variable {name} is not set and has no default")
    return "".join(out) + text[at:]
