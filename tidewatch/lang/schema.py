"""Window schemas."""

from __future__ import annotations

from .ast import WindowSchema
from .tokens import Reader, RuleError

BASE_TYPES = ("chars", "digit", "float", "bool", "time", "ip", "hex")


def _field_name(r: Reader) -> str:
    if r.kind() == "quoted":
        return r.next().text[1:-1]
    name = r.name()
    while r.accept("."):
        name += f".{r.name()}"
    return name


def _window(r: Reader) -> WindowSchema:
    name, streams, time, over, fields = r.name(), (), None, 0.0, []
    r.expect("{")
    while not r.accept("}"):
        what = r.name()
        if what == "stream":
            r.expect("=")
            if r.accept("["):
                listed = [r.string()]
                while r.accept(","):
                    listed.append(r.string())
                r.expect("]")
                streams = tuple(listed)
            else:
                streams = (r.string(),)
        elif what == "time":
            r.expect("=")
            time = _field_name(r)
        elif what == "over":
            r.expect("=")
            over = r.duration() if r.kind() == "duration" else float(r.integer())
        elif what == "fields":
            r.expect("{")
            while not r.accept("}"):
                field = _field_name(r)
                r.expect(":")
                kind = r.name()
                if kind == "array":
                    r.expect("/")
                    kind = f"array/{r.name()}"
                if kind.removeprefix("array/") not in BASE_TYPES:
                    raise RuleError(f"window {name}: {field} has the unknown type {kind}")
                fields.append((field, kind))
                r.accept(",")
        else:
            raise RuleError(f"window {name}: unknown attribute {what}")
    got = WindowSchema(name, streams, time, over, tuple(fields))
    types = got.types
    if len(types) != len(fields):
        raise RuleError(f"window {name}: a field is declared twice")
    if over > 0 and (time is None or types.get(time) != "time"):
        raise RuleError(f"window {name}: over > 0 asks for a time field of type time")
    if time is not None and time not in types:
        raise RuleError(f"window {name}: there is no field {time}")
    return got


def parse_schemas(source: str) -> dict[str, WindowSchema]:
    """The windows of a schema text by name."""
    r, found = Reader(source), {}
    while not r.done():
        r.expect("window")
        w = _window(r)
        if w.name in found:
            raise RuleError(f"window {w.name} is declared twice")
        found[w.name] = w
    return found
