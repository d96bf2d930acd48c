"""strftime patterns as Spark's datetime patterns."""

from __future__ import annotations

#: Conversion letters and what they are called by Spark.
CODES = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE",
    "I": "hh", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "z": "xx", "Z": "z", "e": "d", "k": "H", "l": "h",
}


def spark_pattern(pattern: str) -> str | None:
    """The Spark form of a strftime pattern; none if it has a conversion that Spark lacks."""
    out, literal, k = [], "", 0

    def flush() -> None:
        nonlocal literal
        if literal:
            safe = all(not c.isalpha() and c not in "'[]{}#" for c in literal)
            out.append(literal if safe else "'" + literal.replace("'", "''") + "'")
            literal = ""

    while k < len(pattern):
        c = pattern[k]
        k += 1
        if c != "%":
            literal += c
            continue
        code = pattern[k : k + 1]
        k += 1
        if code == "." and pattern[k : k + 1] == "f":
            code, k = ".f", k + 1
        if code == "%":
            literal += "%"
        elif code in ("f", ".f", "3f", "6f"):
            if code == ".f":
                literal += "."
            flush()
            out.append("SSSSSS")
        elif code in CODES:
            flush()
            out.append(CODES[code])
        else:
            return None
    flush()
    return "".join(out)

