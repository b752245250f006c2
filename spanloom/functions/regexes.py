"""Patterns that mean the same in every engine.

Policy patterns are written for an engine with ASCII word boundaries and a ``$`` that only matches at the very end.
Java reads both otherwise, so they are spelled out before a pattern reaches the JVM.
"""

from __future__ import annotations

# White space of the engine that policies are written for, as a class that Java and RE2 read alike.
WHITE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

#: An ASCII word boundary for Java.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def java(pattern: str) -> str:
    """The pattern for Java's engine: ASCII ``\\b`` and a ``$`` at the very end only."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if pattern[i] == "\\":
            out.append(EDGE if two == r"\b" and not inside else two)
            i += 2
            continue
        c = pattern[i]
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        out.append(r"\z" if c == "$" and not inside else c)
        i += 1
    return "".join(out)
