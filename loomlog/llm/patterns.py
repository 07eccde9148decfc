"""What a regular expression asks for: its pieces, read from the usual syntax (literals, classes, groups, repeats, edges)."""

from __future__ import annotations

import re
from dataclasses import dataclass

_REPEAT = re.compile(r"([?*+]|\{(\d+)(,?)(\d*)\})[?+]?")
_BOUNDS = {"?": (0, 1), "*": (0, None), "+": (1, None)}


@dataclass(frozen=True)
class Piece:
    """One of `chars` (None: not to be told), or a group of `options`, `least` to `most` times (None: without end); an edge (^, $, \\b) is none of them."""

    least: int = 1
    most: int | None = 1
    chars: frozenset[str] | None = None
    options: tuple[tuple[Piece, ...], ...] = ()
    edge: bool = False


def read(pattern: str) -> tuple[tuple[Piece, ...], ...]:
    """The alternatives of an expression, each as its pieces in order."""
    options, at = _options(pattern, 0)
    if at != len(pattern):
        raise ValueError(f"can't read {pattern!r} from {at}")
    return options


def _options(text: str, at: int) -> tuple[tuple[tuple[Piece, ...], ...], int]:
    out: list[list[Piece]] = [[]]
    while at < len(text) and text[at] != ")":
        if text[at] == "|":
            out.append([])
            at += 1
            continue
        chars, options, edge, at = _atom(text, at)
        least, most = 1, 1
        if m := _REPEAT.match(text, at):
            least, most = _BOUNDS.get(m[1][0]) or (int(m[2]), int(m[4]) if m[4] else None if m[3] else int(m[2]))
            at = m.end()
        out[-1].append(Piece(least, most, chars, options, edge))
    return tuple(map(tuple, out)), at


def _atom(text: str, at: int) -> tuple[frozenset[str] | None, tuple, bool, int]:
    if text[at] == "(":
        own = re.compile(r"\((\?(:|[a-z]+:))?").match(text, at)
        if text.startswith("(?", at) and not own[1]:
            raise ValueError(f"can't read {text!r} from {at}")
        options, end = _options(text, own.end())
        return None, options, False, end + 1
    if text[at] == "[":
        end = at + 2 if text[at + 1] != "^" else at + 3
        while text[end] != "]":
            end += 2 if text[end] == "\\" else 1
        return _class(text[at + 1 : end]), (), False, end + 1
    if text[at] in "^$":
        return None, (), True, at + 1
    chars, at = _char(text, at)
    return (None if text[at - 1] == "." and chars == {"."} and text[at - 2 : at] != "\\." else chars), (), chars == frozenset(), at


def _char(text: str, at: int) -> tuple[frozenset[str] | None, int]:
    """One character, escaped or not; an empty set for \\b."""
    if text[at] != "\\":
        return frozenset(text[at]), at + 1
    code = text[at + 1]
    if code == "x":
        return frozenset(chr(int(text[at + 2 : at + 4], 16))), at + 4
    if code in "bB":
        return frozenset(), at + 2
    if code.isalnum():
        return ({"n": frozenset("\n"), "t": frozenset("\t"), "r": frozenset("\r")}).get(code), at + 2
    return frozenset(code), at + 2


def _class(body: str) -> frozenset[str] | None:
    if body.startswith("^"):
        return None
    out, at = set(), 0
    while at < len(body):
        low, at = _char(body, at)
        if low is None:
            return None
        if body[at : at + 1] == "-" and at + 1 < len(body):
            high, at = _char(body, at + 1)
            out |= {chr(c) for c in range(ord(*low), ord(*high) + 1)}
        else:
            out |= low
    return frozenset(out)
