"""Semantic versions and requirements: comma is AND, no operator is caret, ``*`` is any release.

A pre-release matches only if every comparator holds and one of them names the same major.minor.patch with a
pre-release of its own. Build metadata never counts in a match.
"""

from __future__ import annotations

import re
from functools import total_ordering

from .model import PackageError

_NUMBER = r"(?:0|[1-9][0-9]*)"
_VERSION = re.compile(rf"({_NUMBER})\.({_NUMBER})\.({_NUMBER})(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?")
_COMPARATOR = re.compile(rf"\s*(=|>=|>|<=|<|~|\^)?\s*({_NUMBER}|[*xX])(?:\.({_NUMBER}|[*xX])(?:\.({_NUMBER}|[*xX])(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?)?)?\s*")


def _pre(text: str | None) -> tuple[str, ...]:
    parts = tuple((text or "").split(".")) if text else ()
    if any(not p or (p.isdigit() and len(p) > 1 and p[0] == "0") for p in parts):
        raise PackageError("InvalidVersion", text=text)
    return parts


@total_ordering
class Version:
    def __init__(self, text: str):
        m = _VERSION.fullmatch(text)
        if not m:
            raise PackageError("InvalidVersion", text=text)
        self.numbers, self.pre, self.build = tuple(map(int, m.group(1, 2, 3))), _pre(m[4]), m[5]

    def _key(self) -> tuple:
        # A release is above its pre-releases; numbers are below words; a longer list is above its beginning.
        return self.numbers, not self.pre, tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in self.pre)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Version) and self._key() == other._key()

    def __lt__(self, other: Version) -> bool:
        return self._key() < other._key()

    def __hash__(self) -> int:
        return hash(self._key())

    def __str__(self) -> str:
        return ".".join(map(str, self.numbers)) + ("-" + ".".join(self.pre) if self.pre else "") + (f"+{self.build}" if self.build else "")


class Comparator:
    def __init__(self, text: str):
        m = _COMPARATOR.fullmatch(text)
        if not m:
            raise PackageError("InvalidVersionRequirement", text=text)
        self.wild = any(x in ("*", "x", "X") for x in m.group(2, 3, 4) if x)
        parts = [None if x is None or x in "*xX" else int(x) for x in m.group(2, 3, 4)]
        if any(a is None and b is not None for a, b in zip(parts, parts[1:], strict=False)):
            raise PackageError("InvalidVersionRequirement", text=text)
        self.op = m[1] or ("=" if self.wild else "^")
        self.major, self.minor, self.patch = parts
        self.pre = _pre(m[5])

    def __str__(self) -> str:
        shown = [str(x) for x in (self.major, self.minor, self.patch) if x is not None]
        if self.wild:
            shown.append("*")
            return ("" if self.op == "=" else self.op) + ".".join(shown)
        return self.op + ".".join(shown) + ("-" + ".".join(self.pre) if self.pre else "")

    def holds(self, v: Version) -> bool:
        if self.major is None:
            return True
        given = [x for x in (self.major, self.minor, self.patch) if x is not None]
        mine = Version(".".join(map(str, (given + [0, 0])[:3])) + ("-" + ".".join(self.pre) if self.pre else ""))
        same = list(v.numbers[: len(given)]) == given
        full = len(given) == 3
        if self.op == "=":
            return same and (not full or v == mine)
        if self.op == ">":
            return v > mine if full else list(v.numbers[: len(given)]) > given
        if self.op == ">=":
            return v >= mine if full else list(v.numbers[: len(given)]) >= given
        if self.op == "<":
            return v < mine if full else list(v.numbers[: len(given)]) < given
        if self.op == "<=":
            return v <= mine if full else list(v.numbers[: len(given)]) <= given
        if full and v < mine:
            return False
        if self.op == "~":
            return list(v.numbers[: min(2, len(given))]) == given[:2] and list(v.numbers[: len(given)]) >= given
        # caret: nothing left of the first non-zero part may change
        first = next((i for i, x in enumerate(given) if x), len(given) - 1)
        return list(v.numbers[: first + 1]) == given[: first + 1] and list(v.numbers[: len(given)]) >= given


class Requirement:
    def __init__(self, text: str):
        self.comparators = [Comparator(x) for x in text.split(",")]
        if len(self.comparators) > 1 and any(c.major is None for c in self.comparators):
            raise PackageError("InvalidVersionRequirement", text=text)

    def matches(self, version: Version | str) -> bool:
        v = Version(version) if isinstance(version, str) else version
        if not all(c.holds(v) for c in self.comparators):
            return False
        return not v.pre or any(c.pre and (c.major, c.minor, c.patch) == v.numbers for c in self.comparators)

    def __str__(self) -> str:
        return ", ".join(map(str, self.comparators))


def matches(requirement: str, version: str) -> bool:
    return Requirement(requirement).matches(version)
