"""Searches of whole texts in Python's regular expressions, whose classes, case folding
and backtracking results depend on."""

from __future__ import annotations

import re
from collections.abc import Iterator


def lowered(text: str) -> str | None:
    """The text as `needs` are looked up in; none where lower case doesn't tell what a pattern folds."""
    return text.lower() if text.isascii() else None


class Finder:
    """A case-insensitive pattern; each of its matches holds one of `needs`, so that texts
    without them, most of all, are not searched, and begins with one of `starts`, of which none
    begins another or overlaps itself, so that it is tried only where these stand."""

    def __init__(self, pattern: str, *needs: str, starts: tuple[str, ...]):
        self.pattern, self.needs, self.starts = re.compile(pattern, re.I), needs, starts

    def first(self, text: str, low: str | None) -> re.Match | None:
        return next(self.every(text, low), None)

    def every(self, text: str, low: str | None) -> Iterator[re.Match]:
        if low is None:
            return self.pattern.finditer(text)
        for x in self.needs:
            if x in low:
                return self._tried(text, low)
        return iter(())

    def _tried(self, text: str, low: str) -> Iterator[re.Match]:
        places, end = [], 0
        for x in self.starts:
            at = low.find(x)
            while at >= 0:
                places.append(at)
                at = low.find(x, at + len(x))
        if len(self.starts) > 1:
            places.sort()
        for at in places:
            if at >= end and (m := self.pattern.match(text, at)):
                yield m
                end = m.end()
