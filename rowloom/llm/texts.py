"""Whole texts as arrays of code points, in pieces of bounded size, for numpy work inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHARS_AT_ONCE = 1 << 20


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def pieces(texts: Iterable[str], size: int = CHARS_AT_ONCE, gap: str = " ") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, starts, points): texts laid one after the other, ``gap`` before each and at the end.

    ``owner`` are the indexes of the texts of a piece, ``starts`` where the gap before each
    begins in ``points``. A piece holds about ``size`` code points; a longer text comes in
    several pieces, cut after a space where there is one.
    """
    owner: list[int] = []
    parts: list[str] = []
    held = 0
    for k, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > size:
                end = text.rfind(" ", at, at + size) + 1 or at + size
            part = text[at:end] if at or end < len(text) else text
            if parts and held + len(part) > size:
                yield _laid(owner, parts, gap)
                owner, parts, held = [], [], 0
            owner.append(k)
            parts.append(part)
            held += len(part) + len(gap)
            at = end
            if at >= len(text):
                break
    if parts:
        yield _laid(owner, parts, gap)


def _laid(owner: list[int], parts: list[str], gap: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) + len(gap) for p in parts])
    return np.array(owner), np.cumsum(sizes) - sizes, code_points(gap + gap.join(parts) + gap)
