"""Spans in texts and their digests."""

from __future__ import annotations

import hashlib

#: (kind, start, end); code points, end exclusive.
Span = tuple[str, int, int]


def joined(spans: list[Span], kinds: list[str]) -> str:
    """``kind:start:end`` by start, then by the kinds' order, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
