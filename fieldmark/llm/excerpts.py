"""Whole texts in pieces."""

from __future__ import annotations


def pieces(data: bytes, size: int) -> list[bytes]:
    """The whole text in pieces of ``size`` bytes (an empty text is one empty piece)."""
    return [data[i : i + size] for i in range(0, len(data), size)] or [b""]
