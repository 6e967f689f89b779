"""Words and lines as the corpus operators take them: maximal runs outside space, \\t, \\n, \\v, \\f and \\r.

bytes.split() without arguments cuts at exactly these six ASCII characters, and UTF-8 never holds their
bytes inside another character, so the helpers work on encoded text.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"


def encoded(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty and lone surrogates become '?'."""
    return text.encode("utf-8", "replace") if text is not None else b""


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
