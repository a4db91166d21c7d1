"""Words of a text as UTF-8 bytes: A-Z lower-cased, one rule of separators or the other.

Both rules cut at ASCII bytes alone, so they can work on UTF-8 bytes, whose bytes above
0x7F belong to other code points and to words.
"""

from __future__ import annotations

from collections.abc import Iterator

_LOWER = {c: c + 32 for c in range(65, 91)}
_SPACES = {0x20, *range(0x09, 0x0E)}

#: separators are all ASCII but letters and digits
ALNUM = bytes(_LOWER.get(c, c) if c > 0x7F or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))
#: separators are ASCII white space
SPACED = bytes(_LOWER.get(c, 32 if c in _SPACES else c) for c in range(256))
#: the same, with letters as they are
SPACED_CASED = bytes(32 if c in _SPACES else c for c in range(256))

_PIECE = 1 << 22


def pieces(data: bytes, table: bytes) -> Iterator[list[bytes]]:
    """Lists of the words of data, in order; a long text comes in several lists, cut between words."""
    data = data.translate(table)
    if len(data) <= _PIECE:
        yield data.split()
        return
    start = 0
    while start < len(data):
        end = len(data) if start + _PIECE >= len(data) else data.find(b" ", start + _PIECE)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def words(data: bytes, table: bytes) -> list[bytes]:
    return data.translate(table).split()
