"""Words of UTF-8 bytes: one translate and one split per text."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase, digits

_KEPT = (ascii_lowercase + digits).encode() + bytes(range(0x80, 0x100))
#: A-Z become a-z; a-z, digits and every byte of a non-ASCII character stay; all else becomes a blank.
TABLE = bytes(
    b + 32 if chr(b) in ascii_uppercase else b if b in _KEPT else 0x20 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """The words of a text in order; a null or blank text has none."""
    return text.encode().translate(TABLE).split() if text else []
