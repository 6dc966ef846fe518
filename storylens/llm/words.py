"""Word splits of the operators, on UTF-8 bytes: ``bytes.lower`` lowers A-Z
alone, ``bytes.split`` splits at \\x20 and \\x09-\\x0D alone, and every byte of
a non-ASCII character is a word byte."""

from __future__ import annotations

# Letters, digits and bytes from 0x80 stay; all else separates.
_ALNUM = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lowered."""
    return (text or "").encode().lower().translate(_ALNUM).split()


def spaced_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after A-Z are lowered."""
    return (text or "").encode().lower().split()
