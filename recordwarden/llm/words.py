"""Runs of letters and digits in UTF-8 texts, for the lexical operators."""

from __future__ import annotations

import string

_LETTERS = {ord(c) for c in string.ascii_letters + string.digits}
#: For bytes.translate: ASCII capitals in lower case, all other ASCII but letters and digits as spaces.
_PLAIN = bytes(b if b > 0x7F or b in _LETTERS else 0x20 for b in range(256)).lower()


def words_of(body: bytes) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and non-ASCII characters, only A-Z in lower case."""
    return body.translate(_PLAIN).split()
