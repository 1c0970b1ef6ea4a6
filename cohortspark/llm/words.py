"""Words of a text as bytes: A-Z lower-cased, runs of a-z, 0-9 and all non-ASCII characters."""

from __future__ import annotations

_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
               for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []
