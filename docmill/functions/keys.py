"""Field names: normal form and distinct headers. Names are schema, so this runs where the plan is built."""

from __future__ import annotations

import re
import unicodedata


def normalize_key(key: str | None, fallback: str) -> str:
    s = "".join(c for c in unicodedata.normalize("NFD", key or "") if not 0x300 <= ord(c) <= 0x36F).lower()
    return re.sub(r"[^a-z0-9]+", "_", s).strip("_") or fallback


def normalize_keys(keys: list[str | None]) -> list[str]:
    """Normal forms; repeats of one get _1, _2 in order; blanks are field_n."""
    seen: dict[str, int] = {}
    out = []
    for i, k in enumerate(keys, 1):
        base = normalize_key(k, f"field_{i}")
        n = seen.get(base, 0)
        seen[base] = n + 1
        out.append(f"{base}_{n}" if n else base)
    return out
