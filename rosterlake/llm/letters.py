"""Code points of texts and their classes, for models of characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_TABLES: dict[str, np.ndarray] = {}
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def classes() -> np.ndarray:
    """Letter, number, space or other, for every code point."""
    if "classes" not in _TABLES:
        import regex

        found = np.full(0x110000, OTHER, np.uint8)
        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for run in regex.finditer(pattern, points):
                found[np.frombuffer(run.group().encode("utf-32-le"), np.uint32)] = kind
        _TABLES["classes"] = found
    return _TABLES["classes"]


def folded() -> np.ndarray:
    """Lower-case letters as they are, everything else as a space."""
    if "folded" not in _TABLES:
        found = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x1E944):
            if not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1:
                found[c] = ord(low)
        found[classes() != LETTER] = 32
        _TABLES["folded"] = found
    return _TABLES["folded"]


def letter_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, rows): folded texts, runs of other characters as one space, and a space around
    every text, so that grams never cross texts; the row number of every character."""
    listed = ["" if t is None else t for t in texts.to_pylist()]
    joined = " " + " ".join(listed) + " "
    points = folded()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    rows = np.repeat(np.arange(len(listed) + 1), np.array([*map(len, listed), 0]) + 1)
    kept = np.ones(len(points), bool)
    kept[1:] = (points[1:] != 32) | (points[:-1] != 32)
    # The leading space has no row of its own: character n of the joined text is in rows[n - 1].
    return points[kept], np.concatenate([[0], rows])[: len(kept)][kept]
