"""Brute-force versions that the text operators are held against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

LONG = "documents long enough to matter hold many different words and some of them come again "
EDGE_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one two three"),
    (5, LONG * 400),
    (6, LONG * 400),
    (6, LONG * 400),
    (7, "żółć 日本語 🙂   it's 'twas <|endoftext|> end"),
    (None, "a row without an id but with words " * 5),
    (8, "token = \"0123456789abcdef0123456789abcdef\" and password: hunter2hunter2"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, key string, block string"


def edge_documents(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with names the operators use."""
    rows = [(i, t, "en" if i else None, None if i == 4 else "s", None, "clash", "clash", "clash") for i, t in EDGE_TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def shingles(text: str) -> frozenset:
    found = words(text)
    return frozenset(tuple(found[i : i + 5]) for i in range(max(len(found) - 4, 1 if found else 0)))


def jaccard_groups(documents: dict[int, str]) -> tuple[dict[int, int], Counter]:
    """Least id of every document's group of linked documents, and its number of links."""
    sets = {k: shingles(t) for k, t in documents.items()}
    parent, links, ids = {k: k for k in sets}, Counter(), sorted(sets)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in ids}, links


def repeated_bytes(documents: list[tuple[int, bytes]], length: int) -> list[bytearray]:
    """1 for every byte that a string covers that also starts earlier."""
    seen, result = set(), []
    for _, data in documents:
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            piece = data[p : p + length]
            if piece in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(piece)
        result.append(gone)
    return result


ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text: str) -> str:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
