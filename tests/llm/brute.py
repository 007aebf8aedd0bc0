"""Plain single-process versions of the operators, for small inputs."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(ascii_lower(text or ""))


def shingles(text: str | None, width: int) -> set:
    w = words(text)
    if not w:
        return set()
    m = min(width, len(w))
    return {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}


def near_components(rows, width: int, percent: int = 80) -> dict:
    """Smallest reachable id per id, over all pairs that share a shingle."""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders: dict = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for own in holders.values() for k, a in enumerate(own) for b in own[:k]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def edits(a: list[str], b: list[str]) -> int:
    """Levenshtein distance over words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def dropped_lines(rows, min_words: int = 8) -> dict:
    """Dropped line numbers per id; the rows' ids are distinct."""
    lines = [
        (doc is None, doc, n, words(line))
        for doc, text in rows
        for n, line in enumerate((text or "").split("\n"))
        if len(words(line)) >= min_words
    ]
    lines.sort(key=lambda x: (x[0], x[1] if x[1] is not None else 0, x[2]))
    out: dict = {doc: set() for doc, _ in rows}
    for i, (_, doc, n, own) in enumerate(lines):
        if any(abs(len(own) - len(o)) < 2 and edits(own, o) <= 1 for _, _, _, o in lines[:i]):
            out[doc].add(n)
    return out


def without_lines(text, dropped):
    if text is None:
        return None
    return "\n".join(line for n, line in enumerate(text.split("\n")) if n not in dropped)


def kept_bytes(rows, length: int) -> list[tuple[int, list[list[int]], bytes]]:
    """Per row: bytes, maximal removed spans, and what stays."""
    raws = [(t or "").encode() for _, t in rows]
    count: dict = {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            h = hash(raw[i : i + length])
            count[h] = count.get(h, 0) + 1
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if count[hash(raw[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        spans = [[m.start(), m.end()] for m in re.finditer(b"\1+", bytes(gone))]
        out.append((len(raw), spans, bytes(c for c, g in zip(raw, gone) if not g)))
    return out
