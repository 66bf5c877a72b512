"""Plain versions of the corpus operators, for comparison on small tables."""

from __future__ import annotations

import re

import xxhash

NASTY = [None, "", "   \n\t ", "a", "Der\x00Hund", "x" * 50_000, "é" * 40 + " " + "▁ ▁", "12 34 !!", "ab " * 7000]


def fingerprint(text: str | None) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints: list[tuple[int, int]]) -> dict[int, int]:
    """id -> least id reachable over links of at most two bits."""
    parent = {i: i for i, _ in prints}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (i, a) in enumerate(prints):
        for j, b in prints[:k]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in prints}


def bench_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(text: str | None, items: list[tuple[object, str | None]], window: int = 10) -> tuple[int, int, set[str]]:
    words = bench_words(text)
    hit, found = set(), set()
    for item, body in items:
        other = bench_words(body)
        width = min(window, len(other))
        for s in range(len(other) - width + 1 if other else 0):
            for p in range(len(words) - width + 1):
                if words[p : p + width] == other[s : s + width]:
                    hit.update(range(p, p + width))
                    found.add(str(item))
    return len(words), len(hit), found
