"""Small documents with every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

PLAIN = {
    "en": "the house on the hill was old and the people there were kind to every guest who came by",
    "de": "das haus auf dem berg war alt und die leute dort waren freundlich zu jedem gast der kam",
}


def documents(seed: int = 1) -> list[tuple]:
    """Clean texts in two languages, copies, near copies, nulls, empties, a long text, repeated rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(40):
        lang = "en" if i % 3 else "de"
        words = PLAIN[lang].split()
        lines = [" ".join(rng.choices(words, k=rng.randint(4, 14))) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(lines), lang, f"s{i % 4}"))
    rows.append((40, rows[3][1], "en", "s1"))
    rows.append((41, rows[3][1].replace(" ", "  \t"), "en", None))
    rows.append((42, rows[4][1] + " more", "en", "s1"))
    rows.append((43, None, "en", "s1"))
    rows.append((44, "", None, None))
    rows.append((45, " \n\t ", "en", "s2"))
    rows.append((46, "12345 !!! 67", "en", "s2"))
    rows.append((47, " ".join(rng.choices(PLAIN["en"].split(), k=30_000)), "en", "s0"))
    rows.append((48, "a" * 20_000, "en", "s0"))
    rows.append((5, rows[5][1], "en", "s1"))
    rows.append((5, rows[5][1], "en", "s1"))
    rows.append((None, "no id but a text of some words", "en", "s3"))
    rows.append((None, None, None, None))
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def table(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def roots(n: int, links) -> list[int]:
    """Smallest index of the component of each index."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def edit_distance(a: str, b: str) -> int:
    before = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(before[j] + (x != y), before[j + 1] + 1, now[j] + 1))
        before = now
    return before[-1]
