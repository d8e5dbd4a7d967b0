"""Plain versions of the operators, and documents with every odd case."""

from __future__ import annotations

import collections
import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
# Extra columns named like those the operators use themselves.
CLASHES = "key string, node long, text_key string, runs string, n long, component string, score string, c0 string, q_words string"


def odd_documents(seed: int = 7) -> list[tuple[int | None, str | None]]:
    """Ids and texts: nulls, empties, blanks, a very long one, repeated rows, copies, near copies, shared passages."""
    draw = random.Random(seed)

    def sentence(n: int) -> str:
        return " ".join("".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 6))) for _ in range(n))

    passage, base = sentence(60), sentence(300)
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \n\t\x0b "), (4, "one"), (5, "Three short words"), (6, "three  SHORT words"),
        (None, sentence(50)), (None, base), (7, base), (7, base), (8, base.upper()), (9, base.replace(" ", "\n")),
        (10, "x" * 5000), (11, "w " * 4000), (12, sentence(30000)), (13, "漢字 かな ok 🙂 " * 3), (14, passage),
        (15, sentence(40) + "\n" + passage), (16, passage + " " + sentence(20) + " " + passage), (17, None),
    ]
    words = base.split()
    for i in range(20, 60):
        near = list(words)
        for _ in range(draw.randint(0, 12)):
            near[draw.randrange(len(near))] = sentence(1)
        rows.append((i, " ".join(near)))
    rows += [(100 + i, sentence(draw.randint(1, 80))) for i in range(30)]
    rows += [(200 + i, "\n".join([sentence(12)] * draw.randint(1, 4))) for i in range(10)]
    return rows


def frame(spark, rows, clash: bool = True):
    extra = len(CLASHES.split(","))
    kinds = [None] * extra
    schema = "doc_id long, text string" + (", " + CLASHES if clash else "")
    return spark.createDataFrame([(*r, *(kinds if clash else [])) for r in rows], schema).repartition(3)


def signals(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    count = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered: set[int] = set()
    for k in range(len(words) - 7):
        if count[tuple(words[k : k + 8])] > 1:
            covered.update(range(k, k + 8))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def without_repeats(texts: list[str | None], width: int = 35) -> list[tuple[int, int, list[str]]]:
    """(words, removed words, kept words) of every text."""
    words = [WORD.findall(t or "") for t in texts]
    count = collections.Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((len(w), sum(gone), [x for x, g in zip(w, gone) if not g]))
    return out


def shingles(text: str | None) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def classes(rows) -> list[tuple[int, int | None]]:
    """(set size, smallest id reachable) of every row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    low: dict[int, int | None] = {}
    for i, (name, _) in enumerate(rows):
        root = find(i)
        known = low.get(root)
        low[root] = name if known is None else known if name is None else min(known, name)
    return [(len(s), low[find(i)]) for i, s in enumerate(sets)]


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()
