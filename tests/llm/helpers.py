"""Plain-code versions of what the operators compute."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def shingles(text):
    w = WORD.findall(low(text))
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def similarity(a, b):
    same, either = sum((a & b).values()), sum((a | b).values())
    return same / either if either else 1.0


def classes(rows, least=0.8):
    """{id: least id of its component} by comparing everything that shares a shingle; texts without words are one class."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s or [None]:
            where[g].append(i)
    pairs = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        if similarity(sets[a], sets[b]) >= least:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


#: Rows every operator must take: nulls, empty and blank texts, repeated rows, a very long text, ties, other scripts.
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
EDGE = [
    (1, None, None), (2, "", "a"), (3, "  \n\t ", "a"), (4, "one", "b"), (4, "one", "b"), (5, "one", None), (6, LONG, "a"), (7, LONG + " tail", "c"),
    (8, "日本語 の テキスト です 🙂 ok", "c"), (None, "text without an id stands here", "d"), (9, "x" * 3_000, "b"), (10, "<|endoftext|> it's odd  spaces \r\n end", "a"),
]
EDGE_SCHEMA = "doc_id long, text string, source string, score double, size int, bands string, host string"


def edge_frame(spark):
    return spark.createDataFrame([(*r, 1.0, 2, "x", "h") for r in EDGE], EDGE_SCHEMA)
