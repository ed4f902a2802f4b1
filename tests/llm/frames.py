"""Small tables with every awkward case."""

import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside or return.
CLASHES = ["kept", "score", "ids", "_spans", "_id", "_hash", "digest", "cls", "root", "key", "part", "a", "b", "label", "_label", "held_out", "x", "y"]


def prose(seed: int, words: int, stock: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(stock)}{'abcdefgh'[r.randrange(8)]}" for _ in range(words))


def awkward_docs(spark):
    """Nulls, empty and blank texts, a long text, ties, repeated rows, and extra columns."""
    base = prose(1, 120)
    rows = [
        (1, base), (2, base), (3, base.replace("w1", "v1")), (4, None), (5, ""), (6, " \t\n \x0b"), (7, "Word"), (8, "word"),
        (9, prose(9, 60_000)), (None, base + " tail"), (None, None), (10, prose(10, 40)), (10, prose(10, 40)), (10, prose(11, 40)),
        (11, "Émile 漢字 🙂 don't   stop\r\n\r\nnow\x00"), (12, "x" * 5000), (13, "- " * 30),
    ]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    for name in CLASHES:
        frame = frame.selectExpr("*", f"'clash' as `{name}`")
    return frame, rows


def words_of(text: str | None) -> list[bytes]:
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in WORD.findall((text or "").encode())]


class Union:
    def __init__(self):
        self.up = {}

    def find(self, v):
        while self.up.setdefault(v, v) != v:
            v = self.up[v]
        return v

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)
