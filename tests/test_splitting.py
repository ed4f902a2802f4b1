"""Linear splitters against character-by-character brute force."""

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from leafgrain.operators import splitting as sp


def count(text):
    text = " ".join(text.split())
    return max(len(text.split()), math.ceil(len(text) / 4)) if text else 0


def brute_chars(text, budget, head=""):
    text = " ".join(text.split())
    out, current = [], ""
    for char in text:
        grown = current + char
        if current and count(f"{head}\n{grown}") > budget:
            out.append(current)
            current = char
        else:
            current = grown
    if current:
        out.append(current)
    return [" ".join(piece.split()) for piece in out if piece.strip()]


def brute_words(text, budget):
    out, current = [], []
    for word in text.split():
        if current and count(" ".join([*current, word])) > budget:
            out.append(" ".join(current))
            current = [word]
        else:
            current = [*current, word]
        if count(" ".join(current)) > budget:
            out.extend(brute_chars(" ".join(current), budget))
            current = []
    if current:
        out.append(" ".join(current))
    return out


texts = st.lists(st.text(alphabet="abcdé网", min_size=1, max_size=30), max_size=25).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(2, 12))
def test_split_chars(text, budget):
    assert sp.split_chars(text, budget) == brute_chars(text, budget)


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(6, 14))
def test_split_chars_under_header(text, budget):
    head = "ab | cd"
    assert sp.split_chars(text, budget, head) == brute_chars(text, budget, head)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(2, 12))
def test_split_words(text, budget):
    assert sp.split_words(text, budget) == brute_words(text, budget)


def test_table_rows_repeat_header_and_lose_nothing():
    cells = [["System", "Recall", "Precision"], *[[f"model {i}", f"0.{i}", f"0.{i + 1}"] for i in range(3)]]
    pieces = sp.split_table("Scores", cells, 1, 14)
    assert len(pieces) > 1
    assert all("System | Recall | Precision" in p["text"] for p in pieces)
    joined = "\n".join(p["text"] for p in pieces)
    assert all(f"model {i} | 0.{i} | 0.{i + 1}" in joined for i in range(3))
    assert [p["row_start"] for p in pieces][0] == 0 and pieces[-1]["row_end"] == 3


def test_table_pieces_fit_and_cover_rows():
    rng = random.Random(3)
    for _ in range(60):
        cells = [["h1", "h2"]] + [
            ["x" * rng.randint(1, 60), " ".join("y" * rng.randint(1, 9) for _ in range(rng.randint(1, 12)))]
            for _ in range(rng.randint(1, 9))
        ]
        pieces = sp.split_table("A caption", cells, 1, 20)
        assert all(count(p["text"]) <= 20 for p in pieces)
        spans = sorted({(p["row_start"], p["row_end"]) for p in pieces})
        assert spans[0][0] == 0 and spans[-1][1] == len(cells) - 1
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        letters = "".join(c for row in cells[1:] for c in "".join(row) if c in "xy")
        body = "".join(c for p in pieces for c in p["text"].replace("h1 | h2", "") if c in "xy")
        assert body == letters
