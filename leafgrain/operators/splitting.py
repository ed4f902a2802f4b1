"""Budget splits of single over-long texts and tables.

Only rows over the budget carry data into these Arrow-batched functions; all
other rows pass nulls. Each text is walked once, word by word.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("row_start", T.IntegerType()),
    T.StructField("row_end", T.IntegerType()),
    T.StructField("split_index", T.IntegerType()),
    T.StructField("split_count", T.IntegerType()),
])


def tokens(words: int, chars: int) -> int:
    return max(words, -(-chars // 4))


def measure(text: str) -> tuple[int, int]:
    """Words and characters of the normalized text."""
    parts = text.split()
    return len(parts), sum(map(len, parts)) + max(len(parts) - 1, 0)


def fits(text: str, budget: int) -> bool:
    return tokens(*measure(text)) <= budget


def split_chars(text: str, budget: int, head: str = "") -> list[str]:
    """Greedy fragments of a text, each within the budget together with ``head``.

    A fragment takes as many characters as fit; a word is cut only where the
    budget ends inside it.
    """
    head_words, head_chars = measure(head)
    fragments: list[str] = []
    current: list[str] = []
    words, chars = head_words, head_chars
    for word in text.split():
        rest = word
        while rest:
            gap = 1 if chars else 0
            room = budget * 4 - chars - gap
            if words + 1 > budget:
                room = 0
            if room <= 0 and current:
                fragments.append(" ".join(current))
                current, words, chars = [], head_words, head_chars
                continue
            take = rest[: max(room, 1)]
            rest = rest[len(take):]
            current.append(take)
            words, chars = words + 1, chars + gap + len(take)
            if rest:
                fragments.append(" ".join(current))
                current, words, chars = [], head_words, head_chars
    if current:
        fragments.append(" ".join(current))
    return fragments


def split_words(text: str, budget: int) -> list[str]:
    """Greedy fragments at word limits; a word over the budget is cut by characters."""
    fragments: list[str] = []
    current: list[str] = []
    words = chars = 0

    def flush() -> None:
        nonlocal current, words, chars
        if current:
            fragments.append(" ".join(current))
        current, words, chars = [], 0, 0

    for word in text.split():
        gap = 1 if current else 0
        if current and tokens(words + 1, chars + gap + len(word)) > budget:
            flush()
            gap = 0
        if tokens(1, len(word)) > budget:
            fragments.extend(split_chars(word, budget))
            continue
        current.append(word)
        words, chars = words + 1, chars + gap + len(word)
    flush()
    return fragments


def render_row(row: list[str]) -> str:
    return " | ".join(" ".join((cell or "").split()) for cell in row)


def render(caption: str, rows: list[list[str]]) -> str:
    lines = [" ".join(caption.split())] if caption else []
    lines += [render_row(row) for row in rows]
    return "\n".join(line for line in lines if line)


def _numbered(texts: list[str], start: int | None, end: int | None) -> list[dict]:
    many = len(texts) > 1
    return [
        {"text": t, "row_start": start, "row_end": end, "split_index": i if many else None,
         "split_count": len(texts) if many else None}
        for i, t in enumerate(texts)
    ]


def split_row(header: str, row: str, budget: int, start: int, end: int) -> list[dict]:
    """One table row with its header, cut into fragments when it does not fit."""
    whole = "\n".join(part for part in (header, row) if part)
    if fits(whole, budget):
        return _numbered([whole], start, end)
    if header and tokens(*measure(header)) < budget:
        fragments = split_chars(row, budget, header)
        pieces = _numbered([f"{header}\n{f}" for f in fragments], start, end)
        for i, piece in enumerate(pieces):
            piece["split_index"], piece["split_count"] = i, len(pieces)
        if pieces:
            return pieces
    return _numbered(split_chars(whole, budget), start, end)


def split_table(caption: str, cells: list[list[str]], header_rows: int, budget: int) -> list[dict]:
    """Greedy row packing with the header repeated in every piece.

    Sizes are added up row by row, so a table is walked once. The caption is kept
    in a piece only where it fits.
    """
    header_rows = max(0, min(header_rows, len(cells)))
    head, data = cells[:header_rows], cells[header_rows:]
    if not data:
        return _numbered(split_chars(render(caption, cells), budget), None, None)
    header = render("", head)
    head_size, captioned = measure(header), measure(render(caption, head))
    pieces: list[dict] = []
    current: list[list[str]] = []
    start, size = 0, (0, 0)

    def joined(base: tuple[int, int], extra: tuple[int, int]) -> int:
        gap = 1 if base[1] and extra[1] else 0
        return tokens(base[0] + extra[0], base[1] + extra[1] + gap)

    def flush(end: int) -> None:
        nonlocal current, size, start
        if not current:
            return
        if len(current) == 1:
            pieces.extend(split_row(header, render_row(current[0]), budget, start, end))
        else:
            text = render(caption, head + current)
            if not fits(text, budget):
                text = render("", head + current)
            pieces.extend(_numbered(split_chars(text, budget), start, end))
        current, size, start = [], (0, 0), end

    for index, row in enumerate(data):
        own = measure(render_row(row))
        grown = (size[0] + own[0], size[1] + own[1] + (1 if size[1] and own[1] else 0))
        if current and joined(captioned, grown) > budget:
            flush(index)
            grown = own
        if not current:
            start = index
        current.append(row)
        size = grown
        if joined(head_size, size) > budget:
            flush(index + 1)
    flush(len(data))
    return [p for p in pieces if p["text"].strip()]


def text_pieces(text: Column, budget: int, by: str = "chars") -> Column:
    """Pieces of over-budget texts (array of strings; null in, null out)."""
    cut = split_chars if by == "chars" else split_words

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else cut(t, budget))

    return run(text)


def text_pieces_within(text: Column, budget: Column) -> Column:
    """Word-limit pieces with a budget of each row's own."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series, budgets: pd.Series) -> pd.Series:
        return pd.Series([
            None if t is None else split_words(t, int(b)) for t, b in zip(texts, budgets)
        ])

    return run(text, budget)


def table_pieces(caption: Column, cells: Column, header_rows: Column, budget: int) -> Column:
    """Pieces of over-budget tables (array of structs; null cells in, null out)."""

    @F.pandas_udf(T.StringType())
    def run(captions: pd.Series, grids: pd.Series, headers: pd.Series) -> pd.Series:
        return pd.Series([
            None if g is None else json.dumps(
                split_table(c or "", json.loads(g), 1 if pd.isna(h) else int(h), budget),
                ensure_ascii=False,
            )
            for c, g, h in zip(captions, grids, headers)
        ], dtype=object)

    return F.from_json(run(caption, F.to_json(cells), header_rows), T.ArrayType(PIECE))
