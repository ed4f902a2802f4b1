"""Quality rules: exact counts of a text, two base rules, and boosted trees over the counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from leafgrain.llm.common import FIT_ROWS, labelled_sample, small_batches
from leafgrain.llm.trees import Trees, fit_trees, sigmoid
from leafgrain.llm.wordstats import Words, byte_set

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
KEEP_FROM = 0.5
SYMBOLS = byte_set(b"#*$%&|<>")
UPPER, LOWER_CASE, DIGIT = (byte_set(bytes(range(a, b + 1))) for a, b in ((65, 90), (97, 122), (48, 57)))
STOPS, BREAKS = byte_set(b".!?"), byte_set(b",;:")
#: Of the features, those whose growth may only lower the chance to be kept.
FEATURES = ["log_words", "chars_a_word", "symbols", "dup_lines", "repeated", "capitals", "digits", "stops", "breaks",
            "distinct_words", "words_a_line", "short_words", "marks", "pipes"]
FALLING = {FEATURES.index(n): -1 for n in ("symbols", "dup_lines", "repeated")}


def duplicate_lines(text: bytes) -> int:
    """Lines that hold a word and equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def repeated_words(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Words of each text that lie in an 8-word window found twice or more in it."""
    at, gram = words.grams(hashes, WINDOW)
    key = gram ^ (words.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    begin = at[order[twice]]
    cover = np.zeros(len(hashes) + 1, np.int64)
    cover[begin] += 1
    cover[begin + WINDOW] -= 1
    return words.per_words(np.cumsum(cover[:-1]) > 0)


def counts(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The exact counts, and the features of the trees, of each text."""
    words = Words(column)
    hashes = words.hashes()
    n = words.counts
    lead = (words.data & 0xC0) != 0x80
    chars = words.per_text(words.inside & lead)
    symbols = words.per_text(SYMBOLS[words.data])
    texts = pc.fill_null(column, "").cast(pa.binary()).to_pylist()
    dup = np.array([duplicate_lines(t) for t in texts], np.int64)
    repeated = repeated_words(words, hashes)
    base = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeated}
    lines = np.array([t.count(b"\n") + 1 for t in texts])
    order = np.lexsort((hashes, words.doc))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (words.doc[1:] != words.doc[:-1])
    words_, chars_ = np.maximum(n, 1), np.maximum(chars, 1)
    share = lambda table: words.per_text(table[words.data])
    letters = np.maximum(share(UPPER) + share(LOWER_CASE), 1)
    x = np.stack([
        np.log1p(n), chars / words_, symbols / chars_, dup / lines, repeated / words_, share(UPPER) / letters,
        share(DIGIT) / chars_, share(STOPS) / words_, share(BREAKS) / words_, words.per_words(fresh) / words_, n / lines,
        words.per_words(words.ends - words.starts <= 3) / words_, share(byte_set(b"!")) / words_, share(byte_set(b"|")) / words_,
    ], 1)
    return base, x


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees:
    """Learns ``labels.quality`` from at most ``rows`` labelled documents (never the held-out fold)."""
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            x = counts(batch.column(0))[1]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    found = labelled_sample(docs, labels, "quality", rows).mapInArrow(features, "x array<double>, y double").toArrow()
    x = np.array(found.column(0).to_pylist(), float).reshape(-1, len(FEATURES))
    return fit_trees(x, found.column(1).to_numpy(), FALLING)


def judge(column: pa.Array, model: Trees) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    base, x = counts(column)
    failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
    score = sigmoid(model.margin(x))
    return base, failed, score, ~failed & (score >= KEEP_FROM)


def score_quality(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, the counts, base_failed, score, kept) of whole texts, in one pass without a shuffle.

    Null text is the empty text: all counts 0, base_failed. Repeated rows and null ids are rows of their own; a text of
    any length is read whole; an empty table gives no rows; other columns are not read.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            base, failed, score, kept = judge(batch.column(1), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(base[n]) for n in names), pa.array(failed), pa.array(score), pa.array(kept)],
                ["doc_id", *names, "base_failed", "score", "kept"])

    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{n} bigint' for n in names)}, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of ``docs``, all columns, that ``score_quality`` would keep."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            yield batch.filter(pa.array(judge(batch.column("text"), model)[3]))

    return docs.mapInArrow(run, docs.schema)
