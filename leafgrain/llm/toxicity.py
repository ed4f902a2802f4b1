"""Toxicity: boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrain.llm.common import FIT_ROWS, held_out, labelled_sample, materialize, small_batches
from leafgrain.llm.trees import Trees, fit_isotonic, fit_trees, sigmoid
from leafgrain.llm.wordstats import M1, Words, byte_set, mix

TOXIC_FROM = 0.3
#: A lexicon entry covers at least this share of the toxic sample texts (and this many), and is at least this precise.
LEXICON_SHARE, LEXICON_LEAST, LEXICON_PRECISION, LEXICON_SIZE = 0.004, 5, 0.75, 2000
STEMS = (4, 5, 6, 7, 8)
NEAR = 5
#: English insults that count whatever the labels hold.
SEED = "idiot moron stupid loser pathetic worthless disgusting trash scum clown dumb imbecile".split()
#: Second-person words of the four languages.
SECOND_PERSON = ("you your yours yourself du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous "
                 "votre vos usted ustedes ti contigo vosotros vuestro").split()
#: Characters that stand for letters in disguised words, in two readings.
DISGUISES = [{ord(a): ord(b) for a, b in zip("@430$517!|", letters)} for letters in ("aaeossitii", "aaeossltll")]
PUNCTUATION = byte_set(b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\")
LETTER = byte_set(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
INNER = byte_set(b"0123456789@$!|*_.-")
FEATURES = ["log_words", "word_density", "stem_density", "seed_density", "disguised_density", "any_hit", "log_hits", "near_second_person",
            "second_person", "capitals", "capital_words", "exclamations", "questions", "punctuation", "obfuscated",
            "repeated_letters", "distinct_hits"]
HITS = ("word_density", "stem_density", "seed_density", "any_hit", "log_hits")
RISING = {FEATURES.index(n): 1 for n in HITS}


def spelled(words: list[str]) -> np.ndarray:
    return np.unique(Words(pa.array(words)).hashes())


class Tokens:
    """Words in lower case without punctuation at either end, with their hashes and leading bytes."""

    def __init__(self, column: pa.Array):
        self.raw = Words(column)
        self.words = words = Words(column, lower=True)
        # Of a word that is all punctuation the middle stays.
        place, marks = np.arange(len(words.data)), PUNCTUATION[words.data]
        after = np.minimum.accumulate(np.where(marks, len(marks), place)[::-1])[::-1]
        before = np.maximum.accumulate(np.where(marks, -1, place))
        middle = (words.starts + words.ends) // 2
        bare = after[words.starts] >= words.ends
        self.starts = np.where(bare, middle, after[words.starts])
        self.ends = np.where(bare, middle, before[words.ends - 1]) + 1
        self.length = self.ends - self.starts
        self.hashes = words.hashes(self.starts, self.ends)
        self.lead = words.eight(self.starts)

    def stems(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(which words, key) of the words with at least ``size`` bytes."""
        at = np.flatnonzero(self.length >= size)
        mask = np.uint64((1 << (8 * size)) - 1) if size < 8 else np.uint64(2 ** 64 - 1)
        return at, mix((self.lead[at] & mask) * M1 + np.uint64(size))


@dataclass
class Lexicon:
    words: np.ndarray
    stems: np.ndarray
    seed: np.ndarray
    person: np.ndarray


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    tokens = Tokens(column)
    words, raw = tokens.words, tokens.raw
    n = np.maximum(words.counts, 1)
    word = np.isin(tokens.hashes, lexicon.words)
    seed = np.isin(tokens.hashes, lexicon.seed)
    stem = np.zeros(len(word), bool)
    for size in STEMS:
        at, key = tokens.stems(size)
        stem[at] |= np.isin(key, lexicon.stems)
    person = np.isin(tokens.hashes, lexicon.person)
    # Words with a digit or symbol between letters, spelled back and looked up again.
    odd = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(INNER[words.data], out=odd[1:])
    letters = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(LETTER[words.data], out=letters[1:])
    mixed = (odd[tokens.ends] > odd[tokens.starts]) & (letters[tokens.ends] - letters[tokens.starts] >= 2)
    disguised = np.zeros(len(word), bool)
    at = np.flatnonzero(mixed)
    if len(at):
        data = words.data.tobytes()
        _, first, same = np.unique(tokens.hashes[at], return_index=True, return_inverse=True)
        some = [data[a:b].decode("utf-8", "replace") for a, b in zip(tokens.starts[at[first]], tokens.ends[at[first]])]
        for letters in DISGUISES:
            plain = ["".join(c for c in w.translate(letters) if c.isalpha()) or "-" for w in some]
            disguised[at] |= np.isin(Words(pa.array(plain)).hashes(), np.union1d(lexicon.words, lexicon.seed))[same]
    hit = word | seed | stem | disguised
    # Hits with a second-person word of the same text within a few words.
    near = np.zeros(len(hit), bool)
    for d in range(1, NEAR + 1):
        same = words.doc[d:] == words.doc[:-d]
        near[d:] |= hit[d:] & person[:-d] & same
        near[:-d] |= hit[:-d] & person[d:] & same
    upper = byte_set(bytes(range(65, 91)))[raw.data]
    uppers = np.zeros(len(raw.data) + 1, np.int64)
    np.cumsum(upper, out=uppers[1:])
    shouted = (uppers[tokens.ends] - uppers[tokens.starts] == tokens.length) & (tokens.length >= 3)
    tripled = np.zeros(len(words.data), bool)
    tripled[2:] = (words.data[2:] == words.data[1:-1]) & (words.data[2:] == words.data[:-2]) & LETTER[words.data[2:]]
    hits = words.per_words(hit)
    order = np.flatnonzero(hit)
    pairs = np.unique(np.stack([words.doc[order].astype(np.uint64), tokens.hashes[order]], 1), axis=0)[:, 0].astype(np.int64) if len(order) else order
    size = np.maximum(np.diff(words.bounds), 1)
    return np.stack([
        np.log1p(words.counts), words.per_words(word) / n, words.per_words(stem) / n, words.per_words(seed) / n,
        words.per_words(disguised) / n, hits > 0, np.log1p(hits), words.per_words(near) / n, words.per_words(person) / n,
        raw.per_text(upper) / size, words.per_words(shouted) / n, raw.per_text(byte_set(b"!")[raw.data]) / n,
        raw.per_text(byte_set(b"?")[raw.data]) / n, raw.per_text(PUNCTUATION[raw.data]) / size, words.per_words(mixed) / n,
        words.per_text(tripled) / size, np.bincount(pairs, minlength=len(n)),
    ], 1).astype(float)


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and word beginnings whose sample texts are mostly toxic.

    Equal texts count once. What comes to the driver is the entries that pass the thresholds, ``LEXICON_SIZE`` at most
    of either kind, by the number of toxic texts they cover; each covers a fixed share of the toxic texts.
    """
    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            tokens = Tokens(batch.column(0))
            toxic = batch.column(1).to_numpy(zero_copy_only=False) > 0.5
            kinds = [(0, np.arange(len(tokens.hashes)), tokens.hashes), *((1, *tokens.stems(s)) for s in STEMS)]
            for kind, at, key in kinds:
                both = np.unique(np.stack([key, tokens.words.doc[at].astype(np.uint64)], 1), axis=0) if len(at) else np.zeros((0, 2), np.uint64)
                keys, start = np.unique(both[:, 0], return_index=True)
                bad = np.add.reduceat(toxic[both[:, 1].astype(np.int64)].astype(np.int64), start) if len(keys) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), kind), pa.int32()), pa.array(keys.view(np.int64)), pa.array(np.diff([*start, len(both)]), pa.int64()), pa.array(bad)],
                    ["kind", "key", "n", "bad"])

    texts = sample.groupBy("text").agg(F.max("_label").alias("_label")).where(F.col("text").isNotNull())
    total = texts.agg(F.coalesce(F.sum("_label"), F.lit(0.0))).first()[0]
    least = max(LEXICON_LEAST, LEXICON_SHARE * total)
    found = texts.mapInArrow(mine, "kind int, key bigint, n bigint, bad bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    found = found.where((F.col("bad") >= least) & (F.col("bad") >= LEXICON_PRECISION * F.col("n")))
    taken = [[r.key for r in found.where(F.col("kind") == k).orderBy(F.desc("bad"), "key").limit(LEXICON_SIZE).collect()] for k in (0, 1)]
    words, stems = (np.array(t, np.int64).view(np.uint64) for t in taken)
    return Lexicon(words, stems, spelled(SEED), spelled(SECOND_PERSON))


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: np.ndarray
    values: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        return np.interp(sigmoid(self.trees.margin(features(column, self.lexicon))), self.knots, self.values)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learns ``labels.toxic`` from at most ``rows`` labelled documents, never those held out.

    The lexicon is learned from all of these; the trees from four fifths of them and the calibration from the rest.
    Without labels every score is 0.
    """
    sample = materialize(labelled_sample(docs, labels, "toxic", rows), "toxic-sample")
    lexicon = learn_lexicon(sample)

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            x = features(batch.column(0), lexicon)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), *batch.columns[1:]], ["x", "y", "part"])

    parts = sample.select("text", "_label", F.pmod(F.xxhash64("text"), F.lit(5)).alias("part"))
    found = parts.mapInArrow(table, "x array<double>, y double, part bigint").toArrow()
    x, y, part = np.array(found.column(0).to_pylist(), float).reshape(-1, len(FEATURES)), found.column(1).to_numpy(), found.column(2).to_numpy()
    trees = fit_trees(x[part != 0], y[part != 0], RISING, trees=60)
    rest = part == 0 if (part == 0).any() else part >= 0
    knots, values = fit_isotonic(sigmoid(trees.margin(x[rest])), y[rest])
    return Model(lexicon, trees, knots, values)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of whole texts, in one pass without a shuffle.

    Null text is the empty text and has a score too. A null id is not held out. Repeated rows stay rows of their own; a
    text of any length is read whole; an empty table gives no rows; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            score = model.score(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= TOXIC_FROM).astype("int32"))],
                ["doc_id", "held_out", "score", "predicted"])

    docs = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            yield batch.filter(pa.array(model.score(batch.column("text")) < TOXIC_FROM))

    return docs.mapInArrow(run, docs.schema)
