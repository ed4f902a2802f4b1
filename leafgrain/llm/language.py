"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgrain.llm.common import held_out, small_batches, texts_of

#: Documents of a language that its dictionary is made of, at most, and the dictionary's size.
DOCS_A_LANGUAGE, DICTIONARY_BYTES = 400, 192 << 10
SALTS = 64
#: A text is compressed in blocks of this many bytes, each against the dictionary alone.
BLOCK_BYTES, LEVEL = 4096, 3
#: Two sizes closer than this share of the smaller one are too close to call.
NARROW, NARROW_BYTES = 0.01, 2
UNKNOWN = "und"
OTHER = re.compile(r"[\W\d_]+")
LETTER = regex.compile(r"\p{L}")


def letters(text: str) -> str:
    """The words in lower case, one space between them."""
    return OTHER.sub(" ", text.lower()).strip()


@dataclass
class Dictionaries:
    """Language -> bytes of text in it. Compressors are made once in each worker."""

    content: dict[str, bytes]
    _made: list = field(default_factory=list, repr=False)
    _words: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"content": self.content, "_made": [], "_words": []}

    def compressors(self) -> list:
        import zstandard as z

        if not self._made:
            for _, data in sorted(self.content.items()):
                known = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(level=LEVEL)
                self._made.append(z.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self._made

    def known_words(self, text: str) -> np.ndarray:
        """How many of the text's distinct words each language's dictionary holds."""
        if not self._words:
            self._words.extend(set(data.split(b" ")) for _, data in sorted(self.content.items()))
        words = {w.encode() for w in text.split(" ")}
        return np.array([len(words & known) for known in self._words])

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of the whole text with each dictionary, languages in order."""
        data = f" {text} ".encode()
        cuts = [data[a:a + BLOCK_BYTES] for a in range(0, len(data), BLOCK_BYTES)]
        return np.array([sum(len(c.compress(x)) for x in cuts) for c in self.compressors()], float)


def learn_dictionaries(docs: DataFrame, docs_a_language: int = DOCS_A_LANGUAGE, size: int = DICTIONARY_BYTES) -> Dictionaries:
    """Takes the documents with the smallest hash of their id, ``docs_a_language`` of each language at most.

    Documents that are held out or have no language are never taken; of rows with equal id and language, the least
    text is. Ids are chosen on two columns; only the chosen ids are broadcast, and only their texts come to the driver.
    """
    chosen = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", "lang")
    chosen = chosen.withColumn("_h", F.xxhash64("doc_id")).withColumn("_salt", F.pmod("_h", F.lit(SALTS)))
    for keys in (["lang", "_salt"], ["lang"]):  # a language may own most rows: first within each salt
        order = Window.partitionBy(*keys).orderBy("_h", "doc_id")
        chosen = chosen.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= docs_a_language)
    chosen = chosen.select("doc_id", "lang").distinct()
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).where(F.col("text").isNotNull())
    content: dict[str, list[bytes]] = {}
    texts = texts.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    for row in texts.select("lang", "text", F.xxhash64("doc_id").alias("h")).orderBy("lang", "h", "text").toLocalIterator():
        parts = content.setdefault(row.lang, [])
        if sum(map(len, parts)) < size:
            parts.append((letters(row.text) + " ").encode())
    return Dictionaries({lang: b"".join(parts)[:size] for lang, parts in content.items()})


def predict_language(docs: DataFrame, known: Dictionaries, narrow: float = NARROW) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of whole texts, in one pass without a shuffle.

    ``lang_pred`` is the language whose dictionary compresses the whole text's words best, and ``und`` for a null
    text, a text without a letter, or no known language. A margin to the second under ``narrow`` of the size (or under
    ``NARROW_BYTES``) is ``rejected``: among the languages that close, the one that holds most of the words is named, of
    equals the smallest, then the first by name. ``score`` is the margin as a chance between 0 and 1. Repeated rows and
    null ids stay rows of their own; an empty table gives no rows; ``lang`` and other columns are not read.
    """
    names = np.array(sorted(known.content), object)

    def judge(text: str) -> tuple[str, float, bool]:
        words = letters(text)
        if not LETTER.search(words) or not len(names):
            return UNKNOWN, 0.0, True
        sizes = known.sizes(words)
        best = int(sizes.argmin())
        close = np.flatnonzero(sizes - sizes[best] < max(narrow * sizes[best], NARROW_BYTES))
        if rejected := len(close) > 1:
            hits = known.known_words(words)
            best = min(close, key=lambda i: (-hits[i], sizes[i], i))
        weight = np.exp(-np.maximum(sizes - sizes[best], 0) / 4)
        return names[best], float(1 / weight.sum()), rejected

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            lang, score, rejected = zip(*map(judge, texts_of(batch.column(1))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    docs = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
