"""Byte-level BPE encoding and decoding by a local rank file (tiktoken)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from leafgrain.llm.common import small_batches, texts_of
from leafgrain.llm.tokens import rank_encoder


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of whole texts.

    Null text is the empty text: no ids. Repeated rows and null ids stay rows of their own; other columns are not
    read. An empty table gives an empty table. Texts of any length are encoded in blocks cut at safe places.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_encoder(path, pattern)
        for batch in small_batches(batches, "text"):
            ids = [coder.encode(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary): the bytes of each row's ids. Null ids decode to no bytes."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_encoder(path, pattern)
        for batch in batches:
            data = [coder.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    encoded = encoded.select("doc_id", "ids")
    return encoded.mapInArrow(decode, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids again, and keeps digests only.

    Ids and bytes stay inside the task. Nulls, repeats and empty tables as in ``encode_documents``.
    """
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_encoder(path, pattern)
        names = [str(i) for i in range(coder.encoding.n_vocab + 1)]
        for batch in small_batches(batches, "text"):
            counts, ids_sha, text_sha = [], [], []
            for text in texts_of(batch.column(1)):
                ids = coder.encode(text)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(digests, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
