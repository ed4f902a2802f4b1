"""Packing, byte-level BPE and token files against the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import Counter
from array import array

import numpy as np
import public_tokenizers as vocab
import pytest
from frames import DOCS, awkward_docs, prose
from tokenizers import Tokenizer

from leafgrain.llm import byte_bpe, packing, token_files
from leafgrain.llm.common import fresh_folder
from leafgrain.llm.tokens import WordEncoder, blocks

BYTE, LOWERED, RANKS = (vocab.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, LOWERED])
def test_word_cache_equals_whole_text(path):
    r, whole, ours = random.Random(3), library(path), WordEncoder(path)
    letters = "ab'sdtlmvre  \n\n\t\r\x85\xa0 ​é́İΣσς12½<|endoftext|>,.!?\x1c\x1f　ﬁ漢字🙂\x00"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(1500)] + ["", "a" * 3000 + " b", "it's we'll O'Neil's"]
    assert ours.encode(texts) == [array("I", whole(t)).tobytes() for t in texts]


@pytest.mark.parametrize("path", [BYTE, LOWERED])
def test_added_tokens_equal_the_plain_library(path):
    plain, r = Tokenizer.from_file(path), random.Random(4)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "  ", "\n", "end", "it's", "É", "漢", "1", "."]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(2000)] + ["end<|endoftext|>next", "<|endoftext|>"]
    assert WordEncoder(path).encode(texts) == [array("I", plain.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


def test_blocks_do_not_change_ids():
    from leafgrain.llm.tokens import rank_encoder

    coder, text = rank_encoder(RANKS, vocab.PATTERN), prose(1, 500) + "\n\n  x  y" * 20
    cut = blocks(text, 50)
    assert len(cut) > 10 and "".join(cut) == text
    assert [i for b in cut for i in coder.encode(b)] == coder.encode(text)
    assert blocks("a" * 200, 50) == ["a" * 200]


def test_packing_places_every_id_once(spark):
    docs, rows = awkward_docs(spark)
    whole = library(BYTE)
    for capacity in (64, 2048):
        out = packing.pack(docs, BYTE, capacity=capacity, with_ids=True).toPandas()
        filled = out.groupby("sequence_id").length.sum()
        assert sorted(filled.index) == list(range(len(filled))) and filled.max() <= capacity
        for _, window in out.sort_values("offset").groupby("sequence_id"):
            assert window.offset.tolist() == [0, *np.cumsum(window.length)[:-1]]
        assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(out.ids, out.ids_crc32))
        got = Counter()
        for r in out.itertuples():
            got[(None if np.isnan(r.doc_id) else int(r.doc_id), r.start, tuple(r.ids))] += 1
        expected = Counter()
        for doc_id, text in rows:
            expected[doc_id] += len(whole(text)) + 1
        total = Counter()
        for (doc_id, _, ids), n in got.items():
            total[doc_id] += len(ids) * n
        assert total == expected
        assert (filled < capacity).sum() <= docs.rdd.getNumPartitions()
        piece = out[out.doc_id == 9].sort_values("start")
        assert [i for p in piece.ids for i in p] == whole(dict(rows)[9]) + [1]


def test_level_rule_minimises_squared_counts():
    r, packer = random.Random(5), packing.LevelPacker(20)
    for n in range(600):
        size = r.randrange(1, 20)
        options = {}
        for level in range(20 - size + 1):
            if level and not packer.levels[level]:
                continue
            after = packer.levels.copy()
            after[level] -= bool(level)
            after[level + size] += level + size < 20
            options[level] = int((after ** 2).sum())
        best = min(options.values())
        assert packer.level_for(size) == max(k for k, v in options.items() if v == best)
        packer.place((n, 0, b"0000" * size))


def test_byte_bpe_round_trip(spark):
    docs, rows = awkward_docs(spark)
    out = byte_bpe.round_trip(docs, RANKS, vocab.PATTERN).toPandas()
    from leafgrain.llm.tokens import rank_encoder

    coder = rank_encoder(RANKS, vocab.PATTERN).encoding
    expected = []
    for _, text in rows:
        ids = coder.encode_ordinary(text or "")
        expected.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, out[["n_tokens", "ids_sha256", "decoded_sha256"]].values)) == sorted(expected)
    encoded = byte_bpe.encode_documents(docs, RANKS, vocab.PATTERN)
    decoded = byte_bpe.decode_documents(encoded, RANKS, vocab.PATTERN).toPandas()
    assert sorted(bytes(d) for d in decoded.data) == sorted((t or "").encode() for _, t in rows)


def test_token_files_hold_ids_in_order(spark):
    docs, rows = awkward_docs(spark)
    folder, whole = fresh_folder(spark, "test-tokens"), library(LOWERED)
    manifest = token_files.write_token_files(docs.repartition(3), folder, LOWERED).toPandas()
    out = token_files.read_token_files(spark, folder, with_ids=True).toPandas().sort_values("start")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    for r, (doc_id, text) in zip(out.itertuples(), ordered, strict=True):
        ids = whole(text) + [1]
        assert (None if np.isnan(r.doc_id) else int(r.doc_id)) == doc_id and (r.start, r.n_tokens, list(r.ids)) == (at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert manifest.tokens.sum() == at
    ids, offsets, _ = token_files.open_part(folder, int(manifest.part[0]))
    assert offsets[0] == 0 and offsets[-1] == len(ids) == manifest.tokens[0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert packing.pack(none, BYTE).count() == 0
    assert byte_bpe.round_trip(none, RANKS, vocab.PATTERN).count() == 0
    folder = fresh_folder(spark, "test-tokens")
    assert token_files.write_token_files(none, folder, LOWERED).count() == 0
    assert token_files.read_token_files(spark, folder).count() == 0


def test_open_windows_are_bounded():
    r, packer = random.Random(5), packing.LevelPacker(2048, most=100)
    sizes, done, most = [r.randrange(1100, 2000) for _ in range(3000)], [], 0
    for row, size in enumerate(sizes):
        piece = (row, 0, np.full(size, row, "<u4").tobytes())
        done += [w for w in [packer.place(piece)] if w]
        done += packer.relieve()
        most = max(most, packer.held)
    assert most <= 100 and all(sum(len(p[2]) for p in w) == 4 * 2048 for w in done)
    done += packer.close()
    held = Counter()
    for window in done:
        for row, _, ids in window:
            assert set(np.frombuffer(ids, "<u4")) == {row}
            held[row] += len(ids) // 4
    assert [held[i] for i in range(len(sizes))] == sizes and len(done) == -(-sum(sizes) // 2048)


def test_byte_level_encoder_refuses_other_files():
    from leafgrain.llm.tokens import ByteLevelEncoder

    with pytest.raises(ValueError):
        ByteLevelEncoder(LOWERED)
