"""Cross-tokenizer alignment against a plain walk over both token lists."""

import hashlib
from collections import Counter

import public_tokenizers as vocab
import sentencepiece
from frames import awkward_docs, prose
from tokenizers import Tokenizer

from leafgrain.llm import alignment
from leafgrain.llm.tokens import byte_letters

A, B = vocab.path("byte_bpe_50k.json"), vocab.path("piece_bpe_32k.model")


def plain(rows):
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {chr(c): b for b, c in byte_letters().items()}
    found, pairs = [], Counter()
    for doc_id, text in rows:
        ids_a, ids_b, links, groups = [], [], [], []
        if text:
            coded = whole.encode(" " + text, add_special_tokens=False)
            bytes_a = [bytes(letters.get(c, ord(c) & 255) for c in t) for t in coded.tokens]
            pieces = model.encode(text)
            bytes_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ids_a, ids_b = coded.ids, pieces
                i = j = end_a = end_b = 0
                left, right = [], []
                while i < len(ids_a) or j < len(ids_b):
                    if end_a <= end_b and i < len(ids_a):
                        end_a, i = end_a + len(bytes_a[i]), i + 1
                        left.append(str(ids_a[i - 1]))
                    else:
                        end_b, j = end_b + len(bytes_b[j]), j + 1
                        right.append(str(ids_b[j - 1]))
                    if end_a == end_b and left and right:
                        links.append((ids_a[i - 1], ids_b[j - 1]))
                        groups.append(",".join(left) + "|" + ",".join(right))
                        left, right = [], []
        pairs.update(links)
        found.append((doc_id, len(ids_a), len(ids_b), links, ";".join(groups)))
    top = {}
    for (_, b), n in pairs.items():
        top[b] = max(top.get(b, 0), n)
    return sorted([
        (i, a, b, len(l), len(l), sum(pairs[p] == top[p[1]] for p in l), sum(pairs[p] for p in l), hashlib.sha256(g.encode()).hexdigest() if g else "", g)
        for i, a, b, l, g in found], key=str)


def ours(df):
    out = alignment.align(df, A, B, with_groups=True)
    return sorted([(*r[:8], r.groups or "") for r in out.collect()], key=str)


def test_equals_a_plain_walk(spark):
    rows = [
        (1, None), (2, ""), (3, " "), (4, "<|endoftext|> <s>a</s> ▁x"), (None, "漢字🙂 it's"), (4, "<|endoftext|>"), (5, "a  b\t\n\x00 c"), (6, "x" * 5000),
        (7, "▁"), (8, "w é " * 30_000), (9, "Ünïcödé   spaces 　 12345 don't!"), *[(20 + i, prose(i % 7, 60) + " naïve café.") for i in range(60)], *[(99, "copy of a copy")] * 20]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = plain(rows)
    assert ours(docs) == want
    assert {r[0]: r[1] for r in want}[7] == 0  # spelled as a space by the second tokenizer: not the text's bytes
    assert sum(r[5] for r in want) < sum(r[4] for r in want)


def test_blocks_do_not_change_counts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_TEXT", 200)
    rows = [(i, prose(i % 9, 30)) for i in range(100)]
    assert ours(spark.createDataFrame(rows, "doc_id bigint, text string")) == plain(rows)


def test_awkward_rows(spark):
    docs, rows = awkward_docs(spark)
    assert ours(docs) == plain(rows)
    assert ours(docs.where("1 = 0")) == []
