"""Token ids from local vocabulary files, with bounded caches, for whole texts of any length."""

from __future__ import annotations

import base64
import json
import re
from array import array
from functools import lru_cache

import regex

#: Fixed value: the characters of Unicode White_Space, which the vocabularies' own patterns call \s.
SPACES = "\t-\r \x85\xa0  -     　"
CACHE_WORDS = 300_000
LONG_WORD = 256
#: Texts above this many characters are encoded in blocks.
BLOCK_CHARS = 1 << 20
#: Fixed value: the pattern of byte-level files.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAFE_CUT = re.compile(f"(?<=[^{SPACES}]) (?=[^{SPACES}])")


def blocks(text: str, size: int = BLOCK_CHARS) -> list[str]:
    """Cuts a long text before single spaces between two other characters.

    No match of the vocabularies' patterns reaches across such a place, so the blocks' ids, joined, are the text's.
    A text without such a place stays whole.
    """
    out, start = [], 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if not cut:
            break
        out.append(text[start:cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def byte_letters() -> dict[int, int]:
    """Byte-level files write byte b as a printable letter: itself where that prints, else the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return dict(zip(hidden, range(256, 256 + len(hidden))))


class ByteLevelEncoder:
    """ids of a byte-level ``tokenizers`` file through the merge loop of the tiktoken library.

    That loop joins the adjacent pair of least rank, which is the file's own order if each merge makes the next id
    after the 256 bytes; a file of another kind raises. No string stands for a special token here.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first = min(map(model["vocab"].__getitem__, (a + b for a, b in merges)), default=0)
        if (split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or spec.get("normalizer")
                or model["type"] != "BPE" or any(model["vocab"][a + b] != first + i for i, (a, b) in enumerate(merges))):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        letters = {chr(c): b for b, c in byte_letters().items()}
        special = {t["content"] for t in spec.get("added_tokens") or []}
        self.ranks = {bytes(letters.get(c, ord(c) & 255) for c in t): i for t, i in model["vocab"].items() if t not in special}
        self.size = 1 + max(model["vocab"].values())
        self.core = tiktoken.Encoding("local", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id; none for special ones."""
        out = [b""] * self.size
        for data, i in self.ranks.items():
            out[i] = data
        return out

    def ids(self, text: str) -> list[int]:
        if len(text) <= BLOCK_CHARS:
            return self.core.encode_ordinary(text)
        return [i for block in blocks(text) for i in self.core.encode_ordinary(block)]


class WordEncoder:
    """ids of a ``tokenizers`` file as little-endian unsigned 32-bit bytes.

    Byte-level files go through ``ByteLevelEncoder``. Files whose splitter drops white space never merge across a
    chunk between white space, nor across a match of their pattern inside it: each distinct chunk goes once through the
    file's normalizer, pattern and BPE model; its ids then come from a cache of bounded size, of which the half that
    was not used lately is dropped. The file's added tokens, such as ``<|endoftext|>``, stand for one id wherever a
    text spells them; only what lies between is encoded. Other files, and files whose added tokens take in space or
    stand for normalized text, are encoded text by text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        # Kept with a space at the end, as no chunk and no piece of one is spelled.
        self.added = {t["content"] + " ": array("I", [t["id"]]).tobytes() for t in added}
        # The longest of those that start at a place, as the library has it.
        self.marks = re.compile("(" + "|".join(re.escape(t[:-1]) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        plain = not any(t["normalized"] and spec.get("normalizer") or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        steps = spec.get("normalizer") or {}
        steps = [x["type"] for x in steps.get("normalizers", [steps]) if x and x.get("pattern") != {"Regex": r"\s+"}]
        # What these steps do to an ASCII chunk without white space: lower its case or nothing.
        self.lowers = "Lowercase" in steps if set(steps) <= {"NFC", "Lowercase"} else None
        split = spec.get("pre_tokenizer") or {}
        first = split.get("pretokenizers", [split])[0]
        self.chunks = self.whole = None
        if not plain:
            pass
        elif first.get("type") == "ByteLevel":
            try:
                self.whole = byte_level_encoder(path)
            except ValueError:  # merges in an order of their own: the library itself
                pass
        elif first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"):
            self.chunks = re.compile(f"[^{SPACES}]+")
            self.pieces = regex.compile(first["pattern"]["Regex"].replace(r"\s", SPACES))

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            spelled = piece.replace(" ", "\u0120")  # a space's letter
        else:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _ids(self, chunk: str, known: dict[str, bytes]) -> bytes:
        if chunk in self.added:
            return self.added[chunk]
        if not self.normalizer:
            text = chunk
        elif self.lowers is not None and chunk.isascii():
            text = chunk.lower() if self.lowers else chunk
        else:
            text = self.normalizer.normalize_str(chunk)
        if text.isalpha():
            return self._kept(text, known)
        pieces = [text[:-1], text[-1]] if text[-1:] in (",", ".") and text[:-1].isalpha() else self.pieces.findall(text)
        return b"".join([self._kept(p, known) for p in pieces])

    def _kept(self, piece: str, known: dict[str, bytes]) -> bytes:
        """A piece is a chunk, too: its ids are kept for the chunks that hold it with other signs or letter case."""
        ids = known.get(piece)
        if ids is None:
            ids = self._piece(piece)
            if len(piece) <= LONG_WORD:
                known[piece] = ids
        return ids

    def _chunks(self, text: str) -> list[str]:
        if not self.marks or not self.marks.search(text):
            return self.chunks.findall(text)
        parts = self.marks.split(text)
        # Every other part is an added token.
        return [c for i, p in enumerate(parts) for c in ([p + " "] if i % 2 else self.chunks.findall(p))]

    def _whole(self, text: str) -> bytes:
        """A text through the byte-level encoder, its added tokens apart."""
        if not self.marks or not self.marks.search(text):
            return array("I", self.whole.ids(text)).tobytes()
        parts = self.marks.split(text)
        return b"".join(self.added[p + " "] if i % 2 else array("I", self.whole.ids(p)).tobytes() for i, p in enumerate(parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return list(map(self._whole, texts))
        if not self.chunks:
            return [array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
        parts = [self._chunks(t) for t in texts]
        new: set[str] = set()
        for words in parts:
            new.update(words)
        new.difference_update(self.young)
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
            for words in parts:
                new.update(words)
        young, old = self.young, self.old
        long: dict[str, bytes] = {}
        for word in new:
            ids = old.get(word)
            (young if len(word) <= LONG_WORD else long)[word] = self._ids(word, young) if ids is None else ids
        known = young if not long else {w: young.get(w) or long.get(w, b"") for words in parts for w in words}
        return [b"".join(map(known.__getitem__, words)) for words in parts]


class RankEncoder:
    """Byte-level BPE of a rank file through tiktoken; decoding gives raw bytes, whatever the ids are."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) <= BLOCK_CHARS:
            return self.encoding.encode_ordinary(text)
        return [i for block in blocks(text) for i in self.encoding.encode_ordinary(block)]

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


@lru_cache(maxsize=4)
def byte_level_encoder(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str) -> RankEncoder:
    return RankEncoder(path, pattern)
