"""Alignment of two tokenizers over the same texts: Arrow columns in the tasks, pair counts merged by Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrain.llm.common import materialize, small_batches, texts_of
from leafgrain.llm.tokens import byte_level_encoder

#: Text bytes that are aligned at once; a longer text is a block of its own.
BLOCK_TEXT = 2 << 20
#: Fixed values: ``piece``'s white space sign, and how it spells a single byte.
BLANK, BYTE_PIECE = "▁", "<0x%02X>"


@dataclass(frozen=True)
class Side:
    """One tokenizer: ids of texts, and the bytes and the decimal spelling of every id."""

    encode: Callable[[list[str]], list[list[int]]]
    data: pa.Array

    @property
    def sizes(self) -> np.ndarray:
        return pc.binary_length(self.data).to_numpy(zero_copy_only=False).astype(np.int64)


@lru_cache(maxsize=2)
def byte_level_side(path: str) -> Side:
    """A byte-level ``tokenizers`` file over a space and the text; special tokens' strings are plain text."""
    coder = byte_level_encoder(path)
    return Side(lambda texts: [coder.ids(" " + t) for t in texts], pa.array(coder.token_bytes(), pa.large_binary()))


@lru_cache(maxsize=2)
def piece_side(path: str) -> Side:
    """A sentencepiece model over the text, to which the model adds a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    single = {BYTE_PIECE % b: bytes([b]) for b in range(256)}
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    data = [single[p] if model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
    return Side(lambda texts: model.encode(texts, out_type=int, num_threads=1), pa.array(data, pa.large_binary()))


def as_lists(ids: list[list[int]]) -> pa.LargeListArray:
    return pa.array(ids, pa.large_list(pa.int32()))


def emptied(lists: pa.LargeListArray, keep: np.ndarray) -> pa.LargeListArray:
    """The same lists, without the tokens of those that are not kept."""
    sizes = pc.list_value_length(lists).to_numpy()
    flat = pc.list_flatten(lists).filter(pa.array(np.repeat(keep, sizes)))
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes * keep)])), flat)


def bytes_of(array: pa.Array) -> memoryview:
    """The joined values of a binary or string array that starts at its buffer's first byte."""
    data = array.buffers()[2] if len(array) else None
    return memoryview(data).cast("B") if data else memoryview(b"")


def spell_back(lists: pa.LargeListArray, data: pa.Array, wanted: list[bytes]) -> np.ndarray:
    """Whether the joined token bytes of each text are the wanted ones."""
    joined = data.take(lists.values)
    ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1) if len(joined) else np.zeros(1, np.int64)
    cuts = ends[np.frombuffer(lists.buffers()[1], np.int64, len(lists) + 1)]
    view = bytes_of(joined)
    return np.array([view[a:b] == w for a, b, w in zip(cuts, cuts[1:], wanted)], bool)


@dataclass
class Ends:
    """Tokens of all texts of a block: id, text (parent) and byte offset in the text where each ends."""

    ids: np.ndarray
    parent: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, lists: pa.LargeListArray, sizes: np.ndarray) -> Ends:
        ids = pc.list_flatten(lists).to_numpy()
        parent = pc.list_parent_indices(lists).to_numpy()
        total = pc.cumulative_sum(pa.array(sizes[ids], pa.int64())).to_numpy()
        starts = np.searchsorted(parent, np.arange(len(lists)))
        before = np.concatenate([[0], total])[starts]
        return cls(ids, parent, total - before[parent])

    def table(self, name: str) -> pa.Table:
        """Keys of text and end in one number, and each token's row."""
        return pa.table({"key": (self.parent << 36) | self.end, name: np.arange(len(self.ids))})

    def groups(self, shared: np.ndarray, texts: int) -> np.ndarray:
        """The number of each token's group in its text: shared ends before its own."""
        last = shared.copy()
        if len(last) > 1:  # of tokens without bytes, which end where the one before ends, the last closes the group
            last[:-1] &= (self.end[1:] != self.end[:-1]) | (self.parent[1:] != self.parent[:-1])
        closed = np.cumsum(last) - last
        starts = np.searchsorted(self.parent, np.arange(texts))
        return closed - np.concatenate([closed, [last.sum()]])[starts][self.parent]


@lru_cache(maxsize=2)
def spellings(size: int) -> pa.Array:
    """Every id in decimal with each sign that may follow it."""
    return pa.array([f"{i}{sign}" for i in range(size) for sign in ",|;"], pa.large_string())


def spell_groups(a: Ends, b: Ends, group_a: np.ndarray, group_b: np.ndarray, texts: int) -> list[memoryview]:
    """``a1,a2|b1;a3|b2,b3`` of each text."""
    if not len(a.ids):
        return [memoryview(b"")] * texts
    # Groups numbered over all texts; A's tokens of a group stand before B's.
    groups = np.zeros(texts, np.int64)
    np.maximum.at(groups, a.parent, group_a + 1)
    base = np.cumsum(groups) - groups
    group_a, group_b = group_a + base[a.parent], group_b + base[b.parent]
    many = int(groups.sum())
    of_a, of_b = np.bincount(group_a, minlength=many), np.bincount(group_b, minlength=many)
    to_a = np.arange(len(a.ids)) + (np.cumsum(of_b) - of_b)[group_a]
    to_b = np.arange(len(b.ids)) + np.cumsum(of_a)[group_b]
    ids = np.empty(len(a.ids) + len(b.ids), np.int64)
    ids[to_a], ids[to_b] = a.ids, b.ids
    sign = np.zeros(len(ids), np.int64)
    sign[np.cumsum(of_a + of_b) - 1] = 2
    sign[np.cumsum(of_a + of_b) - of_b - 1] = 1
    size = int(ids.max(initial=0)) + 1
    spelled = spellings(1 << (size - 1).bit_length()).take(pa.array(ids * 3 + sign))
    offsets = np.frombuffer(spelled.buffers()[1], np.int64, len(ids) + 1)
    view = bytes_of(spelled)
    every = np.arange(texts + 1)
    cuts = np.searchsorted(a.parent, every) + np.searchsorted(b.parent, every)
    # Without the last sign.
    return [view[offsets[s]:offsets[e] - 1] if e > s else memoryview(b"") for s, e in zip(cuts, cuts[1:])]


def align_block(texts: list[str], a_side: Side, b_side: Side) -> tuple[dict, pa.Table]:
    """Figures of each text, and the block's distinct pairs (a, b, links); a text's links are rows of that table."""
    lists = [as_lists(side.encode(texts)) for side in (a_side, b_side)]
    wanted = [(" " + t).encode() for t in texts]
    good = np.array([bool(t) for t in texts], bool)
    for tokens, side in zip(lists, (a_side, b_side)):
        good &= spell_back(tokens, side.data, wanted)
    if not good.all():
        lists = [emptied(tokens, good) for tokens in lists]
    n = len(texts)
    a, b = (Ends.of(tokens, side.sizes) for tokens, side in zip(lists, (a_side, b_side)))
    links = a.table("at_a").join(b.table("at_b"), "key", join_type="inner", use_threads=False)
    at_a, at_b = links.column("at_a").to_numpy(), links.column("at_b").to_numpy()
    shared_a, shared_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
    shared_a[at_a] = shared_b[at_b] = True
    group_a, group_b = a.groups(shared_a, n), b.groups(shared_b, n)
    spelled = spell_groups(a, b, group_a, group_b, n)
    n_groups = np.zeros(n, np.int64)
    np.maximum.at(n_groups, a.parent, group_a + 1)
    width = np.int64(len(b_side.data))
    pair = a.ids[at_a].astype(np.int64) * width + b.ids[at_b]
    counts = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
    distinct = np.sort(counts.column("pair").to_numpy())
    counts = counts.sort_by("pair")
    home = a.parent[at_a]
    order = np.argsort(home, kind="stable")
    row = np.searchsorted(distinct, pair)[order].astype(np.int32)
    cuts = np.searchsorted(home[order], np.arange(n + 1))
    figures = {
        "n_a": np.bincount(a.parent, minlength=n), "n_b": np.bincount(b.parent, minlength=n), "n_groups": n_groups, "n_links": np.diff(cuts),
        "groups": spelled, "links": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(row))}
    return figures, pa.table({"a": distinct // width, "b": distinct % width, "n": counts.column("count_all")})


def align(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) of whole texts.

    A's tokens spell a space and the text, B's the text with the space that B adds. Offsets where tokens of both end
    cut them into groups; each A and B token that end together are a link. How often an id pair is linked in all texts
    is its count: ``n_best`` are the links whose count is the highest of their B id, ``count_sum`` adds the counts.
    ``groups`` spells the groups in decimal ids.

    Each task flattens its token lists, sums sizes up inside each text, joins the ends on text and offset, and counts
    pairs by block. Blocks' distinct pairs (not links) are summed by Spark, looked up again by pair, and go back to
    their block, where the links of each text add them up; so no task ever holds the pairs of all texts.

    Texts that are null, empty, or that one tokenizer spells otherwise have no tokens: zeros and an empty hash.
    Repeated rows and null ids stay rows of their own. An empty table gives no rows; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "links", "pairs"]
    pairs_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = byte_level_side(a_path), piece_side(b_path)
        block = TaskContext.get().partitionId() << 32
        for batch in small_batches(batches, "text", BLOCK_TEXT):
            figures, pairs = align_block(texts_of(batch.column(1)), a_side, b_side)
            n = batch.num_rows
            fixed = {"a": pa.array(pairs.column("a").to_numpy(), pa.int32()), "b": pa.array(pairs.column("b").to_numpy(), pa.int32()),
                     "n": pairs.column("n").combine_chunks()}
            held = pa.StructArray.from_arrays(list(fixed.values()), list(fixed))
            # The pairs stand in the block's first row.
            offsets = pa.array([0] + [len(held)] * n, pa.int32())
            spelled = figures["groups"]
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * n, pa.int64()), batch.column(0), *(pa.array(figures[c], pa.int64()) for c in names[2:6]),
                pa.array([hashlib.sha256(g).hexdigest() if len(g) else "" for g in spelled], pa.string()),
                pa.array([str(g, "ascii") for g in spelled] if with_groups else [None] * n, pa.string()),
                figures["links"], pa.ListArray.from_arrays(offsets, held).cast(pairs_type)], names)
            block += 1

    schema = (f"block bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, "
              "links array<int>, pairs array<struct<a:int,b:int,n:bigint>>")
    blocks = materialize(docs.mapInArrow(run, schema), "aligned")
    pairs = blocks.where(F.size("pairs") > 0).select("block", F.posexplode("pairs").alias("at", "pair")).select("block", "at", "pair.*")
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("n").alias("total")), "pair_counts")
    best = counts.groupBy("b").agg(F.max("total").alias("top")).withColumnRenamed("b", "_b")
    known = counts.join(best, F.col("b") == F.col("_b")).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "total", (F.col("total") == F.col("top")).alias("best"))
    looked_up = pairs.join(known, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select(F.col("block").alias("home"), "at", "total", "best")
    carried = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        # A block's rows and its distinct pairs: bounded by BLOCK_TEXT or by one text.
        at = right.column("at").to_numpy()
        total, top = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        total[at], top[at] = right.column("total").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        links = left.column("links").combine_chunks()
        flat = links.flatten().to_numpy()
        cuts = np.concatenate([[0], np.cumsum(left.column("n_links").to_numpy())])
        out = left.select(carried[1:])
        for name, values in (("n_best", top), ("count_sum", total)):
            sums = np.concatenate([[0], np.cumsum(values[flat])])
            out = out.append_column(name, pa.array(sums[cuts[1:]] - sums[cuts[:-1]], pa.int64()))
        return out

    rows = blocks.select(*carried, "links").groupBy("block").cogroup(looked_up.groupBy("home"))
    out = rows.applyInArrow(add_up, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, n_best bigint, count_sum bigint")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return out.select(*names, *(["groups"] if with_groups else []))
