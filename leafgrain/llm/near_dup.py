"""Near-duplicate documents by HyperMinHash: banded compressed registers, corrected estimates, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrain.llm.common import materialize, small_batches
from leafgrain.llm.graph import components
from leafgrain.llm.wordstats import Words, mix

#: Bits of a register after the leading-zero count.
MANTISSA = 10
#: Members of a bucket compared with each other at once.
BLOCK = 1024
#: How many standard errors below the threshold an estimate may lie without ruling a pair out.
ERRORS = 5.0


@dataclass(frozen=True)
class Shape:
    """``bands`` x ``rows`` registers. A pair of similarity s shares no band with chance (1 - s^rows)^bands: 3e-6 at 0.8."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5

    @property
    def registers(self) -> int:
        return self.bands * self.rows


class Sketcher:
    """HyperMinHash registers of sets of 64-bit hashes.

    The range of a hash is cut into as many buckets as registers. A register holds the leading zeros and the next
    ``MANTISSA`` bits of the least value in its bucket, 16 bits in all. An empty bucket borrows the register of the
    first filled one in an order of its own, so small sets band as large ones do.
    """

    def __init__(self, registers: int):
        self.m = registers
        self.low = np.array([(j << 64) // registers for j in range(registers)], np.uint64)
        self.high = np.append(self.low[1:] - np.uint64(1), np.uint64(2 ** 64 - 1))
        rng = np.random.default_rng(20)
        self.order = np.stack([rng.permutation(registers) for _ in range(registers)])

    def registers(self, ordered: np.ndarray) -> np.ndarray:
        """``ordered``: distinct hashes, ascending, at least one."""
        at = np.searchsorted(ordered, self.low)
        least = ordered[np.minimum(at, len(ordered) - 1)]
        filled = (at < len(ordered)) & (least <= self.high)
        value = (least - self.low) * np.uint64(self.m)
        zeros = np.minimum(64 - np.frexp(value.astype(np.float64))[1], 62).astype(np.uint64)
        mantissa = (value << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
        out = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
        empty = np.flatnonzero(~filled)
        if len(empty):
            order = self.order[empty]
            out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(1)]]
        return out


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending; a text of fewer words has one shingle, an empty one none."""
    text = Words(column, lower=True)
    hashes = text.hashes()
    at, gram = text.grams(hashes, words)
    first = np.searchsorted(at, text.first[:-1])
    last = np.searchsorted(at, text.first[1:])
    out = []
    for row, (a, b) in enumerate(zip(first, last)):
        n = text.counts[row]
        if 0 < n < words:
            own = np.array([n], np.uint64)
            for h in hashes[text.first[row]:text.first[row + 1]]:
                own = mix(own ^ h) * np.uint64(3)
            out.append(own)
        else:
            out.append(np.unique(gram[a:b]))
    return out


def collisions(a: np.ndarray, b: np.ndarray, registers: int) -> np.ndarray:
    """Chance that two registers of disjoint sets of these sizes are equal."""
    cut = 2.0 ** -np.arange(0, 40)
    share = lambda n: np.diff((1 - np.append(cut, 0)[None, :]) ** np.maximum(n / registers, 1)[:, None], axis=1)
    return (share(a) * share(b)).sum(1) * 2.0 ** -MANTISSA


def may_be_similar(equal: np.ndarray, a: np.ndarray, b: np.ndarray, shape: Shape) -> np.ndarray:
    """Whether the corrected estimate and the set sizes leave the threshold within reach."""
    threshold = shape.percent / 100
    small, large = np.minimum(a, b), np.maximum(a, b)
    least = threshold - ERRORS * np.sqrt(threshold * (1 - threshold) / np.minimum(small, shape.registers))
    # The correction only lowers an estimate, so it is worked out for what is still in reach without it.
    ok = (equal / shape.registers >= least) & (100 * small >= shape.percent * large)
    at = np.flatnonzero(ok)
    if len(at):
        chance = collisions(a[at], b[at], shape.registers)
        ok[at] = (equal[at] / shape.registers - chance) / (1 - chance) >= least[at]
    return ok


def sketch(docs: DataFrame, shape: Shape) -> DataFrame:
    """(doc_id, n_shingles, digest, registers): digest is 128 bits of the whole set, null for an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(shape.registers)
        for batch in small_batches(batches, "text"):
            sets = shingle_sets(batch.column(1), shape.words)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([sketcher.registers(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "digest", "registers"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, digest binary, registers binary")


def in_reach(pairs: DataFrame, classes: DataFrame, shape: Shape) -> DataFrame:
    """The pairs (a, b) that their registers and sizes do not rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, shape.registers) for c in ("ra", "rb"))
            ok = may_be_similar((ra == rb).sum(1), *(batch.column(c).to_numpy().astype(float) for c in ("na", "nb")), shape)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    for x in "ab":
        side = classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
        pairs = pairs.join(side, x)
    return pairs.mapInArrow(run, "a bigint, b bigint")


def full_sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, shape: Shape) -> DataFrame:
    """(cls, shingles) of the wanted classes (cls), from one text of each, written down. No other text is read again."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            own = shingle_sets(batch.column(0), shape.words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in own], pa.binary()), pa.array([s.tobytes() for s in own], pa.binary())], ["digest", "shingles"])

    wanted = wanted.distinct().join(classes.select("cls", "digest", "rep"), "cls")
    texts = docs.select("doc_id", "text").join(wanted.select("rep").distinct(), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    known = texts.select("text").where("text is not null").mapInArrow(sets, "digest binary, shingles binary").join(wanted.select("cls", "digest"), "digest")
    return materialize(known.select("cls", "shingles"), "shingles")


def verify(pairs: DataFrame, known: DataFrame, shape: Shape) -> DataFrame:
    """The pairs whose full shingle sets have the similarity."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                ok.append(similar(x, [y], shape)[0])
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    for x in "ab":
        pairs = pairs.join(known.select(F.col("cls").alias(x), F.col("shingles").alias(f"s{x}")), x)
    return pairs.mapInArrow(compare, "a bigint, b bigint").distinct()


def similar(x: np.ndarray, others: list[np.ndarray], shape: Shape) -> np.ndarray:
    """Whether each of the other sets has the similarity to x; all are ascending and not empty."""
    values = np.concatenate(others)
    sizes = np.array([len(o) for o in others])
    hit = x[np.minimum(np.searchsorted(x, values), len(x) - 1)] == values
    common = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return 100 * common >= shape.percent * (len(x) + sizes - common)


def link_groups(left: pa.Table, right: pa.Table, shape: Shape) -> pa.Table:
    """Links (a, b) that join the components of one group, as few as it takes.

    Every class on the left is held against every class of another component on the right: sizes and registers first,
    then full sets. What a link has joined is one component from then on.
    """
    if not left.num_rows or not right.num_rows:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    x, y = ([t.column(f"{c}{s}").to_numpy() for c in ("cls", "root", "n")] for s, t in enumerate((left, right)))
    rx, ry = (np.frombuffer(b"".join(t.column(f"registers{s}").to_pylist()), np.uint16).reshape(-1, shape.registers) for s, t in enumerate((left, right)))
    sx, sy = ([np.frombuffer(v.as_buffer(), np.uint64) for v in t.column(f"shingles{s}")] for s, t in enumerate((left, right)))
    up: dict[int, int] = {}

    def find(v: int) -> int:
        while up.get(v, v) != v:
            v = up[v]
        return v

    labels, links = y[1].copy(), []
    for cls, root, n, registers, own in zip(*x, rx, sx):
        mine = find(int(root))
        at = np.flatnonzero(labels != mine)
        at = at[may_be_similar((ry[at] == registers).sum(1), np.full(len(at), float(n)), y[2][at].astype(float), shape)]
        for k in range(0, len(at), 512):
            some = at[k:k + 512]
            for j in some[similar(own, [sy[i] for i in some], shape)]:
                theirs = find(int(labels[j]))
                if theirs != mine:
                    links.append((cls, y[0][j]))
                    up[theirs] = mine
                    labels[labels == theirs] = mine
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def compare_groups(left: DataFrame, right: DataFrame, facts: DataFrame, shape: Shape) -> DataFrame:
    """Links between what is left and right of each ``place``, in blocks of ``BLOCK`` classes a side.

    ``left`` and ``right`` are (place, cls, root); a place with many classes is many tasks.
    """
    count = lambda t, n: t.groupBy("place").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n))
    grid = count(left, "across").join(count(right, "down"), "place")
    block = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(grid, "place").withColumn("i", block("across")).withColumn("j", every("down"))
    right = right.join(grid, "place").withColumn("j", block("down")).withColumn("i", every("across"))
    names = ("place", "i", "j", "cls", "root", "n", "registers", "shingles")  # a cogroup needs columns of its own on either side
    sides = [t.join(facts, "cls").select(*(F.col(c).alias(f"{c}{s}") for c in names)).groupBy(*(f"{c}{s}" for c in names[:3])) for s, t in enumerate((left, right))]
    return sides[0].cogroup(sides[1]).applyInArrow(lambda x, y: link_groups(x, y, shape), "a bigint, b bigint")


def across(shared: DataFrame, roots: DataFrame, docs: DataFrame, classes: DataFrame, shape: Shape) -> DataFrame:
    """Links between classes that share a band but, after the stars, no component.

    In each bucket the members outside its largest component are held against all of that component (once, however
    many buckets say so) and, inside the bucket, against each other. Comparisons stay in the task; only links that
    join components leave it.
    """
    roots = roots.withColumnRenamed("v", "cls")
    members = shared.where("members > 2").select("key", "cls").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    members = members.join(sizes, "root", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    main = members.groupBy("key").agg(F.max(F.struct("size", "root")).alias("main"), F.min("root").alias("_low"), F.max("root").alias("_high"))
    main = main.where("_low <> _high").select("key", F.col("main.root").alias("main"))
    outside = materialize(members.join(main, "key").where("root <> main").select("key", "cls", "root", "main"), "outside")
    asked = outside.select(F.col("main").alias("place"), "cls", "root").distinct()
    alone = asked.select("place").distinct()
    inside = alone.join(roots.select("cls", F.col("root").alias("place")), "place")
    # A main component of one class is not among the roots.
    inside = inside.union(alone.join(inside.select("place").distinct(), "place", "left_anti").select("place", F.col("place").alias("cls")))
    inside = materialize(inside.select("place", "cls", F.col("place").alias("root")), "inside")
    several = outside.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("key")
    each = outside.join(several, "key").select(F.col("key").alias("place"), "cls", "root")
    known = full_sets(outside.select("cls").union(inside.select("cls")), docs, classes, shape)
    facts = classes.select("cls", "n", "registers").join(known, "cls")
    return compare_groups(asked, inside, facts, shape).union(compare_groups(each, each, facts, shape))


def near_duplicates(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Words are runs of non-space bytes, A-Z in lower case; shingles are ``words`` of them. Documents of equal sets are
    one class from the start. Classes that share a band are first compared with two of their bucket: the one that
    shares most bands with any others, and the least. Then, in buckets that still hold several components, the members
    are held against the other components. Pairs in reach of the threshold by the corrected register estimate are
    verified on full sets. So a component is found whole without listing the pairs inside it.

    A null text, or one without words, has no shingles and is linked with nothing. ``component_id`` is the least
    doc_id of a component; ``kept`` marks it (repeated rows of that doc_id alike). A null doc_id is never the least
    unless the component has no other. An empty table gives no rows; other columns are not read.
    """
    sketches = materialize(sketch(docs, shape), "sketches")
    classes = sketches.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    width = 2 * shape.rows
    bands = classes.select("cls", F.explode(F.expr(
        f"transform(sequence(0, {shape.bands - 1}), i -> xxhash64(i, substring(registers, i * {width} + 1, {width})))")).alias("key"))
    hits = bands.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("members")).where("low < high")
    hits = materialize(hits, "buckets")
    shared = materialize(bands.join(hits.select("key", "low", "members"), "key"), "shared")
    # The class whose buckets are fullest is the one that most others were copied from.
    fullness = shared.groupBy("cls").agg((F.sum("members") + F.pmod("cls", F.lit(9973)) / 10_000).alias("fullness"))
    centres = shared.join(fullness, "cls").groupBy("key").agg(F.max_by("cls", "fullness").alias("centre"))
    stars = shared.join(centres, "key").select("cls", F.explode(F.array("low", "centre")).alias("other")).where("cls <> other")
    stars = stars.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()
    tried = materialize(in_reach(stars, classes, shape), "stars")
    known = full_sets(tried.select(F.col("a").alias("cls")).union(tried.select("b")), docs, classes, shape)
    links = materialize(verify(tried, known, shape), "links")
    roots = components(links)
    more = materialize(across(shared, roots, docs, classes, shape), "across")
    if not more.isEmpty():
        roots = components(links.union(more))
    rooted = classes.select("digest", "cls").join(roots.withColumnRenamed("v", "cls"), "cls", "left").select("digest", F.coalesce("root", "cls").alias("root"))
    placed = sketches.select("doc_id", "n_shingles", "digest").join(rooted, "digest", "left")
    least = classes.select("cls", "rep").join(roots.withColumnRenamed("v", "cls"), "cls", "left").groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("rep").alias("_least"))
    out = placed.join(least, "root", "left").withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("_least")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
