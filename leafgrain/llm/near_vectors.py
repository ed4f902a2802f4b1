"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leafgrain.llm.common import materialize
from leafgrain.llm.graph import components

#: Vectors that the lists and codewords are fitted on, at most: those with the smallest hash of their id.
FIT_VECTORS = 16_384
LISTS, SUBSPACES, CODEWORDS, ROUNDS = 64, 8, 256, 8
#: Members of a list compared with each other at once.
BLOCK = 512
#: Bytes of components, in double precision, that a block of lists holds, about: what a task gets of either side.
ROOM = 8 << 20
#: What rounding may add to a distance.
SLACK = 1e-6


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances to all centres, the nearest)."""
    d = np.maximum((x ** 2).sum(1)[:, None] + (centres ** 2).sum(1) - 2 * x @ centres.T, 0)
    return d, d.argmin(1)


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(9)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        at = nearest(x, centres)[1]
        count = np.bincount(at, minlength=len(centres))
        for j in range(x.shape[1]):
            total = np.bincount(at, x[:, j], len(centres))
            centres[:, j] = np.where(count, total / np.maximum(count, 1), centres[:, j])
    return centres


@dataclass
class Quantizer:
    """Coarse centres and, for each subspace, codewords of what is left after the nearest centre."""

    centres: np.ndarray
    cuts: list[int]
    words: list[np.ndarray]

    @classmethod
    def plain(cls, width: int) -> Quantizer:
        """For lengths that no sampled vector has: one list and codes that rule nothing out, so all is reranked exactly."""
        cuts = np.linspace(0, width, min(SUBSPACES, width) + 1).astype(int).tolist()
        return cls(np.zeros((1, width)), cuts, [np.zeros((1, b - a)) for a, b in zip(cuts, cuts[1:])])

    @classmethod
    def fit(cls, units: np.ndarray, lists: int = LISTS, subspaces: int = SUBSPACES) -> Quantizer:
        centres = k_means(units, max(1, min(lists, len(units) // 8)))
        rest = units - centres[nearest(units, centres)[1]]
        cuts = np.linspace(0, units.shape[1], min(subspaces, units.shape[1]) + 1).astype(int).tolist()
        return cls(centres, cuts, [k_means(rest[:, a:b], CODEWORDS) for a, b in zip(cuts, cuts[1:])])

    def encode(self, units: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
        """(list, codes, distance from the coded place, lists to probe) of each vector.

        A neighbour within ``reach`` lies in list j only if the plane halfway between j's centre and the nearest one is
        within ``reach``, too; all such lists are probed, so none is missed.
        """
        d, home = nearest(units, self.centres)
        rest = units - self.centres[home]
        codes = np.stack([nearest(rest[:, a:b], w)[1] for a, b, w in zip(self.cuts, self.cuts[1:], self.words)], 1).astype(np.uint8)
        coded = np.concatenate([w[codes[:, s]] for s, w in enumerate(self.words)], 1)
        error = np.sqrt(((rest - coded) ** 2).sum(1))
        return home, codes, error, [np.flatnonzero(p).tolist() for p in self.reached(units, home, np.arange(len(self.centres)), reach)]

    def reached(self, units: np.ndarray, home: np.ndarray, lists: np.ndarray, reach: float) -> np.ndarray:
        """Which of ``lists`` each vector must probe."""
        d, own = nearest(units, self.centres[lists])[0], ((units - self.centres[home]) ** 2).sum(1)
        apart = np.sqrt(nearest(self.centres, self.centres[lists])[0])
        return d - own[:, None] <= 2 * reach * apart[home] + SLACK

    def table_distances(self, units: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Distance of each vector from each coded place of one list, by sums of looked-up subspace distances."""
        rest = units - self.centres[centre]
        total = np.zeros((len(units), len(codes)))
        for s, (a, b, w) in enumerate(zip(self.cuts, self.cuts[1:], self.words)):
            total += nearest(rest[:, a:b], w)[0][:, codes[:, s]]
        return np.sqrt(total)


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, starts, ends, components in double precision) of the vectors that are not null or zero and hold no null or
    non-finite value."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(float)  # null becomes not a number
    ends = np.cumsum(sizes)
    starts = ends - sizes
    upto = lambda marks: np.concatenate([[0], np.cumsum(marks)])
    bad, other = upto(~np.isfinite(flat)), upto(flat != 0)
    rows = np.flatnonzero((sizes > 0) & (bad[ends] == bad[starts]) & (other[ends] > other[starts]))
    return rows, starts[rows], ends[rows], flat


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.maximum(np.abs(vectors).max(1, keepdims=True), 1e-300)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def fit_quantizer(vectors: DataFrame, rows: int = FIT_VECTORS) -> dict[int, Quantizer]:
    """A quantizer for each length among the sampled vectors: at most ``rows`` of them, one for each vec_id.

    The number of lists grows with the table, to lists of a block each and then with the root of the rows, as far as the
    sample carries it.
    """
    known = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull())
    chosen = known.select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows)
    sample = vectors.join(F.broadcast(chosen), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).toArrow().sort_by("vec_id")
    rows = vectors.count()
    lists = max(LISTS, min(rows // BLOCK, int(rows ** 0.5)))
    by_length: dict[int, list[np.ndarray]] = {}
    for chunk in sample.column("embedding").chunks:
        _, starts, ends, flat = usable(chunk)
        for a, b in zip(starts.tolist(), ends.tolist()):
            by_length.setdefault(b - a, []).append(flat[a:b])
    return {width: Quantizer.fit(unit(np.array(found)), lists) for width, found in sorted(by_length.items())}


def compare_lists(quantizer: Quantizer, cosine: float, centre: int, ask: dict, base: dict, both: bool) -> list[tuple[np.ndarray, ...]]:
    """(v, hits, root) of the links between asked classes and one list: how many rows each is linked to here, and stars that
    join what is linked. ``both``: the list's classes are not asked themselves, so theirs are counted, too."""
    reach = np.sqrt(2 - 2 * cosine)
    linked = quantizer.table_distances(ask["unit"], centre, base["codes"]) - base["error"] <= reach + SLACK
    linked &= ask["cls"][:, None] != base["cls"]
    a, b = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(a):
        return []
    linked[np.ix_(a, b)] &= ask["unit"][a] @ base["unit"][b].T >= cosine
    a, b = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    linked = linked[np.ix_(a, b)]
    # Labels of what is connected inside this block, spread until they rest.
    left, right = ask["cls"][a], base["cls"][b]
    top = np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(linked, right, top).min(1, initial=top))
        new_right = np.minimum(right, np.where(linked, new_left[:, None], top).min(0, initial=top))
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    back = ask["weight"][a] @ linked if both else np.zeros(len(b), np.int64)
    return [(ask["cls"][a], linked @ base["weight"][b], left), (base["cls"][b], back, right)]


def compare_blocks(quantizer: Quantizer, cosine: float, ask: dict, base: dict, both: bool) -> pa.Table:
    """(v, hits, root) of two blocks: each asked class against those lists of the other block that it probes."""
    reach = float(np.sqrt(2 - 2 * cosine))
    some = lambda side, at: {k: v[at] for k, v in side.items()}
    base = some(base, np.argsort(base["home"], kind="stable"))
    lists, starts = np.unique(base["home"], return_index=True)
    ends, found = np.append(starts[1:], len(base["home"])), []
    for at in range(0, len(ask["cls"]), 4 * BLOCK):
        part = some(ask, slice(at, at + 4 * BLOCK))
        probe = quantizer.reached(part["unit"], part["home"], lists, reach)
        for k in np.flatnonzero(probe.any(0)).tolist():
            asked = some(part, np.flatnonzero(probe[:, k]))
            for b in range(starts[k], ends[k], BLOCK):
                found += compare_lists(quantizer, cosine, int(lists[k]), asked, some(base, slice(b, min(b + BLOCK, ends[k]))), both)
    return pa.table({c: np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i, c in enumerate(("v", "hits", "root"))})


def block_pairs(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, base): the classes by pairs (i, j) of blocks of their label and width, i <= j; those of i ask those of j.

    Only labels with more than one block need a place for each list; what tells it is a row for each of them.
    """
    own = ["label", "width"]
    room = F.greatest(F.lit(BLOCK), F.floor(F.lit(ROOM) / (8 * F.col("width"))))
    before = W.partitionBy(*own).orderBy("home").rowsBetween(W.unboundedPreceding, -1)
    lists = classes.groupBy(*own, "home").agg(F.count("*").alias("n"))
    lists = lists.withColumn("first", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / room).cast("int"))
    lists = lists.withColumn("last", (F.col("first") + F.ceil(F.col("n") / room) - 1).cast("int"))
    spans = lists.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("home", F.struct("first", "last")))).alias("at"), F.max("home").alias("most"), F.max("last").alias("top"))
    spans = spans.where("top > 0").select(*own, F.transform(F.sequence(F.lit(0), "most"), lambda x: F.try_element_at("at", x)).alias("spans"))
    spans = materialize(spans, "spans")
    home = F.get("spans", F.col("home"))
    block = F.coalesce(home["first"] + F.pmod(F.xxhash64("cls"), home["last"] - home["first"] + 1).cast("int"), F.lit(0))
    placed = classes.join(spans, own, "left").withColumn("block", block)
    held = F.filter(F.transform("probes", lambda p: F.get("spans", p)), lambda x: x.isNotNull())
    targets = F.array_distinct(F.flatten(F.transform(held, lambda x: F.sequence(x["first"], x["last"]))))
    asked = placed.select(*own, F.col("block").alias("i"), F.explode(F.when(F.col("spans").isNull(), F.array(F.lit(0))).otherwise(targets)).alias("j"), "cls", "data", "weight", "home")
    asked = asked.where("j >= i")
    met = materialize(asked.join(spans.select(*own), own, "left_semi").groupBy(*own, "j").agg(F.collect_set("i").alias("askers")), "met")
    base = placed.withColumnRenamed("block", "j").join(met, [*own, "j"], "left")
    return asked, base.withColumn("i", F.explode(F.coalesce("askers", F.array("j")))).select(*asked.columns, "codes", "error")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, quantizers: dict[int, Quantizer] | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Vectors are compared when their labels are equal and not null, and their lengths are; each length has a quantizer of
    its own. Equal vectors of a label are one class with a
    weight. A class lies in the list of its nearest centre and asks every list that may hold a neighbour. A label's lists
    are joined into blocks of about ``ROOM``, and a list above that is cut into several, so a hot label or list gives more
    tasks, not larger ones. A class is sent to a block once, however many of its lists it asks, and two blocks meet once:
    links are mutual. A task emits counts and
    stars, never its pairs. Looked-up distances less each code's own error never exceed true ones, so nothing is lost
    before the exact rerank in double precision.

    Null, zero, non-finite or null-holding vectors and null labels link with nothing. ``component_id`` is the least vec_id of a component; a null vec_id never is unless there is no other.
    Repeated rows are rows of their own. An empty table gives no rows; other columns are not read.
    """
    vectors = vectors.select("vec_id", "embedding", "label")
    coders = fit_quantizer(vectors) if quantizers is None else quantizers
    coder = lambda width: coders.get(width) or Quantizer.plain(width)
    reach = float(np.sqrt(2 - 2 * cosine))
    # Single precision is kept as it is; it becomes double where it is compared.
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    kept = np.dtype("<f4" if kinds["embedding"] == "array<float>" else "<f8")

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data: list[bytes | None] = [None] * batch.num_rows
            rows, starts, ends, flat = usable(batch.column(1))
            for i, a, b in zip(rows.tolist(), starts.tolist(), ends.tolist()):
                data[i] = flat[a:b].astype(kept).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(data, pa.binary())], ["vec_id", "label", "data"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = pc.binary_length(batch.column("data")).to_numpy(zero_copy_only=False) // kept.itemsize
            for width in np.unique(widths).tolist():
                some = batch.filter(pa.array(widths == width))
                home, codes, error, probes = coder(width).encode(unit(np.frombuffer(b"".join(some.column("data").to_pylist()), kept).astype(float).reshape(-1, width)), reach)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array([width] * len(home), pa.int32()), pa.array(home, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array(error), pa.array(probes, pa.list_(pa.int32()))],
                    [*some.schema.names, "width", "home", "codes", "error", "probes"])

    def side(table: pa.Table, s: str, *more: str) -> dict:
        read = lambda c, kind: np.frombuffer(b"".join(table.column(c + s).to_pylist()), kind).reshape(table.num_rows, -1)
        out = {c: table.column(c + s).to_numpy() for c in ("cls", "weight", "home", *more)} | {"unit": unit(read("data", kept).astype(float))}
        return out | ({"codes": read("codes", np.uint8)} if more else {})

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("v", "hits", "root")})
        i, j = left.column("i0")[0].as_py(), left.column("j0")[0].as_py()
        return compare_blocks(coder(left.column("width0")[0].as_py()), cosine, side(left, "0"), side(right, "1", "error"), i < j)

    data = materialize(vectors.mapInArrow(raw, f"vec_id {kinds['vec_id']}, label {kinds['label']}, data binary"), "vectors")
    classes = data.where(F.col("label").isNotNull() & F.col("data").isNotNull()).groupBy("label", "data").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = classes.withColumn("cls", F.monotonically_increasing_id())
    coded = classes.mapInArrow(encode, ", ".join(f"{n} {t}" for n, t in classes.dtypes) + ", width int, home int, codes binary, error double, probes array<int>")
    classes = materialize(coded, "classes")
    asked, base = block_pairs(classes)
    names = ["label", "width", "i", "j", "cls", "data", "weight", "home"]  # a cogroup needs columns of its own on either side
    sides = [t.select(*(F.col(c).alias(f"{c}{s}") for c in n)).groupBy(*(f"{c}{s}" for c in names[:4])) for s, (t, n) in enumerate(((asked, names), (base, [*names, "codes", "error"])))]
    found = materialize(sides[0].cogroup(sides[1]).applyInArrow(compare, "v bigint, hits bigint, root bigint"), "found")
    roots = components(found.select(F.col("v").alias("a"), F.col("root").alias("b")))
    hits = found.groupBy("v").agg(F.sum("hits").alias("hits"))
    placed = classes.select("cls", "label", "data", "rep", "weight").join(hits, F.col("cls") == F.col("v"), "left").drop("v")
    placed = placed.join(roots, F.col("cls") == F.col("v"), "left").withColumn("root", F.coalesce("root", "cls"))
    placed = placed.select("label", "data", "root", "rep", (F.coalesce("hits", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    least = placed.groupBy("root").agg(F.min("rep").alias("least"))
    out = data.join(placed.drop("rep"), ["label", "data"], "left").join(least, "root", "left")
    out = out.withColumn("component_id", F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
