"""Merkle manifest of a dataset: one tree per group of rows, proofs and their check by cogrouped superblocks."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrain.llm.common import materialize

FAN = 8
#: Levels that one superblock spans; it holds at most FAN ** LEVELS nodes, whatever its tree's size.
LEVELS = 4
SPAN = FAN ** LEVELS
#: What a superblock needs from above.
OUTER = ("tree", "pos", "left", "right", "subroot", "root")
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the byte count, ``:`` and the value, so that no two rows spell the same leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def height(nodes: int) -> int:
    """Levels until one node remains."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def grow(digests: Sequence[str], levels: int) -> list[list[str]]:
    """The levels above a superblock's nodes, the nodes first; the last run of a level may be short."""
    out = [list(digests)]
    for _ in range(levels):
        low = out[-1]
        out.append([sha("".join(low[i:i + FAN])) for i in range(0, len(low), FAN)])
    return out


def siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a node's way up in its runs, level by level; digests joined."""
    left, right = [], []
    for nodes in levels[:-1]:
        first = at // FAN * FAN
        left.append("".join(nodes[first:at]))
        right.append("".join(nodes[at + 1:first + FAN]))
        at //= FAN
    return left, right


def fold(digest: str, left: Sequence[str], right: Sequence[str]) -> str:
    """The root that a digest and its siblings give."""
    for a, b in zip(left, right):
        digest = sha(a + digest + b)
    return digest


def place(nodes: DataFrame, *order: str) -> DataFrame:
    """Adds pos (from 0 in each tree) and n (nodes of the tree).

    Rows are range-partitioned by (tree, order), so a tree of any size is spread; only the count of each tree in each
    partition is summed up over partitions. ``order`` must tell all rows of a tree apart.
    """
    ranged = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = ranged.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ordered")
    runs = ranged.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    runs = runs.select(
        F.col("tree").alias("_tree"), F.col("part").alias("_part"), "first", F.sum("rows").over(tree).alias("n"),
        (F.sum("rows").over(tree.orderBy("part")) - F.col("rows")).alias("before"))
    # A tree and partition meet in one row of ``runs``: as many as partitions and trees together.
    placed = ranged.join(runs, (F.col("tree") == F.col("_tree")) & (F.col("part") == F.col("_part")))
    return placed.withColumn("pos", F.col("row") - F.col("first") + F.col("before")).drop("_tree", "_part", "first", "before", "row", "part")


def in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / SPAN).cast("bigint"))


def superblock_roots(nodes: DataFrame) -> DataFrame:
    """(tree, pos, digest, n) one superblock higher: every superblock of at most SPAN nodes becomes its root."""
    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        n = int(group["n"].iloc[0])
        top = grow(group["digest"].tolist(), min(LEVELS, height(n)))[-1][0]
        return pd.DataFrame({"tree": [group["tree"].iloc[0]], "pos": [group["block"].iloc[0]], "digest": [top], "n": [-(-n // SPAN)]})

    blocks = in_blocks(nodes.select("tree", "pos", "digest", "n"))
    return blocks.groupBy("tree", "block").applyInPandas(reduce, "tree string, pos bigint, digest string, n bigint")


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the superblock roots above them, up to the tier where each tree is one node."""
    out = [nodes]
    while True:
        out.append(materialize(superblock_roots(out[-1]), "roots"))
        if (out[-1].agg(F.max("n")).first()[0] or 1) == 1:
            return out


def hand_down(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """Adds to each node its siblings up to the root: (…, left, right, subroot, root).

    ``outer`` holds one row for each superblock: the siblings from its root upward.
    """
    kept = [c for c in nodes.columns if c != "n"]
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}

    def exchange(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group, up = group.sort_values("pos"), above.iloc[0]
        levels = grow(group["digest"].tolist(), min(LEVELS, height(int(group["n"].iloc[0]))))
        pairs = [siblings(levels, i) for i in range(len(group))]
        return group[kept].assign(
            left=[a + list(up["left"]) for a, _ in pairs], right=[b + list(up["right"]) for _, b in pairs],
            subroot=up["subroot"], root=up["root"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", left array<string>, right array<string>, subroot string, root string"
    return in_blocks(nodes).groupBy("tree", "block").cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(exchange, schema)


def leaves_of(docs: DataFrame, altered: Column, fields: Sequence[str] = FIELDS, text: str = "text", group: str = "lang", order: str = "doc_id") -> DataFrame:
    """(key, tree, digest, changed, uid): leaves, and for rows where ``altered`` holds the leaf of the altered text."""
    spelled = lambda *c: F.sha2(F.concat(*map(field, c)).cast("binary"), 256)
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(
        F.col(order).alias("key"),
        # Null sorts before every other group, the empty one included.
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        spelled(*(F.col(c) for c in fields)).alias("digest"),
        F.when(altered, spelled(*(lowered if c == text else F.col(c) for c in fields))).alias("changed"),
        F.monotonically_increasing_id().alias("uid"))


def manifest(docs: DataFrame, altered: Column | None = None, with_siblings: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified[, left, right]) of every row of ``docs``.

    A row's leaf is the hash of its fields. Per lang the leaves ascend by doc_id; runs of eight become their hash until
    one is left, the subroot; subroots by lang make the root alike. ``altered`` says which rows a reader presents with
    the letters A-Z of the text in lower case: ``folded_root`` is the root which that leaf and the stored siblings
    give, and ``verified`` tells whether it is the stored one. ``left`` and ``right`` are the proof itself: siblings
    before and after, joined, one entry for each level.

    Superblocks of 4,096 nodes become their roots, these again, until trees are single nodes. Going down, the leaves of
    each superblock are cogrouped with the outer nodes that it needs (one row), and local reduction, joining of the
    proof and folding finish there. So no task ever holds more than a superblock, however large a lang is; digests
    alone are shuffled.

    A null lang is a group of its own, the first; null doc_ids come first in a group; rows of equal doc_id follow by
    leaf, and equal rows count as leaves each. Null fields and empty ones differ. An empty table gives no rows; other
    columns are not read.
    """
    if altered is None:
        altered = F.lit(False)
    leaves = materialize(leaves_of(docs, altered), "leaves")
    # Equal rows differ in uid only, so a document repeated many times is spread, too.
    low = tiers(place(leaves, "key", "digest", "uid").drop("uid"))
    subroots = low[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    high = tiers(place(subroots, "name"))
    nothing = F.array().cast("array<string>")
    outer = high[-1].select("tree", "pos", nothing.alias("left"), nothing.alias("right"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for nodes in high[-2::-1]:
        outer = materialize(hand_down(nodes, outer.select(*OUTER)), "outer")
    # The leaves of the upper tree are the subroots: each stands above the one top node of its lang.
    outer = outer.select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "left", "right", F.col("digest").alias("subroot"), "root")
    for nodes in low[-2:0:-1]:
        outer = materialize(hand_down(nodes, outer.select(*OUTER)), "outer")
    return proven(low[0], outer.select(*OUTER), with_siblings)


def proven(leaves: DataFrame, outer: DataFrame, with_siblings: bool) -> DataFrame:
    """The leaf tier: local reduction, the joined proof, and the root folded from the presented leaf."""
    kind = leaves.schema["key"].dataType.simpleString()
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["left", "right"] if with_siblings else [])]

    def finish(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group, up = group.sort_values("pos"), above.iloc[0]
        levels = grow(group["digest"].tolist(), min(LEVELS, height(int(group["n"].iloc[0]))))
        up_left, up_right, root = list(up["left"]), list(up["right"]), up["root"]
        rows = []
        for i, (key, leaf, changed) in enumerate(zip(group["key"], levels[0], group["changed"])):
            left, right = siblings(levels, i)
            left, right = left + up_left, right + up_right
            folded = fold(changed if isinstance(changed, str) else leaf, left, right)
            proof = sha("".join(a + b for a, b in zip(left, right)))
            rows.append((key, leaf, up["subroot"], root, proof, folded, folded == root, left, right)[:len(names)])
        return pd.DataFrame(rows, columns=names)

    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema += ", left array<string>, right array<string>" if with_siblings else ""
    # As text, a null beside it does not turn an id into a rounded float.
    blocks = in_blocks(leaves.withColumn("key", F.col("key").cast("string")))
    out = blocks.groupBy("tree", "block").cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(finish, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def one_in_three(doc_id: Column) -> Column:
    """Rows whose decimal id has a crc32 that three divides."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False))


#: The query's rows in DuckDB: level by level over the whole table.
SQL = """
with recursive table_bits as (
  select i, 0 as k, i::bigint as c from range(256) r(i)
  union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from table_bits where k < 8
), crc_table as (select i, c from table_bits where k = 8),
ids as (select distinct doc_id, doc_id::varchar as s from documents where doc_id is not null),
steps as (
  select doc_id, s, 0 as k, 4294967295::bigint as c from ids
  union all
  select p.doc_id, p.s, p.k + 1, xor(t.c, p.c >> 8)
  from steps p join crc_table t on t.i = xor(p.c & 255, ord(s[p.k + 1])) where p.k < length(p.s)
), picked as (select doc_id from steps where k = length(s) and xor(c, 4294967295) % 3 = 0),
fields as (
  select *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
    doc_id in (select doc_id from picked) as hit from documents
), spelled as (
  select doc_id, lang, hit,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as body, coalesce(strlen(low) || ':' || low, '-') as low_body
  from fields
), leaves as (
  select doc_id, dense_rank() over (order by lang nulls first) as tree, sha256(head || body) as leaf,
    case when hit then sha256(head || low_body) else sha256(head || body) end as shown, lang
  from spelled
), placed as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from leaves
), low_nodes as (
  select tree, 0 as level, pos, leaf as digest, n from placed
  union all
  select tree, level + 1, pos // 8, sha256(string_agg(digest, '' order by pos)), (n + 7) // 8 from low_nodes where n > 1 group by tree, level, pos // 8, n
), subroots as (select tree, digest as subroot, level as top from low_nodes where n = 1),
high_nodes as (
  select 0 as level, tree - 1 as pos, subroot as digest, count(*) over () as n from subroots
  union all
  select level + 1, pos // 8, sha256(string_agg(digest, '' order by pos)), (n + 7) // 8 from high_nodes where n > 1 group by level, pos // 8, n
), roots as (select digest as root, level as high_top from high_nodes where n = 1),
nodes as (
  select tree, level, pos, digest from low_nodes where n > 1
  union all
  select 0, level, pos, digest from high_nodes where n > 1
), sides as (
  select tree, level, pos, coalesce(string_agg(digest, '') over (w rows between unbounded preceding and 1 preceding), '') as a,
    coalesce(string_agg(digest, '') over (w rows between 1 following and unbounded following), '') as b
  from nodes window w as (partition by tree, level, pos // 8 order by pos)
), climb as (
  select p.tree as own, p.pos as own_pos, p.tree, p.pos, 0 as level, p.shown as digest, '' as proof, s.top, r.high_top
  from placed p join subroots s using (tree), roots r
  union all
  select own, own_pos, case when step then tree else 0 end, case when step then pos // 8 else own - 1 end,
    case when step then level + 1 else 0 end, case when step then sha256(a || digest || b) else digest end,
    case when step then proof || a || b else proof end, top, high_top
  from (
    select c.*, c.level < case when c.tree > 0 then c.top else c.high_top end as step, x.a, x.b
    from climb c left join sides x on x.tree = c.tree and x.level = c.level and x.pos = c.pos)
  where step or tree > 0
), ends as (select own, own_pos, digest as folded_root, sha256(proof) as proof_sha256 from climb where tree = 0 and level = high_top)
select p.doc_id, p.leaf, s.subroot, r.root, e.proof_sha256, e.folded_root, e.folded_root = r.root as verified
from placed p join subroots s using (tree) join ends e on e.own = p.tree and e.own_pos = p.pos, roots r
"""
