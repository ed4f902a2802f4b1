"""Removal of repeated runs of lines by winnowing over line hashes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrain.llm.common import materialize

#: A run is worth removing from this many lines, or from fewer with this many words.
RUN_LINES, RUN_WORDS = 3, 50
BLANK = " \t\n\x0b\x0c\r"


def hashed_lines(text: Column) -> Column:
    """array<struct<p, h, g, n>>: number, two hashes and words of each line that has a word."""
    trimmed = F.transform(F.split(text, "\n"), lambda x, k: F.struct(k.alias("p"), F.btrim(x, F.lit(BLANK)).alias("x")))
    return F.transform(
        F.filter(trimmed, lambda y: y["x"] != ""),
        lambda y: F.struct(y["p"].alias("p"), F.xxhash64(y["x"]).alias("h"), F.xxhash64(F.lit(7), y["x"]).alias("g"),
                           F.regexp_count(y["x"], F.lit("[^ \\t-\\r]+")).alias("n")))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` reads it inside a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def window_at(seq: Column, i: Column, lines: int, words: int) -> Column:
    """struct<s, e, anchor, at, w1, w2>: the window that starts at entry i, null if the text ends before it is whole.

    It is as short as a run worth removing can be: it ends at the line that brings it to ``words`` words, or after
    ``lines`` lines. Its anchor is its least line hash (``at``: the last place of that), ``w1`` and ``w2`` are hashes of
    all its lines, ``s`` and ``e`` the first and last line number. Equal runs have equal windows with equal anchors,
    whatever stands around them.
    """
    line = [F.get(seq, i + j) for j in range(lines)]
    out: Column | None = None
    for size in range(1, lines + 1):
        part = line[:size]
        enough = sum((x["n"] for x in part[1:]), part[0]["n"]) >= words if size < lines else part[-1].isNotNull()
        least = F.least(*(x["h"] for x in part)) if size > 1 else part[0]["h"]
        at = F.coalesce(*(F.when(x["h"] == least, x["p"]) for x in reversed(part)))
        window = F.struct(
            part[0]["p"].alias("s"), part[-1]["p"].alias("e"), least.alias("anchor"), at.alias("at"),
            F.xxhash64(*(x["h"] for x in part)).alias("w1"), F.xxhash64(*(x["g"] for x in part)).alias("w2"))
        out = F.when(enough, window) if out is None else out.when(enough, window)
    return out


def picks_of(seq: Column, lines: int, words: int) -> Column:
    """array<struct<at, anchor, around>>: the lines that some window chose as its anchor, once each.

    ``around`` holds the windows that chose the line. They start at most ``lines - 1`` entries before it, so each line
    looks at that many windows and the work grows with the lines.
    """
    def pick(both: Column, k: Column) -> Column:
        line = F.get(both["seq"], k)
        near = F.array(*(F.get(both["windows"], k - j) for j in reversed(range(lines))))
        around = F.transform(
            F.filter(near, lambda w: w["at"] == line["p"]),
            lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), w["w1"].alias("w1"), w["w2"].alias("w2")))
        return F.struct(line["p"].alias("at"), line["h"].alias("anchor"), around.alias("around"))

    def chosen(both: Column) -> Column:
        return F.filter(F.transform(both["numbers"], lambda k: pick(both, k)), lambda x: F.size(x["around"]) > 0)

    def windows(both: Column) -> Column:
        return once(F.struct(both["seq"].alias("seq"), both["numbers"].alias("numbers"), F.transform(
            both["numbers"], lambda i: window_at(both["seq"], i, lines, words)).alias("windows")), chosen)

    def numbered(x: Column) -> Column:
        numbers = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1))
        return once(F.struct(x.alias("seq"), numbers.alias("numbers")), windows)

    return once(seq, numbered)


def dedup_lines(docs: DataFrame, lines: int = RUN_LINES, words: int = RUN_WORDS, removed_as: str | None = None) -> DataFrame:
    """``docs`` with every later occurrence of a repeated run removed from ``text``.

    ``removed_as`` names a column for the number of lines removed.

    A run is ``lines`` consecutive lines with a word, or fewer that hold ``words`` words; lines are compared without
    white space at their ends. Of equal runs the first by (doc_id, line) stays, in whichever document; lines that only
    later runs cover go, with the blank lines inside.

    Winnowing selects one line of each window, the least line hash; only selected lines leave a task, one row each.
    Their positions are joined by hash: a line that stands in one place only goes no further. Around one that stands
    in several, the match is extended both ways, window by window over those that chose it: each is held against the
    first place of the same content, and overlapping spans join into runs. Every window has its selected line, so no
    repeated run is missed. What stands in any number of documents is met by its first place only, never by pairs.

    Null text stays null, an empty one empty. A null doc_id sorts first. Rows with equal doc_id and text are one
    document and end alike. Columns other than doc_id and text pass through, whatever their names; an empty table
    gives no rows.
    """
    key = ["_id", "_hash"]
    # Only two columns are read before the end, under names of our own, so other columns cannot clash.
    slim = docs.select(docs["doc_id"].alias("_id"), docs["text"].alias("_text"))

    found = slim.select("_id", F.xxhash64("_text").alias("_hash"), F.explode_outer(picks_of(hashed_lines(F.col("_text")), lines, words)).alias("_w"))
    picks = materialize(found.where(F.col("_w").isNotNull()).select(*key, "_w.*"), "picks")
    place = F.xxhash64(*key, "at")
    repeated = picks.groupBy("anchor").agg(F.min(place).alias("_low"), F.max(place).alias("_high")).where("_low <> _high").select("anchor")
    matched = picks.join(repeated, "anchor", "left_semi").select(*key, F.inline("around"))
    here = F.struct("_id", "_hash", "s")
    firsts = matched.groupBy("w1", "w2").agg(F.min(here).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    later = matched.join(firsts, ["w1", "w2"]).where(~here.eqNullSafe(F.col("_first")))
    spans = later.groupBy(*key).agg(F.collect_list(F.struct("s", "e")).alias("_spans"))
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["_id"]) & (F.xxhash64(docs["text"]) == spans["_hash"]), "left")
    gone = F.array_distinct(F.flatten(F.transform(spans["_spans"], lambda x: F.sequence(x["s"], x["e"]))))

    def rest(x: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])
        return F.array_join(F.transform(kept, lambda k: F.get(x["lines"], k)), "\n")

    text = F.when(spans["_spans"].isNull(), docs["text"]).otherwise(once(F.struct(F.split(docs["text"], "\n").alias("lines"), gone.alias("gone")), rest))
    out = [text.alias("text") if c == "text" else docs[c] for c in docs.columns]
    return joined.select(*out, *([F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias(removed_as)] if removed_as else []))


#: The same by windows of text instead of hashes; :lines and :words as above.
SQL = """
with lines as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as p
  from documents
), worded as (
  select doc_id, p, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as x from lines
  where regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), near as (
  select doc_id, p, x, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) as n,
    lead(p) over w as p1, lead(x) over w as x1, lead(p, 2) over w as p2, lead(x, 2) over w as x2
  from worded window w as (partition by doc_id order by p)
), windows as (
  select doc_id, p as s,
    case when n >= {words} then p
      when n + len(regexp_extract_all(x1, '[^\\x20\\x09-\\x0D]+')) >= {words} then p1 else p2 end as e,
    case when n >= {words} then x
      when n + len(regexp_extract_all(x1, '[^\\x20\\x09-\\x0D]+')) >= {words} then x || chr(10) || x1
      else x || chr(10) || x1 || chr(10) || x2 end as content
  from near
), later as (
  select doc_id, s, e from (
    select *, row_number() over (partition by content order by doc_id nulls first, s) as k from windows where e is not null
  ) where k > 1
), reach as (
  select l.doc_id, l.p, l.line, max(w.e) over (partition by l.doc_id order by l.p) as e
  from lines l left join later w on w.doc_id = l.doc_id and w.s = l.p
), kept as (
  select doc_id, string_agg(line, chr(10) order by p) filter (where e is null or e < p) as text,
    count(*) filter (where e >= p) as n_removed from reach group by doc_id
)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text, coalesce(k.n_removed, 0) as n_removed
from documents d left join kept k using (doc_id)
""".format(words=RUN_WORDS)
