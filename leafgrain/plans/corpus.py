"""Maps the given tables onto the data model (spaces, papers, passages, ...).

Every frame here is a projection of a whole given table; nothing is sampled.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrain.functions import text as tx

SECTION_NAMES = (
    "Abstract", "1 Introduction", "2. Methods", "3 Results and evaluation",
    "Discussion", "IV. Limitations", "Appendix A", "References", "Notes", "",
)
CARD_KINDS = ("Method", "Result", "Limitation", "Evidence")
PROVIDER, MODEL = "local", "e5-small"
EPOCH = "2024-01-01 00:00:00"


def at_second(offset: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + offset)


class Corpus:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def turns(self) -> DataFrame:
        return self.table("conversations")

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages")

    @cached_property
    def lines(self) -> DataFrame:
        """One row per text line, in order."""
        return self.documents.select(
            "doc_id", "lang", "source", F.posexplode(tx.lines(F.col("text"))).alias("pos", "line")
        )

    @cached_property
    def normal_lines(self) -> DataFrame:
        """Lines with white space made plain, once a line."""
        return self.lines.select("doc_id", "source", "pos", tx.once(tx.normalize_ws(F.col("line"))).alias("text"))

    @cached_property
    def spaces(self) -> DataFrame:
        n = F.substring("source", 4, 9).cast("int")
        status = F.when(n % 7 == 5, "archived").when(n % 7 == 6, "deleted").otherwise("active")
        return (
            self.documents.select("source").distinct().select(
                F.col("source").alias("id"),
                F.concat(F.lit("Space "), "source").alias("name"),
                status.alias("status"),
                at_second(n * 60).alias("updated_at"),
            )
        )

    @cached_property
    def papers(self) -> DataFrame:
        d = F.col("doc_id")
        first_line = tx.normalize_ws(F.substring_index("text", "\n", 1))
        return self.documents.select(
            d,
            F.concat(F.lit("doc-"), d).alias("id"),
            F.col("source").alias("space_id"),
            F.when(d % 4 == 0, F.lit("")).otherwise(F.substring(first_line, 1, 80)).alias("title"),
            F.concat("lang", F.lit(" Author; Second "), "source").alias("authors"),
            F.when(d % 5 == 0, F.lit(None)).otherwise(1990 + d % 35).cast("int").alias("year"),
            F.when(d % 3 == 0, F.concat(F.lit("10.1234/d"), d)).otherwise("").alias("doi"),
            F.lit("").alias("arxiv_id"),
            F.lit("").alias("pubmed_id"),
            F.concat(F.lit("Venue "), "lang").alias("venue"),
            F.lit("").alias("abstract"),
            F.lit("").alias("citation"),
            F.lit("unclassified").alias("relation_to_idea"),
            F.concat("lang", F.lit("/"), d, F.lit("_"), "source", F.lit(".pdf")).alias("file_path"),
            F.sha2("text", 256).alias("file_hash"),
            F.when(d % 6 == 0, "error").when(d % 11 == 0, "pending").otherwise("parsed")
            .alias("parse_status"),
            at_second(d).alias("imported_at"),
        )

    @cached_property
    def passages(self) -> DataFrame:
        """Line-level passages: a cheap stand-in for chunker output in lookups."""
        d, p = F.col("doc_id"), F.col("pos")
        names = F.array(*[F.lit(s) for s in SECTION_NAMES])
        section = F.get(names, ((d + p) % 10).cast("int"))
        text = F.col("text")
        return self.normal_lines.filter(text != "").select(
            F.concat(F.lit("doc-"), d, F.lit("-p"), p).alias("id"),
            F.concat(F.lit("doc-"), d).alias("paper_id"),
            F.col("source").alias("space_id"),
            section.alias("section"),
            F.floor(p / 10).cast("int").alias("page_number"),
            p.alias("paragraph_index"),
            text.alias("original_text"),
            F.when(p % 7 == 6, "method").otherwise("body").alias("passage_type"),
            F.when(section == "", F.array().cast("array<string>"))
            .otherwise(F.array(F.lit("Paper"), section)).alias("heading_path"),
            F.sha2(text, 256).alias("content_hash"),
            F.when(p % 9 == 8, F.lit(None)).otherwise(F.concat(F.lit("run-"), d))
            .alias("parse_run_id"),
            F.concat(F.lit("backend"), d % 2).alias("parser_backend"),
            F.when(p % 5 == 4, F.array(F.lit("short"), F.lit("ocr")))
            .otherwise(F.array().cast("array<string>")).alias("quality_flags"),
        )

    @cached_property
    def elements(self) -> DataFrame:
        """Layout-like rows: short lines are headings, every 13th line a table."""
        d, p = F.col("doc_id"), F.col("pos")
        text = F.col("text")
        kind = (
            F.when(F.length(text) <= 40, "heading")
            .when(p % 13 == 12, "table")
            .when(p % 10 == 9, "page_footer")
            .when(p % 17 == 16, "reference")
            .otherwise("paragraph")
        )
        x = (p % 2 * 260 + 40).cast("double")
        y = (p % 10 * 70 + 30).cast("double")
        return self.normal_lines.select(
            F.concat(F.lit("doc-"), d, F.lit("-e"), p).alias("id"),
            F.concat(F.lit("doc-"), d).alias("paper_id"),
            F.col("source").alias("space_id"),
            p.alias("element_index"),
            kind.alias("element_type"),
            text.alias("text"),
            (F.floor(p / 10) + 1).cast("int").alias("page_number"),
            F.array(x, y, x + 200, y + 50).alias("bbox"),
        )

    @cached_property
    def embeddings(self) -> DataFrame:
        v = F.col("vec_id")
        return self.table("embeddings").select(
            F.concat(F.lit("doc-"), v, F.lit("-p0")).alias("passage_id"),
            F.lit(PROVIDER).alias("provider"),
            F.lit(MODEL).alias("model"),
            F.size("embedding").alias("dimension"),
            "embedding",
            at_second(v).alias("created_at"),
        )

    @cached_property
    def queries(self) -> DataFrame:
        """One search per benchmark item: its whole text, scoped to a space."""
        i = F.col("item_id")
        words = tx.word_tokens(F.col("text"))
        return self.table("benchmark").select(
            i.alias("query_id"),
            F.array_join(words, " ").alias("query"),
            F.concat(F.lit("src"), i % 20).alias("space_id"),
            F.when(i % 3 == 0, "auto").when(i % 3 == 1, "fts").otherwise("hybrid").alias("mode"),
            F.col("text"),
        )

    @cached_property
    def query_vectors(self) -> DataFrame:
        """A vector per search: the stored vector of the same number."""
        vectors = self.table("embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
        return self.queries.join(vectors, "query_id").select(
            "query_id", "space_id", F.lit(PROVIDER).alias("provider"), F.lit(MODEL).alias("model"),
            F.col("embedding").alias("vector"),
        )

    @cached_property
    def cards(self) -> DataFrame:
        """One card per conversation turn, five conversations to a paper.

        Three turns in five are summarized by their whole text, the others by the paper's first line, so that some cards
        of a paper are near copies. Quotes are a whole line, the line's words backwards, or the whole turn.
        """
        c, t = F.col("conv_id"), F.col("turn")
        paper = F.floor(c / 5)
        kinds = F.array(*[F.lit(k) for k in CARD_KINDS])
        # The first line alone is cut off; the others are not broken up for it.
        first = self.documents.filter("text is not null").select(
            F.col("doc_id").alias("paper_no"), F.col("source").alias("space_id"),
            F.substring_index("text", "\n", 1).alias("line"),
        )
        turns = self.turns.withColumn("paper_no", paper)
        words = F.split("lead", " ")
        own = tx.normalize_ws(F.col("text"))
        sources = F.array_distinct(F.array(
            F.concat(F.lit("doc-"), "paper_no", F.lit("-p0")),
            F.concat(F.lit("doc-"), "paper_no", F.lit("-p"), t % 4),
        ))
        summary = F.when(t % 5 >= 2, own).otherwise(F.concat("lead", F.lit(" note "), t))
        quote = (
            F.when(t % 3 == 0, F.col("lead"))
            .when(t % 3 == 1, F.array_join(F.reverse(words), " "))
            .otherwise(own)
        )
        # Dealt by turn before texts are made: the papers may lie in few files, and one task would make all their cards.
        dealt = turns.join(first, "paper_no").repartition("conv_id", "turn").withColumn("lead", tx.normalize_ws(F.col("line")))
        return dealt.select(
            F.concat(F.lit("card-"), c, F.lit("-"), t).alias("id"),
            "space_id",
            F.concat(F.lit("doc-"), "paper_no").alias("paper_id"),
            F.when(t % 3 != 2, sources[0]).alias("source_passage_id"),
            F.get(kinds, ((c + t) % 4).cast("int")).alias("card_type"),
            summary.alias("summary"),
            sources.alias("source_passage_ids"),
            quote.alias("evidence_quote"),
            F.when(t % 7 == 6, F.lit("")).otherwise(F.lit("because")).alias("reasoning_summary"),
            F.round(((c * 7 + t * 3) % 100) / 100.0, 2).alias("confidence"),
            (t % 4 == 3).alias("user_edited"),
            F.when(t % 4 == 3, "user").when(t % 4 == 2, "heuristic").otherwise("ai")
            .alias("created_by"),
            (c * 100 + t).cast("int").alias("card_index"),
            at_second(c * 100 + t).alias("created_at"),
        )

    @cached_property
    def card_sources(self) -> DataFrame:
        return self.cards.select(
            "id", "paper_id", "space_id", "evidence_quote", "confidence", "created_at",
            F.posexplode("source_passage_ids").alias("pos", "passage_id"),
        ).select(
            F.concat("id", F.lit("-s"), "pos").alias("id"),
            F.col("id").alias("card_id"), "passage_id", "paper_id", "space_id",
            "evidence_quote", "confidence", "created_at",
        )

    @cached_property
    def run_events(self) -> DataFrame:
        """Events as run lifecycle messages; a run is one user's day."""
        kinds = {"signup": "queued", "view": "claimed", "click": "heartbeat",
                 "purchase": "completed", "error": "failed"}
        kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()])
        u = F.col("user_id")
        return self.table("events").select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            F.concat(F.lit("run-"), u, F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("run_id"),
            F.concat(F.lit("doc-"), u).alias("paper_id"),
            F.concat(F.lit("src"), u % 20).alias("space_id"),
            kind.alias("kind"),
            F.get_json_object("props", "$.k").cast("int").alias("worker"),
            "value",
        )

    @cached_property
    def runs(self) -> DataFrame:
        """Latest state of each run (the last message decides)."""
        order = F.struct("ts", "event_id")
        last = F.max_by("kind", order)
        return (
            self.run_events.groupBy("run_id", "paper_id", "space_id")
            .agg(
                last.alias("last"),
                F.min("ts").alias("started_at"),
                F.max(F.when(F.col("kind") == "heartbeat", F.col("ts"))).alias("heartbeat_at"),
                F.max("ts").alias("seen_at"),
                F.count_if(F.col("kind") == "claimed").cast("int").alias("attempt_count"),
                F.max_by("worker", order).alias("worker"),
                F.count(F.lit(1)).cast("int").alias("messages"),
                F.round(F.sum("value"), 4).alias("seconds"),
            )
            .select(
                F.col("run_id").alias("id"), "paper_id", "space_id",
                F.when(F.col("last").isin("claimed", "heartbeat"), "running")
                .otherwise(F.col("last")).alias("status"),
                "started_at", "heartbeat_at", "seen_at", "attempt_count", "worker", "messages",
                "seconds",
            )
        )
