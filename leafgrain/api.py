"""Engine: the named tools over stored tables, for batches of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrain.operators import cards as cd
from leafgrain.operators import extraction as xt
from leafgrain.operators import listing as ls
from leafgrain.operators import retrieval as rt
from leafgrain.operators import search_index as si
from leafgrain.operators import vector_index as vi
from leafgrain.sources import tables as tb
from leafgrain.schemas import CANDIDATE_POOL

CARD_VIEWS = {
    "methods": "Method", "metrics": "Metric", "limitations": "Limitation", "failure_modes": "Failure Mode",
}


@dataclass
class Engine:
    """Tables by name (see ``schemas.TABLE_SCHEMAS``), plus the index built from them."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    postings: DataFrame
    corpus: DataFrame
    text_index: si.SearchIndex | None = None
    vector_index: vi.VectorIndex | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str, postings: DataFrame | None = None, index: str | None = None) -> Engine:
        """Tables under a root folder; ``index`` is a folder that ``store_indexes`` wrote."""
        engine = cls.of(spark, tb.load_tables(spark, root), postings)
        if index:
            engine.text_index = si.SearchIndex.open(spark, f"{index}/text")
            engine.vector_index = vi.VectorIndex.open(spark, f"{index}/vectors")
        return engine

    def store_indexes(self, folder: str) -> None:
        """Write the text and vector indexes of the tables; searches use them from then on."""
        passages = self.tables["passages"]
        self.text_index = si.write_search_index(passages, f"{folder}/text")
        self.vector_index = vi.write_vector_index(self.tables["passage_embeddings"], passages, f"{folder}/vectors")

    def full_text_hits(self, queries: DataFrame, limit: int) -> DataFrame:
        if self.text_index:
            return si.search(self.text_index, queries, limit)
        return rt.fts_rank(queries, self.postings, self.corpus, limit)

    def nearest_hits(self, query_vectors: DataFrame, limit: int) -> DataFrame:
        if self.vector_index:
            return vi.search(self.vector_index, query_vectors, limit)
        return rt.vector_rank(query_vectors, self.tables["passage_embeddings"], self.tables["passages"], limit)

    @classmethod
    def of(cls, spark: SparkSession, tables: dict[str, DataFrame], postings: DataFrame | None = None) -> Engine:
        passages = tables["passages"]
        return cls(spark, tables, postings or rt.build_postings(passages), rt.corpus_stats(passages))

    def register_views(self) -> None:
        """Temp views of all tables for SQL users."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)

    def scoped(self, name: str, space_id: str | None = None) -> DataFrame:
        """Rows of the active space only."""
        return ls.scope_to_space(self.tables[name], self.tables["spaces"], self.tables["app_state"], space_id)

    @property
    def cards(self) -> DataFrame:
        evidence = F.col("evidence.source_passage_ids")
        return self.tables["knowledge_cards"].withColumn(
            "source_passage_ids", F.coalesce(evidence, F.array().cast("array<string>"))
        )

    def search(
        self, queries: DataFrame, query_vectors: DataFrame | None = None, limit: int = 20,
        pool: int | None = CANDIDATE_POOL,
    ) -> DataFrame:
        """Hybrid (with query vectors) or full-text hits with passage provenance."""
        if query_vectors is None:
            hits = self.full_text_hits(queries, limit).withColumn("rank", F.col("fts_rank"))
        else:
            hits = rt.hybrid_search(
                queries, query_vectors, self.tables["passages"], self.tables["passage_embeddings"],
                self.postings, self.corpus, limit, pool, self.full_text_hits, self.nearest_hits,
            ).join(queries.select("query_id", "space_id"), "query_id")
        return rt.enrich_passages(hits, self.tables["passages"])

    def compare_with_literature(
        self, queries: DataFrame, query_vectors: DataFrame | None = None, pool: int | None = CANDIDATE_POOL
    ) -> DataFrame:
        hits = self.search(queries, query_vectors, 10, pool).select("query_id", "passage_id")
        return rt.compare_with_literature(hits, self.tables["passages"], self.cards)

    def evidence_for_claim(
        self, claims: DataFrame, query_vectors: DataFrame | None = None, limit: int = 10,
        pool: int | None = CANDIDATE_POOL,
    ) -> tuple[DataFrame, DataFrame]:
        return rt.evidence_for_claim(claims, self.search(claims, query_vectors, limit, pool), self.cards, limit)

    def card_view(self, name: str) -> DataFrame:
        """Methods, metrics, limitations or failure modes with titles and sources."""
        return cd.cards_by_type(
            self.cards, self.tables["papers"], self.tables["knowledge_card_sources"], self.tables["passages"],
            CARD_VIEWS[name],
        )

    def spaces(self) -> DataFrame:
        """The active space; no row where none is set or it is not active."""
        named = self.tables["spaces"].withColumn("space_id", F.col("id"))
        return ls.list_spaces(ls.scope_to_space(named, self.tables["spaces"], self.tables["app_state"]).drop("space_id"))

    def papers(self, space_id: str | None = None) -> DataFrame:
        return ls.list_papers(self.scoped("papers", space_id))

    def elements(
        self, limit: int = 100, element_type: str | None = None, page: int | None = None, space_id: str | None = None
    ) -> DataFrame:
        """First elements of each paper in reading order."""
        return ls.list_elements(self.scoped("document_elements", space_id), limit, element_type, page)

    def document_tables(self, space_id: str | None = None) -> DataFrame:
        return ls.list_tables(self.scoped("document_tables", space_id))

    def passages(self, space_id: str | None = None) -> DataFrame:
        return ls.list_passages(self.scoped("passages", space_id))

    def runs(self, kind: str = "analysis_runs", space_id: str | None = None) -> DataFrame:
        """Runs of a kind (a table of runs), newest of each paper first."""
        return ls.list_runs(self.scoped(kind, space_id))

    def newest_cards(self, limit: int = 100, space_id: str | None = None) -> DataFrame:
        """Newest cards of the space with titles and checked sources."""
        cards = ls.scope_to_space(self.cards, self.tables["spaces"], self.tables["app_state"], space_id)
        newest = cd.newest_cards(cards, ["space_id"], limit)
        return self.enriched(cd.cards_with_titles(newest, self.tables["papers"]))

    def enriched(self, cards: DataFrame) -> DataFrame:
        return cd.enrich_cards(cards, self.tables["knowledge_card_sources"], self.tables["passages"])

    def similar_results(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """Full-text hits of each query with passage provenance, whatever its mode."""
        return self.search(queries, None, limit)

    def paper_summary(self, with_cards: bool = False) -> DataFrame:
        """Papers with passage and card counts; ``with_cards`` adds the enriched cards of a paper as a list, by id."""
        counts = cd.paper_summary(self.tables["papers"], self.tables["passages"], self.cards)
        if not with_cards:
            return counts
        cards = self.enriched(self.cards)
        row = F.struct("id", *[c for c in cards.columns if c not in ("id", "paper_id", "space_id")])
        listed = cards.groupBy("paper_id", "space_id").agg(F.collect_list(row).alias("cards"))
        by_id = F.array_sort("cards", lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
        return counts.join(listed, ["paper_id", "space_id"], "left").withColumn("cards", by_id)

    def edit_papers(self, edits: DataFrame) -> None:
        """An agent's edits of papers of the active space (id and fields to overwrite; null, '' and 0 keep what is there)."""
        fields = [
            F.when(~F.col(c).cast("string").isin("", "0"), F.col(c)).alias(c) for c in edits.columns if c not in ("id", "space_id")]
        homes = self.scoped("papers").select("id", "space_id")
        known = edits.select("id", *fields).join(homes, "id")
        self.tables = {**self.tables, "papers": ls.apply_paper_edits(self.tables["papers"], known, by_user=False)}

    def add_cards(self, new: DataFrame) -> DataFrame:
        """Store an agent's cards (id, paper_id, card_type, summary, source_passage_id) of the active space; returns the rejects.

        A paper outside the active space is not found; an empty source counts as none.
        """
        homes = self.scoped("papers").select(F.col("id").alias("paper_id"), "space_id")
        asked = new.join(homes, "paper_id", "left").withColumns({
            "confidence": F.lit(1.0), "user_edited": F.lit(False),
            "source_passage_id": F.when(F.col("source_passage_id") != "", F.col("source_passage_id"))})
        accepted, rejected = cd.append_cards(asked, self.tables["papers"], self.tables["passages"], "agent")
        old = self.tables["knowledge_cards"]
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema if f.name not in accepted.columns]
        stored = accepted.select("*", *missing).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema])
        self.tables = {**self.tables, "knowledge_cards": old.unionByName(stored)}
        return rejected

    def edit_cards(self, edits: DataFrame, now: Column) -> None:
        """A user's edits of cards (id, space_id, summary, card_type, confidence; null keeps)."""
        old = self.tables["knowledge_cards"]
        edited = cd.apply_card_edits(old, edits, now).select(*old.columns)
        self.tables = {**self.tables, "knowledge_cards": edited}

    def delete_cards(self, ids: DataFrame) -> None:
        """Remove cards (id, space_id) and their links."""
        cards, links = cd.delete_cards(self.tables["knowledge_cards"], self.tables["knowledge_card_sources"], ids)
        self.tables = {**self.tables, "knowledge_cards": cards, "knowledge_card_sources": links}

    def analyse(self, extractor: xt.Extractor, folder: str, run_id: str, now: Column, **limits) -> xt.Extraction:
        """Extract cards of all parsed papers with the caller's extractor; the engine's card tables become the new ones."""
        found, cards, links = xt.analyse(self.tables, extractor, folder, F.lit(run_id), now, **limits)
        self.tables = {**self.tables, "knowledge_cards": cards, "knowledge_card_sources": links}
        return found

    def full_text(self, papers: DataFrame) -> DataFrame:
        return rt.full_text(papers, self.tables["passages"])

    def citations(self) -> DataFrame:
        return rt.citation_record(self.tables["papers"])
