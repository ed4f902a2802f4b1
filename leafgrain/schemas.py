"""Table schemas, enums and budgets.

Everything in this module is a fixed value of the data contract: column types,
allowed labels, size limits.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Labels allowed in enum columns.
ELEMENT_TYPES = (
    "title", "heading", "paragraph", "list", "table", "figure", "caption",
    "equation", "code", "reference", "page_header", "page_footer", "unknown",
)
SEARCHABLE_ELEMENT_TYPES = (
    "title", "paragraph", "list", "caption", "equation", "code", "unknown",
)
PASSAGE_TYPES = (
    "abstract", "introduction", "method", "result", "discussion",
    "limitation", "appendix", "body",
)
CARD_TYPES = (
    "Problem", "Claim", "Evidence", "Method", "Object", "Variable", "Metric",
    "Result", "Failure Mode", "Interpretation", "Limitation", "Practical Tip",
)
RELATION_VALUES = (
    "supports", "refutes", "inspires", "baseline", "method_source",
    "background", "result_comparison", "unclassified",
)
CORE_METADATA_FIELDS = (
    "title", "authors", "year", "doi", "arxiv_id", "venue", "abstract",
)
SECTION_PRIORITY = {
    "abstract": 0, "introduction": 1, "method": 2, "result": 3,
    "discussion": 4, "limitation": 5, "body": 6, "appendix": 7, "reference": 8,
}

# Budgets and limits.
MAX_TOKENS = 900
SOFT_TOKENS = 700
OVERLAP_TOKENS = 100
ANALYSIS_BATCH_TOKENS = 8000
UNDERSTANDING_TOKENS = 12000
UNDERSTANDING_PASSAGES = 24
METADATA_PASSAGES = 10
FINAL_CARDS = 20
MAX_FILE_BYTES = 200 * 1024 * 1024
MAX_BATCH_FILES = 20
RRF_K = 60
CANDIDATE_POOL = 200
EMBED_BATCH = 16

_S, _I, _D, _TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampType()
_LIST, _BBOX = T.ArrayType(_S), T.ArrayType(_D)


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols.items()])


SPACES = _struct(id=_S, name=_S, description=_S, status=_S, created_at=_TS, updated_at=_TS)
PAPERS = _struct(
    id=_S, space_id=_S, title=_S, authors=_S, year=_I, doi=_S, arxiv_id=_S, pubmed_id=_S,
    venue=_S, abstract=_S, citation=_S, user_tags=_S, relation_to_idea=_S, file_path=_S,
    file_hash=_S, imported_at=_TS, parse_status=_S, metadata_status=_S, embedding_status=_S,
    metadata_sources=T.MapType(_S, _S), metadata_confidence=T.MapType(_S, _D),
    user_edited_fields=_LIST,
)
PASSAGES = _struct(
    id=_S, paper_id=_S, space_id=_S, section=_S, page_number=_I, paragraph_index=_I,
    original_text=_S, parse_confidence=_D, passage_type=_S, parse_run_id=_S, element_ids=_LIST,
    heading_path=_LIST, bbox=_BBOX, token_count=_I, char_count=_I, content_hash=_S,
    parser_backend=_S, extraction_method=_S, quality_flags=_LIST,
)
ELEMENTS = _struct(
    id=_S, parse_run_id=_S, paper_id=_S, space_id=_S, element_index=_I, element_type=_S,
    text=_S, page_number=_I, bbox=_BBOX, heading_path=_LIST, metadata=T.MapType(_S, _S),
)
TABLES = _struct(
    id=_S, parse_run_id=_S, paper_id=_S, space_id=_S, element_id=_S, table_index=_I,
    page_number=_I, caption=_S, cells=T.ArrayType(_LIST), bbox=_BBOX, header_rows=_I,
)
ASSETS = _struct(
    id=_S, parse_run_id=_S, paper_id=_S, space_id=_S, element_id=_S, asset_type=_S,
    page_number=_I, uri=_S, bbox=_BBOX,
)
EVIDENCE = _struct(
    source_passage_ids=_LIST, evidence_quote=_S, reasoning_summary=_S,
    metadata=T.MapType(_S, _S),
)
CARDS = _struct(
    id=_S, space_id=_S, paper_id=_S, source_passage_id=_S, card_type=_S, summary=_S,
    confidence=_D, user_edited=T.BooleanType(), created_by=_S, extractor_version=_S,
    analysis_run_id=_S, evidence=EVIDENCE, quality_flags=_LIST, created_at=_TS, updated_at=_TS,
)
CARD_SOURCES = _struct(
    id=_S, card_id=_S, passage_id=_S, paper_id=_S, space_id=_S, analysis_run_id=_S,
    evidence_quote=_S, confidence=_D, created_at=_TS,
)
_RUN = dict(
    id=_S, paper_id=_S, space_id=_S, status=_S, started_at=_TS, completed_at=_TS,
    claimed_at=_TS, heartbeat_at=_TS, worker_id=_S, attempt_count=_I, last_error=_S,
    warnings=_LIST, metadata_json=_S,
)
PARSE_RUNS = _struct(**_RUN, backend=_S, extraction_method=_S, quality_score=_D)
EMBEDDING_RUNS = _struct(
    **_RUN, parse_run_id=_S, provider=_S, model=_S, passage_count=_I, embedded_count=_I,
    reused_count=_I, skipped_count=_I, batch_count=_I,
)
ANALYSIS_RUNS = _struct(
    **_RUN, parse_run_id=_S, provider=_S, model=_S, extractor_version=_S,
    accepted_card_count=_I, rejected_card_count=_I, diagnostics_json=_S,
)
EMBEDDINGS = _struct(
    passage_id=_S, provider=_S, model=_S, dimension=_I, embedding=T.ArrayType(T.FloatType()),
    content_hash=_S, created_at=_TS,
)
NOTES = _struct(id=_S, space_id=_S, paper_id=_S, content=_S, created_at=_TS, updated_at=_TS)
APP_STATE = _struct(key=_S, value=_S)

TABLE_SCHEMAS: dict[str, T.StructType] = {
    "spaces": SPACES,
    "papers": PAPERS,
    "passages": PASSAGES,
    "document_elements": ELEMENTS,
    "document_tables": TABLES,
    "document_assets": ASSETS,
    "knowledge_cards": CARDS,
    "knowledge_card_sources": CARD_SOURCES,
    "parse_runs": PARSE_RUNS,
    "embedding_runs": EMBEDDING_RUNS,
    "analysis_runs": ANALYSIS_RUNS,
    "passage_embeddings": EMBEDDINGS,
    "notes": NOTES,
    "app_state": APP_STATE,
}
