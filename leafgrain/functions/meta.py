"""Column -> Column functions for bibliographic fields, labels and provenance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafgrain.functions.text import normalize_ws, ordered_distinct, strip
from leafgrain.schemas import SECTION_PRIORITY

# Identifier patterns.
DOI_PATTERN = r"(?i)10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+"
ARXIV_PATTERN = (
    r"(?i)(?:arxiv\s*:?\s*|arxiv\.org/(?:abs|pdf)/)"
    r"([a-z-]+(?:\.[a-z]{2})?/[0-9]{7}(?:v[0-9]+)?|[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)"
)
YEAR_PATTERN = r"\b((?:18|19|20)[0-9]{2})\b"
SECTION_NUMBER_PATTERN = (
    r"(?i)^\s*(?:(?:[0-9]+(?:\.[0-9]+)*)|(?:[ivxlcdm]+))(?:[\).:\-]\s*|\s+)"
)
# Labels of bibliography sections.
REFERENCE_LABELS = (
    "reference", "references", "bibliography", "works cited", "literature cited",
)
# Anchored section headers, tested in this order on upper-cased text.
SECTION_HEADERS = (
    ("abstract", r"^(ABSTRACT)$"),
    ("introduction", r"^([0-9]+\.?\s*)?(INTRODUCTION|BACKGROUND|MOTIVATION)$"),
    (
        "method",
        r"^([0-9]+\.?\s*)?(METHODS|METHODOLOGY|APPROACH|THE\s+MODEL|ARCHITECTURE|PROPOSED)$",
    ),
    ("result", r"^([0-9]+\.?\s*)?(RESULTS|EVALUATION|EXPERIMENTS|PERFORMANCE)$"),
    ("discussion", r"^([0-9]+\.?\s*)?(DISCUSSION|ANALYSIS|FINDINGS)$"),
    ("limitation", r"^([0-9]+\.?\s*)?(LIMITATIONS|FUTURE\s+WORK)$"),
    ("appendix", r"^(APPENDIX|SUPPLEMENTARY)$"),
    ("conclusion", r"^([0-9]+\.?\s*)?(CONCLUSION|CONCLUDING)$"),
    ("reference", r"^(REFERENCES|BIBLIOGRAPHY)$"),
)
# Words that decide a passage type, first matching row wins.
TYPE_TERMS = (
    ("abstract", ("abstract",)),
    ("introduction", ("introduction",)),
    ("method", ("method", "approach", "experiment")),
    ("result", ("result", "evaluation")),
    ("discussion", ("discussion",)),
    ("limitation", ("limitation", "future work")),
    ("appendix", ("appendix",)),
)


def contains_any(text: Column, terms: tuple[str, ...]) -> Column:
    found = text.contains(terms[0])
    for term in terms[1:]:
        found = found | text.contains(term)
    return found


def normalize_doi(value: Column) -> Column:
    text = normalize_ws(value)
    text = F.regexp_replace(text, r"(?i)^doi\s*:\s*", "")
    text = F.regexp_replace(text, r"(?i)^https?://(?:dx\.)?doi\.org/", "")
    found = F.regexp_extract(text, DOI_PATTERN, 0)
    text = F.when(found != "", found).otherwise(text)
    return F.regexp_replace(text, r"[.,;]+$", "")


def normalize_arxiv(value: Column) -> Column:
    text = normalize_ws(value)
    text = F.regexp_replace(text, r"(?i)^arxiv\s*:?\s*", "")
    text = F.regexp_replace(text, r"(?i)^https?://arxiv\.org/(?:abs|pdf)/", "")
    return F.regexp_replace(text, r"[.,;]+$", "")


def doi_match(text: Column) -> Column:
    """First DOI in a text as written, '' when there is none. Texts without a DOI's first letters are not searched."""
    found = F.when(text.contains("10."), F.regexp_extract(text, DOI_PATTERN, 0))
    return F.when(text.isNotNull(), F.coalesce(found, F.lit("")))


def arxiv_match(text: Column) -> Column:
    """First arXiv id in a text as written, '' when there is none. Texts without a part of the name are not searched."""
    found = F.when(text.rlike("[xX][iI][vV]"), F.regexp_extract(text, ARXIV_PATTERN, 1))
    return F.when(text.isNotNull(), F.coalesce(found, F.lit("")))


def first_doi(text: Column) -> Column:
    return normalize_doi(doi_match(text))


def first_arxiv(text: Column) -> Column:
    return normalize_arxiv(arxiv_match(text))


def extract_year(value: Column) -> Column:
    return F.regexp_extract(value, YEAR_PATTERN, 1).try_cast("int")


def clean_title(value: Column) -> Column:
    return F.regexp_replace(normalize_ws(value), r"(?i)^title\s*[:.\-]?\s*", "")


def clean_abstract(value: Column) -> Column:
    return F.regexp_replace(normalize_ws(value), r"(?i)^abstract\s*[:.\-]\s*", "")


def author_list(value: Column) -> Column:
    return ordered_distinct(F.split(value, r"\s*(?:;|\band\b)\s*"))


def author_names(people: Column) -> Column:
    """Author structs (full_name, first, last) to names."""
    return ordered_distinct(
        F.transform(
            people,
            lambda p: F.coalesce(
                F.nullif(normalize_ws(p["full_name"]), F.lit("")),
                normalize_ws(F.concat_ws(" ", p["first"], p["last"])),
            ),
        )
    )


def filename_title(path: Column) -> Column:
    """Title from a file name: the stem with separators as spaces."""
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    stem = F.regexp_extract(base, r"^(.+)\.[^.]+$", 1)
    return clean_title(F.translate(F.when(stem != "", stem).otherwise(base), "_-", "  "))


def section_label(value: Column) -> Column:
    """Lower-case label without numbering and edge punctuation."""
    text = F.regexp_replace(F.lower(normalize_ws(value)), SECTION_NUMBER_PATTERN, "")
    return F.regexp_replace(text, r"^[ .:\-)\t]+|[ .:\-)\t]+$", "")


def detect_section_header(text: Column) -> Column:
    """Section named by an anchored header line, null when it is not a header."""
    upper = F.upper(strip(text))
    found = F.lit(None).cast("string")
    for section, pattern in reversed(SECTION_HEADERS):
        found = F.when(upper.rlike(pattern), F.lit(section)).otherwise(found)
    return found


def table_cell_text(cell: Column) -> Column:
    text = normalize_ws(cell)
    text = F.regexp_replace(text, r"^([0-9]{2,})([0-9])\s+\.$", "$1.$2")
    return F.regexp_replace(text, r"^([0-9]+(?:\.[0-9]+)?)([A-Za-z]+)$", "$1 $2")


def label_in(value: Column, labels: tuple[str, ...] = REFERENCE_LABELS) -> Column:
    return section_label(value).isin(*labels)


def type_from_labels(text: Column, rows=TYPE_TERMS, default: str = "body") -> Column:
    kind = F.lit(default)
    for name, terms in reversed(rows):
        kind = F.when(contains_any(text, terms), F.lit(name)).otherwise(kind)
    return kind


def heading_passage_type(heading_path: Column) -> Column:
    """Passage type used by the chunker."""
    return type_from_labels(F.lower(F.array_join(heading_path, " ")))


def analysis_heading_path(heading_path: Column, section: Column) -> Column:
    """Stripped non-blank headings, else the section alone."""
    kept = F.filter(F.transform(heading_path, strip), lambda h: h != "")
    fallback = F.when(strip(section) != "", F.array(strip(section))).otherwise(
        F.array().cast("array<string>")
    )
    return F.when(F.size(F.coalesce(kept, F.array().cast("array<string>"))) > 0, kept).otherwise(
        fallback
    )


def evidence_labels(section: Column, headings: Column) -> Column:
    """Normalized labels of a section and its headings."""
    return F.transform(F.concat(F.array(section), headings), lambda x: section_label(x))


def type_of_labels(raw_label: Column, labels: Column, joined: Column) -> Column:
    """Passage type for evidence selection; trusts an informative input type.

    ``labels`` and their ``joined`` text should be stored columns: they are read many
    times here.
    """
    rows = tuple(
        (name, terms + ("finding",)) if name == "result" else (name, terms)
        for name, terms in TYPE_TERMS
    )
    typed = type_from_labels(joined, rows, default="?")
    reference = F.when(F.exists(labels, lambda x: x.isin(*REFERENCE_LABELS)), "reference").otherwise("body")
    trusted = [name for name in SECTION_PRIORITY if name != "body"]
    return (
        F.when(raw_label.isin(*trusted), raw_label).when(typed != "?", typed).otherwise(reference)
    )


def guess_section(text: Column) -> Column:
    """Broad section of a free paragraph: header line, opening word, then keywords."""
    low = F.lower(strip(text))
    keyword = (
        F.when(low.startswith("abstract"), "abstract")
        .when(contains_any(low, ("introduction", "related work")), "introduction")
        .when(contains_any(low, ("method", "algorithm", "architecture")), "method")
        .when(contains_any(low, ("result", "evaluation", "experiment")), "result")
        .when(contains_any(low, ("limitation", "future work")), "limitation")
        .when(low.startswith("appendix") | low.startswith("supplementary"), "appendix")
        .otherwise("body")
    )
    return F.coalesce(detect_section_header(text), keyword)


def section_passage_type(section: Column) -> Column:
    """Storage type of a detected section."""
    same = ("abstract", "introduction", "method", "result", "discussion", "limitation", "appendix")
    return (
        F.when(section.isin(*same), section)
        .when(section == "conclusion", "discussion")
        .when(section == "reference", "appendix")
        .otherwise("body")
    )


def is_reference(raw_type: Column, section: Column, headings: Column) -> Column:
    return F.exists(F.concat(F.array(raw_type, section), headings), lambda x: label_in(x))


def priority_of(passage_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SECTION_PRIORITY.items() for x in kv])
    return F.coalesce(F.element_at(table, passage_type), F.lit(SECTION_PRIORITY["body"]))


def section_score(passage_type: Column) -> Column:
    """Ranking weight of a cited section."""
    return (
        F.when(passage_type.isin("method", "result", "limitation"), 3)
        .when(passage_type == "discussion", 2)
        .when(passage_type.isin("abstract", "introduction"), 1)
        .otherwise(0)
    )


def group_key(passage_type: Column, headings: Column) -> Column:
    heading = F.array_join(headings, " > ")
    return F.when(heading != "", F.concat_ws(":", passage_type, heading)).otherwise(passage_type)


def source_priority(source: Column) -> Column:
    return (
        F.when(source == "user.edit", 1000)
        .when(source.startswith("regex."), 900)
        .when(source.startswith("document."), 700)
        .when(source.startswith("llm."), 600)
        .when(source == "filename.fallback", 100)
        .when(F.coalesce(source, F.lit("")) != "", 50)
        .otherwise(0)
    )


def put_many(values: Column, entries: Column) -> Column:
    """Set several keys of a map from an array of (key, value) structs; null entries are skipped."""
    kept = F.filter(entries, lambda e: e.isNotNull())
    keys = F.transform(kept, lambda e: e["key"])
    rest = F.map_filter(values, lambda k, _: ~F.array_contains(keys, k))
    return F.map_concat(rest, F.map_from_entries(kept))


def put_provenance(values: Column, field: Column, value: Column) -> Column:
    """Set one key of a map, replacing an earlier entry."""
    rest = F.map_filter(values, lambda k, _: k != field)
    return F.map_concat(rest, F.create_map(field, value))


def merge_metadata(old: Column, new: Column, keep: str = "progress") -> Column:
    """Merge two maps: new entries win except the kept key of the old one."""
    frozen = F.map_filter(old, lambda k, _: k == keep)
    incoming = F.map_filter(
        new, lambda k, _: ~((k == keep) & F.map_contains_key(old, keep))
    )
    others = F.map_filter(
        old, lambda k, _: (k != keep) & ~F.map_contains_key(new, k)
    )
    return F.map_concat(others, incoming, frozen)


def parse_dimension(value: Column) -> Column:
    number = F.trim(value).try_cast("int")
    return F.when(number > 0, number)


def infer_metadata_status(sources: Column, user_fields: Column) -> Column:
    values = F.map_values(sources)
    return (
        F.when(F.size(user_fields) > 0, "user_edited")
        .when(F.exists(values, lambda s: s.startswith("llm.")), "enriched")
        .when(F.exists(values, lambda s: (s != "") & (s != "filename.fallback")), "extracted")
        .otherwise("empty")
    )
