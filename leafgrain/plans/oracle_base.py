"""SQL twins of ``corpus`` and of the scalar functions, for the value checks."""

from __future__ import annotations

from leafgrain.functions.meta import REFERENCE_LABELS, SECTION_HEADERS, TYPE_TERMS
from leafgrain.functions.text import ACCENTS, DASHES, STOPWORDS
from leafgrain.plans.corpus import CARD_KINDS, SECTION_NAMES
from leafgrain.schemas import SECTION_PRIORITY

ACCENTED = "".join(ACCENTS.values())
UNACCENTED = "".join(base * len(marks) for base, marks in ACCENTS.items())
SPACE = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
WORD = r"[\p{L}\p{N}_]"


def lit(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(n: str) -> str:
    return f"(CASE WHEN {n} = '' THEN 0 ELSE length({n}) - length(replace({n}, ' ', '')) + 1 END)"


def tokens_n(n: str) -> str:
    """Token estimate of an already normalized SQL expression."""
    return f"greatest({words(n)}, CAST(ceil(length({n}) / 4.0) AS BIGINT))"


def tokens(x: str) -> str:
    return tokens_n(ws(x))


def word_list(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}+')"


def fold(x: str) -> str:
    return f"translate(lower({x}), '{ACCENTED}', '{UNACCENTED}')"


def dehyphen(x: str) -> str:
    return (
        f"array_to_string(list_filter(list_transform(string_split(regexp_replace({x}, "
        rf"'({WORD})-\s*\n({WORD})', '\1\2', 'g'), chr(10)), lambda l: {strip('l')}), "
        "lambda l: l <> ''), ' ')"
    )


def snippet(x: str) -> str:
    n = ws(x)
    return f"CASE WHEN length({n}) <= 240 THEN {n} ELSE rtrim(substr({n}, 1, 237)) || '...' END"


def best_window(source: str, keys: str, size: int = 32) -> dict[str, str]:
    """CTEs up to ``shown`` (keys, snippet) for the best windows of ``source`` (keys, body, terms)."""
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    word = f"len(list_intersect({word_list(fold('word'))}, terms)) > 0"
    return dict(
        sn_rows=f"SELECT {keys}, terms, {ws('body')} AS compact FROM {source}",
        sn_words=f"SELECT {keys}, terms, unnest(string_split(compact, ' ')) AS word,"
        " generate_subscripts(string_split(compact, ' '), 1) AS pos FROM sn_rows",
        sn_found=f"SELECT DISTINCT {keys}, pos, term FROM (SELECT {keys}, pos, terms, unnest({word_list(fold('word'))})"
        " AS term FROM sn_words) WHERE list_contains(terms, term)",
        sn_first=f"SELECT {keys}, pos AS first FROM (SELECT a.*, (SELECT count(DISTINCT term) FROM sn_found b WHERE {same}"
        f" AND b.pos BETWEEN a.pos AND a.pos + {size - 1}) AS n FROM (SELECT DISTINCT {keys}, pos FROM sn_found) a)"
        f" QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, pos) = 1",
        sn_start=f"SELECT {keys}, total, greatest(least(coalesce(first, 1), total - {size} + 1), 1) AS start FROM (SELECT *,"
        f" CASE WHEN compact = '' THEN 0 ELSE len(string_split(compact, ' ')) END AS total FROM sn_rows) LEFT JOIN sn_first"
        f" USING ({keys})",
        shown=f"SELECT {keys}, CASE WHEN any_value(start) > 1 THEN '...' ELSE '' END || string_agg(CASE WHEN {word} THEN"
        " '<mark>' || word || '</mark>' ELSE word END, ' ' ORDER BY pos) || CASE WHEN any_value(start) + "
        f"{size - 1} < any_value(total) THEN '...' ELSE '' END AS snippet FROM sn_words JOIN sn_start USING ({keys})"
        f" WHERE pos BETWEEN start AND start + {size - 1} GROUP BY {keys}",
    )


def truncated(x: str) -> str:
    n = ws(x)
    return (
        f"CASE WHEN length({n}) <= 3000 THEN {n} "
        f"ELSE rtrim(substr({n}, 1, 3000)) || '... [truncated]' END"
    )


def label(x: str) -> str:
    sub = (
        f"regexp_replace(lower({ws(x)}), "
        r"'^\s*(?:(?:[0-9]+(?:\.[0-9]+)*)|(?:[ivxlcdm]+))(?:[\).:\-]\s*|\s+)', '')"
    )
    return rf"regexp_replace({sub}, '^[ .:\-)\t]+|[ .:\-)\t]+$', '', 'g')"


def label_is_reference(x: str) -> str:
    return f"list_contains({lit(REFERENCE_LABELS)}, {label(x)})"


def contains_any(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


def type_case(x: str, default: str = "'body'", extra_result: tuple = ()) -> str:
    out = "CASE"
    for name, terms in TYPE_TERMS:
        more = extra_result if name == "result" else ()
        out += f" WHEN {contains_any(x, terms + more)} THEN '{name}'"
    return out + f" ELSE {default} END"


def heading_type(path: str) -> str:
    return type_case(f"lower(array_to_string({path}, ' '))")


def analysis_path(path: str, section: str) -> str:
    kept = f"list_filter(list_transform({path}, lambda h: {strip('h')}), lambda h: h <> '')"
    return (
        f"CASE WHEN len({kept}) > 0 THEN {kept} "
        f"WHEN {strip(section)} <> '' THEN [{strip(section)}] ELSE CAST([] AS VARCHAR[]) END"
    )


def analysis_type(raw: str, section: str, path: str) -> str:
    labels = f"list_concat([{section}], {path})"
    joined = f"array_to_string(list_transform({labels}, lambda q: {label('q')}), ' ')"
    refs = (
        f"len(list_filter({labels}, lambda r: {label_is_reference('r')})) > 0"
    )
    trusted = [k for k in SECTION_PRIORITY if k != "body"]
    inferred = type_case(
        joined, f"CASE WHEN {refs} THEN 'reference' ELSE 'body' END", ("finding",)
    )
    return (
        f"CASE WHEN list_contains({lit(trusted)}, {label(raw)}) THEN {label(raw)} "
        f"ELSE {inferred} END"
    )


def is_reference(raw: str, section: str, path: str) -> str:
    return (
        f"(len(list_filter(list_concat([{raw}, {section}], {path}), "
        f"lambda z: {label_is_reference('z')})) > 0)"
    )


def priority(kind: str) -> str:
    body = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SECTION_PRIORITY.items())
    return f"CAST((CASE {kind} {body} ELSE 6 END) AS BIGINT)"


def section_score(kind: str) -> str:
    return (
        f"(CASE WHEN {kind} IN ('method','result','limitation') THEN 3 "
        f"WHEN {kind} = 'discussion' THEN 2 WHEN {kind} IN ('abstract','introduction') THEN 1 "
        "ELSE 0 END)"
    )


def source_priority(s: str) -> str:
    return (
        f"(CASE WHEN {s} = 'user.edit' THEN 1000 WHEN starts_with({s}, 'regex.') THEN 900 "
        f"WHEN starts_with({s}, 'document.') THEN 700 WHEN starts_with({s}, 'llm.') THEN 600 "
        f"WHEN {s} = 'filename.fallback' THEN 100 WHEN coalesce({s}, '') <> '' THEN 50 ELSE 0 END)"
    )


def header(x: str) -> str:
    up = f"upper({strip(x)})"
    body = " ".join(
        f"WHEN regexp_matches({up}, '{p}') THEN '{s}'" for s, p in SECTION_HEADERS
    )
    return f"CASE {body} END"


DOI = r"(?i)10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+"
ARXIV = (
    r"(?i)(?:arxiv\s*:?\s*|arxiv\.org/(?:abs|pdf)/)"
    r"([a-z-]+(?:\.[a-z]{2})?/[0-9]{7}(?:v[0-9]+)?|[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)"
)


def clean_title(x: str) -> str:
    return rf"regexp_replace({ws(x)}, '(?i)^title\s*[:.\-]?\s*', '')"


def clean_abstract(x: str) -> str:
    return rf"regexp_replace({ws(x)}, '(?i)^abstract\s*[:.\-]\s*', '')"


def doi(x: str) -> str:
    t = (
        rf"regexp_replace(regexp_replace({ws(x)}, '(?i)^doi\s*:\s*', ''), "
        r"'(?i)^https?://(?:dx\.)?doi\.org/', '')"
    )
    return (
        f"regexp_replace(CASE WHEN regexp_extract({t}, '{DOI}') <> '' "
        f"THEN regexp_extract({t}, '{DOI}') ELSE {t} END, '[.,;]+$', '')"
    )


def arxiv(x: str) -> str:
    t = (
        rf"regexp_replace(regexp_replace({ws(x)}, '(?i)^arxiv\s*:?\s*', ''), "
        r"'(?i)^https?://arxiv\.org/(?:abs|pdf)/', '')"
    )
    return f"regexp_replace({t}, '[.,;]+$', '')"


def file_title(x: str) -> str:
    base = f"regexp_extract({x}, '([^/]*)/*$', 1)"
    stem = rf"regexp_extract({base}, '^(.+)\.[^.]+$', 1)"
    return clean_title(f"translate(CASE WHEN {stem} <> '' THEN {stem} ELSE {base} END, '_-', '  ')")


def summary_norm(x: str) -> str:
    return rf"trim(regexp_replace(lower({ws(x)}), '[^a-z0-9''\x{{4e00}}-\x{{9fff}}]+', ' ', 'g'))"


def summary_tokens(x: str) -> str:
    """Latin and CJK content tokens of a summary."""
    n = summary_norm(x)
    latin = (
        f"list_filter(regexp_extract_all({n}, '[a-z0-9]+(?:''[a-z0-9]+)?'), "
        f"lambda w: NOT list_contains({lit(STOPWORDS)}, w))"
    )
    cjk = rf"regexp_extract_all({n}, '[\x{{4e00}}-\x{{9fff}}]')"
    pairs = (
        f"CASE WHEN len({cjk}) > 1 THEN list_transform(range(1, len({cjk})), "
        f"lambda i: {cjk}[i] || {cjk}[i + 1]) ELSE {cjk} END"
    )
    return f"list_concat({latin}, {pairs})"


def jaccard(a: str, b: str) -> str:
    inter = f"len(list_distinct(list_intersect({a}, {b})))"
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 "
        f"ELSE CAST({inter} AS DOUBLE) / {union} END"
    )


def evidence(x: str) -> str:
    """Quote comparison form for texts whose compatibility form is themselves."""
    return ws(f"translate(replace(replace(lower({x}), 'ß', 'ss'), chr(173), ''), '{DASHES}', '------')")


def evidence_tokens(n: str) -> str:
    return (
        f"list_filter(regexp_extract_all({n}, '[a-z0-9]+(?:''[a-z0-9]+)?'), "
        f"lambda w: NOT list_contains({lit(STOPWORDS)}, w))"
    )


def ordered_distinct(x: str) -> str:
    t = f"list_filter(list_transform({x}, lambda v: {strip('v')}), lambda v: v <> '')"
    return f"list_filter({t}, lambda v, i: list_position({t}, v) = i)"


def when(seconds: str) -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST({seconds} AS BIGINT)))"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": (
        (),
        "SELECT doc_id, lang, source, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT)"
        " AS pos, unnest(string_split(text, chr(10))) AS line FROM documents",
    ),
    "spaces": (
        (),
        "SELECT source AS id, 'Space ' || source AS name, CASE CAST(substr(source, 4) AS INT) % 7"
        " WHEN 5 THEN 'archived' WHEN 6 THEN 'deleted' ELSE 'active' END AS status, "
        + when("CAST(substr(source, 4) AS INT) * 60")
        + " AS updated_at FROM (SELECT DISTINCT source FROM documents)",
    ),
    "papers": (
        (),
        "SELECT doc_id, 'doc-' || doc_id AS id, source AS space_id, CASE WHEN doc_id % 4 = 0 THEN ''"
        f" ELSE substr({ws('split_part(text, chr(10), 1)')}, 1, 80) END AS title,"
        " lang || ' Author; Second ' || source AS authors,"
        " CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(1990 + doc_id % 35 AS INT) END AS year,"
        " CASE WHEN doc_id % 3 = 0 THEN '10.1234/d' || doc_id ELSE '' END AS doi,"
        " '' AS arxiv_id, '' AS pubmed_id, 'Venue ' || lang AS venue, '' AS abstract,"
        " '' AS citation, 'unclassified' AS relation_to_idea,"
        " lang || '/' || doc_id || '_' || source || '.pdf' AS file_path,"
        " sha256(text) AS file_hash, CASE WHEN doc_id % 6 = 0 THEN 'error'"
        " WHEN doc_id % 11 = 0 THEN 'pending' ELSE 'parsed' END AS parse_status, "
        + when("doc_id") + " AS imported_at FROM documents",
    ),
    "passages": (
        ("lines",),
        "SELECT * REPLACE (CASE WHEN section = '' THEN CAST([] AS VARCHAR[]) ELSE ['Paper', section]"
        " END AS heading_path) FROM (SELECT 'doc-' || doc_id || '-p' || pos AS id,"
        " 'doc-' || doc_id AS paper_id, source AS space_id,"
        f" list_extract({lit(SECTION_NAMES)}, CAST((doc_id + pos) % 10 + 1 AS BIGINT)) AS section,"
        f" pos // 10 AS page_number, pos AS paragraph_index, {ws('line')} AS original_text,"
        " CASE WHEN pos % 7 = 6 THEN 'method' ELSE 'body' END AS passage_type,"
        " CAST([] AS VARCHAR[]) AS heading_path,"
        f" sha256({ws('line')}) AS content_hash,"
        " CASE WHEN pos % 9 = 8 THEN NULL ELSE 'run-' || doc_id END AS parse_run_id,"
        " 'backend' || (doc_id % 2) AS parser_backend,"
        " CASE WHEN pos % 5 = 4 THEN ['short', 'ocr'] ELSE CAST([] AS VARCHAR[]) END AS quality_flags,"
        f" doc_id FROM lines WHERE {ws('line')} <> '')",
    ),
    "elements": (
        ("lines",),
        "SELECT 'doc-' || doc_id || '-e' || pos AS id, 'doc-' || doc_id AS paper_id,"
        f" source AS space_id, pos AS element_index, CASE WHEN length({ws('line')}) <= 40 THEN"
        " 'heading' WHEN pos % 13 = 12 THEN 'table' WHEN pos % 10 = 9 THEN 'page_footer'"
        f" WHEN pos % 17 = 16 THEN 'reference' ELSE 'paragraph' END AS element_type,"
        f" {ws('line')} AS text, pos // 10 + 1 AS page_number,"
        " [CAST(pos % 2 * 260 + 40 AS DOUBLE), pos % 10 * 70 + 30, pos % 2 * 260 + 240,"
        " pos % 10 * 70 + 80] AS bbox FROM lines",
    ),
    "emb": (
        (),
        "SELECT 'doc-' || vec_id || '-p0' AS passage_id, 'local' AS provider, 'e5-small' AS model,"
        " len(embedding) AS dimension, CAST(embedding AS DOUBLE[]) AS embedding, "
        + when("vec_id") + " AS created_at FROM embeddings",
    ),
    "q": (
        (),
        f"SELECT item_id AS query_id, array_to_string({word_list('text')}, ' ')"
        " AS query, 'src' || (item_id % 20) AS space_id, CASE item_id % 3 WHEN 0 THEN 'auto'"
        " WHEN 1 THEN 'fts' ELSE 'hybrid' END AS mode, text FROM benchmark",
    ),
    "qv": (
        ("q",),
        "SELECT query_id, space_id, CAST(embedding AS DOUBLE[]) AS vector FROM q"
        " JOIN embeddings ON vec_id = query_id",
    ),
    "cards": (
        ("lines",),
        "SELECT 'card-' || conv_id || '-' || turn AS id, space_id, 'doc-' || paper_no AS paper_id,"
        " CASE WHEN turn % 3 <> 2 THEN 'doc-' || paper_no || '-p0' END AS source_passage_id,"
        f" list_extract({lit(CARD_KINDS)}, CAST((conv_id + turn) % 4 + 1 AS BIGINT)) AS card_type,"
        f" CASE WHEN turn % 5 >= 2 THEN {ws('text')} ELSE lead || ' note ' || turn END"
        " AS summary, CASE WHEN turn % 4 = 0 THEN ['doc-' || paper_no || '-p0'] ELSE"
        " ['doc-' || paper_no || '-p0', 'doc-' || paper_no || '-p' || (turn % 4)] END"
        " AS source_passage_ids, CASE turn % 3 WHEN 0 THEN lead WHEN 1 THEN"
        " array_to_string(list_reverse(string_split(lead, ' ')), ' ')"
        f" ELSE {ws('text')} END AS evidence_quote,"
        " CASE WHEN turn % 7 = 6 THEN '' ELSE 'because' END AS reasoning_summary,"
        " round(((conv_id * 7 + turn * 3) % 100) / 100.0, 2) AS confidence,"
        " turn % 4 = 3 AS user_edited, CASE turn % 4 WHEN 3 THEN 'user' WHEN 2 THEN 'heuristic'"
        " ELSE 'ai' END AS created_by, conv_id * 100 + turn AS card_index, "
        + when("conv_id * 100 + turn")
        + " AS created_at FROM (SELECT *, conv_id // 5 AS paper_no FROM conversations) JOIN"
        f" (SELECT doc_id AS paper_no, source AS space_id, {ws('line')} AS lead FROM lines"
        " WHERE pos = 0) USING (paper_no)",
    ),
    "card_sources": (
        ("cards",),
        "SELECT id || '-s' || pos AS id, id AS card_id, passage_id, paper_id, space_id,"
        " evidence_quote, confidence, created_at FROM (SELECT *, unnest(source_passage_ids) AS"
        " passage_id, unnest(range(len(source_passage_ids))) AS pos FROM cards)",
    ),
    "run_events": (
        (),
        "SELECT event_id, ts, 'run-' || user_id || '-' || strftime(ts, '%Y%m%d') AS run_id,"
        " 'doc-' || user_id AS paper_id, 'src' || (user_id % 20) AS space_id,"
        " CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'claimed' WHEN 'click'"
        " THEN 'heartbeat' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS kind,"
        " CAST(json_extract_string(props, '$.k') AS INT) AS worker, value FROM events",
    ),
    "runs": (
        ("run_events",),
        "SELECT run_id AS id, paper_id, space_id, CASE WHEN last IN ('claimed','heartbeat') THEN"
        " 'running' ELSE last END AS status, started_at, heartbeat_at, seen_at, attempt_count,"
        " worker, messages, seconds FROM (SELECT run_id, paper_id, space_id,"
        " arg_max(kind, row(ts, event_id)) AS last, min(ts) AS started_at,"
        " max(CASE WHEN kind = 'heartbeat' THEN ts END) AS heartbeat_at, max(ts) AS seen_at,"
        " count(*) FILTER (kind = 'claimed') AS attempt_count,"
        " arg_max(worker, row(ts, event_id)) AS worker, count(*) AS messages,"
        " round(sum(value), 4) AS seconds FROM run_events GROUP BY ALL)",
    ),
}


def sql(body: str, /, *needs: str, recursive: bool = False, **extra: str) -> str:
    """Prepend the named base tables (and their own needs) to a query."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered]
    parts += [f"{name} AS ({text})" for name, text in extra.items()]
    if not parts:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body
